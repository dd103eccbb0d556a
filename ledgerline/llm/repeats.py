"""Repeated substrings across documents, by a Burrows-Wheeler transform over what could repeat.

A string of ``LENGTH`` bytes is named by its minimizer, the least hash of its
``GRAM``-byte substrings. Equal strings have equal minimizers at the same place,
so equal strings meet under the same anchor. The context of an anchor's place is
the text of all strings the place names. Equal contexts are one, and all but
those of their first document are repeats as a whole. Only where contexts of one
anchor differ and have half of what surrounds the anchor in common, as equal
strings have, their texts go to a shard: there, interval expansion on the
transform finds the equal strings, stopping at the minimum length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..operators._order import ranked
from . import _shingles as S
from ._bwt import equal_prefixes
from ._shared import Scratch, cut, release

LENGTH = 50
GRAM = 16
SHARD_BYTES = 1 << 20        # context bytes of a shard
ANCHOR_SHARD_BYTES = 8 << 20  # text whose anchors meet in one shard
RUN_BYTES = 8 << 20          # text whose anchors a batch settles by itself
PIECE_BYTES = 1 << 18        # text whose anchors are found at once
HOT_CONTEXTS = 20_000        # an anchor with more contexts is split up by the strings themselves
ROUND_BYTES = 64 << 20       # contexts, and strings of hot anchors, move in rounds of so many bytes at least
STRING_BYTES = 90            # that a hot anchor's string takes with its place
LAST = 2**63 - 1             # rank of a null id
PLACE_BITS = 20              # of a minimizer's hash, for its place
UNSURE = 255                 # place of a minimizer that isn't the same in all its strings


def anchors(data, ends, length: int, gram: int):
    """(hash, first, count, place) of the anchors of texts that lie one after the other and end at ``ends``.

    The strings starting at first .. first + count - 1 have the hash as
    minimizer. It is ``place`` bytes behind first, or the leftmost one isn't at
    one place in all these strings: UNSURE.
    """
    import numpy as np
    none = np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3
    if len(data) < length:
        return none
    h, done = data.astype(np.uint64), 1
    for bit in bin(gram)[3:]:  # the hash of gram bytes by doubling and adding one
        h = h[:len(h) - done] * np.uint64(pow(S._BASE, done, 1 << 64)) + h[done:]
        done *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(S._BASE) + data[done:done + len(h) - 1]
            done += 1
    bits, mask = np.uint64(PLACE_BITS), np.uint64((1 << PLACE_BITS) - 1)
    low, span, window = S.mixed(h) & ~mask | np.arange(len(h), dtype=np.uint64) & mask, 1, length - gram + 1
    while span * 2 <= window:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if rest := window - span:
        low = np.minimum(low[:len(low) - rest], low[rest:])
    value = low >> bits
    sizes = np.diff(ends, prepend=0)
    room = np.repeat(ends, sizes)[:len(low)] - np.arange(len(low)) >= length
    value[~room] = ~np.uint64(0)  # these strings reach into the next text
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(first, len(low)))
    inside = room[first]
    first, count = first[inside], count[inside]
    last = first + count - 1
    place = ((low[first] - first.astype(np.uint64)) & mask).astype(np.int64)
    place[(low[first] != low[last]) | (first >> PLACE_BITS != (last + window - 1) >> PLACE_BITS)] = UNSURE
    # A minimizer's strings span at most ``window`` starts; longer runs (equal grams in a row) are cut to that.
    if len(count) and count.max() > window:
        parts = -(-count // window)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count, place = np.repeat(first, parts) + step * window, np.minimum(np.repeat(count, parts) - step * window, window), np.repeat(place, parts)
    return value[first], first, count, place


def _halves(length: int, gram: int) -> tuple[int, int]:
    """Bytes before and behind the minimizer: each string has so many before it or so many behind it."""
    before = (length - gram + 1) // 2
    return before, length - gram - before + 1


def _sides(count, place, length: int, gram: int):
    """(left, right): contexts with strings that have half of what surrounds their minimizer before it, and behind it."""
    before, behind = _halves(length, gram)
    sure = place != UNSURE
    return sure & (place >= before), sure & (count - 1 + length - place - gram >= behind)


def _named(data):
    """A function of places a, z: 64-bit hashes of the bytes [a, z)."""
    import numpy as np
    up, down = S._powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)])
    return lambda a, z: S.mixed((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))


#: Bytes of each field of a packed row; ``doc`` as steps.
_ENTRY = {"hash": 4, "name": 8, "doc": 8, "at": 4, "n": 1, "place": 1}
_SPAN = {"doc": 8, "a": 4, "size": 4}
_PLACE = {"a": 4, "size": 4, "hash": 8, "name": 8}
_PLACE_OF = {"doc": 8} | _PLACE


def _planes(values, width: int) -> bytes:
    """The first bytes of all values, then the second ones and so on: zeros then lie together and take no room when compressed."""
    import numpy as np
    return np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(data: bytes, at: int, n: int, width: int):
    import numpy as np
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _packed(columns: dict, layout: dict) -> bytes:
    import numpy as np
    n = len(next(iter(columns.values())))
    out = [n.to_bytes(8, "little")]
    for f, width in layout.items():
        values = columns[f].astype(np.int64) if f == "doc" else columns[f]
        out.append(_planes(np.diff(values, prepend=0) if f == "doc" else values, width))
    return b"".join(out)


def _unpacked(rows: list[bytes], layout: dict) -> dict:
    """All rows' entries; hashes and names as unsigned numbers, the rest as signed ones."""
    import numpy as np
    found = {f: [np.zeros(0, dtype=np.uint64)] for f in layout}
    for data in rows:
        n, at = int.from_bytes(data[:8], "little"), 8
        for f, width in layout.items():
            values = _values(data, at, n, width)
            found[f].append(np.cumsum(values, dtype=np.uint64) if f == "doc" else values)
            at += n * width
    found = {f: np.concatenate(x) for f, x in found.items()}
    return {f: x if f in ("hash", "name") else x.view(np.int64) for f, x in found.items()}


def _entries(columns: dict, length: int, gram: int) -> bytes:
    """Entries as bytes; keys only of the sides that there are."""
    left, right = _sides(columns["n"], columns["place"], length, gram)
    return _packed(columns, _ENTRY) + _planes(columns["left"][left], 3) + _planes(columns["right"][right], 3)


def _read_entries(rows: list[bytes], length: int, gram: int) -> dict:
    import numpy as np
    e = _unpacked(rows, _ENTRY)
    left, right = _sides(e["n"], e["place"], length, gram)
    e["left"], e["right"] = np.zeros((2, len(left)), dtype=np.uint64)
    done = 0
    for data in rows:
        n = int.from_bytes(data[:8], "little")
        at = 8 + n * sum(_ENTRY.values())
        for side, there in (("left", left), ("right", right)):
            of = done + np.flatnonzero(there[done:done + n])
            e[side][of] = _values(data, at, len(of), 3)
            at += 3 * len(of)
        done += n
    return e


def _dealt(where, columns: dict, pack):
    """(where, bytes): a packed row for each value of ``where``, in the order of the documents."""
    import numpy as np
    order = np.lexsort((columns["doc"], where))
    where, columns = where[order], {f: x[order] for f, x in columns.items()}
    starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(where) else []
    for a, z in zip(starts, [*starts[1:], len(where)]):
        yield int(where[a]), pack({f: x[a:z] for f, x in columns.items()})


def _modulo(values, n: int):
    """Values dealt evenly over 0 .. n - 1."""
    import numpy as np
    return (S.mixed(values.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _firsts(e: dict):
    """(order, first): entries by anchor, context and document, and per entry the first document of its context."""
    import numpy as np
    order = np.lexsort((e["doc"], e["name"], e["hash"]))
    h, name, doc = e["hash"][order], e["name"][order], e["doc"][order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (name[1:] != name[:-1])]))
    return order, np.repeat(doc[starts], np.diff(np.append(starts, len(h))))


def _shared(doc, key):
    """Whether another document has the entry's key as well."""
    import numpy as np
    order = np.argsort(key, kind="stable")
    doc, key = doc[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(key), dtype=bool)
    if len(key):
        out[order] = np.repeat(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), np.diff(np.append(starts, len(key))))
    return out


def _open(e: dict, length: int, gram: int):
    """(left, right): entries that may have a string in common with another document's, one with the left half before the minimizer, or the right one behind it.

    Equal strings have their leftmost minimizer at the same place, so they have
    the same bytes before it and behind it; the keys are hashes of half of
    these. An anchor with an UNSURE place is open as a whole.
    """
    import numpy as np
    left, right = _sides(e["n"], e["place"], length, gram)
    h, out = e["hash"] << np.uint64(32), []
    unsure = np.isin(e["hash"], e["hash"][e["place"] == UNSURE])
    unsure[unsure] = _shared(e["doc"][unsure], e["hash"][unsure])
    for there, key in ((left, e["left"]), (right, e["right"])):
        found = there.copy()
        found[there] = _shared(e["doc"][there], (h | key)[there])
        out.append(found | unsure)
    return out


def _spans(doc, a, z):
    """Ranges [a, z) of documents, overlapping and touching ones as one."""
    import numpy as np
    order = np.lexsort((a, doc))
    doc, a, z = doc[order], a[order], z[order]
    if not len(doc):
        return doc, a, z
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    far = np.maximum.accumulate(z + np.cumsum(new) * (1 << 33)) - np.cumsum(new) * (1 << 33)
    new[1:] |= a[1:] > far[:-1]
    starts = np.flatnonzero(new)
    return doc[starts], a[starts], np.maximum.reduceat(z, starts)


def _runs(batches, most: int):
    """The batches, large ones in slices of about ``most`` bytes of text."""
    import numpy as np
    import pyarrow.compute as pc
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        part = sizes // most
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(int(a), int(b - a))


def _found(batch, length: int, gram: int) -> dict:
    """The entries of a batch of texts: each anchor's hash, its context's name, place and keys."""
    import numpy as np
    import pyarrow.compute as pc
    (before, behind), made = _halves(length, gram), []
    for piece in _runs([batch], PIECE_BYTES):
        texts = piece.column(1)
        doc, ends = piece.column(0).to_numpy(zero_copy_only=False), np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        data = np.frombuffer(b"".join(texts.to_pylist()), dtype=np.uint8)
        h, first, n, place = anchors(data, ends, length, gram)
        if not len(h):
            continue
        named, of = _named(data), np.searchsorted(ends, first, side="right")
        e = {"hash": h, "name": named(first, first + n - 1 + length), "doc": doc[of], "at": first - np.concatenate([[0], ends])[of], "n": n, "place": place}
        least = first + place
        for side, there, a, z in zip(("left", "right"), _sides(n, place, length, gram), (least - before, least), (least + gram, least + gram + behind)):
            e[side] = np.zeros(len(h), dtype=np.uint64)
            e[side][there] = named(a[there], z[there]) >> np.uint64(40)
        made.append(e)
    return {f: np.concatenate([e[f] for e in made]) for f in made[0]} if made else {}


REPEAT, OPEN, HOT = range(3)


def _places(docs: DataFrame, total: int, length: int, gram: int, hot_contexts: int) -> DataFrame:
    """What the anchors tell, packed by ``bucket`` of documents, as rows of three kinds.

    REPEAT: ranges [a, z) of documents that a smaller document has as well. OPEN:
    contexts of their first document, as far as they may hold a string of
    another one of their anchor. HOT: the same of an anchor with more than ``hot_contexts`` such places.

    A batch of rows settles what it can by itself: of equal contexts in it, only
    those of the first document go on to meet other batches. So a frequent
    passage costs its shard one entry for each batch, not for each document.
    """
    shards = max(1, math.ceil(total / ANCHOR_SHARD_BYTES))
    before = _halves(length, gram)[0]

    def rows(kind: int, dealt, key: str):
        import pyarrow as pa
        where, data = zip(*dealt) if dealt else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array([kind] * len(where), pa.int32()), pa.array(data, pa.binary())], names=[key, "kind", "data"])

    def spans(doc, a, z) -> dict:
        return {"doc": doc, "a": a, "size": z - a}

    def spread(batches: Iterator) -> Iterator:
        for batch in _runs(batches, RUN_BYTES):
            e = _found(batch, length, gram)
            if not e:
                continue
            order, first = _firsts(e)
            e = {f: x[order] for f, x in e.items()}
            again = e["doc"] > first
            found = spans(*_spans(e["doc"][again], e["at"][again], (e["at"] + e["n"] - 1 + length)[again]))
            yield rows(REPEAT, list(_dealt(_modulo(found["doc"], shards), found, lambda x: _packed(x, _SPAN))), "shard")  # settled: dealt anywhere
            e = {f: x[~again] for f, x in e.items()}
            yield rows(OPEN, list(_dealt(_modulo(e["hash"], shards), e, lambda x: _entries(x, length, gram))), "shard")

    def meet(table):
        import numpy as np
        import pyarrow as pa
        shard, kinds, data = table.column("shard")[0].as_py(), table.column("kind").to_pylist(), table.column("data").to_pylist()
        past = _unpacked([x for k, x in zip(kinds, data) if k == REPEAT], _SPAN)
        e = _read_entries([x for k, x in zip(kinds, data) if k == OPEN], length, gram)
        del table, data
        order, first = _firsts(e)
        e = {f: x[order] for f, x in e.items()}
        again = e["doc"] > first
        ends = e["at"] + e["n"] - 1 + length
        found = spans(*_spans(*[np.concatenate(x) for x in ((past["doc"], e["doc"][again]), (past["a"], e["at"][again]), (past["a"] + past["size"], ends[again]))]))
        e = {f: x[~again] for f, x in e.items()}
        left, right = _open(e, length, gram)
        ends, half = ends[~again], e["at"] + e["place"] - before  # the last string with the left half
        a = np.where(left, e["at"], np.maximum(e["at"], half + 1))
        z = np.where(right, ends, np.minimum(ends, half + length))
        some = left | right
        places = {"doc": e["doc"], "a": a, "size": z - a, "hash": e["hash"] | np.uint64(shard << 32), "name": e["name"]}
        places = {f: x[some] for f, x in places.items()}
        _, of, many = np.unique(places["hash"], return_inverse=True, return_counts=True)
        hot = many[of] > hot_contexts
        dealt = [(REPEAT, found, _SPAN), *[(k, {f: x[there] for f, x in places.items()}, _PLACE_OF) for k, there in ((OPEN, ~hot), (HOT, hot))]]
        return pa.Table.from_batches([rows(kind, list(_dealt(_modulo(x["doc"], shards), x, lambda y, layout=layout: _packed(y, layout))), "bucket") for kind, x, layout in dealt])

    packed = docs.select("doc", "text").mapInArrow(spread, "shard bigint, kind int, data binary")
    return packed.groupBy("shard").applyInArrow(meet, "bucket bigint, kind int, data binary")


_MARKS = "doc bigint, spans array<struct<a:int,z:int>>, open binary, open_bytes bigint, hot binary, hot_bytes bigint, hot_strings bigint"


def _marks(places: DataFrame, length: int) -> DataFrame:
    """A row for each document with any: its repeats, overlapping ones as one, and its open places."""

    def gather(table):
        import numpy as np
        import pyarrow as pa
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        past = _unpacked([x for k, x in zip(kinds, data) if k == REPEAT], _SPAN)
        doc, a, z = _spans(past["doc"], past["a"], past["a"] + past["size"])
        left = [_unpacked([x for k, x in zip(kinds, data) if k == kind], _PLACE_OF) for kind in (OPEN, HOT)]
        ids = np.unique(np.concatenate([doc, left[0]["doc"], left[1]["doc"]]))
        runs = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["a", "z"])
        columns = [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc, ids), len(doc)), pa.int32()), runs)]
        for x in left:
            order = np.argsort(x["doc"], kind="stable")
            x = {f: v[order] for f, v in x.items()}
            starts, ends = np.searchsorted(x["doc"], ids), np.searchsorted(x["doc"], ids, side="right")
            sizes = np.concatenate([[0], np.cumsum(x["size"])])
            some = ends > starts
            columns.append(pa.array([_packed({f: x[f][i:j] for f in _PLACE}, _PLACE) if i < j else None for i, j in zip(starts, ends)], pa.binary()))
            columns.append(pa.array(sizes[ends] - sizes[starts], pa.int64()))
        columns.append(pa.array((sizes[ends] - sizes[starts] - (ends - starts) * (length - 1)) * some, pa.int64()))
        return pa.table(columns, names=["doc", "spans", "open", "open_bytes", "hot", "hot_bytes", "hot_strings"])

    return places.groupBy("bucket").applyInArrow(gather, _MARKS)


def _contexts(docs: DataFrame, marks: DataFrame, kind: str, part: int = 0, parts: int = 1) -> DataFrame:
    """The open places' contexts, of a part of the anchors; only the texts that are asked for move."""
    places = marks.filter(F.col(kind).isNotNull()).select("doc", F.col(kind).alias("places"))
    joined = docs.select("doc", "text").join(places, "doc")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("doc", pa.int64()), ("a", pa.int64()), ("hash", pa.int64()), ("name", pa.int64()), ("context", pa.binary())])
        for batch in _runs(batches, RUN_BYTES // 2):
            made, context = {f: [] for f in ("doc", "a", "hash", "name")}, []
            for doc, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, x = text.as_py(), _unpacked([places.as_py()], _PLACE)
                if parts > 1:
                    here = _modulo(x["hash"], parts) == part
                    x = {f: v[here] for f, v in x.items()}
                context += [text[i:j] for i, j in zip(x["a"].tolist(), (x["a"] + x["size"]).tolist())]
                for f, v in ("doc", np.full(len(x["a"]), doc)), ("a", x["a"]), ("hash", x["hash"].view(np.int64)), ("name", x["name"].view(np.int64)):
                    made[f].append(v)
            if context:
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(made[f]), pa.int64()) for f in made], pa.array(context, pa.binary())], schema=schema)

    return joined.mapInArrow(run, "doc bigint, a bigint, hash bigint, name bigint, context binary")


def _shard(table, length: int):
    """(doc, a, z): ranges of strings that a context with a smaller document holds under the same anchor."""
    import numpy as np
    import pyarrow as pa
    h, name, doc, at = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) if hasattr(table.column(c), "combine_chunks")
                        else table.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "name", "doc", "a"))
    # Places of one context, in its one document, share a text.
    order = np.lexsort((name, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (name[order][1:] != name[order][:-1])])
    one = order[np.flatnonzero(new)]
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    contexts = table.column("context").take(pa.array(one)).to_pylist()
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    text = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(text)) - np.repeat(begin, sizes)
    whole = place + length <= sizes[owner]  # strings inside their context
    rows, starts = equal_prefixes(text, length)
    least = np.where(whole[rows], doc[one][owner[rows]], LAST)
    group = np.minimum.reduceat(least, starts)[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))]
    better = np.zeros(len(text), dtype=bool)
    better[rows] = group < least
    better &= whole
    a = np.flatnonzero(better & ~(np.concatenate([[False], better[:-1]]) & (place > 0)))
    z = np.flatnonzero(better & ~np.concatenate([better[1:] & (place[1:] > 0), [False]]))
    runs = np.bincount(owner[a], minlength=len(one))
    first = np.cumsum(runs) - runs
    many = runs[of]  # each place gets the runs of its context
    who = np.repeat(np.arange(len(of)), many)
    which = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + first[of[who]]
    return pa.table({"doc": pa.array(doc[who], pa.int64()), "a": pa.array(at[who] + place[a][which], pa.int64()), "z": pa.array(at[who] + place[z][which] + length, pa.int64())})


def _differing(docs: DataFrame, marks: DataFrame, total: int, length: int, scratch: Scratch) -> DataFrame:
    """(doc, a, z): the repeats inside open contexts.

    Contexts overlap, so all of them may be several times the text: what moves
    at once is at most half the text, and a quarter of it where hot anchors go
    by their strings, in as many rounds as that takes.
    """
    sums = marks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("open_bytes", "hot_bytes", "hot_strings")]).first()
    found = []
    parts = max(1, math.ceil(sums["open_bytes"] / max(total // 2, ROUND_BYTES)))
    shards = max(1, math.ceil(sums["open_bytes"] / parts / SHARD_BYTES))
    for part in range(parts):
        contexts = _contexts(docs, marks, "open", part, parts)
        found.append(scratch.table(contexts.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards))).groupBy("shard")
                                   .applyInArrow(lambda t: _shard(t, length), "doc bigint, a bigint, z bigint")))
        del contexts
    if sums["hot_strings"]:
        # The strings of a hot anchor, each on its own: no group but that of equal strings.
        contexts = scratch.table(_contexts(docs, marks, "hot"))
        kept = scratch.count
        parts = max(1, math.ceil(sums["hot_strings"] * STRING_BYTES / max(total // 4, ROUND_BYTES)))
        for part in range(parts):
            strings = contexts.select("doc", "a", "context", F.explode(F.sequence(F.lit(1), F.octet_length("context") - length + 1)).alias("i"))
            strings = strings.select("doc", (F.col("a") + F.col("i") - 1).alias("a"), F.substring("context", F.col("i"), F.lit(length)).alias("string"))
            if parts > 1:
                strings = strings.filter(F.pmod(F.xxhash64("string"), F.lit(parts)) == part)
            strings = scratch.table(strings)
            least = scratch.table(strings.groupBy("string").agg(F.min("doc").alias("least")))
            done = scratch.count
            found.append(scratch.table(strings.join(least, "string").filter("least < doc").select("doc", "a", (F.col("a") + length).alias("z"))))
            for number in (done - 1, done):
                scratch.drop(number)
        scratch.drop(kept)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(docs: DataFrame, length: int, gram: int, hot_contexts: int) -> DataFrame:
    """doc, spans (possibly overlapping byte ranges [a, z)) to remove; ``docs``: doc (rank), text (bytes)."""
    scratch = Scratch(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    places = scratch.table(_places(docs, total, length, gram, hot_contexts))
    marks = scratch.table(_marks(places, length))
    scratch.drop(1)
    inside = _differing(docs, marks, total, length, scratch)
    spans = marks.select("doc", F.explode("spans").alias("span")).select("doc", "span.a", "span.z").unionByName(inside)
    spans = cut(spans.groupBy("doc").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("z").cast("int").alias("z"))).alias("spans")))  # bounded by the text
    scratch.drop()
    release(docs.sparkSession)
    return spans


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``doc``: a number of its own for each row, in the order of the ids.

    The id itself, unless ids are null or repeated: then rows get their places
    by (id, row number), from a checkpoint so that they stay what they are.
    """
    shared = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    places = ranked(rows.select("doc_id", "row"), [F.asc_nulls_last("doc_id"), F.asc("row")], "doc").select("row", "doc")
    return rows.join(places, "row").drop("row")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                    hot_contexts: int = HOT_CONTEXTS, keep_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256 (and kept, the bytes left).

    Every byte covered by a ``length``-byte string that also starts in a
    document with a smaller id is removed; strings are judged on the input.
    ``spans`` are the maximal removed runs as [a, z). Ids are whole numbers.
    Anchors, open contexts and spans move, and the texts to join them; a
    frequent passage is reduced before each shuffle, and an anchor with very
    many contexts is split by its strings.

    A null text is empty. Rows without an id rank behind all others; of these,
    and of rows that repeat an id, the ones read first count as smaller. Each
    row has its own spans. An empty table gives no rows; other columns are not
    read. ``length`` is 254 more than ``gram`` at most. Contexts under one anchor
    are told apart by 64 bits: N different ones are mixed up with a chance of
    N * N / 2**65.
    """
    if length - gram + 1 > 255:
        raise ValueError(f"length is at most {254 + gram} with grams of {gram} bytes")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("binary"), F.lit("").cast("binary")).alias("text"))
    rows = _ordered(rows)
    spans = repeated_spans(rows, length, gram, hot_contexts)
    joined = rows.join(spans, "doc", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "spans", "kept_sha256", "kept")}
            for text, found in zip(batch.column(1), batch.column(2)):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                runs, gone, kept = [], 0, data.tobytes()
                if found.is_valid and len(found.values):
                    a, z = (np.minimum(found.values.field(f).to_numpy(), len(data)) for f in "az")
                    depth = np.cumsum(np.bincount(a, minlength=len(data) + 1) - np.bincount(z, minlength=len(data) + 1))[:len(data)]
                    out_of = depth > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], out_of, [False]]).astype(np.int8)))
                    runs, gone, kept = edges.reshape(-1, 2).tolist(), int(out_of.sum()), data[~out_of].tobytes()
                for k, x in zip(out, (len(data), gone, [{"a": a, "z": z} for a, z in runs], hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(x)
            arrays = [batch.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                      pa.array(out["spans"], pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))), pa.array(out["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]
            if keep_bytes:
                arrays, names = arrays + [pa.array(out["kept"], pa.binary())], names + ["kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    done = joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<a:int,z:int>>, kept_sha256 string" + ", kept binary" * keep_bytes)
    return done.withColumn("n_spans", F.size("spans").cast("bigint"))
