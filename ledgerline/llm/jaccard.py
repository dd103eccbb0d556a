"""Set similarity join on word shingles, size-aware: subsets for light sets, inverted lists for heavy ones.

Two sets that link differ in a small part of their elements. A light set (few
shingles) enumerates its subsets of the sizes that an overlap can have; linked
light sets share one of them. A heavy set is cut by hash into more parts than
linked sets of its size can differ in, so linked heavy sets agree on a whole
part; the parts are the keys of inverted lists. Where light ends and heavy
begins is chosen by the cost of both over the sizes there are.

Lists are scanned with parity bitmaps of the sets: their Hamming distance never
exceeds the real one, so what they rule out is ruled out. Of what is left a
list gives a spanning forest, not all pairs; its edges are verified on the real
sets. Lists that still hold members of different components are scanned again
with the real sets of the members that could link across.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from . import _shingles as S
from ._graph import components
from ._shared import Scratch, cut, keyed, release

WORDS = 3
PERCENT = 90         # of the union that the intersection holds at least
BITMAP = 8192        # bits of a set's parity bitmap
BLOCK = 512          # a longer list is scanned block by block, each pair of blocks on its own
GROUP_ROWS = 2048    # rows of lists scanned together
SMALL = 32           # lists of up to so many members are scanned at once, with all others of their length
PAIRS = 4096         # pairs of bitmaps compared at a time
LIST_COST = 4.0      # cost of a key in an inverted list, which is scanned, next to that of a subset
LIGHT_MOST = 60      # sizes for which the cost of subsets is worked out at all
SENT_IDS = 1_000_000 # up to so many ids are sent to every task


def differs(total: int, percent: int) -> int:
    """The most elements two linked sets differ in, when their sizes add up to ``total``."""
    return total * (100 - percent) // (100 + percent)


def dropped(size: int, percent: int) -> int:
    """The most elements a set of ``size`` has outside its overlap with a linked set."""
    return size * (100 - percent) // 100


def classes_of(percent: int, most: int) -> list[int]:
    """Starts of size classes: linked sets lie in one class or in neighbouring ones."""
    least = -(-percent // (100 - percent))  # the least n with n of n + 1 enough: smaller sets link only if they are equal
    starts = [least]
    while starts[-1] <= most:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


@functools.cache
def parts_of(top: int, percent: int) -> int:
    """Into how many parts sets of up to ``top`` elements are cut: one more than linked sets differ in, and some that may be empty."""
    p = differs(2 * top, percent) + 1
    for spare in range(p // 8 + 2):
        bare = (p + spare) * math.exp(-top / (p + spare))   # parts without an element, as expected
        if math.ceil(bare + 2 * math.sqrt(bare) - 0.5) <= spare:
            return p + spare
    return p


def light_end(counts: dict[int, int], percent: int) -> int:
    """The first heavy size: where subsets below and lists from there on cost least. ``counts``: sets by size."""
    starts = classes_of(percent, LIGHT_MOST * 2)

    def subsets(s):
        return sum(math.comb(s, r) for r in range(dropped(s, percent) + 1))

    def lists(s):
        k = sum(1 for x in starts if x <= s) - 1
        return LIST_COST * sum(parts_of(starts[c + 1] - 1, percent) for c in (k, k + 1))

    sizes = [s for s in counts if starts[0] <= s <= LIGHT_MOST]
    total = lambda x: sum(counts[s] * (subsets(s) if s < x else lists(s)) for s in sizes)
    return min(range(starts[0], LIGHT_MOST + 1), key=lambda x: (total(x), x))


def keys(x, light: int, percent: int):
    """The keys of a set of shingle hashes: subset keys if light, part keys if heavy or nearly so.

    Each element in which linked sets differ spoils one part, and all other
    parts agree. If a set has more parts with elements than it can differ in
    from any linked set, one of these agrees, so its empty parts, which it would
    share with all sets of its class, need no key. Of two linked sets one such
    set is enough, as parts with elements always have their key.
    """
    import numpy as np
    n = len(x)
    starts = classes_of(percent, max(n, 1))
    out = []
    if n < starts[0]:
        return np.zeros(0, dtype=np.uint64)
    if n < light:
        m = S.mixed(x)
        whole = m.sum(dtype=np.uint64)
        for r in range(dropped(n, percent) + 1):
            less = np.array([sum(int(m[i]) for i in c) & (2**64 - 1) for c in itertools.combinations(range(n), r)], dtype=np.uint64)
            out.append(S.mixed((whole - less) ^ S.mixed(np.full(1, n - r, dtype=np.uint64))))
    if 100 * n >= percent * light:
        k = sum(1 for s in starts if s <= n) - 1
        starts = classes_of(percent, starts[k] * 10_000 // percent**2 + 2)   # two more at least
        for c in (k, k + 1):
            top = starts[c + 1] - 1
            p = parts_of(top, percent)
            m = S.mixed(x + np.uint64(c + 1))
            order = np.argsort(part := (m >> np.uint64(32)) % np.uint64(p), kind="stable")
            sums = np.concatenate([[np.uint64(0)], np.cumsum(m[order], dtype=np.uint64)])
            at = np.searchsorted(part[order], np.arange(p + 1))
            tag = S.mixed(np.arange(p, dtype=np.uint64) + np.uint64(c + 1) * np.uint64(1 << 32))
            held = at[1:] > at[:-1]
            spoilt = differs(n + min(top, n * 100 // percent), percent)
            told = held if np.count_nonzero(held) > spoilt else np.ones(p, dtype=bool)
            out.append(S.mixed((sums[at[1:]] - sums[at[:-1]]) ^ tag)[told])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def bitmap(x) -> bytes:
    import numpy as np
    bits = np.bincount((S.mixed(x + np.uint64(0x5851F42D4C957F2D)) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def fingerprint(x) -> int | None:
    """64 bits that name a set, None for the empty one."""
    import numpy as np
    return int(S.mixed(S.mixed(x).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x))).view(np.int64)[0]) if len(x) else None


def described(docs: DataFrame, words: int, percent: int, light: int | None) -> DataFrame:
    """doc_id, n (set size), cls (fingerprint), and unless ``light`` is None bits (bitmap) and keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, cls, bits, ks = [], [], [], []
                for text in part.column(1):
                    x = S.shingles(text.as_py(), words)
                    n.append(len(x))
                    cls.append(fingerprint(x))
                    if light is not None:
                        bits.append(bitmap(x))
                        ks.append(np.unique(keys(x, light, percent)).view(np.int64))
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64())]
                if light is not None:
                    out += [pa.array(bits, pa.binary()), pa.array(ks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n", "cls", "bits", "keys"][:len(out)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, cls bigint" + (", bits binary, keys array<bigint>" if light is not None else ""))


def sizes_of(docs: DataFrame, words: int) -> DataFrame:
    """About the set sizes, at six bytes a word: good enough to weigh costs with."""
    return docs.select(F.greatest(F.ceil(F.octet_length("text") / 6) + 1 - words, F.lit(1)).alias("n"))


KEY_SHARD = 1 << 20  # keys that meet in one shard, about
OPEN, KNOWN, WITNESS = 0, 1, 2


def shared_keys(facts: DataFrame, total: int) -> DataFrame:
    """(key, cls) of the keys that two classes or more have; ``facts``: cls, keys; ``total``: number of keys.

    Keys meet in shards, many as one row of bytes. A key that a batch of rows
    already shows in two classes is known to be shared: its members skip the
    meeting, spread evenly, and only a witness goes there for other batches.
    """
    shards = max(1, math.ceil(total / KEY_SHARD))

    def spread(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                lists = part.column(1)
                key = lists.flatten().to_numpy(zero_copy_only=False)
                cls = np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
                order = np.lexsort((cls, key))
                key, cls = key[order], cls[order]
                once = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]) if len(key) else np.zeros(0, dtype=bool)
                key, cls = key[once], cls[once]
                if not len(key):
                    continue
                new = np.concatenate([[True], key[1:] != key[:-1]])
                starts = np.flatnonzero(new)
                known = np.repeat(np.diff(np.append(starts, len(key))) > 1, np.diff(np.append(starts, len(key))))
                home = (S.mixed(key.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                away = (S.mixed(key.view(np.uint64) ^ S.mixed(cls.view(np.uint64))) % np.uint64(shards)).astype(np.int64)
                for kind, rows, to in ((OPEN, ~known, home), (KNOWN, known, away), (WITNESS, known & new, home)):
                    k, c, to = key[rows], cls[rows], to[rows]
                    order = np.argsort(to, kind="stable")
                    k, c, to = k[order], c[order], to[order]
                    ends = np.searchsorted(to, np.arange(shards + 1))
                    at = np.unique(to).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([kind] * len(at), pa.int32())] + [
                        pa.array([x[ends[t]:ends[t + 1]].tobytes() for t in at], pa.binary()) for x in (k, c)], names=["shard", "kind", "key", "cls"])

    def meet(table):
        import numpy as np
        import pyarrow as pa
        sizes = [len(x) // 8 for x in table.column("key").to_pylist()]
        key, cls = (np.frombuffer(b"".join(table.column(f).to_pylist()), dtype=np.int64) for f in ("key", "cls"))
        kind = np.repeat(np.array(table.column("kind").to_pylist(), dtype=np.int8), sizes)
        keep = kind == KNOWN
        at = np.flatnonzero(~keep)
        order = at[np.argsort(key[at], kind="stable")]
        if len(order):
            starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            least, most = np.minimum.reduceat(cls[order], starts), np.maximum.reduceat(cls[order], starts)
            shared = (least < most) | (np.maximum.reduceat(kind[order], starts) == WITNESS)
            keep[order[np.repeat(shared, np.diff(np.append(starts, len(order))))]] = True
        keep &= kind != WITNESS
        return pa.table({"key": key[keep], "cls": cls[keep]})

    packed = facts.select("cls", "keys").mapInArrow(spread, "shard bigint, kind int, key binary, cls binary")
    return packed.groupBy("shard").applyInArrow(meet, "key bigint, cls bigint").distinct()


def distinct_lists(lists: DataFrame) -> DataFrame:
    """One of each group of lists with the same members: near copies agree on many parts, and need one scan.

    Members are compared by their number, ends and two 64-bit sums without carry.
    """
    told = lists.groupBy("key").agg(F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"),
                                    F.count(F.lit(1)).alias("size"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    keys = cut(told.groupBy("x", "y", "size", "lo", "hi").agg(F.min("key").alias("key")).select("key"))
    return lists.join(keys, "key", "left_semi")


def _forest(d, label):
    """Boruvka on a matrix of distances (inf: no edge): pairs of a spanning forest, nearest first."""
    import numpy as np
    label, found = label.copy(), []
    d = d.copy()
    while True:
        d[label[:, None] == label[None, :]] = np.inf
        to = d.argmin(1)
        best = d[np.arange(len(d)), to]
        rows = np.flatnonzero(np.isfinite(best))
        if not len(rows):
            return found
        rows = rows[np.lexsort((best[rows], label[rows]))]
        rows = rows[np.concatenate([[True], label[rows][1:] != label[rows][:-1]])]
        for i in rows.tolist():
            a, b = label[i], label[to[i]]
            if a != b:
                found.append((i, int(to[i])))
                label[label == max(a, b)] = min(a, b)


def _distances(flat, a, b, most):
    """Hamming distances of the bitmaps ``a`` and ``b``, inf where more than ``most``; a quarter of the words rules most pairs out."""
    import numpy as np
    out = np.full(len(a), np.inf, dtype=np.float32)
    cut_at = flat.shape[1] // 4
    head, rest = np.ascontiguousarray(flat[:, :cut_at]), flat[:, cut_at:]
    for lo in range(0, len(a), PAIRS):
        at = lo + np.flatnonzero(most[lo:lo + PAIRS] >= 0)
        far = np.bitwise_count(head[a[at]] ^ head[b[at]]).sum(1, dtype=np.int64)
        at, far = at[far <= most[at]], far[far <= most[at]]
        far += np.bitwise_count(rest[a[at]] ^ rest[b[at]]).sum(1, dtype=np.int64)
        out[at[far <= most[at]]] = far[far <= most[at]]
    return out


def _nearest(a, b, d, nodes):
    """Kruskal on the edges (a, b) of many lists: the pairs of a spanning forest, nearest first. ``nodes``: by row, its node."""
    import numpy as np
    up, found = {}, []

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    order = np.argsort(d, kind="stable")
    for p, q, x, y in zip(a[order].tolist(), b[order].tolist(), nodes[a[order]].tolist(), nodes[b[order]].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            found.append((p, q))
    return found


def _scan(group, percent: int, mode: str):
    """Scan the lists of one group of rows; see ``_lists`` for the modes."""
    import numpy as np
    import pyarrow as pa
    get = lambda c: group.column(c).to_numpy(zero_copy_only=False) if not hasattr(group.column(c), "combine_chunks") else group.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    key, i, j = get("key"), get("i"), get("j")
    order = np.lexsort((j, i, key))
    key, i, j, side, cls, n, comp = (get(c)[order] for c in ("key", "i", "j", "side", "cls", "n", "comp"))
    data = group.column("data").to_pylist()
    new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.flatnonzero(np.concatenate([[True], new, [True]]))
    long = np.diff(starts)
    out = []

    def pairs_of(first, m):
        """All pairs (a, b) of the lists of length ``m`` that start at ``first``, across components and blocks."""
        p, q = np.triu_indices(m, 1)
        a, b = (first[:, None] + p).ravel(), (first[:, None] + q).ravel()
        ok = (comp[a] != comp[b]) & ((i[a] == j[a]) | (side[a] != side[b]))
        return a[ok], b[ok]

    if mode == "exact":
        sets = [np.frombuffer(data[o], dtype=np.uint64) for o in order]
        for s, m in zip(starts[:-1], long):
            label = dict(zip(range(s, s + m), comp[s:s + m].tolist()))
            for a, b in zip(*(x.tolist() for x in pairs_of(np.array([s]), m))):
                if label[a] == label[b]:  # already connected here
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                    old = label[b]
                    out.append((a, b))
                    label = {x: label[a] if y == old else y for x, y in label.items()}
    else:
        flat = np.frombuffer(b"".join(data[o] for o in order), dtype=np.uint64).reshape(len(order), BITMAP // 64)
        nodes = np.unique(np.stack([np.repeat(starts[:-1], long), comp], 1), axis=0, return_inverse=True)[1].ravel()
        for m in np.unique(long[long > 1]).tolist():
            first = starts[:-1][long == m]
            for part in [first] if m <= SMALL else first[:, None]:
                a, b = pairs_of(part, m)
                near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
                d = _distances(flat, a, b, np.where(near, (n[a] + n[b]) * (100 - percent) // (100 + percent), -1))
                hit = np.isfinite(d)
                a, b, d = a[hit], b[hit], d[hit]
                if mode == "members":
                    out += [(x, x) for x in np.union1d(a, b).tolist()]
                elif m <= SMALL:
                    out += _nearest(a, b, d, nodes)
                else:
                    away = np.full((m, m), np.inf, dtype=np.float32)
                    away[a - part[0], b - part[0]] = away[b - part[0], a - part[0]] = d
                    out += [(part[0] + p, part[0] + q) for p, q in _forest(away, nodes[part[0]:part[0] + m])]
    if mode == "members":
        rows = sorted({x for x, _ in out})
        return pa.table({"key": pa.array(key[rows], pa.int64()), "a": pa.array(cls[rows], pa.int64()), "b": pa.array(cls[rows], pa.int64())})
    pairs = sorted({(min(int(cls[p]), int(cls[q])), max(int(cls[p]), int(cls[q]))) for p, q in out})
    return pa.table({"key": pa.array([0] * len(pairs), pa.int64()), "a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})


def _lists(lists: DataFrame, members: DataFrame, percent: int, mode: str) -> DataFrame:
    """Scan ``lists`` (key, cls): (key, a, b). ``members``: cls, n, comp, data.

    mode ``forest``: edges of a spanning forest of what bitmaps leave open;
    ``members``: the members (a = b) that bitmaps let link across components;
    ``exact``: edges of a spanning forest of real links between components.
    """
    hot = cut(lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > BLOCK)
              .select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    groups = max(1, math.ceil(lists.count() / GROUP_ROWS))
    met = lists.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"), F.when(x < F.col("own"), 1).otherwise(0).alias("side")))
    met = met.select("key", "cls", F.explode(pairs).alias("p")).select("key", "cls", "p.*")
    met = met.withColumn("grp", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))).join(members, "cls")
    return met.groupBy("grp").applyInArrow(lambda group: _scan(group, percent, mode), "key bigint, a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, data = the set's hashes as bytes) of the ``wanted`` classes (cls, rep); texts of other documents stay put."""
    wanted = wanted.select("cls", "rep")
    few = wanted.count() <= SENT_IDS
    ids = wanted.select("rep").distinct()
    found = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for text in batch.column(1):
                x = S.shingles(text.as_py(), words)
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["cls", "data"])

    sets = found.mapInArrow(run, "cls bigint, data binary").join(wanted.select("cls"), "cls", "left_semi")
    return sets.groupBy("cls").agg(F.max("data").alias("data"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose real sets link."""
    left = sets.select(F.col("cls").alias("a"), F.col("data").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("data").alias("y"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * 100 >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Words are split at spaces and the characters 09 to 0D, with A-Z lowered; a
    document's set is its distinct ``words``-word shingles, or its whole
    sequence if it has fewer words. Two documents link when 100 x intersection
    >= ``percent`` x union. Equal sets are one class, named by 64 bits, before
    anything else, so a group of copies costs as much as one document. Every
    list is scanned in full, long ones in pairs of blocks; nothing is capped.

    Null and empty texts, and texts without words, have 0 shingles and link
    with nothing. Repeated rows give a row each, in one component; a null id is
    named by the smallest other id of its component, if there is one. An empty
    table gives no rows; other columns are not read.
    """
    out = _placed(docs, id_col, text_col, words, percent)
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _placed(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, cls and first: the component's smallest class, the same for all its rows."""
    rows = keyed(docs, id_col, text_col)
    by_size = sizes_of(rows, words).filter(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("docs"))
    light = light_end({r["n"]: r["docs"] for r in by_size.collect()}, percent)  # LIGHT_MOST rows at most
    scratch = Scratch(docs.sparkSession)
    facts = scratch.table(described(rows, words, percent, light))
    classes = scratch.table(facts.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("data")))
    total = facts.agg(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    lists = scratch.table(distinct_lists(scratch.table(shared_keys(facts.filter("cls IS NOT NULL"), total))))
    facts = scratch.table(facts.select("doc_id", "n", "cls"))
    scratch.drop(1)  # the keys have met

    alone = classes.select("cls", "n", "data", F.col("cls").alias("comp"))
    open_pairs = scratch.table(_lists(lists, alone, percent, "forest").select("a", "b").distinct())
    ends = open_pairs.select(F.col("a").alias("cls")).unionByName(open_pairs.select(F.col("b").alias("cls"))).distinct()
    sets = scratch.table(_sets(rows, cut(classes.select("cls", "rep").join(ends, "cls", "left_semi")), words))
    links = scratch.table(_verified(open_pairs, sets, percent))
    first = cut(components(links).select(F.col("node").alias("cls"), F.col("component").alias("comp")))

    placed = lists.join(first, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = cut(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi and size > 2").select("key"))
    linked = classes.join(first, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).select("cls", "n", "comp", "data")
    across = scratch.table(_lists(cut(lists.join(mixed, "key", "left_semi")), linked, percent, "members").select("key", F.col("a").alias("cls")).distinct())
    across = scratch.table(distinct_lists(across))
    sets = scratch.table(_sets(rows, cut(classes.select("cls", "rep").join(across.select("cls").distinct(), "cls", "left_semi")), words))
    more = scratch.table(_lists(across, linked.drop("data").join(sets, "cls"), percent, "exact").select("a", "b"))

    comp = components(links.unionByName(more)).select(F.col("node").alias("cls"), "component")
    named = cut(classes.select("cls", "rep").join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    names = cut(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("cls").alias("first")))
    named = cut(named.join(names, "component").select("cls", "component_id", "first"))
    facts = cut(facts.select("doc_id", "n", "cls"))
    scratch.drop()
    release(docs.sparkSession)
    out = facts.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cls", "first")


def _classed(texts: DataFrame, words: int) -> DataFrame:
    """(cls, hash): the fingerprint of each text and its SHA-256; a text without words has no fingerprint."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            cls = [fingerprint(S.shingles(text.as_py(), words)) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), batch.column(1)], names=["cls", "hash"])

    return texts.select("text", F.sha2(F.col("text").cast("binary"), 256).alias("hash")).mapInArrow(run, "cls bigint, hash string")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns, the document with the smallest id of each component.

    Of a component without ids one document stays, of its smallest class the one
    whose text has the smallest SHA-256. Texts without words are linked with
    nothing: those with a null id stay, one of each text.
    """
    placed = _placed(docs, id_col, text_col, words, percent)
    stay = placed.filter("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(stay, docs[id_col] == stay["__id"], "left_semi")
    nameless = cut(placed.filter("doc_id IS NULL AND component_id IS NULL AND (cls IS NULL OR cls = first)").select("cls").distinct())
    if nameless.isEmpty():
        return named.dropDuplicates([id_col, text_col])
    without = docs.filter(docs[id_col].isNull())
    found = _classed(keyed(without, id_col, text_col), words).join(nameless.withColumnRenamed("cls", "__cls"), F.col("cls").eqNullSafe(F.col("__cls")), "left_semi").distinct()
    ones = found.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("hash").alias("__hash")).select("__hash")
    ones = cut(ones.unionByName(found.filter("cls IS NULL").select(F.col("hash").alias("__hash"))))
    own = F.sha2(F.coalesce(without[text_col].cast("string"), F.lit("")).cast("binary"), 256)
    return named.unionByName(without.join(ones, own == ones["__hash"], "left_semi")).dropDuplicates([id_col, text_col])
