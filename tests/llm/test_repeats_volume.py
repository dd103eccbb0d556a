"""op4: what moves and lies on disk stays in proportion to the text."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import repeats


def texts(rng, n, shared, own):
    """Texts of random letters, each with pieces of one text of ``shared`` bytes' length that others have as well."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", dtype=np.uint8)
    pool = [bytes(rng.choice(letters, shared)).decode() for _ in range(5)]
    return ["".join(bytes(rng.choice(letters, own)).decode() + pool[rng.integers(5)] for _ in range(6)) for _ in range(n)]


def removed(rows, length):
    seen, out = {}, {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p:p + length], i) != i:
                gone[p:p + length] = True
        out[i] = int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
    return out


def marked(docs, hot=repeats.HOT_CONTEXTS):
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    return repeats._marks(repeats._places(docs, total, 50, 16, hot), 50)


def test_copies_are_one_span_each(spark, monkeypatch):
    """A copy's repeats are put together before they are kept: one span, not one for each of its anchors."""
    monkeypatch.setattr(repeats, "ANCHOR_SHARD_BYTES", 1 << 12)  # several shards
    text = texts(np.random.default_rng(1), 1, 40, 500)[0]
    docs = spark.createDataFrame([(i, bytearray(text.encode())) for i in range(6)], "doc long, text binary").repartition(6)
    got = {r["doc"]: [tuple(s) for s in r["spans"]] for r in repeats.repeated_spans(docs, 50, 16, repeats.HOT_CONTEXTS).collect()}
    assert got == {i: [(0, len(text))] for i in range(1, 6)}


@pytest.mark.parametrize("shared, some", [(25, False), (60, True)])
def test_contexts_move_only_where_half_of_what_surrounds_the_anchor_is_shared(spark, shared, some):
    rows = list(enumerate(texts(np.random.default_rng(2), 40, shared, 70)))
    docs = spark.createDataFrame(rows, "doc long, text string").withColumn("text", F.col("text").cast("binary"))
    sums = marked(docs).agg(F.sum("open_bytes"), F.sum("hot_bytes")).first()
    assert ((sums[0] or 0) + (sums[1] or 0) > 0) == some


@pytest.mark.parametrize("hot", [repeats.HOT_CONTEXTS, 1])
def test_rounds_give_what_one_round_gives(spark, monkeypatch, hot):
    rows = list(enumerate(texts(np.random.default_rng(3), 40, 55, 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    strings = marked(docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("text")), hot).agg(F.sum("hot_strings")).first()[0]
    rounds, contexts = [], repeats._contexts
    monkeypatch.setattr(repeats, "ROUND_BYTES", strings * repeats.STRING_BYTES // 2 + 1)  # two rounds of strings; contexts go by the text's half
    monkeypatch.setattr(repeats, "_contexts", lambda docs, marks, kind, part=0, parts=1: (rounds.append((kind, part, parts)), contexts(docs, marks, kind, part, parts))[1])
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in repeats.without_repeats(docs, hot_contexts=hot).collect()}
    assert got == removed(rows, 50) and sum(n for n, _ in got.values())
    assert ("hot", 0, 1) in rounds if hot == 1 else max(parts for _, _, parts in rounds) > 1


@pytest.mark.parametrize("bits", [20, 8])
@pytest.mark.parametrize("length, gram", [(50, 16), (9, 4), (16, 16)])
def test_equal_strings_have_their_minimizer_at_one_place(monkeypatch, length, gram, bits):
    """Or it is marked as unsure; with 8 bits, places begin anew every 256 bytes."""
    monkeypatch.setattr(repeats, "PLACE_BITS", bits)
    rng = np.random.default_rng(4)
    base = rng.choice(list(b"ab"), 300).astype(np.uint8)
    made = []
    for _ in range(30):
        a = int(rng.integers(200))
        made.append(np.concatenate([base[a:a + int(rng.integers(100))], np.frombuffer(b"a" * int(rng.integers(90)), dtype=np.uint8),
                                    rng.choice(list(b"abc"), int(rng.integers(60))).astype(np.uint8), np.frombuffer(b"abcabd" * int(rng.integers(15)), dtype=np.uint8)]))
    made.append(np.zeros(0, dtype=np.uint8))
    data, ends = np.concatenate(made), np.cumsum([len(x) for x in made])
    h, first, n, place = repeats.anchors(data, ends, length, gram)
    want = np.concatenate([np.arange(e - len(x), max(e - len(x), e - length + 1)) for e, x in zip(ends, made)])
    assert sorted(np.concatenate([np.arange(a, a + c) for a, c in zip(first, n)])) == want.tolist()
    found = {}
    for a, c, x, p in zip(first.tolist(), n.tolist(), h.tolist(), place.tolist()):
        for s in range(a, a + c):
            hashes, places = found.setdefault(bytes(data[s:s + length]), (set(), set()))
            hashes.add(x)
            places.update([] if p == repeats.UNSURE else [a + p - s])
    assert all(len(hashes) == 1 and len(places) <= 1 for hashes, places in found.values())
    left, right = repeats._sides(n, place, length, gram)
    assert (left | right | (place == repeats.UNSURE)).all()
