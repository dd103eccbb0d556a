"""Line rules, importance resampling and the prefix trie against brute force, on small awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import _joins, _shared, importance, lines, trie

from .test_operators import awkward, empty

BLANK = "[\x20\x09-\x0d]+"
CLASH = ["row", "copy", "host", "lines", "key", "words", "h", "n", "line", "at", "uses", "gain", "across", "tie", "rank", "_at", "own", "path", "shard", "x"]


@pytest.fixture(scope="module", autouse=True)
def _ready(spark):
    _shared.ready(spark)


def clash(df):
    return df.select("*", *[F.lit("z").alias(c) for c in CLASH if c not in df.columns])


def webby(spark):
    """Two hosts: one with a line that half its documents share, copies of one text, near-empty and repetitive texts."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows, i = [], 0
    for k in range(40):
        text = words(12) + "\n" + (" Subscribe   to\tour Letter \n" if k % 2 else "") + words(9)
        rows.append((i, text, "hot")); i += 1
    body = words(15) + "\n" + words(5)
    for _ in range(30):                                     # copies: their lines are one document's
        rows.append((i, body, "hot")); i += 1
    for k in range(8):
        rows.append((i, "subscribe to our letter\n" + "subscribe to our letter and more\n" * k + words(10), "cold")); i += 1
    rows += [(i, "SUBSCRIBE to our letter\nsubscribe to our letter \n" * 4 + "one two three", "hot"), (i + 1, words(6), None), (i + 2, "a b c d e " * 9, None),
             (i + 3, "a b c d e f a b c d e", "cold"), (i + 4, "#$ %& |<> *", "cold"), (i + 5, None, "cold"), (i + 6, "", None), (None, words(14), "hot"), (None, words(13), None),
             (i + 7, "\n\n \n", "hot"), (i + 8, "x " * 70_000, "hot"), (0, rows[0][1], "hot")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def plain_rules(rows, most_docs, most_percent):
    normal = lambda x: re.sub(BLANK, " ", x).strip(" ").lower()
    texts = defaultdict(set)
    docs = defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t or "")
        for x in {normal(x) for x in (t or "").split("\n")} - {""}:
            docs[s, x].add(t)
    often = {k for k, d in docs.items() if len(d) > most_docs and 100 * len(d) > most_percent * len(texts[k[0]])}
    out = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        windows = defaultdict(list)
        for k in range(len(w) - 4):
            windows[tuple(w[k:k + 5])].append(k)
        spots = {k + j for x in windows.values() if len(x) > 1 for k in x for j in range(5)}
        raw = [x for x in t.split("\n") if normal(x)]
        gone = sum(len(normal(x).split(" ")) for x in raw if (s, normal(x)) in often)
        failed = len(w) < 10 or 100 * len(spots) > 20 * len(w)
        kept = not failed and len(w) - gone >= 10 and 100 * gone <= lines.MOST_REMOVED * len(w)
        left = "\n".join(x for x in t.split("\n") if (s, normal(x)) not in often)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(raw) - len(set(raw)), len(spots), failed, gone, kept, left))
    return out


@pytest.mark.parametrize("most", [(5, 5), (2, 0), (0, 40)])
def test_line_rules(spark, most):
    docs = webby(spark)
    got = lines.line_rules(clash(docs), texts=True, most_docs=most[0], most_percent=most[1])
    assert Counter(map(tuple, got.collect())) == Counter(plain_rules([tuple(r) for r in docs.collect()], *most))


def test_line_rules_copies_are_one_document(spark):
    docs = webby(spark)
    got = {r["doc_id"]: r for r in lines.line_rules(docs).collect()}
    assert all(got[i]["kept"] for i in range(70))           # copies and documents with the letter line stay
    assert got[1]["n_removed"] == 4 and got[0]["n_removed"] == 0 and got[45]["n_removed"] == 0


def test_line_rules_awkward(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = Counter(tuple(r) for r in lines.line_rules(docs, texts=True).collect())
    assert got == Counter(plain_rules(rows, lines.MOST_DOCS, lines.MOST_PERCENT))
    assert lines.line_rules(empty(spark)).count() == 0


def test_by_weight_splits_hot_keys(spark, monkeypatch):
    big = spark.range(3000).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.range(500).select(F.lit(100).cast("long").alias("k"), "id"))
    small = big.groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 2).filter("k <> 3")
    want = Counter((r["k"], r["id"], r["k"] * 2) for r in big.collect() if r["k"] != 3)
    for most in (1, 3, 10_000):                              # none, some and all keys broadcast
        monkeypatch.setattr(_joins, "HEAVY_KEYS", most)
        got = _joins.by_weight(big, small, "k", "w").select("k", "id", "v").collect()
        assert Counter(map(tuple, got)) == want


def plain_resample(rows, aims, order, buckets, least, percent):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    have, want = Counter(b for _, t in rows for b in features(t)), Counter(b for t in aims for b in features(t))
    s, t = sum(have.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log(((want[b] + 1.0) * (s + buckets)) / ((have[b] + 1.0) * (t + buckets)))) for b in have}
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {id(r): k for k, r in enumerate(able[:len(able) * percent // 100], 1)}
    return [(*r, place.get(id(r))) for r in out]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resample(spark, order):
    docs = awkward(spark).select("doc_id", "text").unionByName(webby(spark).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    docs = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = docs.unionByName(spark.createDataFrame([(5000, "a\nb\n\nc d\ne\nf"), (5001, "A B\nC")], "doc_id long, text string"))
    aims = spark.createDataFrame([(1, "one two three a b c"), (2, None), (3, "subscribe to our letter\nabcde")], "item_id long, text string")
    got = importance.resample(clash(docs), clash(aims), order=order, buckets=97, percent=40)
    want = plain_resample([tuple(r) for r in docs.collect()], [r["text"] for r in aims.collect()], order, 97, 20, 40)
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_resample_repeated_rows_and_nothing(spark):
    rows = [(None, "w " * 30), (None, "w " * 30), (7, "v " * 25), (7, "v " * 25), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aims = spark.createDataFrame([], "item_id long, text string")
    got = importance.resample(docs, aims, percent=50).collect()
    want = plain_resample(rows, [], 1, importance.BUCKETS, 20, 50)
    assert Counter(r[:-1] for r in map(tuple, got)) == Counter(r[:-1] for r in want)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert importance.resample(docs.limit(0), aims).count() == 0


def plain_trie(rows, block, heads):
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = tuple(turns.get(c - c % block, [])[:h] + v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in made.items():
        ends[v].append(c)
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not kids[p]
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()]


def talks(spark, seed=5, hot=60):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(0, 230):
        if c in (20, 60):                                    # blocks without their first conversation
            continue
        for n in range(int(rng.integers(1, 7))):
            rows.append((c, n if rng.random() > .1 else None, rng.choice(["user", "bot", None]), rng.choice(["hi there", "hi", "", "tell me more now", None])))
    rows += [(c, n, "user", "the same long talk") for c in range(300, 300 + hot) for n in range(9)]     # one conversation many times
    rows += [(400 + c, n, "user", f"deep {min(n, 20 + c)}") for c in range(3) for n in range(40)]
    rows += [(500, 1, "a", "x"), (500, 1, "a", "x"), (500, 1, "b", "y"), (None, 1, "a", "x"), (None, None, None, None), (999, None, None, None)]
    return spark.createDataFrame([(c, n, None if r is None else str(r), None if t is None else str(t)) for c, n, r, t in rows], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("shards", [1, 4, 37])
def test_prefix_trie(spark, shards):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        turns = talks(spark)
        got = Counter(map(tuple, trie.prefix_trie(clash(turns)).collect()))
        assert got == Counter(plain_trie([tuple(r) for r in turns.collect()], trie.BLOCK, trie.HEADS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_prefix_trie_chunks_of_ids(spark, monkeypatch):
    """The ids of a path in many shards and many rows give one hash."""
    turns = talks(spark, hot=400)
    found = trie.skeleton([(0, "", "a" * 32), (1, "a" * 64, "a" * 96), (2, "a" * 64 + "b" * 32, "c" * 32)])
    assert found == {(0, "a" * 32): 1, (1, "a" * 32): 2}
    walk = trie._Walk({(0, "a" * 32): 1})
    monkeypatch.setattr(trie, "CHUNK", 5)
    for i in range(30):
        walk.add(0, i, "a" * 32, [2])
    while walk.open:
        walk.close()
    ids = [r[-1] for r in walk.rows if r[0] == trie.ENDS]
    assert len(ids) > 5 and ",".join(ids) == ",".join(map(str, range(30)))
    assert Counter(map(tuple, trie.prefix_trie(turns).collect())) == Counter(plain_trie([tuple(r) for r in turns.collect()], trie.BLOCK, trie.HEADS))


def test_prefix_trie_turnless_and_nothing(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    turns = spark.createDataFrame([(c, 0, "user", "gone")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in trie.prefix_trie(turns).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert trie.prefix_trie(turns.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_mixing_spends_its_budget(spark, seed):
    """A document longer than the room doesn't end the pass, and only a little room stays."""
    from ledgerline.llm import mixing
    rng = np.random.default_rng(1)
    rows = [(i, "a", int(n)) for i, n in enumerate(rng.integers(1, 60, 300))] + [(900, "a", 5000)] + [(1000 + i, "b", 10) for i in range(99)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("text", F.lit("t"))
    total = sum(r[2] for r in rows)
    mixed = mixing.mix(docs, target_entropy=0.99, budget_tokens=4000, tokens=F.col("n"), seed=seed)
    spent = {r["source"]: r["s"] for r in mixed.groupBy("source").agg(F.sum("mix_tokens").alias("s")).collect()}
    assert total > 10_000 and 4000 - 10 <= sum(spent.values()) <= 4000 and spent["a"] > 1500


def test_mixing_with_clashing_names(spark):
    from ledgerline.llm import mixing
    docs = spark.createDataFrame([(i, f"s{i % 2}", "word " * (i + 1)) for i in range(20)], "doc_id long, source string, text string")
    more = docs.select("*", *[F.lit("z").alias(c) for c in ("room", "tokens", "taken", "fits", "spent", "now", "mix_source", "mix_blocks", "t_source", "t_block", "size", "budget", "c0", "c1", "mix_spent")])
    plain, clashing = (mixing.mix(d, max_repeats=1.5) for d in (docs, more))
    assert clashing.columns == more.columns + ["mix_tokens", "mix_block", "mix_pass", "mix_rank"]
    cols = ["doc_id", "mix_tokens", "mix_block", "mix_pass", "mix_rank"]
    assert Counter(map(tuple, plain.select(cols).collect())) == Counter(map(tuple, clashing.select(cols).collect()))
    assert {r["room"] for r in clashing.collect()} == {"z"}
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("mix_tokens", F.lit(1)), max_repeats=1.5)


def test_copies_are_told_by_id_and_text(spark):
    from ledgerline.llm import exact
    rows = [(None, "a b"), (None, "a  b"), (3, "A a"), (5, "A a"), (5, "B b"), (6, "B  b"), (7, None), (None, "")]
    got = exact.drop_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in got) == Counter([(None, "a b"), (3, "A a"), (5, "B b"), (7, "")])


def test_language_of_nothing_and_of_numerals(spark):
    from ledgerline.llm import langid
    docs = spark.createDataFrame([(i, "some text here", None, "z") for i in range(30)], "doc_id long, text string, lang string, names string")
    assert langid.accepted(docs, langid.learn(docs)).count() == 30
    assert not any(langid.has_letter(t) for t in ("", "²", "½ 3", "① _ 9", "١٢")) and all(langid.has_letter(t) for t in ("a", "½é", "漢", "ª"))


def test_empty_parts_have_no_key_where_others_do():
    from ledgerline.llm import jaccard
    rng = np.random.default_rng(4)
    for percent in (50, 80, 90):
        keys = [np.unique(jaccard.keys(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), jaccard.classes_of(percent, 500)[0], percent)) for n in [60] * 40 + [240] * 40]
        seen = Counter(np.concatenate(keys).tolist())
        if percent >= 80:
            assert sum(v for v in seen.values() if v > 1) <= 8    # unrelated sets hardly meet
        assert all(jaccard.parts_of(top, percent) > jaccard.differs(2 * top, percent) for top in range(1, 400))


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_key(percent):
    from ledgerline.llm import jaccard
    rng = np.random.default_rng(percent)
    light = jaccard.classes_of(percent, 500)[0]
    for _ in range(600):
        n = int(rng.integers(light, 160))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        most = jaccard.differs(2 * len(a), percent)
        out, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[:max(len(a) - out, 1)], rng.integers(0, 2**63, new).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both * 100 >= percent * (len(a) + len(b) - both) and min(len(a), len(b)) >= light:
            assert len(np.intersect1d(jaccard.keys(a, light, percent), jaccard.keys(b, light, percent)))


def test_repeats_of_rows_without_or_with_shared_ids(spark):
    """Each row loses its own repeats only: not what another row of the same or no id has twice."""
    from ledgerline.llm import repeats
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    shared, alone = word(72), word(87)
    rows = [(1, "x" + shared), (None, "yy" + shared + "z"), (None, alone), (4, alone[:40] + word(60)), (4, word(90)), (4, "q" + shared), (None, word(70) + shared), (9, None)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    gone = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got)
    assert gone == Counter([(1, 73, 0), (None, 75, 72), (None, 87, 0), (4, 100, 0), (4, 90, 0), (4, 73, 72), (None, 142, 72), (9, 0, 0)])
    with pytest.raises(ValueError):
        repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=300, gram=16)
