"""The document operators against brute force, on small awkward tables and on sf0.001."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from ledgerline.llm import _bwt, _shared, embeddings, exact, jaccard, langid, licenses, mixing, packing, quality, queries, repeats, tokens
from ledgerline.llm._graph import components

P = pytest.importorskip("public_tokenizers")
SMOKE = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("cls", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.StringType())])


@pytest.fixture(scope="module", autouse=True)
def _ready(spark):
    _shared.ready(spark)


def awkward(spark):
    """Nulls, empty and blank texts, a very long one, copies, near copies, repeated rows and clashing columns."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    base = [word() for _ in range(400)]
    texts = [None, "", " \n ", "one", "One", "one two", " ".join(base), "  ".join(base), "\t".join(base), " ".join(base[:200] + ["x"] + base[200:]),
             " ".join(base[100:300]), " ".join(base[:12]), " ".join(base[:13]), " ".join(base[:11] + ["y"]), "ab " * 40_000, "Ünïcödé ß 漢字 " * 30, "a" * 5000,
             "prefix " + " ".join(base[50:90]) + " suffix", "<|endoftext|> one <|startoftext|>  two\n\n three", "x́ é z"]
    rows = [(i, t, "en", ("hot" if i % 3 else None), "c", "k", "n") for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "hot", "c", "k", "n"), (None, texts[6], None, "hot", "c", "k", "n"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    docs = awkward(spark)
    identify = (lambda c: F.lit(1).cast("bigint")) if weak else exact._ids  # a hash that says nothing: ordinals decide
    got = exact.exact_groups(docs, identify=identify).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(plain(r["text"]), []).append(r["doc_id"])
    assert len(got) == docs.count()
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[key] if i is not None]
        assert (r["group_size"], r["keep_id"]) == (len(groups[key]), min(ids) if ids else None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact.exact_groups(empty(spark)).count() == 0


def test_drop_exact_keeps_one_of_each(spark):
    docs = awkward(spark)
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(Counter(plain(r["text"]) for r in kept.collect()).values()) == [1] * len({plain(r["text"]) for r in docs.collect()})


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (140, 139), (None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 141)}, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = rng.standard_normal(16)
    rows = [(i, (center + rng.standard_normal(16) * 0.05 * (i % 7)).tolist()) for i in range(150)] + [(i, rng.standard_normal(16).tolist()) for i in range(150, 300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (305, [1.0, None]), (306, []), (307, [2.0 * x for x in rows[200][1]]),
             (308, [1e300, 1e300]), (309, [1.0, 1.0]), (301, rows[0][1])]
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit("x"))
    got = embeddings.near_vectors(docs).collect()
    unit = [embeddings._unit(v) for _, v in rows]
    near = np.array([[a is not b and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9 for b in unit] for a in unit])
    links, label = near.sum(1), np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    want = Counter((rows[i][0], int(links[i]), rows[label[i]][0], rows[i][0] == rows[label[i]][0]) for i in range(len(rows)))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert embeddings.near_vectors(docs.limit(0)).count() == 0


def test_vector_recall():
    bits, tables = embeddings.plan(10**6)
    same = (1 - math.acos(0.9) / math.pi) ** bits
    assert (1 - same) ** tables <= embeddings.MISS


def removed(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p:p + length], i) != i:
                gone[p:p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(i, []).append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT_CONTEXTS, 1])
def test_repeats(spark, hot):
    docs = awkward(spark).filter("doc_id IS NOT NULL OR text IS NOT NULL").dropDuplicates(["doc_id"])
    want = removed([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    got = repeats.without_repeats(docs, hot_contexts=hot).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]][0], r["doc_id"]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(s["z"] - s["a"] for s in r["spans"]) == r["n_removed"]
    assert repeats.without_repeats(empty(spark)).count() == 0
    assert repeats.without_repeats(awkward(spark)).count() == awkward(spark).count()


@pytest.mark.parametrize("length", [3, 9, 50])
def test_equal_prefixes(length):
    text = np.frombuffer(b"abracadabra-" * 30 + b"mississippi " * 20 + b"abracadabra", dtype=np.uint8)
    rows, starts = _bwt.equal_prefixes(text, length)
    twice = bytes(text) * 2
    groups = [set(twice[r:r + length] for r in rows[a:z]) for a, z in zip(starts, [*starts[1:], len(rows)])]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == len(groups) and sorted(rows) == list(range(len(text)))


def shingled(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if x]
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("words,percent,block", [(3, 90, 512), (5, 80, 4)])
def test_jaccard(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = [str(x) for x in rng.integers(0, 10**6, 300)]
    made = []
    for size in (8, 12, 15, 21, 40, 90, 300):
        for changes in (0, 0, 1, 1, 2, 3, 5, 9):
            w = base[:size].copy()
            for at in rng.integers(0, size, changes):
                w[at] = str(rng.integers(0, 10**6))
            made.append(" ".join(w))
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + i, t, "en", "s", "c", "k", "n") for i, t in enumerate(made)], SCHEMA))
    rows = [(r["doc_id"], shingled(r["text"], words)) for r in docs.collect()]
    label = list(range(len(rows)))
    for (i, a), (j, b) in itertools.combinations(enumerate(x for _, x in rows), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            p, q = sorted((label[i], label[j]))
            label = [p if x == q else x for x in label]
    least = {}
    for x, (i, _) in zip(label, rows):
        least[x] = min([y for y in (least.get(x), i) if y is not None], default=None)
    want = Counter((i, len(s), least[x] if s else i) for x, (i, s) in zip(label, rows))
    got = jaccard.jaccard_groups(docs, words=words, percent=percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    assert jaccard.jaccard_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_every_size_pair_that_links_shares_a_key(percent):
    x = np.unique(jaccard.S.mixed(np.arange(1, 80, dtype=np.uint64)))
    for light in (jaccard.classes_of(percent, 1)[0], 8, 13):
        for n, m in itertools.combinations(range(1, 31), 2):
            if 100 * n >= percent * m:  # n inside m
                assert np.intersect1d(jaccard.keys(x[:n], light, percent), jaccard.keys(x[:m], light, percent)).size, (n, m, light)


@pytest.mark.parametrize("words,percent,size", [(3, 90, 11), (5, 80, 8)])
def test_jaccard_links_the_smallest_sets_that_can(spark, words, percent, size):
    """9 shingles in 10 at 90, 4 in 5 at 80: a word more at either end; one size less does not link."""
    text = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    rows = [(1, text(0, size)), (2, text(0, size) + ["z"]), (3, text(1, size)), (4, ["z"] + text(1, size)), (5, text(2, size - 1)), (6, text(2, size - 1) + ["z"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs, words=words, percent=percent).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_keep_one_without_ids(spark):
    """Null ids: none beside a copy with an id, one of a group without ids, lone and blank ones as they are."""
    a, b, c = ([f"{k}{i}" for i in range(40)] for k in "abc")
    rows = [(1, a), (None, a + ["x"]), (None, b), (None, ["x"] + b), (None, b), (None, c), (None, []), (2, ["lone"])]
    docs = spark.createDataFrame([(i, " ".join(w), "s") for i, w in rows], "doc_id long, text string, source string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"].replace("x", "").strip()) for r in kept.collect())
    assert got == Counter([(1, " ".join(a)), (None, " ".join(b)), (None, " ".join(c)), (None, ""), (2, "lone")])


def test_light_boundary_follows_cost():
    assert jaccard.light_end({12: 1000, 40: 10}, 90) == 13
    assert jaccard.light_end({40: 1000}, 90) <= 40


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "w" * (4 * (1 + i % 5)), None if i < 20 else "hot" if i < 700 else f"s{i % 4}") for i in range(800)], "doc_id long, text string, source string")
    sizes = {r["source"]: r["tokens"] for r in mixing.shares(docs).collect()}
    for target in ({"target_entropy": 0.9}, {"max_repeats": 2.0}):
        a = mixing.exponent(mixing.shares(docs), **target)
        w = np.array([t ** a for t in sizes.values()])
        w /= w.sum()
        if "target_entropy" in target:
            assert -(w * np.log(w)).sum() / np.log(len(w)) == pytest.approx(0.9, abs=1e-4)
        else:
            ratio = w / np.array(list(sizes.values()))
            assert ratio.max() / ratio.min() == pytest.approx(2.0, abs=1e-3)
    kept = mixing.mix(docs, max_repeats=2.0, block_tokens=50).collect()
    assert {r["doc_id"] for r in kept} == set(range(800)) and max(Counter(r["doc_id"] for r in kept).values()) <= 2
    some = mixing.mix(docs, target_entropy=0.9, budget_tokens=1500, block_tokens=50)
    spent = {r["source"]: r["n"] for r in some.groupBy("source").agg(F.sum("mix_tokens").alias("n")).collect()}
    a = mixing.exponent(mixing.shares(docs), target_entropy=0.9)
    plan = {r["source"]: r["budget"] for r in mixing.budgets(mixing.shares(docs), a, 1500).collect()}
    assert all(plan[s] - 25 <= spent.get(s, 0) <= plan[s] for s in plan)
    assert mixing.mix(docs.limit(0), max_repeats=2.0).count() == 0
    nulls = mixing.mix(awkward(spark), max_repeats=1.5)
    assert nulls.select("doc_id").distinct().count() == awkward(spark).select("doc_id").distinct().count()


def test_differencing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 500).tolist()
    got = packing.windows(sizes, 2048)
    assert sorted(i for w in got for i in w) == list(range(500))
    sums = [sum(sizes[i] for i in w) for w in got]
    assert max(sums) <= 2048 and max(sums) - min(sums) < 64 and packing.windows([], 2048) == []
    assert [len(w) for w in packing.windows([2000, 2000, 2000], 2048)] == [1, 1, 1]  # the count rises


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    docs, path = awkward(spark), P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, batch_tokens=4096).collect()
    by_doc = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for r in docs.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL AND doc_id <> 7").collect():
        ids = [x for _, part in sorted(by_doc[r["doc_id"]]) for x in part]
        assert ids == t.encode(r["text"] or "", add_special_tokens=False).ids + [1], r["doc_id"]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty(spark), path).count() == 0


def test_fast_encoder_is_the_library():
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    t, fast = Tokenizer.from_file(path), packing._encoder(path)
    points = [chr(c) for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for text in ["".join(points[i:i + 500]) for i in range(0, len(points), 500)] + [" ".join(points), "a  b\n\n c <|endoftext|>it's", " " * 3000, ""]:
        assert fast(text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    path = P.path(name)
    docs = awkward(spark)
    if name.endswith(".model"):
        import sentencepiece
        count = lambda x: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(x))
    else:
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or "")) for r in docs.collect())
    got = tokens.count_tokens(docs, path).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got) and tokens.count_tokens(empty(spark), path).count() == 0


def test_quality_and_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = _shared.table(spark, sf, "labels")
    got = queries.op3_quality(spark, sf).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    docs = _shared.table(spark, sf, "documents").select("doc_id", "lang")
    got = queries.op8_language(spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_classifiers_on_awkward_rows(spark):
    docs = awkward(spark)
    marks = spark.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(3, None, "x"), (99, 1, "x"), (None, 0, "x"), (5, 0, "x")], "doc_id long, quality int, text string")
    got = quality.quality(docs, marks).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.quality(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.quality(empty(spark), marks).count() == 0
    got = langid.languages(docs).collect()
    assert len(got) == docs.count() and all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2) or (r["doc_id"] is None and r["lang_pred"] == "und")) for r in got)
    assert langid.languages(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_codewords(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1, 1}
    assert (abs(code.sum(0)) < n).all()


def test_licences(spark):
    mit = ["MIT-grant", "MIT-notice", "MIT-warranty"]
    texts = {0: "Released under the MIT License.", 1: ". ".join(licenses.SENTENCES[x].upper() for x in mit) + ".", 2: "// SPDX-License-Identifier: Apache-2.0\ncode",
             3: licenses.SENTENCES["BSD-grant"] + ". a. b. c. d. e. " + licenses.SENTENCES["BSD-source"], 4: None, 5: "", 6: "released under the mit",
             7: "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("codes", F.lit("x"))
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {i: list(r["licences"]) for i, r in got.items()} == {0: ["MIT"], 1: ["MIT"], 2: ["Apache-2.0"], 3: [], 4: [], 5: [], 6: [], 7: ["CC-BY-NC-4.0", "GPL-3.0-only"]}
    assert len(got[1]["matches"]) == 1 and got[4]["n_sentences"] == 0 and licenses.scan(docs.limit(0)).count() == 0


def test_licences_on_lines_of_their_own(spark):
    header = '# Copyright 2020 Foo\n#\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with\n#  the License.\n'
    texts = {0: "a table |\nLicensed under CC BY-NC 4.0.\nb", 1: header, 2: "x\nReleased under the MIT License\ny", 3: "x released under the MIT license\ny", 4: "x\nreleased under the MIT license or so", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_known"], list(r["licences"])) for r in licenses.scan(docs).collect()}
    assert got == {0: (1, ["CC-BY-NC-4.0"]), 1: (2, ["Apache-2.0"]), 2: (1, ["MIT"]), 3: (0, []), 4: (0, []), 5: (0, [])}
    more = {0: "/* SPDX-License-Identifier: GPL-3.0-or-later */", 1: "# SPDX-License-Identifier: Unlicense\n", 2: "This project is licensed under the MIT License - see the LICENSE file for details.",
            3: "x\n * Licensed under the Eclipse Public License 2.0\n * Released under BSD-3-Clause\ny"}
    got = {r["doc_id"]: list(r["licences"]) for r in licenses.scan(spark.createDataFrame(list(more.items()), "doc_id long, text string")).collect()}
    assert got == {0: ["GPL-3.0-or-later"], 1: ["Unlicense"], 2: ["MIT"], 3: ["BSD-3-Clause", "EPL-2.0"]}
    docs = _shared.table(spark, "/root/testdata/sf0.01", "documents")
    plain_search = {r["doc_id"]: sum(re.sub("(?<=under )the ", "", licenses._plain(x)) in licenses.known() for x in (r["text"] or "").split("\n")) for r in docs.collect()}
    assert sum(plain_search.values()) > 0
    assert all(r["n_known"] >= plain_search[r["doc_id"]] for r in licenses.scan(docs).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SMOKE)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want.fetchall())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    docs = _shared.table(spark, SMOKE, "documents")
    assert [n for n, _ in C.STAGES] == ["language", "exact", "near", "mix", "pack"] and C.ORACLE_SQL is None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in C.STAGES[:-1]:
        stage(spark, kept, SMOKE).write.parquet(str(tmp_path / name))
        before, kept = kept, spark.read.parquet(str(tmp_path / name))
        assert kept.columns == C.COLUMNS
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name == "exact":
            assert len({plain(texts[i]) for i in ids}) == len(ids) == len({plain(r["text"]) for r in before.collect()})
        if name == "near":
            sets = [shingled(texts[i], 5) for i in ids]
            assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(sets, 2))
        if name == "mix":
            assert set(ids) == {r["doc_id"] for r in before.collect()}
    packed = C.run(spark, SMOKE)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(ids)


def test_long_texts_in_pieces(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "PIECE_CHARS", 64)
    texts = [" ".join(f"word{i * 7919 % 997}x" for i in range(k)) for k in (0, 1, 30, 500)] + ["a" * 1000 + " " + "b" * 200, "  x   y  "]
    want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens._JsonCounter(path).counts(texts) == want
    assert list(_shared.runs([3, 9, 1, 1, 20, 0], 5)) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 6)] and not list(_shared.runs([], 5))


def test_sample_is_each_label_s_smallest_hashes(spark):
    from ledgerline.llm import _grams
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    marks = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") < 40, "b").when(F.col("doc_id") < 2900, "c").alias("label"))
    rows, labels, counts = _grams.sampled_indicators(marks.unionByName(marks.limit(50)), docs, 50, True, False)
    assert Counter(labels) == {"a": 50, "b": 26, "c": 50} and counts == {"a": 1000, "b": 26, "c": 1907}
    ranked = marks.filter("label = 'c'").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(50).collect()
    want = {tuple(np.flatnonzero(_grams.indicators(f"text {r['doc_id']}", True, False))) for r in ranked}
    assert {tuple(r) for r, x in zip(rows, labels) if x == "c"} == want


def test_hinge_descent_finds_the_least_loss(spark):
    from ledgerline.llm import _grams
    draw = np.random.default_rng(3)
    rows = [np.sort(draw.choice(12, size=draw.integers(1, 6), replace=False)) for _ in range(60)]
    y = np.array([1 if 3 in r or draw.random() < 0.3 else -1 for r in rows])
    cost = np.full(60, 0.7)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
        x[i, 12] = 1  # the bias

    def loss(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    w, bias = _grams.hinge_descent(rows, y, cost, 12, epochs=2000)
    found, plain, best = loss(np.append(w, bias)), np.zeros(13), np.inf
    for step in range(1, 20001):  # plain subgradient steps over all rows
        plain -= (plain - (cost * y * (y * (x @ plain) < 1)) @ x) / (step + 10)
        best = min(best, loss(plain))
    assert found <= best * 1.02


def test_decoder_against_a_plain_loop():
    from ledgerline.llm import _grams
    draw = np.random.default_rng(4)
    code = langid.codewords(5)
    model = {"names": list("abcde"), "code": code, "weights": draw.standard_normal((_grams.SIZE, code.shape[1])).astype(np.float32),
             "bias": draw.standard_normal(code.shape[1]), "trust": draw.random(code.shape)}
    decode = langid._decoder(model, 0.05)
    for text in ("some words", "Ünïcode", "x" * 400, "a b c d"):
        seen = np.flatnonzero(_grams.indicators(text, True, False))
        losses = []
        for i in range(5):
            total = 0.0
            for b in range(code.shape[1]):
                margin = sum(float(model["weights"][f, b]) for f in seen) / math.sqrt(len(seen)) + model["bias"][b]
                total += model["trust"][i, b] * math.log1p(math.exp(min(30, max(-30, -2 * code[i, b] * margin))))
            losses.append(total)
        share = [math.exp(min(losses) - x) for x in losses]
        share = sorted(((s / sum(share), n) for s, n in zip(share, "abcde")), reverse=True)
        lang, score, ambiguous = decode(text)
        assert lang == share[0][1] and abs(score - share[0][0]) < 1e-9 and ambiguous == (share[0][0] - share[1][0] < 0.05)
