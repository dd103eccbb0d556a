"""Importance resampling towards a target: hashed n-gram features, distinct lines counted once.

Line ends are separators, so no word crosses them and a text's n-grams are
those of its lines plus those that run over a line end. A line that many
documents share is a segment: the distinct lines are found first, their words
and buckets are worked out once, and their counts are multiplied by how often
they occur. N-grams across line ends are added from the documents.

The gains of the buckets (``buckets`` of them, a fixed number) are what the
corpus and the target differ in; a document's weight is the mean gain of its
features, and Gumbel noise from its id turns the highest scores into a sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators._order import ranked
from ._joins import by_weight
from ._shared import cut, keyed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # after lower-casing A-Z
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _line(text: Column) -> Column:
    """The lines of a text, raw."""
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line, from two seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(gram) % F.lit(buckets)).cast("int")


def _runs(size: Column, length: int) -> Column:
    """The starts of all runs of ``length`` among ``size`` words."""
    return F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))


def _grams(words: str, i: Column, n: int, buckets: int, part: str | None = None) -> Column:
    """The bucket of the ``n`` words from place ``i`` of the list in a column."""
    each = [F.get(words, i + k) for k in range(n)]
    return _bucket(F.concat_ws(" ", *[x[part] if part else x for x in each]), buckets)


def _inside(words: str, order: int, buckets: int) -> Column:
    """Buckets of all n-grams of a list of words."""
    each = [F.transform(words, lambda w: _bucket(w, buckets))]
    for n in range(2, order + 1):
        each.append(F.transform(_runs(F.size(words), n), (lambda n: lambda i: _grams(words, i, n, buckets))(n)))
    return F.concat(*each)


def _across(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """``docs`` with ``across``: buckets of the n-grams of ``text`` that run over at least one line end."""
    none = F.array().cast("array<int>")
    if order < 2:
        return docs.withColumn("across", none)
    at = F.flatten(F.transform(_line(F.col("text")), lambda x, i: F.transform(words_of(x), lambda w: F.struct(w.alias("w"), i.alias("i")))))
    each = []
    for n in range(2, order + 1):
        over = F.filter(_runs(F.size("at"), n), (lambda n: lambda i: F.get("at", i)["i"] != F.get("at", i + n - 1)["i"])(n))
        each.append(F.transform(over, (lambda n: lambda i: _grams("at", i, n, buckets, "w"))(n)))
    return docs.withColumn("at", at).withColumn("across", F.concat(*each)).drop("at")


def segments(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """(key, uses, words, buckets): the distinct lines, each worked out once. ``docs`` has ``text``.

    Lines without a word stay, with no buckets: a filter on words would be pushed below the grouping and read every line.
    """
    lines = docs.select(F.explode(_line(F.col("text"))).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("uses"))
    read = lines.select(_key(F.col("line")).alias("key"), "uses", words_of(F.col("line")).alias("list"))
    return cut(read.select("key", "uses", F.size("list").cast("long").alias("words"), _inside("list", order, buckets).alias("buckets")))


def counts(parts: DataFrame, across: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket: lines times their uses, and ``across`` (buckets) once. The driver gets one number a bucket."""
    each = parts.select("uses", F.explode("buckets").alias("b")).unionByName(across.select(F.lit(1).cast("long").alias("uses"), F.explode("across").alias("b")))
    found = dict(map(tuple, each.groupBy("b").agg(F.sum("uses").alias("n")).collect()))
    return [found.get(b, 0) for b in range(buckets)]


def _gains(have: list[int], want: list[int]) -> list[int]:
    import math
    m, s, t = len(have), float(sum(have)), float(sum(want))
    return [math.floor(1000 * math.log(((y + 1.0) * (s + m)) / ((x + 1.0) * (t + m)))) for x, y in zip(have, want)]


def _total(buckets: str, gains: list[int]) -> Column:
    """Sum of the gains of a list of buckets; the gains are one constant array."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<int>")
    return F.aggregate(F.transform(buckets, lambda b: F.get(table, b)), F.lit(0).cast("long"), lambda a, x: a + x)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
             order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, and rank for the ``percent`` percent drawn.

    Drawn are the highest scores among documents of at least ``least_words`` words, equal scores by smaller id (null ids
    last, then by text); rank is null elsewhere. A null or empty text has no features, weight 0 and is never drawn; a null
    id is the empty string in the noise. Repeated rows count and are drawn one by one. An empty target leaves its counts
    at 0; an empty table gives no rows. Columns that aren't named are ignored, whatever their names. Lines are told apart
    by 128 bits of hash.
    """
    docs = keyed(docs, id_col, text_col)
    shaped = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("tie"),
                         F.transform(_line(F.col("text")), _key).alias("lines"))
    shaped = cut(_across(shaped, order, buckets).drop("text"))
    parts = segments(docs, order, buckets)
    aims = keyed(target, target_id, target_text)
    want = counts(segments(aims, order, buckets), _across(aims, order, buckets).select("across"), buckets)
    gains = _gains(counts(parts, shaped, buckets), want)

    worth = cut(parts.select("key", "uses", "words", F.size("buckets").cast("long").alias("n"), _total("buckets", gains).alias("gain")))
    each = by_weight(shaped.select("row", F.explode("lines").alias("key")), worth, "key", "uses").select("row", "words", "n", "gain")
    over = shaped.filter(F.size("across") > 0).select("row", F.lit(0).cast("long").alias("words"), F.size("across").cast("long").alias("n"), _total("across", gains).alias("gain"))
    sums = each.unionByName(over).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("words", "n", "gain")])
    found = shaped.select("row", "doc_id", "tie").join(sums, "row", "left").fillna(0, ["words", "n", "gain"])
    mean = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain - pmod(gain, n)) div n"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    found = cut(found.withColumn("weight", mean).withColumn("score", F.col("weight") + noise))

    able = found.filter(F.col("words") >= least_words)
    draw = able.count() * percent // 100
    order_by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("row")]
    drawn = ranked(able.select("row", "doc_id", "score", "tie"), order_by, "rank").filter(F.col("rank") <= draw).select("row", "rank")
    return found.join(drawn, "row", "left").select("doc_id", F.col("words").alias("n_words"), F.col("n").alias("n_features"), "weight", "score", "rank")
