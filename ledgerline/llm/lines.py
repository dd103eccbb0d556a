"""Quality rules with line frequencies across documents (DataFrame functions only).

Base rules look at one text: few words, or passages that it repeats. The
verdict for the rest comes from lines: each is normalised and hashed, the
distinct documents that have it are counted per host, lines of more documents
than the limits allow are removed, and a document of which too little is left
is rejected.

Documents are distinct by text: thousands of exact copies are one document, so
copies (which are the dedup's task) don't make their own lines frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._joins import by_weight
from ._shared import cut, keyed

WINDOW = 5                             # words of a window that may repeat
LEAST_WORDS, MOST_REPEATED = 10, 20    # words a text has at least; percent of its words in repeated windows at most
MOST_DOCS, MOST_PERCENT = 5, 5         # a line may be in so many documents of its host, or in such a percentage of them if that is more
MOST_REMOVED = 70                      # percent of its words that a document may lose

BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"             # runs of blanks but a lone space
INLINE = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+"  # the same without line ends


def _base(docs: DataFrame) -> DataFrame:
    """The counts of the base rules, from the whole text in one pass over its words."""
    flat = docs.withColumn("flat", F.trim(F.regexp_replace("text", BLANKS, " ")))
    words = flat.withColumn("words", F.when(F.col("flat") == "", F.array().cast("array<string>")).otherwise(F.split("flat", " ", -1)))
    words = words.withColumn("n_words", F.size("words").cast("long"))
    words = words.withColumn("word_chars", F.length("flat").cast("long") - F.greatest(F.col("n_words") - 1, F.lit(0)))
    words = words.withColumn("n_symbols", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"))
    raw = words.withColumn("raw", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    raw = raw.withColumn("n_dup_lines", (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long")).drop("raw", "flat")
    hashed = raw.withColumn("words", F.transform("words", lambda x: F.xxhash64(x)))
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    windows = hashed.withColumn("h", F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).drop("words")
    # nearly all texts have no window twice: only the others are sorted
    twice = windows.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).otherwise(F.array().cast("array<long>")))
    pairs = twice.withColumn("h", F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    same = lambda x, k: (k >= 0) & F.coalesce(F.get("h", k)["h"] == x["h"], F.lit(False))
    spots = pairs.withColumn("h", F.sort_array(F.transform(F.filter("h", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    cover = F.aggregate(F.transform("h", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("h", k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return spots.withColumn("n_repeat_words", cover).drop("h")


def _lines(text):
    """The normalised lines of a text that have a word, in order: blanks as one space, none at the ends, lower case."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.lower(text), INLINE, " "), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def _key(line):
    return F.xxhash64(line)


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", texts: bool = False,
               most_docs: int = MOST_DOCS, most_percent: int = MOST_PERCENT, most_removed: int = MOST_REMOVED) -> DataFrame:
    """One row per row of ``docs``: the counts of the base rules, ``n_removed`` (words of removed lines) and the verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed, kept, and with
    ``texts`` also ``text``: the text without its frequent lines. A line is frequent if more than ``most_docs`` distinct
    texts of its host have it, and more than ``most_percent`` percent of those that the host has.

    A null text is empty: no words, base_failed, not kept. A null host is a host of its own; null or repeated ids keep
    their rows apart. Repeated rows are one document in the counts and stay rows in the result. Columns that aren't named
    are ignored, whatever their names. An empty table gives no rows. Hashes of lines and of windows are xxhash64: a rare
    line is taken for a frequent one of its host with a probability of frequent lines / 2**64.
    """
    docs = keyed(docs, id_col, text_col, host_col).toDF("doc_id", "text", "host").withColumn("row", F.monotonically_increasing_id())
    lines = F.transform(_lines(F.col("text")), lambda x: F.struct(
        _key(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")))
    shaped = docs.withColumn("lines", lines).withColumn("host", F.xxhash64("host")).withColumn("copy", F.xxhash64("text"))
    shaped = _base(shaped if not texts else shaped.withColumn("whole", F.col("text"))).drop("text")
    shaped = shaped.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    shaped = cut(shaped)   # the texts are read once; row numbers stay

    hosts = shaped.groupBy("host").agg(F.count_distinct("copy").alias("texts")).withColumnRenamed("host", "at")
    each = shaped.select("row", "host", "copy", F.explode("lines").alias("x")).select("row", "copy", "host", "x.line", "x.words")
    held = each.groupBy("host", "line").agg(F.count_distinct("copy").alias("docs"), F.count(F.lit(1)).alias("uses"))
    held = cut(held.filter(F.col("docs") > most_docs).withColumnRenamed("host", "at"))   # far fewer than there are lines
    weights = held.groupBy("at").agg(F.count(F.lit(1)).alias("rows"))
    limits = cut(hosts.join(weights, "at"))
    frequent = by_weight(held, limits, "at", "rows").filter(100 * F.col("docs") > most_percent * F.col("texts"))
    frequent = cut(frequent.select(F.struct(F.col("at").alias("host"), "line").alias("key"), "uses"))
    hits = by_weight(each.select("row", F.struct("host", "line").alias("key"), "words"), frequent, "key", "uses")
    lost = hits.groupBy("row").agg(F.sum("words").alias("n_removed"), *([F.collect_set("key.line").alias("gone")] if texts else []))
    found = shaped.drop("host", "copy", "lines").join(lost, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (left < LEAST_WORDS) | (100 * F.col("n_removed") > most_removed * F.col("n_words"))
    found = found.withColumn("kept", ~F.col("base_failed") & ~depleted)
    if texts:   # a line stays unless its normalised form has words and is among those that go
        normal = lambda x: F.trim(F.regexp_replace(F.lower(x), INLINE, " "))
        stay = F.filter(F.split("whole", "\n", -1), lambda x: ~F.coalesce((normal(x) != "") & F.array_contains("gone", _key(normal(x))), F.lit(False)))
        found = found.withColumn("text", F.array_join(stay, "\n"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept", *(["text"] if texts else []))
