"""Exact duplicates by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so: a chunk has at least ``MIN_CHARS``
characters and ends at the next place that matches ``BOUNDARY``, or after
``MAX_CHARS``. A document becomes its recipe, the ordered list of its chunks'
identifiers, so long texts are compared as short lists of longs. Each distinct
chunk moves once, to the dictionary that verifies identifiers: chunks that
differ in text but share a hash get different ordinals there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import cut, keyed

MIN_CHARS, MAX_CHARS = 512, 8192
BOUNDARY = r"(?<=[aeiou][a-z] )(?=[a-m])"
BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"  # every run of blanks but a lone space


def normalised(text):
    """Each run of blanks as one space (a lone space already is one)."""
    return F.regexp_replace(text, BLANKS, " ")


def _chunks(text):
    pattern = rf"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?(?:{BOUNDARY}|\z)|.{{1,{MAX_CHARS}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _ids(chunk):
    return F.xxhash64(chunk)


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               identify=_ids) -> tuple[DataFrame, DataFrame]:
    """The distinct chunks (h, chunk, uses), and the hashes that more than one of them has (h)."""
    chunk = (keyed(docs, id_col, text_col).select(normalised(F.col("text")).alias("text"))
             .select(F.explode(_chunks(F.col("text"))).alias("chunk")).select(identify(F.col("chunk")).alias("h"), "chunk"))
    distinct = chunk.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("h")
    return distinct, shared


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify=_ids) -> DataFrame:
    """doc_id, text_sha256, recipe (hash per chunk) and ordinals (empty unless a chunk's hash is shared)."""
    base = keyed(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    base = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"),
                       F.transform(_chunks(F.col("text")), identify).alias("recipe"))
    none = F.array().cast("array<struct<at:int,ordinal:int>>")
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    distinct, shared = dictionary(docs, id_col, text_col, identify)
    shared = cut(shared)  # empty but for a collision of 64-bit hashes
    if shared.isEmpty():
        return base.withColumn("ordinals", none)
    ordinals = (distinct.join(shared, "h").withColumn("ordinal", F.row_number().over(W.partitionBy("h").orderBy("chunk")))
                .select("h", "chunk", "ordinal"))
    found = (keyed(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
             .select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(_chunks(F.col("text"))).alias("at", "chunk"))
             .withColumn("h", identify(F.col("chunk"))).join(ordinals, ["h", "chunk"])
             .groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("at", "ordinal"))).alias("ordinals")))
    same = base["doc_id"].eqNullSafe(found["doc_id"]) & (base["text_sha256"] == found["text_sha256"])
    return base.join(found, same, "left").select(base["*"], F.coalesce(found["ordinals"], none).alias("ordinals"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identify=_ids) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after each run of blanks (space, tab, line
    ends, form feeds) becomes one space. Of equal texts the smallest doc_id
    stays. A group of copies is reduced before it is shuffled, and the way back
    is a join that splits a hot group, never a window over it.

    A null text counts as empty, and all empty texts are equal. Rows that repeat
    a doc_id with the same text are in one group and share the flag; a null id
    is kept only where its group has no other. An empty table gives no rows;
    other columns are not read.
    """
    found = recipes(docs, id_col, text_col, identify)
    key = F.struct("recipe", "ordinals")
    found = found.select("doc_id", "text_sha256", F.size("recipe").alias("n_chunks"), key.alias("key"))
    groups = cut(found.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    out = found.join(groups, "key")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256", "n_chunks")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies: all columns of one row per group of equal texts.

    Rows are told by id and normalised text: rows that share an id with different
    texts are judged each by its own, and of null ids one row a text stays.
    """
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    text = normalised(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    named = docs.withColumn("__own", F.sha2(text, 256))
    same = docs[id_col].eqNullSafe(stay["__id"]) & (F.col("__own") == stay["__sha"])
    return named.join(stay, same, "left_semi").dropDuplicates([id_col, "__own"]).drop("__own")
