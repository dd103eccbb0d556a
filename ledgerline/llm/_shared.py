"""Helpers of the document operators: input shaping and lineage cuts."""

from __future__ import annotations

import gc
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure, ensure_checkpoint_dir


def ready(spark: SparkSession) -> SparkSession:
    """Session defaults, and this package's place on the Python path of the workers.

    On a cluster the package is installed or sent along (``--py-files``); where
    driver and workers share a file system, as in local mode, its folder is enough.
    """
    configure(spark)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (top, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    A lost executor loses nothing of it, and because the rows are read back as
    stored, values such as ``monotonically_increasing_id()`` stay what they were.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables written in the shared folder for one computation, compressed, and dropped when it is done with them.

    Writing one also lets go of what earlier steps shuffled: Spark removes
    shuffle files once the driver has collected the objects that stand for them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/ledgerline-{uuid.uuid4()}"
        self.count = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        del df  # else its shuffles stay
        release(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, number: int | None = None) -> None:
        """Drop the table written as the ``number``-th, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder if number is None else f"{self.folder}/{number}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that shuffle files nothing refers to any more go now.

    Twice: what the first round lets go of on the Python side is garbage to the JVM only then.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, under names of its own.

    Everything else is dropped here, so extra columns can't clash with the
    operator's own. A null text counts as empty.
    """
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                       *[docs[c] for c in more])


def fold(id_col, folds: int):
    """crc32 of the id as text, modulo ``folds``: the held-out split of the classifiers."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(folds)


def runs(sizes: list[int], most: int):
    """Runs (first, last + 1) of items of about ``most`` in all, one item at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def by_bytes(texts: list[str], most: int):
    """Runs of texts of about ``most`` characters in all, one text at least."""
    return runs([len(t) for t in texts], most)
