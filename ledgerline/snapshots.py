"""Tables that change by whole commits (INC-3 silver tables, SNK-2 marts, INC-1 state).

A snapshot table is a folder of Parquet files and a small manifest per
version. Rows lie in parts (a month, or a bucket of a key); a commit writes the
parts it makes to a folder of its own, and then the manifest that names the
folders of all parts, kept, made and gone. The manifest is one file that
appears whole, so readers see the version before or the one after, a commit
that fails leaves the table as it was, and a part without rows simply isn't in
the next manifest. The manifest also holds the last batch of each writer: a
batch that is delivered again changes nothing.

One writer at a time commits to a table. Folders of earlier versions stay for
their readers; the storage's own lifecycle rules may remove them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

PART = "_part"
MANIFEST = "schema string, ledger map<string,long>, parts map<string,array<string>>"
NAME = re.compile(r"[A-Za-z0-9_.-]+")


@dataclass
class Version:
    number: int = 0
    schema: str | None = None
    ledger: dict[str, int] = field(default_factory=dict)
    parts: dict[str, list[str]] = field(default_factory=dict)


class Snapshot:
    """A table at ``path`` whose rows lie in parts named by ``part`` (a function from nothing to a Column)."""

    def __init__(self, spark: SparkSession, path: str, part: Callable[[], Column]):
        self.spark, self.path, self._part = spark, path.rstrip("/"), part

    @classmethod
    def by_key(cls, spark: SparkSession, path: str, key, buckets: int = 16) -> "Snapshot":
        """Parts are buckets of the key. A merge rewrites the buckets its batch touches, so make them as many as a batch should
        spare and as large as a file should be."""
        keys = [key] if isinstance(key, str) else list(key)
        return cls(spark, path, lambda: F.pmod(F.xxhash64(*keys), F.lit(buckets)))

    @classmethod
    def by_column(cls, spark: SparkSession, path: str, column: str) -> "Snapshot":
        return cls(spark, path, lambda: F.col(column))

    # -- reading ---------------------------------------------------------------

    def head(self) -> Version:
        """The newest version; number 0 where nothing was ever committed."""
        try:
            versions = self.spark.read.schema(f"{MANIFEST}, v long").parquet(f"{self.path}/versions")
            newest = versions.agg(F.max("v").alias("v")).first()["v"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            newest = None
        if newest is None:
            return Version()
        row = versions.filter(F.col("v") == newest).first()
        return Version(newest, row["schema"], dict(row["ledger"]), {p: list(d) for p, d in row["parts"].items()})

    def read(self, parts=None, head: Version | None = None) -> DataFrame:
        """All rows, or those of the ``parts`` named; only their folders are listed."""
        head = head or self.head()
        if head.schema is None:
            raise FileNotFoundError(f"no version of {self.path}")
        schema = StructType.fromJson(json.loads(head.schema))
        dirs = [d for p, ds in sorted(head.parts.items()) if parts is None or p in parts for d in ds]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in dirs])

    def done(self, writer: str, batch: int | None, head: Version | None = None) -> bool:
        return batch is not None and (head or self.head()).ledger.get(writer, -1) >= batch

    def part(self) -> Column:
        return F.coalesce(self._part().cast("string"), F.lit("none"))

    def parts_of(self, df: DataFrame) -> list[str]:
        """The parts that rows of ``df`` lie in: a month or a bucket each, so a short list."""
        return [r[0] for r in df.select(self.part().alias(PART)).distinct().collect()]

    # -- commits ---------------------------------------------------------------

    def commit(self, df: DataFrame, gone=(), writer: str = "", batch: int | None = None, add: bool = False, head: Version | None = None) -> bool:
        """Write ``df`` and switch to a version with its parts and without those of ``gone`` (None: all) that it doesn't have.

        ``add`` puts the rows beside those of the same parts. False if the writer's ``batch`` was committed before.
        """
        head = head or self.head()
        if self.done(writer, batch, head):
            return False
        at = f"data/{uuid.uuid4()}"
        df.withColumn(PART, self.part()).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{at}")
        made = self.spark.read.schema(StructType.fromJson(df.schema.jsonValue()).add(PART, "string")).parquet(f"{self.path}/{at}")
        names = [r[0] for r in made.select(PART).distinct().collect()]
        if bad := [n for n in names if not NAME.fullmatch(n)]:
            raise ValueError(f"names of parts are letters, digits and _.-: {bad[:3]}")
        out = set(head.parts) if gone is None else set(gone)
        parts = {p: d for p, d in head.parts.items() if p not in out}
        for n in names:
            parts[n] = (parts.get(n, []) if add else []) + [f"{at}/{PART}={n}"]
        ledger = head.ledger | ({writer: batch} if batch is not None else {})
        row = self.spark.createDataFrame([(df.schema.json(), ledger, parts)], MANIFEST)
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/versions/v={head.number + 1}")
        return True

    def replace(self, df: DataFrame, parts=None, writer: str = "", batch: int | None = None) -> bool:
        """``df`` instead of the rows of ``parts`` (None: of all); parts that ``df`` no longer has rows for are gone."""
        return self.commit(df, parts, writer, batch)

    def append(self, df: DataFrame, writer: str = "", batch: int | None = None) -> bool:
        return self.commit(df, (), writer, batch, add=True)

    def merge(self, df: DataFrame, key, version: str, tiebreak: str | None = None, writer: str = "", batch: int | None = None) -> bool:
        """The newest row of each key among the table's and those of ``df``. Only parts with keys of ``df`` are read and rewritten."""
        from .streaming.incremental import latest_per_key
        head = self.head()
        if self.done(writer, batch, head):
            return False
        df = df.persist()
        try:
            touched = self.parts_of(df)
            both = self.read(touched, head).unionByName(df) if head.number else df
            return self.commit(latest_per_key(both, key, version, tiebreak), touched, writer, batch, head=head)
        finally:
            df.unpersist()


def refresh_parts(table: Snapshot, build: Callable[[], DataFrame], touched: DataFrame, column: str = "year_month") -> list[str]:
    """SNK-2: rebuild the touched parts of a mart; those that ``build`` makes no row for any more are removed.

    ``build`` computes the mart for the touched parts only; ``touched`` holds
    their values in ``column``, of the old and the new version of changed rows.
    """
    names = [r[0] for r in touched.select(F.coalesce(F.col(column).cast("string"), F.lit("none"))).distinct().collect()]
    table.replace(build(), names)
    return sorted(names)


class HighWaterMarks:
    """INC-1: how far each endpoint has been loaded; moved only after a load is committed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Snapshot.by_column(spark, path, "endpoint")

    def get(self, endpoint: str):
        head = self.table.head()
        rows = self.table.read([endpoint], head).collect() if endpoint in head.parts else []
        return rows[0]["mark"] if rows else None

    def load(self, endpoint: str, source: DataFrame, column: str, commit: Callable[[DataFrame], None]):
        """Give the rows from the mark on (inclusive: equal times may have come later) to ``commit``, then move the mark.

        If ``commit`` fails the mark stays, and the next load reads the same rows
        again; ``commit`` must therefore bear rows it has seen (a merge does).
        """
        mark = self.get(endpoint)
        delta = source if mark is None else source.where(F.col(column) >= F.lit(mark))
        top = delta.agg(F.max(column).alias("mark"))     # fixed before the load: rows that come meanwhile are the next one's
        reached = top.first()["mark"]
        if reached is None:
            return mark
        commit(delta.where(F.col(column) <= F.lit(reached)))
        kind = source.schema[column].dataType.simpleString()
        self.table.replace(self.spark.createDataFrame([(endpoint, reached)], f"endpoint string, mark {kind}"), [endpoint])
        return reached
