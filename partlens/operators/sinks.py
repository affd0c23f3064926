"""Sinks over Parquet folders: versions that replace one another whole, dynamic overwrites of a scope, inserts, upserts, reports.

A table is a folder of versions. A version counts once its write is committed (Spark's _SUCCESS), so a reader sees the last
whole one, and a write that fails or is cut off leaves it as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.operators import relational as R
from partlens.storage import materialize


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(conf)
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._versions()[-1]}")

    def replace(self, df: DataFrame, *partition_by: str) -> Table:
        """Full rebuild: the next version holds df alone; whoever reads meanwhile has the one before."""
        n = max(self._versions(), default=0) + 1
        writer = df.write.mode("overwrite")  # what a failed write of this version left goes
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v{n}")
        return self

    def insert_ignore(self, new: DataFrame, keys: Sequence[str]) -> Table:
        """Append rows of keys that aren't there; again the same rows change nothing."""
        return self.replace(R.insert_ignore(self.read(), R.latest_per_key(new, keys, F.xxhash64(*new.columns)), keys) if self.exists() else new)

    def upsert(self, new: DataFrame, keys: Sequence[str]) -> Table:
        return self.replace(R.upsert(self.read(), new, keys))

    def update_from(self, other: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> Table:
        """UPDATE ... FROM: cols of rows with a match take its values; others stay."""
        new = other.select(*keys, F.struct(*cols).alias("__new"))
        x = self.read().join(new, list(keys), "left")
        return self.replace(x.withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in cols}).drop("__new"))

    def clone(self, path: str) -> Table:
        return Table(self.spark, path).replace(self.read())


def overwrite_scope(df: DataFrame, path: str, *partition_by: str) -> None:
    """Only the partitions that df has rows of are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def numbered(spark: SparkSession, df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """df with consecutive numbers in a total order; ranges are numbered apart, and only their sizes meet in one place."""
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(spark, df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row for each range
    x = placed.withColumn("__p", part).join(before, "__p")
    return x.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1) + start).drop("__m", "__p", "__before")


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, quoted by RFC 4180 with CRLF at line ends; for reports, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A summary as one JSON line; what is no number there is null."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    clean = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in doubles})
    clean.coalesce(1).write.mode("overwrite").json(path)
