"""CSV sources as text, with provenance, file hashes, header checks, row hashes and a ledger of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.operators.relational import latest_per_key

#: Columns that tell a source apart, columns it must have, the name under which the ledger has it.
SIGNATURES = {"ebay_sold": ("item_number", "sold_date_iso", "is_sold"), "vcp": ("avg_price_eur", "total_sold")}
REQUIRED = {"ebay_sold": ("item_number", "title", "price_eur", "sold_date_iso"), "vcp": ("avg_price_eur", "total_sold")}
LEDGER_NAME = {"ebay_sold": "historical_ebay_sold", "vcp": "historical"}
TRUE = ("1", "true", "True", "TRUE")
_KEEP = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """df as CSV with a header; quotes are doubled, blanks stay."""
    (df.repartition(files) if files else df).write.option("header", True).options(**_KEEP).option("quoteAll", True).csv(path)


def headers(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, columns) of each file below path, from its first 64 KB; names trimmed, in lower case."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    line = F.element_at(F.split(F.decode(F.substring("content", 1, 1 << 16), "UTF-8"), r"\r?\n"), 1)
    names = F.transform(F.split(line, ","), lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "^﻿", ""), '^"|"$', ""))))
    return raw.select("path", names.alias("columns"))


def hashes(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, hash): the SHA-256 of each file's bytes; a file is read as one value, so it must stay under 2 GB."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.sha2("content", 256).alias("hash"))


def read_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All rows of all CSV files below path as text, with the path of the file; blank cells are empty text, never null.

    Columns are found by name: files with the same header are read together, whatever the order of their columns.
    Missing columns are empty; others are left out.
    """
    known = [tuple(r["columns"]) for r in headers(spark, path).select("columns").distinct().collect()]  # a row for each kind of header
    found = None
    for names in known:
        schema = ", ".join(f"`{i}_{n}` string" for i, n in enumerate(names))
        same = headers(spark, path).where(F.concat_ws("\x1f", "columns") == "\x1f".join(names)).select("path")
        rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("multiLine", False).options(**_KEEP).csv(path)
        rows = rows.select(F.col("_metadata.file_path").alias("file"), *[F.coalesce(F.col(f"`{names.index(c)}_{c}`") if c in names else F.lit(""), F.lit("")).alias(c) for c in columns])
        rows = rows.join(F.broadcast(same), F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace("path", "^file:/+", "/"), "left_semi") if len(known) > 1 else rows  # paths of a folder's files
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], ", ".join(["file string", *[f"`{c}` string" for c in columns]]))


def missing(columns: Column, required: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(c) for c in required]), columns)


def source_type(columns: Column) -> Column:
    """The first source whose signature lies in the columns, else null."""
    out = F.lit(None).cast("string")
    for name, signature in reversed(SIGNATURES.items()):
        out = F.when(F.size(missing(columns, signature)) == 0, name).otherwise(out)
    return out


def plan_drop_folder(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """(path, source, missing, hash, action): each file is rejected, skipped as read before, or routed to its source.

    ledger: (source_type, hash, status).
    """
    x = headers(spark, path).withColumn("source", source_type(F.col("columns")))
    need = F.lit(None).cast("array<string>")
    for name, required in REQUIRED.items():
        need = F.when(F.col("source") == name, F.array_sort(missing(F.col("columns"), required))).otherwise(need)
    x = x.withColumn("missing", need).join(hashes(spark, path), "path")
    name = F.create_map(*[F.lit(v) for kv in LEDGER_NAME.items() for v in kv])[F.col("source")]
    done = ledger.where("status = 'success'").select(F.col("source_type").alias("name"), "hash", F.lit(True).alias("done")).distinct()
    x = x.withColumn("name", name).join(done, ["name", "hash"], "left")
    action = F.when(F.col("source").isNull(), "REJECT unrecognized schema").when(F.size("missing") > 0, F.concat(F.lit("REJECT missing "), F.array_join("missing", ","))).when(F.col("done"), "SKIP").otherwise("ROUTE")
    return x.select("path", "source", "missing", "hash", action.alias("action"))


def row_hash(*cols: str | Column) -> Column:
    return F.sha2(F.concat_ws("||", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]), 256)


def numbers(df: DataFrame, *cols: str) -> DataFrame:
    """What is no number becomes null."""
    return df.withColumns({c: F.trim(c).try_cast("double") for c in cols})


def flag(c: str) -> Column:
    return F.trim(c).isin(*TRUE)


def provenance(own: Column, container: Column) -> Column:
    """A row's own source, unless blank or 'nan'; then the file that holds it."""
    x = F.trim(own)
    return F.when(x.isNull() | (x == "") | (F.lower(x) == "nan"), container).otherwise(x)


def new_rows(rows: DataFrame, known: DataFrame, key: str, *order: Column) -> DataFrame:
    """rows whose key isn't known yet, the first of each key."""
    return latest_per_key(rows.join(known.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key), key, "left_anti"), [key], *order)
