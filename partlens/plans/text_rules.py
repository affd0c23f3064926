"""Matching, cleaning and identity queries over the star schema's names of parts, customers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.functions import text as X


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def title_normalise(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.normalize_title(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  X "))).alias("t"))


def slug_id(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.slug_id(F.col("p_brand"), F.col("p_type"), F.when(F.col("p_size") % 2 > 0, F.col("p_name"))).alias("id"))


def alnum_distinctive(spark, d):
    n = X.alnum_count(F.col("p_brand"))
    return _t(spark, d, "part").groupBy("p_brand").agg(F.max(n).alias("n"), F.max(n >= 5).alias("distinctive"))


def stable_uid_hash(spark, d):
    return _t(spark, d, "customer").select("c_custkey", X.stable_uid("EV-ACTIVE-", F.lit("active"), F.when(F.col("c_custkey") % 11 > 0, F.col("c_mktsegment")), F.col("c_custkey").cast("string")).alias("uid"))


def url_item_id(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract(u, r"/(\d+)(?:[^0-9/][^/]*)?/?$", 1), F.lit("")).try_cast("long").alias("item"), F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"))


def json_bucket_roundtrip(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.to_json(F.array(F.struct(F.lit("0-30").alias("bucket"), F.col("p_size").alias("units")), F.struct(F.lit("31+").alias("bucket"), (F.col("p_size") * 2).alias("units")))).alias("j"))
    return p.select("p_partkey", F.explode(F.from_json("j", "array<struct<bucket string, units int>>")).alias("x")).groupBy("p_partkey").agg(F.sum("x.units").alias("units"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"
QUERIES = {f.__name__: f for f in (title_normalise, slug_id, alnum_distinctive, stable_uid_hash, url_item_id, json_bucket_roundtrip)}
ORACLE_SQL = {
    "title_normalise": "SELECT p_partkey, trim(regexp_replace(lower(p_name) || '  x ', '\\s+', ' ', 'g')) AS t FROM part",
    "slug_id": "SELECT p_partkey, " + _SLUG.format("p_brand") + " || '_' || " + _SLUG.format("p_type") + " || '_' || CASE WHEN p_size % 2 > 0 THEN " + _SLUG.format("p_name") + " ELSE 'unknown' END AS id FROM part",
    "alnum_distinctive": "SELECT p_brand, max(length(regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g'))) AS n, max(length(regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g')) >= 5) AS distinctive FROM part GROUP BY 1",
    "stable_uid_hash": "SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN 'EV-ACTIVE-' || sha256('active|' || c_mktsegment || '|' || c_custkey) END AS uid FROM customer",
    "url_item_id": "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/(\\d+)(?:[^0-9/][^/]*)?/?$', 1), '') AS BIGINT) AS item, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages",
    "json_bucket_roundtrip": "SELECT p_partkey, CAST(sum(p_size * 3) AS BIGINT) AS units FROM part GROUP BY 1",
}
