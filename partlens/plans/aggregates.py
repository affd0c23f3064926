"""Aggregations, windows, portfolio rollups, sampling and validation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.functions import stats as S
from partlens.operators import relational as R
from partlens.operators.sinks import numbered
from partlens.plans.valuation import _RATES, rates


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def robust_price_stats_mad(spark, d):
    li = _t(spark, d, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    x = S.robust_stats(li, "l_partkey", "price")
    return x.select("l_partkey", "n", *[F.round(c, 4).alias(c) for c in ("med", "q1", "q3", "mad")])


def outlier_counts(spark, d):
    li = _t(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"))
    return S.robust_stats(li, "l_partkey", "price").select("l_partkey", "outliers")


def conditional_counts(spark, d):
    o = _t(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2).alias("open_value"), F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).cast("long").alias("has_urgent"))


def distinct_case_counts(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned_parts"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_orderkey"))).alias("big_orders"))


def filtered_counts(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.expr("count(*) FILTER (WHERE value > 50)").alias("high"), F.expr("count(DISTINCT user_id) FILTER (WHERE value <= 50)").alias("low_users"))


def two_level_evidence_stats(spark, d):
    li = _t(spark, d, "lineitem")
    one = li.groupBy("l_orderkey", "l_partkey").agg(F.median("l_extendedprice").alias("price"), F.max("l_quantity").alias("units"))
    return one.groupBy("l_partkey").agg(F.sum("units").alias("units"), F.round(F.median("price"), 4).alias("med"), F.round(F.percentile("price", 0.25), 4).alias("q1"), F.round(F.percentile("price", 0.75), 4).alias("q3"))


def arg_max_latest(spark, d):
    v = F.when(F.col("value") > 20, F.col("value"))
    return _t(spark, d, "events").groupBy("user_id").agg(F.max_by(v, F.when(v.isNotNull(), F.struct("ts", "event_id"))).alias("last_value"), F.max("event_id").alias("last_event"))


def string_agg_distinct(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.expr("listagg(DISTINCT o_orderpriority, ', ') WITHIN GROUP (ORDER BY o_orderpriority)").alias("priorities"))


def collision_map_having(spark, d):
    return _t(spark, d, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands"), F.min("p_partkey").alias("anchor")).where("brands > 1")


def seller_profile_hhi(spark, d):
    n = _t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))  # 25 rows
    return share.agg(F.round(F.sum(F.pow("share", F.lit(2))), 2).alias("hhi"), F.max("share").alias("top"), F.count("*").alias("groups"))


def duplicate_group_size(spark, d):
    h = F.substring(F.sha2("text", 256), 1, 16)
    return _t(spark, d, "documents").select("doc_id", h.alias("gid")).withColumn("size", F.count("*").over(Window.partitionBy("gid")))


def aggregate_duplicates_anchor(spark, d):
    return _t(spark, d, "part").groupBy("p_name").agg(F.sum("p_size").alias("stock"), F.min("p_partkey").alias("anchor"), F.min_by("p_brand", "p_partkey").alias("brand"), F.max("p_size").alias("worst"))


def status_summary_cascade(spark, d):
    x = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    status = F.when(F.col("p") > 0, "REVIEW").when(F.col("f") > F.col("o"), "CONFIRMED").when(F.col("o") > 0, "CANDIDATE").otherwise("NONE")
    return x.select("o_custkey", "p", "f", "o", status.alias("status"))


def weakest_tier(spark, d):
    rank = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(rank).cast("long").alias("tier"))


def histogram_overflow(spark, d):
    b = F.least(F.floor(F.col("p_retailprice") / 100), F.lit(15)).cast("long")
    return _t(spark, d, "part").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min("p_retailprice").alias("lo"))


def sell_time_bins(spark, d):
    bins = spark.createDataFrame([("Fast", -1e9, 30.0), ("Medium", 31.0, 183.0), ("Slow", 184.0, 1e9)], "label string, lo double, hi double")
    x = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.datediff("l_shipdate", "o_orderdate").alias("days"))
    label = F.when(F.col("days") <= 30, "Fast").when(F.col("days").between(31, 183), "Medium").when(F.col("days") >= 184, "Slow")
    return bins.join(x.groupBy(label.alias("label")).agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def top_n_others(spark, d):
    return R.top_n_others(_t(spark, d, "part"), "p_brand", 5)


def brand_share(spark, d):
    n = _t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("v"))
    return n.select("p_brand", "n", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 3).alias("pct"), F.round("v", 2).alias("v"))


def bucket_rollup(spark, d):
    p = _t(spark, d, "part")
    edges = [0, 10, 20, 30, 40, 1000]
    cols = [F.sum(F.when((F.col("p_size") > a) & (F.col("p_size") <= b), F.col("p_size"))).alias(f"u{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return p.groupBy("p_type").agg(*cols, F.round(F.sum(F.col("p_size") * F.col("p_retailprice")), 2).alias("revenue"))


def confusion_matrix(spark, d):
    x = _t(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count("toxic"))
    return x.select("quality", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


def precision_recall_f1(spark, d):
    y, p = F.col("toxic") == 1, F.col("quality") == 0
    x = _t(spark, d, "labels").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    pr, rc = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return x.select("tp", "fp", "fn", F.round(pr, 5).alias("p"), F.round(rc, 5).alias("r"), F.round(F.try_divide(2 * pr * rc, pr + rc), 5).alias("f1"))


def majority_label_ties(spark, d):
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id")
    top = n.withColumn("top", F.max("n").over(w)).where("n = top")
    return top.groupBy("user_id").agg(F.min("event_type").alias("label"), (F.count("*") > 1).alias("tie"), F.first("top").alias("n"))


def round_robin_priority(spark, d):
    p = _t(spark, d, "part")
    own = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    x = p.withColumn("turn", own)
    ranked = numbered(spark, x.select("p_partkey", "p_size", F.col("turn").cast("long").alias("turn")), [F.asc("turn"), F.desc("p_size"), F.asc("p_partkey")], "priority")
    return ranked.select("p_partkey", "turn", "priority")


def lowest_tier_merge(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.min_by("l_returnflag", F.struct("l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice")).alias("flag"), F.min("l_linenumber").cast("long").alias("tier"))


def search_filter_sort(spark, d):
    p = _t(spark, d, "part")
    hit = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("e")
    return p.where(hit & (F.col("p_size") >= 20)).orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_retailprice")


def topk_nulls_last(spark, d):
    v = F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal"))
    return _t(spark, d, "customer").select("c_custkey", v.alias("v")).orderBy(F.asc_nulls_last("v"), "c_custkey").limit(25)


def profile_null_dup_rates(spark, d):
    x = _t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_discount")).alias("v"), "l_orderkey", "l_linenumber")
    keys = x.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c"), F.count("v").alias("k"), F.sum("v").alias("s"))
    return keys.agg(F.sum("c").alias("n"), F.round(1 - F.sum("k") / F.sum("c"), 6).alias("null_rate"), F.round(F.sum(F.col("c") - 1) / F.sum("c"), 6).alias("dup_rate"), F.round(F.sum("s") / F.sum("k"), 6).alias("mean"))


def cross_source_agreement(spark, d):
    o = _t(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_set(F.trunc("o_orderdate", "month")).alias("da"), F.avg("o_totalprice").alias("pa"))
    b = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.collect_set(F.trunc("o_orderdate", "month")).alias("db"), F.avg("o_totalprice").alias("pb"))
    return a.join(b, "o_custkey").select("o_custkey", F.arrays_overlap("da", "db").alias("same_month"), (F.abs(F.col("pa") - F.col("pb")) <= 0.1 * F.greatest("pa", "pb")).alias("close"))


def set_coverage_compare(spark, d):
    hit = lambda c: F.max(F.when(c & F.col("user_id").isNotNull(), 1).otherwise(0))
    x = _t(spark, d, "events").groupBy("event_type", "user_id").agg(hit(F.col("value") > 60).alias("a"), hit(F.col("value") <= 10).alias("b"))
    n = lambda c, name: F.sum(c).cast("int").alias(name)
    return x.groupBy("event_type").agg(n(F.col("a"), "n_a"), n(F.col("b"), "n_b"), n(F.greatest("a", "b"), "n_any"), n(F.col("a") * F.col("b"), "n_both"))


def false_match_breakdown(spark, d):
    x = _t(spark, d, "lineitem").where("l_returnflag <> 'N'")
    cat = F.when(F.col("l_tax") > 0.06, "TAX").when(F.col("l_discount") > 0.07, "DISCOUNT").when(F.col("l_quantity") > 40, "QUANTITY").otherwise("OTHER")
    n = x.groupBy("l_returnflag", cat.alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("l_returnflag")), 4))


def largest_remainder_allocation(spark, d):
    p = _t(spark, d, "part").withColumn("x", F.col("p_retailprice") / F.sum("p_retailprice").over(Window.partitionBy("p_brand")) * 100)
    p = p.withColumn("base", F.floor("x"))
    left = 100 - F.sum("base").over(Window.partitionBy("p_brand"))
    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(F.round(F.col("x") - F.col("base"), 9)), "p_partkey"))
    return p.withColumn("left", left).withColumn("rn", rn).select("p_partkey", (F.col("base") + (F.col("rn") <= F.col("left")).cast("long")).alias("units"))


def long_format_two_measures(spark, d):
    li = _t(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return li.unpivot(["l_returnflag"], ["l_discount", "l_tax"], "measure", "v").groupBy("l_returnflag", "measure").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


def json_extract(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _t(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def monte_carlo_units(spark, d):
    """Units sold within 30 and 90 days: mean, p5 and p95 of a binomial draw over the stock, exact in place of the reference's 2,000 random trials."""
    rate = rates(spark, d).select(F.col("item").alias("p_partkey"), "rate")
    stock = F.greatest(F.coalesce("p_size", F.lit(0)), F.lit(0)).cast("int")
    x = _t(spark, d, "part").select("p_partkey", stock.alias("n")).join(rate, "p_partkey", "left")
    for days in (30, 90):
        p = F.coalesce(S.sold_by(F.col("rate"), days), F.lit(0.0))  # never sold: never sells
        x = x.withColumn(f"mean{days}", F.round(F.col("n") * p, 4)).withColumn("q", S.binomial_quantiles(F.col("n"), p))
        x = x.select("*", F.col("q.q0").alias(f"p5_{days}"), F.col("q.q1").alias(f"p95_{days}")).drop("q")
    return x.drop("rate").withColumnRenamed("n", "units")


_ROB = "WITH s AS (SELECT l_partkey, {v} AS price FROM lineitem), m AS (SELECT l_partkey, count(price) AS n, median(price) AS med, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM s GROUP BY 1), a AS (SELECT l_partkey, median(abs(price - med)) AS mad FROM s JOIN m USING (l_partkey) GROUP BY 1)"
QUERIES = {f.__name__: f for f in (robust_price_stats_mad, outlier_counts, conditional_counts, distinct_case_counts, filtered_counts, two_level_evidence_stats, arg_max_latest, string_agg_distinct, collision_map_having, seller_profile_hhi, duplicate_group_size, aggregate_duplicates_anchor, status_summary_cascade, weakest_tier, histogram_overflow, sell_time_bins, top_n_others, brand_share, bucket_rollup, confusion_matrix, precision_recall_f1, majority_label_ties, round_robin_priority, lowest_tier_merge, search_filter_sort, topk_nulls_last, profile_null_dup_rates, cross_source_agreement, set_coverage_compare, false_match_breakdown, largest_remainder_allocation, long_format_two_measures, json_extract, monte_carlo_units)}
_PMF = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + CASE WHEN k > 0 THEN k * ln(greatest(p, 1e-300)) ELSE 0 END + CASE WHEN k < n THEN (n - k) * ln(greatest(1 - p, 1e-300)) ELSE 0 END)"
ORACLE_SQL = {
    "monte_carlo_units": _RATES + f", u AS (SELECT p_partkey, greatest(coalesce(p_size, 0), 0) AS n, rate, days FROM part LEFT JOIN rs ON item = p_partkey, (SELECT unnest([30, 90]) AS days)), v AS (SELECT *, coalesce(1 - exp(-rate * days / 30e0), 0) AS p FROM u), k AS (SELECT *, unnest(generate_series(0, n)) AS k FROM v), c AS (SELECT *, sum({_PMF}) OVER (PARTITION BY p_partkey, days ORDER BY k) AS cdf FROM k), q AS (SELECT p_partkey, n, days, any_value(p) AS p, coalesce(min(k) FILTER (WHERE cdf > 0.05), n) AS lo, coalesce(min(k) FILTER (WHERE cdf > 0.95), n) AS hi FROM c GROUP BY 1, 2, 3) SELECT p_partkey, n AS units, " + ", ".join(f"max(CASE WHEN days = {d} THEN {x} END) AS {name}{d}" for d in (30, 90) for x, name in (("round(n * p, 4)", "mean"), ("lo", "p5_"), ("hi", "p95_"))) + " FROM q GROUP BY 1, 2",
    "robust_price_stats_mad": _ROB.format(v="l_extendedprice / l_quantity") + " SELECT l_partkey, n, round(med, 4) AS med, round(q1, 4) AS q1, round(q3, 4) AS q3, round(mad, 4) AS mad FROM m JOIN a USING (l_partkey)",
    "outlier_counts": _ROB.format(v="l_extendedprice") + " SELECT l_partkey, count(*) FILTER (WHERE CASE WHEN mad > 0 THEN abs(price - med) > 3.5 * 1.4826 * mad WHEN q3 - q1 > 0 THEN price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) END) AS outliers FROM s JOIN m USING (l_partkey) JOIN a USING (l_partkey) GROUP BY 1",
    "conditional_counts": "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS open_value, CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS has_urgent FROM orders GROUP BY 1",
    "distinct_case_counts": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_parts, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_orderkey END) AS big_orders FROM lineitem GROUP BY 1",
    "filtered_counts": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) FILTER (WHERE value <= 50) AS low_users FROM events GROUP BY 1",
    "two_level_evidence_stats": "SELECT l_partkey, sum(units) AS units, round(median(price), 4) AS med, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.75), 4) AS q3 FROM (SELECT l_orderkey, l_partkey, median(l_extendedprice) AS price, max(l_quantity) AS units FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "arg_max_latest": "SELECT user_id, arg_max(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL) AS last_value, max(event_id) AS last_event FROM (SELECT *, CASE WHEN value > 20 THEN value END AS v FROM events) GROUP BY 1",
    "string_agg_distinct": "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1",
    "collision_map_having": "SELECT p_name, count(DISTINCT p_brand) AS brands, min(p_partkey) AS anchor FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "seller_profile_hhi": "SELECT round(sum(share * share), 2) AS hhi, max(share) AS top, count(*) AS groups FROM (SELECT round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM supplier GROUP BY s_nationkey)",
    "duplicate_group_size": "SELECT doc_id, substr(sha256(text), 1, 16) AS gid, count(*) OVER (PARTITION BY substr(sha256(text), 1, 16)) AS size FROM documents",
    "aggregate_duplicates_anchor": "SELECT p_name, sum(p_size) AS stock, min(p_partkey) AS anchor, arg_min(p_brand, p_partkey) AS brand, max(p_size) AS worst FROM part GROUP BY 1",
    "status_summary_cascade": "SELECT *, CASE WHEN p > 0 THEN 'REVIEW' WHEN f > o THEN 'CONFIRMED' WHEN o > 0 THEN 'CANDIDATE' ELSE 'NONE' END AS status FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1)",
    "weakest_tier": "SELECT l_orderkey, CAST(min(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS BIGINT) AS tier FROM lineitem GROUP BY 1",
    "histogram_overflow": "SELECT CAST(least(floor(p_retailprice / 100), 15) AS BIGINT) AS bin, count(*) AS n, min(p_retailprice) AS lo FROM part GROUP BY 1",
    "sell_time_bins": "WITH x AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT 'Fast' AS label, count(*) FILTER (WHERE days <= 30) AS n FROM x UNION ALL SELECT 'Medium', count(*) FILTER (WHERE days BETWEEN 31 AND 183) FROM x UNION ALL SELECT 'Slow', count(*) FILTER (WHERE days >= 184) FROM x",
    "top_n_others": "SELECT CASE WHEN r <= 5 THEN p_brand ELSE 'Others' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1) GROUP BY 1",
    "brand_share": "SELECT p_brand, count(*) AS n, round(count(*) * 100::DOUBLE / sum(count(*)) OVER (), 3) AS pct, round(sum(p_retailprice), 2) AS v FROM part GROUP BY 1",
    "bucket_rollup": "SELECT p_type, " + ", ".join(f"CAST(sum(CASE WHEN p_size > {a} AND p_size <= {b} THEN p_size END) AS BIGINT) AS u{i}" for i, (a, b) in enumerate([(0, 10), (10, 20), (20, 30), (30, 40), (40, 1000)])) + ", round(sum(p_size * p_retailprice), 2) AS revenue FROM part GROUP BY 1",
    "confusion_matrix": "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY 1",
    "precision_recall_f1": "WITH x AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality <> 0) AS fn FROM labels) SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 5) AS p, round(tp / nullif(tp + fn, 0)::DOUBLE, 5) AS r, round(2 * (tp / nullif(tp + fp, 0)::DOUBLE) * (tp / nullif(tp + fn, 0)::DOUBLE) / nullif(tp / nullif(tp + fp, 0)::DOUBLE + tp / nullif(tp + fn, 0)::DOUBLE, 0), 5) AS f1 FROM x",
    "majority_label_ties": "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT * FROM n QUALIFY n = max(n) OVER (PARTITION BY user_id)) SELECT user_id, min(event_type) AS label, count(*) > 1 AS tie, min(n) AS n FROM t GROUP BY 1",
    "round_robin_priority": "SELECT p_partkey, turn, row_number() OVER (ORDER BY turn, p_size DESC, p_partkey) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS turn FROM part)",
    "lowest_tier_merge": "SELECT l_partkey, arg_min(l_returnflag, (l_linenumber, l_orderkey, l_suppkey, l_extendedprice)) AS flag, CAST(min(l_linenumber) AS BIGINT) AS tier FROM lineitem GROUP BY 1",
    "search_filter_sort": "SELECT p_partkey, p_retailprice FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'e') AND p_size >= 20 ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50",
    "topk_nulls_last": "SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS v FROM customer ORDER BY v ASC NULLS LAST, c_custkey LIMIT 25",
    "profile_null_dup_rates": "WITH x AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS v, l_orderkey, l_linenumber FROM lineitem) SELECT count(*) AS n, round(1 - count(v)::DOUBLE / count(*), 6) AS null_rate, round((count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::DOUBLE / count(*), 6) AS dup_rate, round(avg(v), 6) AS mean FROM x",
    "cross_source_agreement": "WITH a AS (SELECT o_custkey, list(DISTINCT date_trunc('month', o_orderdate)) AS da, avg(o_totalprice) AS pa FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT date_trunc('month', o_orderdate)) AS db, avg(o_totalprice) AS pb FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT o_custkey, list_has_any(da, db) AS same_month, abs(pa - pb) <= 0.1 * greatest(pa, pb) AS close FROM a JOIN b USING (o_custkey)",
    "set_coverage_compare": "WITH x AS (SELECT event_type, user_id, max(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS a, max(CASE WHEN value <= 10 THEN 1 ELSE 0 END) AS b FROM events WHERE true GROUP BY 1, 2) SELECT event_type, CAST(sum(a) AS INT) AS n_a, CAST(sum(b) AS INT) AS n_b, CAST(sum(greatest(a, b)) AS INT) AS n_any, CAST(sum(a * b) AS INT) AS n_both FROM x GROUP BY 1",
    "false_match_breakdown": "WITH n AS (SELECT l_returnflag, CASE WHEN l_tax > 0.06 THEN 'TAX' WHEN l_discount > 0.07 THEN 'DISCOUNT' WHEN l_quantity > 40 THEN 'QUANTITY' ELSE 'OTHER' END AS category, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2) SELECT *, round(n * 100::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag), 4) AS pct FROM n",
    "largest_remainder_allocation": "WITH x AS (SELECT p_partkey, p_brand, p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand) * 100 AS x FROM part), y AS (SELECT *, 100 - sum(floor(x)) OVER (PARTITION BY p_brand) AS left_, row_number() OVER (PARTITION BY p_brand ORDER BY round(x - floor(x), 9) DESC, p_partkey) AS rn FROM x) SELECT p_partkey, CAST(floor(x) + CAST(rn <= left_ AS INT) AS BIGINT) AS units FROM y",
    "long_format_two_measures": "SELECT l_returnflag, 'l_discount' AS measure, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_tax', count(*), round(avg(l_tax), 6) FROM lineitem GROUP BY 1",
    "json_extract": "SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
}
