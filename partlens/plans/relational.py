"""As-of joins, dedup, precedence unions, emulated upserts and lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.operators import relational as R


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rates(spark: SparkSession, d: str) -> DataFrame:
    """A daily rate series for each priority, with gaps: the mean order price of a day, in thousands."""
    return _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("ccy"), F.to_date("o_orderdate").alias("valid")).agg(F.round(F.avg("o_totalprice") / 1000, 6).alias("rate"))


_RATES = "rates AS (SELECT o_orderpriority AS ccy, CAST(o_orderdate AS DATE) AS valid, round(avg(o_totalprice) / 1000, 6) AS rate FROM orders GROUP BY 1, 2)"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """(l_orderkey, l_linenumber, ccy, day): one row for each line item; repeated keys stay rows."""
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ccy"))
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "ccy", F.date_sub("day", 200).alias("day"))


_FACTS = "facts AS (SELECT l_orderkey, l_linenumber, o_orderpriority AS ccy, CAST(CAST(l_shipdate AS DATE) - INTERVAL 200 DAY AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


BASE = "5-LOW"


def fx_asof_keyed(spark, d):
    return R.asof_join(_facts(spark, d), _rates(spark, d), "day", "valid", "rate", ["ccy"], lambda t: F.trunc(t, "month"))


def fx_asof_single(spark, d):
    one = _rates(spark, d).where("ccy = '1-URGENT'").drop("ccy")
    # a series without keys is small: densified to a daily calendar it joins by equality and is broadcast
    last = Window.orderBy("valid")
    steps = one.groupBy("valid").agg(F.max("rate").alias("rate")).withColumn("next", F.coalesce(F.lead("valid").over(last), F.lit("2100-01-01").cast("date")))
    days = steps.select(F.explode(F.sequence("valid", F.date_sub("next", 1), F.expr("interval 1 day"))).alias("day"), "rate")
    return _facts(spark, d).join(days, "day", "left").select("l_orderkey", "l_linenumber", "day", "rate")


def fx_asof_fallback(spark, d):
    f = R.asof_join(_facts(spark, d), _rates(spark, d), "day", "valid", "rate", ["ccy"], lambda t: F.trunc(t, "month"))
    ends = _rates(spark, d).groupBy("ccy").agg(F.min_by("rate", "valid").alias("earliest"), F.max_by("rate", "valid").alias("latest"))
    x = f.join(ends, "ccy", "left")
    base = F.when(F.col("ccy") == BASE, 1.0)  # against itself a currency is 1, whatever was quoted
    return x.select("l_orderkey", "l_linenumber", F.coalesce(base, "rate", "earliest").alias("rate_e"), F.coalesce(base, "rate", "latest").alias("rate_l"), F.col("rate").isNull().alias("is_fallback"))


def rate_lookup_as_of(spark, d):
    return _rates(spark, d).where("valid <= DATE '1998-06-30'").groupBy("ccy").agg(F.max_by("rate", "valid").alias("rate"), F.max("valid").alias("valid"))


def dedup_latest(spark, d):
    e = _t(spark, d, "events")
    return R.latest_per_key(e, ["user_id", "event_type"], F.desc_nulls_last("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


def dedup_first_alt_key(spark, d):
    o = _t(spark, d, "orders").withColumn("k", F.coalesce(F.nullif(F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string")), F.lit("")), F.concat(F.lit("h"), F.col("o_orderkey").cast("string"))))
    return R.latest_per_key(o, ["k"], F.asc("o_orderkey")).select("k", "o_orderkey")


def is_current_flag(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("ts"), F.desc("event_id"))
    return _t(spark, d, "events").select("event_id", "user_id", (F.row_number().over(w) == 1).alias("is_current"))


def precedence_union(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    a = o.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v")).withColumn("src", F.lit("governed"))
    b = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v")).withColumn("src", F.lit("algorithmic"))
    return R.precedence_union(a, b, "o_custkey")


def union_all_tagged(spark, d):
    c = _t(spark, d, "customer").select(F.lit("customer").alias("src"), F.col("c_nationkey").alias("nk"), F.col("c_acctbal").alias("bal"))
    s = _t(spark, d, "supplier").select(F.lit("supplier").alias("src"), F.col("s_nationkey").alias("nk"), F.col("s_acctbal").alias("bal"))
    return c.unionByName(s).groupBy("src", "nk").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 2).alias("bal"))


def union_distinct(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("nk")).union(_t(spark, d, "supplier").select("s_nationkey")).distinct()


def anti_join_new_rows(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


def _old(spark, d):
    return _t(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_acctbal")


def _new(spark, d):
    return _t(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1000).alias("c_acctbal"))


_OLDNEW = "WITH o AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_acctbal + 1000 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)"


def insert_ignore(spark, d):
    return R.insert_ignore(_old(spark, d), _new(spark, d), ["c_custkey"])


def upsert_latest_wins(spark, d):
    return R.upsert(_old(spark, d), _new(spark, d), ["c_custkey"])


def conditional_upsert_greatest(spark, d):
    return _old(spark, d).unionByName(_new(spark, d)).groupBy("c_custkey").agg(F.max("c_acctbal").alias("c_acctbal"), F.count("*").alias("versions"))


def scoped_replace(spark, d):
    return R.replace_scope(_old(spark, d), _new(spark, d).where("c_custkey <= 500"), F.col("c_custkey") <= 500)


def null_safe_change_detect(spark, d):
    a = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("old"))
    b = _t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("new"))
    return a.join(b, "c_custkey").where(~F.col("old").eqNullSafe(F.col("new")))


def expected_vs_done_pairs(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey")
    c = _t(spark, d, "customer")
    pairs = F.broadcast(n).crossJoin(F.broadcast(c.select("c_mktsegment").distinct()))  # 25 by 5 at every scale
    done = c.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
    return pairs.join(done, ["n_nationkey", "c_mktsegment"], "left_anti").select("n_nationkey", "c_mktsegment")


def conditional_left_joins_pick(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_returnflag", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    key = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    names = _t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("k"), F.col("p_name").alias("name")).unionByName(_t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"), F.col("s_name").alias("name")))
    return li.withColumn("k", key).join(names, "k", "left").groupBy("l_returnflag", "name").agg(F.sum("n").alias("n"))


def join_two_path_fallback(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("uid"), F.col("o_custkey").alias("id"))
    c = _t(spark, d, "customer").where("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    k = o.withColumn("k", F.coalesce("uid", "id"))  # a set uid that is missing never falls back
    return k.join(c, F.col("k") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


def wildcard_policy_join(spark, d):
    policy = spark.createDataFrame([("Brand#11", "HIGH"), ("Brand#22", "LOW"), ("ANY", "MEDIUM")], "seg string, level string")
    p = _t(spark, d, "part").select("p_partkey", "p_brand")
    exact = policy.where("seg <> 'ANY'").select(F.col("seg").alias("p_brand"), F.col("level").alias("exact"))
    wild = policy.where("seg = 'ANY'").select(F.col("level").alias("wild"))
    return p.join(F.broadcast(exact), "p_brand", "left").crossJoin(F.broadcast(wild)).select("p_partkey", F.coalesce("exact", "wild").alias("level"))


def sibling_lookup(spark, d):
    w = Window.partitionBy("p_brand", "p_type")
    has = F.col("p_name").contains("a").cast("int")
    return _t(spark, d, "part").select("p_partkey", (F.count("*").over(w) - 1).alias("siblings"), (F.sum(has).over(w) - has).alias("with_a"))


def retention_keep_n(spark, d):
    e = _t(spark, d, "events").withColumn("run", F.to_date("ts"))
    runs = e.groupBy("run").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return runs.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("run")))).select("run", "n", "lo", "hi", (F.col("rk") <= 5).alias("kept"))


_K = "CASE WHEN o_custkey % 3 = 0 THEN 'h' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END"
QUERIES = {f.__name__: f for f in (fx_asof_keyed, fx_asof_single, fx_asof_fallback, rate_lookup_as_of, dedup_latest, dedup_first_alt_key, is_current_flag, precedence_union, union_all_tagged, union_distinct, anti_join_new_rows, insert_ignore, upsert_latest_wins, conditional_upsert_greatest, scoped_replace, null_safe_change_detect, expected_vs_done_pairs, conditional_left_joins_pick, join_two_path_fallback, wildcard_policy_join, sibling_lookup, retention_keep_n)}
ORACLE_SQL = {
    "fx_asof_keyed": f"WITH {_RATES}, {_FACTS} SELECT l_orderkey, l_linenumber, f.ccy AS ccy, day, rate FROM facts f ASOF LEFT JOIN rates r ON f.ccy = r.ccy AND f.day >= r.valid",
    "fx_asof_single": f"WITH {_RATES}, {_FACTS} SELECT l_orderkey, l_linenumber, day, rate FROM facts f ASOF LEFT JOIN (SELECT valid, rate FROM rates WHERE ccy = '1-URGENT') r ON f.day >= r.valid",
    "fx_asof_fallback": f"WITH {_RATES}, {_FACTS}, e AS (SELECT ccy, arg_min(rate, valid) AS earliest, arg_max(rate, valid) AS latest FROM rates GROUP BY 1) SELECT l_orderkey, l_linenumber, CASE WHEN f.ccy = '{BASE}' THEN 1.0 ELSE coalesce(rate, earliest) END AS rate_e, CASE WHEN f.ccy = '{BASE}' THEN 1.0 ELSE coalesce(rate, latest) END AS rate_l, rate IS NULL AS is_fallback FROM facts f ASOF LEFT JOIN rates r ON f.ccy = r.ccy AND f.day >= r.valid LEFT JOIN e ON e.ccy = f.ccy",
    "rate_lookup_as_of": f"WITH {_RATES} SELECT ccy, arg_max(rate, valid) AS rate, max(valid) AS valid FROM rates WHERE valid <= DATE '1998-06-30' GROUP BY 1",
    "dedup_latest": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1",
    "dedup_first_alt_key": f"SELECT {_K} AS k, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
    "is_current_flag": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1 AS is_current FROM events",
    "precedence_union": "WITH a AS (SELECT o_custkey, max(o_totalprice) AS v, 'governed' AS src FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS v, 'algorithmic' AS src FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)",
    "union_all_tagged": "SELECT src, nk, count(*) AS n, round(sum(bal), 2) AS bal FROM (SELECT 'customer' AS src, c_nationkey AS nk, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2",
    "union_distinct": "SELECT c_nationkey AS nk FROM customer UNION SELECT s_nationkey FROM supplier",
    "anti_join_new_rows": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "insert_ignore": _OLDNEW + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)",
    "upsert_latest_wins": _OLDNEW + " SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)",
    "conditional_upsert_greatest": _OLDNEW + " SELECT c_custkey, max(c_acctbal) AS c_acctbal, count(*) AS versions FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1",
    "scoped_replace": _OLDNEW + " SELECT * FROM o WHERE c_custkey > 500 UNION ALL SELECT * FROM n WHERE c_custkey <= 500",
    "null_safe_change_detect": "SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS old, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS new FROM customer WHERE (CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END) IS DISTINCT FROM (CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END)",
    "expected_vs_done_pairs": "SELECT n_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000",
    "conditional_left_joins_pick": "SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN p_name WHEN 'R' THEN s_name END AS name, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_returnflag = 'A' LEFT JOIN supplier ON s_suppkey = l_suppkey AND l_returnflag = 'R' GROUP BY 1, 2",
    "join_two_path_fallback": "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0",
    "wildcard_policy_join": "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'HIGH' WHEN 'Brand#22' THEN 'LOW' ELSE 'MEDIUM' END AS level FROM part",
    "sibling_lookup": "SELECT p_partkey, count(*) OVER w - 1 AS siblings, sum(CAST(contains(p_name, 'a') AS INT)) OVER w - CAST(contains(p_name, 'a') AS INT) AS with_a FROM part WINDOW w AS (PARTITION BY p_brand, p_type)",
    "retention_keep_n": "SELECT run, n, lo, hi, row_number() OVER (ORDER BY run DESC) <= 5 AS kept FROM (SELECT CAST(ts AS DATE) AS run, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1)",
}
