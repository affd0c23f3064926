"""Valuation, turnover and backtests over the star schema: a part is an inventory item, its line items are sales."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.config import CONFIG as C
from partlens.functions import stats as S
from partlens.storage import materialize


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sales(spark: SparkSession, d: str) -> DataFrame:
    """(item, price, vol, day, seller): one row for each sale."""
    return _t(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("vol"), F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("seller"))


def aged(spark: SparkSession, d: str) -> DataFrame:
    s = sales(spark, d)
    ref = s.agg(F.max("day").alias("ref"))  # one row
    return s.crossJoin(F.broadcast(ref)).withColumn("age", S.age_months("day", "ref")).withColumn("w", S.decay_weight("age"))


SALES = "WITH s AS (SELECT l_partkey AS item, l_extendedprice / l_quantity AS price, l_quantity AS vol, CAST(l_shipdate AS DATE) AS day FROM lineitem), r AS (SELECT max(day) AS ref FROM s), a AS (SELECT s.*, ref, greatest(0, date_diff('day', day, ref) / 30.44) AS age, exp(-ln(2) / 12 * greatest(0, date_diff('day', day, ref) / 30.44)) AS w FROM s, r)"


def decay_weighted_value(spark: SparkSession, d: str) -> DataFrame:
    return aged(spark, d).groupBy("item").agg(F.round(S.decayed_mean("price", "vol", "w"), 4).alias("h"), F.count("*").alias("n"), F.sum("vol").alias("total"))


def active_median_discounted(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy(F.desc_nulls_last("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("price"))
    last = li.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return last.groupBy(F.col("l_partkey").alias("item")).agg(F.round(F.median("price") * C.ask_discount, 4).alias("c"), F.count("*").alias("n"))


def price_trend_ols(spark: SparkSession, d: str) -> DataFrame:
    s = aged(spark, d).withColumn("month", -F.col("age"))
    fit = s.groupBy("item").agg(F.regr_slope("price", "month").alias("slope"), F.avg("price").alias("mean"), F.count("*").alias("n"), F.count_distinct("day").alias("days"))
    p = F.when(F.col("days") >= 2, S.clip(F.col("slope") * C.horizon_months / F.col("mean"), -C.trend_clip, C.trend_clip)).otherwise(0.0)
    return fit.select("item", F.round(F.coalesce(p, F.lit(0.0)), 4).alias("p"), "n")


def demand_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    sold = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("sold"))
    parts = _t(spark, d, "part").join(sold, "p_partkey", "left")
    return S.with_pct_rank(parts, "sold", "p_brand", "d").select("p_partkey", "p_brand", F.round("d", 4).alias("d"))


def scarcity_pct_rank(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("offers"))
    parts = _t(spark, d, "part").join(n, "p_partkey", "left")
    x = S.with_pct_rank(parts, "offers", "p_type", "rank").select("p_partkey", "p_type", F.round(1 - F.col("rank"), 4).alias("s"))
    return x.withColumn("flag", F.when(F.col("s") >= 0.66, "SCARCE").when(F.col("s") <= 0.33, "PLENTY").otherwise("NORMAL"))


_RANK = """CASE WHEN n{0} >= 3 THEN (rank() OVER (PARTITION BY {0}, {1} IS NOT NULL ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0) / count(*) OVER (PARTITION BY {0}, {1} IS NOT NULL) ELSE (rank() OVER (PARTITION BY {1} IS NOT NULL ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0) / count(*) OVER (PARTITION BY {1} IS NOT NULL) END"""


def composite_valuation(spark: SparkSession, d: str) -> DataFrame:
    # what the sales tell of an item comes from one pass; its row is written, as ranks ask for it several times
    sold = aged(spark, d).withColumn("month", -F.col("age")).groupBy("item").agg(
        S.decayed_mean("price", "vol", "w").alias("h"), F.count("*").alias("n"), F.regr_slope("price", "month").alias("slope"), F.avg("price").alias("mean"),
        (F.min("day") < F.max("day")).alias("spread"), F.sum("vol").alias("sold"), F.count_distinct("seller").alias("offers"),
    )
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    x = materialize(spark, parts.join(sold, "item", "left"), "valued")
    x = S.with_pct_rank(S.with_pct_rank(x, "sold", "p_brand", "demand"), "offers", "p_type", "rank").where("n IS NOT NULL")
    x = x.join(active_median_discounted(spark, d).select("item", "c"), "item", "left")
    p = F.round(F.coalesce(F.when(F.col("spread"), S.clip(F.col("slope") * C.horizon_months / F.col("mean"), -C.trend_clip, C.trend_clip)), F.lit(0.0)), 4)
    s, dm = F.round(1 - F.col("rank"), 4), F.round("demand", 4)
    price = F.coalesce("h", "c") * (1 + C.alpha * p) * (1 + C.beta * (s - 0.5)) * (1 + C.demand_weight * (dm - 0.5))
    tier = F.when(F.col("n") >= 3, "HIGH").when(F.col("n") >= 1, "MEDIUM").otherwise("LOW")
    band = F.when(F.col("n") >= 3, C.bands[0]).when(F.col("n") >= 1, C.bands[1]).otherwise(C.bands[2])
    return x.select("item", F.round(price, 3).alias("price"), tier.alias("tier"), F.round(price * (1 - band), 3).alias("low"), F.round(price * (1 + band), 3).alias("high"))


_ACTIVE = "SELECT l_partkey AS item, median(price) * 0.79 AS c, count(*) AS n FROM (SELECT *, l_extendedprice / l_quantity AS price, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC, l_extendedprice / l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1"
_TREND = "SELECT item, round(coalesce(CASE WHEN count(DISTINCT day) >= 2 THEN greatest(-0.1, least(0.1, regr_slope(price, -age) * 6 / avg(price))) ELSE 0 END, 0), 4) AS p, count(*) AS n FROM a GROUP BY 1"
_DEMAND = "SELECT p_partkey, p_brand, round(coalesce(" + _RANK.format("p_brand", "sold") + ", 0.5), 4) AS d FROM (SELECT p_partkey, p_brand, sold, count(sold) OVER (PARTITION BY p_brand) AS np_brand FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS sold FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"
_SCARCE = "SELECT p_partkey, p_type, round(1 - coalesce(" + _RANK.format("p_type", "offers") + ", 0.5), 4) AS s FROM (SELECT p_partkey, p_type, offers, count(offers) OVER (PARTITION BY p_type) AS np_type FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS offers FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"


def rates(spark: SparkSession, d: str) -> DataFrame:
    """(item, rate, stock): units a month from decayed sales over the effective window, and a stock."""
    s = aged(spark, d)
    by = s.groupBy("item").agg(F.sum(F.col("w") * F.col("vol")).alias("wv"), F.max("age").alias("oldest"))
    part = _t(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("stock"))
    return by.select("item", (F.col("wv") / S.effective_window(F.col("oldest"))).alias("rate")).join(part, "item")


_RATES = SALES + ", rt AS (SELECT item, sum(w * vol) / greatest(1.0, (1 - exp(-ln(2) / 12 * max(age))) / (ln(2) / 12)) AS rate FROM a GROUP BY 1), rs AS (SELECT rt.*, CAST(p_size AS DOUBLE) AS stock FROM rt JOIN part ON p_partkey = item)"


def turnover_hazard(spark: SparkSession, d: str) -> DataFrame:
    r = rates(spark, d)
    return r.select("item", F.round("rate", 4).alias("rate"), F.round(S.median_days(F.col("rate")), 4).alias("median_days"), F.round(S.sold_by(F.col("rate"), 30), 5).alias("p30"), F.round(S.sold_by(F.col("rate"), 90), 5).alias("p90"), F.round(S.trend_adjusted(F.col("rate"), F.lit(0.02)), 4).alias("adjusted"))


def survival_buckets(spark: SparkSession, d: str) -> DataFrame:
    # slower rates than the raw ones, so that all buckets hold units
    r = rates(spark, d).withColumn("rate", F.col("rate") / 100)
    parts = F.array(*[F.struct(F.lit(k).alias("bucket"), F.round(v, 4).alias("units")) for k, v in S.bucket_units(F.col("rate"), F.col("stock"))])
    return r.select("item", F.explode(parts).alias("b")).select("item", "b.bucket", "b.units")


def monthly_growth_trend(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    span = o.groupBy("o_orderpriority").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = span.select("o_orderpriority", F.posexplode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("idx", "month"))
    x = spine.join(o, ["o_orderpriority", "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fit = x.groupBy("o_orderpriority").agg(F.count("*").alias("months"), F.count_if(F.col("n") > 0).alias("positive"), F.expr("regr_slope(ln(n), idx) FILTER (WHERE n > 0)").alias("g"))
    return fit.select("o_orderpriority", "months", "positive", F.round(F.when((F.col("months") >= 4) & (F.col("positive") >= 3), S.clip(F.col("g"), -C.growth_clip, C.growth_clip)).otherwise(0.0), 6).alias("growth"))


def cohort_hazard_fallback(spark: SparkSession, d: str) -> DataFrame:
    # few of the sales, so that cohorts of all levels lack evidence somewhere
    r = aged(spark, d).where("vol <= item % 4").groupBy("item").agg(F.sum(F.col("w") * F.col("vol")).alias("wv"), F.count("*").alias("ev"))
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type", "p_size")
    x = p.join(r, "item", "left")
    def level(*keys: str) -> DataFrame:
        return x.groupBy(*keys).agg((F.sum("wv") / F.count_distinct(F.when(F.col("wv").isNotNull(), F.col("item")))).alias("rate"), F.sum("ev").alias("ev"), F.count_distinct(F.when(F.col("wv").isNotNull(), F.col("item"))).alias("items"))
    fine = level("p_brand", "p_type", "p_size").where((F.col("ev") >= C.cohort_fine[0]) & (F.col("items") >= C.cohort_fine[1])).select("p_brand", "p_type", "p_size", F.col("rate").alias("r1"))
    brand = level("p_brand").where((F.col("ev") >= C.cohort_global[0]) & (F.col("items") >= C.cohort_global[1])).select("p_brand", F.col("rate").alias("r2"))
    everything = level().where((F.col("ev") >= C.cohort_global[0]) & (F.col("items") >= C.cohort_global[1])).select(F.col("rate").alias("r3"))
    y = p.join(fine, ["p_brand", "p_type", "p_size"], "left").join(brand, "p_brand", "left").join(F.broadcast(everything), F.lit(True), "left")  # one row
    return y.select("item", F.when(F.col("r1").isNotNull(), "BRAND_TYPE").when(F.col("r2").isNotNull(), "BRAND").when(F.col("r3").isNotNull(), "GLOBAL").otherwise("NONE").alias("level"), F.round(F.coalesce("r1", "r2", "r3"), 3).alias("rate"))


def backtest_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    s = aged(spark, d)
    w = Window.partitionBy("item")
    num, den = F.col("w") * F.col("vol") * F.col("price"), F.col("w") * F.col("vol")
    x = s.select("item", "price", ((F.sum(num).over(w) - num) / F.nullif(F.sum(den).over(w) - den, F.lit(0.0))).alias("est"), F.count("*").over(w).alias("n")).where("n > 1")
    ape = F.abs(F.col("est") - F.col("price")) / F.col("price")
    return x.groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg(ape), 4).alias("mape"), F.round(F.median(ape), 4).alias("mdape"), F.round(F.avg((ape <= 0.2).cast("int")), 4).alias("hit20"))


def backtest_temporal_holdout(spark: SparkSession, d: str) -> DataFrame:
    s = aged(spark, d).withColumn("cut", F.add_months("ref", -6))
    train = s.where("day <= cut").withColumn("age", S.age_months("day", "cut")).withColumn("w", S.decay_weight("age"))
    h = train.groupBy("item").agg(S.decayed_mean("price", "vol", "w").alias("est"))
    ape = F.abs(F.col("est") - F.col("price")) / F.col("price")
    return s.where("day > cut").join(h, "item").groupBy("item").agg(F.count("*").alias("n"), F.round(F.avg(ape), 4).alias("mape"), F.round(F.avg((ape <= 0.1).cast("int")), 4).alias("hit10"))


def turnover_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = aged(spark, d).withColumn("cut", F.add_months("ref", -6))
    before = F.when(F.col("day") <= F.col("cut"), F.col("vol"))
    x = s.groupBy("item").agg(F.sum(before).alias("b"), F.datediff(F.first("cut"), F.min(F.when(F.col("day") <= F.col("cut"), F.col("day")))).alias("days"), F.sum(F.when(F.col("day") > F.col("cut"), F.col("vol"))).alias("actual"))
    return x.where("days > 0").select("item", F.round(F.col("b") / F.col("days") * 30.44 * 6, 3).alias("expected"), F.coalesce("actual", F.lit(0.0)).alias("actual"))


def elasticity_whatif(spark: SparkSession, d: str) -> DataFrame:
    r = rates(spark, d)
    pct = F.explode(F.array(*[F.lit(x) for x in (-10, -5, 0, 5, 10)])).alias("pct")
    return r.select("item", S.median_days(F.col("rate")).alias("days"), pct).select("item", "pct", F.round(F.col("days") * F.pow(1 + F.col("pct") / 100, F.lit(C.elasticity)), 5).alias("days"))


def valuation_reason(spark: SparkSession, d: str) -> DataFrame:
    p = price_trend_ols(spark, d)
    text = F.concat(F.lit("Based on "), F.col("n").cast("string"), F.lit(" sales; trend "), F.format_string("%+.1f%%", 100 * F.col("p") + 1e-7))
    return p.select("item", text.alias("reason"))


_BUCKETS = " UNION ALL ".join(
    f"SELECT item, '{k}' AS bucket, round(stock * ({'1.0' if hi is None else f'(1 - exp(-rate / 100 * {float(hi)} / 30))'} - (1 - exp(-rate / 100 * {float(max(0, lo - 1))} / 30))), 4) AS units FROM rs" for k, lo, hi in C.buckets
)

QUERIES = {f.__name__: f for f in (decay_weighted_value, active_median_discounted, price_trend_ols, demand_pct_rank, scarcity_pct_rank, composite_valuation, turnover_hazard, survival_buckets, monthly_growth_trend, cohort_hazard_fallback, backtest_leave_one_out, backtest_temporal_holdout, turnover_calibration, elasticity_whatif, valuation_reason)}
ORACLE_SQL = {
    "decay_weighted_value": SALES + " SELECT item, round(sum(w * vol * price) / sum(w * vol), 4) AS h, count(*) AS n, sum(vol) AS total FROM a GROUP BY 1",
    "active_median_discounted": f"SELECT item, round(c, 4) AS c, n FROM ({_ACTIVE})",
    "price_trend_ols": SALES + " " + _TREND,
    "demand_pct_rank": _DEMAND,
    "scarcity_pct_rank": f"SELECT *, CASE WHEN s >= 0.66 THEN 'SCARCE' WHEN s <= 0.33 THEN 'PLENTY' ELSE 'NORMAL' END AS flag FROM ({_SCARCE})",
    "composite_valuation": SALES + f", h AS (SELECT item, sum(w * vol * price) / sum(w * vol) AS h, count(*) AS n FROM a GROUP BY 1), c AS ({_ACTIVE}), p AS ({_TREND}), sc AS ({_SCARCE}), d AS ({_DEMAND}), x AS (SELECT h.item, h.n, coalesce(h, round(c, 4)) * (1 + p) * (1 + 0.1 * (s - 0.5)) * (1 + 0.05 * (d - 0.5)) AS price, CASE WHEN h.n >= 3 THEN 0.15 WHEN h.n >= 1 THEN 0.25 ELSE 0.4 END AS band FROM h LEFT JOIN c USING (item) LEFT JOIN p USING (item) LEFT JOIN sc ON sc.p_partkey = h.item LEFT JOIN d ON d.p_partkey = h.item) SELECT item, round(price, 3) AS price, CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS tier, round(price * (1 - band), 3) AS low, round(price * (1 + band), 3) AS high FROM x",
    "turnover_hazard": _RATES + " SELECT item, round(rate, 4) AS rate, round(least(3650.0, 30 * ln(2) / rate), 4) AS median_days, round(1 - exp(-rate), 5) AS p30, round(1 - exp(-rate * 3), 5) AS p90, round(rate * (exp(0.12) - 1) / 0.12, 4) AS adjusted FROM rs",
    "survival_buckets": _RATES + " " + _BUCKETS,
    "monthly_growth_trend": "WITH o AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2), sp AS (SELECT o_orderpriority, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM o GROUP BY 1), x AS (SELECT sp.o_orderpriority, row_number() OVER (PARTITION BY sp.o_orderpriority ORDER BY sp.month) - 1 AS idx, coalesce(n, 0) AS n FROM sp LEFT JOIN o ON o.o_orderpriority = sp.o_orderpriority AND o.month = CAST(sp.month AS DATE)) SELECT o_orderpriority, count(*) AS months, count(*) FILTER (WHERE n > 0) AS positive, round(CASE WHEN count(*) >= 4 AND count(*) FILTER (WHERE n > 0) >= 3 THEN greatest(-0.08, least(0.08, regr_slope(CASE WHEN n > 0 THEN ln(n) END, idx) FILTER (WHERE n > 0))) ELSE 0 END, 6) AS growth FROM x GROUP BY 1",
    "cohort_hazard_fallback": SALES + ", rr AS (SELECT item, sum(w * vol) AS wv, count(*) AS ev FROM a WHERE vol <= item % 4 GROUP BY 1), x AS (SELECT p_partkey AS item, p_brand, p_type, p_size, wv, ev FROM part LEFT JOIN rr ON rr.item = p_partkey), f AS (SELECT p_brand, p_type, p_size, sum(wv) / count(wv) AS r1 FROM x GROUP BY 1, 2, 3 HAVING sum(ev) >= 5 AND count(wv) >= 3), b AS (SELECT p_brand, sum(wv) / count(wv) AS r2 FROM x GROUP BY 1 HAVING sum(ev) >= 25 AND count(wv) >= 10), g AS (SELECT sum(wv) / count(wv) AS r3 FROM x HAVING sum(ev) >= 25 AND count(wv) >= 10) SELECT item, CASE WHEN r1 IS NOT NULL THEN 'BRAND_TYPE' WHEN r2 IS NOT NULL THEN 'BRAND' WHEN r3 IS NOT NULL THEN 'GLOBAL' ELSE 'NONE' END AS level, round(coalesce(r1, r2, r3), 3) AS rate FROM x LEFT JOIN f USING (p_brand, p_type, p_size) LEFT JOIN b USING (p_brand) LEFT JOIN g ON true",
    "backtest_leave_one_out": SALES + ", x AS (SELECT item, price, (sum(w * vol * price) OVER p - w * vol * price) / nullif(sum(w * vol) OVER p - w * vol, 0) AS est, count(*) OVER p AS n FROM a WINDOW p AS (PARTITION BY item)), y AS (SELECT item, abs(est - price) / price AS ape FROM x WHERE n > 1) SELECT item, count(*) AS n, round(avg(ape), 4) AS mape, round(median(ape), 4) AS mdape, round(avg(CAST(ape <= 0.2 AS INT)), 4) AS hit20 FROM y GROUP BY 1",
    "backtest_temporal_holdout": SALES + ", c AS (SELECT *, CAST(ref - INTERVAL 6 MONTH AS DATE) AS cut FROM a), h AS (SELECT item, sum(exp(-ln(2) / 12 * (date_diff('day', day, cut) / 30.44)) * vol * price) / sum(exp(-ln(2) / 12 * (date_diff('day', day, cut) / 30.44)) * vol) AS est FROM c WHERE day <= cut GROUP BY 1) SELECT item, count(*) AS n, round(avg(abs(est - price) / price), 4) AS mape, round(avg(CAST(abs(est - price) / price <= 0.1 AS INT)), 4) AS hit10 FROM c JOIN h USING (item) WHERE day > cut GROUP BY 1",
    "turnover_calibration": SALES + ", c AS (SELECT *, CAST(ref - INTERVAL 6 MONTH AS DATE) AS cut FROM a), x AS (SELECT item, sum(vol) FILTER (WHERE day <= cut) AS b, date_diff('day', min(day) FILTER (WHERE day <= cut), min(cut)) AS days, sum(vol) FILTER (WHERE day > cut) AS actual FROM c GROUP BY 1) SELECT item, round(b / days * 30.44 * 6, 3) AS expected, coalesce(actual, 0.0) AS actual FROM x WHERE days > 0",
    "elasticity_whatif": _RATES + " SELECT item, pct, round(least(3650.0, 30 * ln(2) / rate) * pow(1 + pct / 100, 1.5), 5) AS days FROM rs, (SELECT unnest([-10, -5, 0, 5, 10]) AS pct)",
    "valuation_reason": SALES + f" SELECT item, 'Based on ' || n || ' sales; trend ' || format('{{:+.1f}}%', 100 * p + 1e-7) AS reason FROM ({_TREND})",
}
