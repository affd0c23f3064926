"""The pricing contract: confidence, method, reasons, turnover with its fallbacks, unpriced items, advice and what-if tables.

An item is a part; its sold and active evidence are line items of two kinds. What the evidence lacks, such as match scores
and dispersions, is derived from the part's key and size, so that every branch has rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partlens.config import CONFIG as C

#: Thresholds of stable and agreeing prices.
ACTIVE_IQR, ACTIVE_RANGE, HISTORICAL_IQR, HIGH_GAP, MEDIUM_GAP = 0.60, 6.0, 0.75, 0.65, 0.90
#: Least evidence and items of a cohort by level.
FINE, BROAD = C.cohort_fine, C.cohort_global
BUCKETS = [(0, 30), (31, 90), (91, 183), (184, 365), (366, 730), (731, 1065), (1066, None)]
#: Expressions that both engines understand, over parts with their evidence.
ITEM = {
    "item": "p_partkey",
    "brand": "p_brand",
    "caliber": "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END",
    "source": "CASE WHEN p_partkey % 31 = 0 THEN 'GOVERNED' ELSE 'ALGORITHMIC' END",
    "tier": "CASE p_partkey % 4 WHEN 0 THEN 'AUTO_CONFIRMED' WHEN 1 THEN 'HIGH_CONFIDENCE' WHEN 2 THEN 'MEDIUM_CONFIDENCE' ELSE NULL END",
    "basis": "CASE WHEN n_h > 0 THEN 'HISTORICAL' WHEN n_a > 0 THEN 'ACTIVE_ONLY' WHEN p_partkey % 3 = 0 THEN NULL ELSE 'COMPARABLE' END",
    "price": "CASE WHEN p_partkey % 9 = 0 OR (n_h + n_a = 0 AND p_partkey % 2 = 0) THEN NULL ELSE p_retailprice END",
    "n_h": "n_h", "n_a": "n_a", "units": "units",
    "score": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (70 + p_partkey % 30) / 100e0 END",
    "iqr": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 2 / 100e0 END",
    "spread": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size % 9 * 1e0 END",
    "h_iqr": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size * 3 % 100 / 100e0 END",
    "gap": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey * 7 % 120 / 100e0 END",
    "match_status": "CASE p_partkey % 12 WHEN 0 THEN 'NO_CANDIDATES' WHEN 1 THEN 'ONLY_LOW_CONFIDENCE_CANDIDATES' WHEN 2 THEN 'ONLY_INSUFFICIENT_EVIDENCE' WHEN 3 THEN 'ALL_CANDIDATES_REJECTED' WHEN 4 THEN 'REVIEW_PENDING' WHEN 5 THEN 'HAS_CONFIRMED_MATCH' ELSE NULL END",
    "candidates": "p_partkey % 5", "auto_high": "CASE WHEN p_partkey % 20 < 8 THEN 0 ELSE 1 END", "rejected": "p_partkey % 2",
    "days": "CASE WHEN n_h = 0 AND n_a > 0 THEN 3650e0 WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 23 + 0.6e0 END",
    "p30": "CASE WHEN n_h = 0 THEN 0e0 ELSE 0.25e0 END", "p90": "CASE WHEN n_h = 0 THEN 0e0 ELSE 0.5e0 END",
    "stock": "p_partkey % 12",
    "scarcity": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size * 2 / 100e0 END",
    "trend": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_size - 25) / 370e0 END",
}
_SOLD = "l_returnflag = 'R' AND l_quantity <= l_partkey % 12 * 2"
_ASKED = "l_linestatus = 'O' AND l_quantity <= l_partkey % 15 * 3"
EVIDENCE = f"SELECT l_partkey, CAST(sum(CASE WHEN {_SOLD} THEN 1 ELSE 0 END) AS BIGINT) AS n_h, CAST(sum(CASE WHEN {_ASKED} THEN 1 ELSE 0 END) AS BIGINT) AS n_a, sum(CASE WHEN {_SOLD} THEN l_quantity ELSE 0 END) AS units FROM lineitem GROUP BY l_partkey"


def contract(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    one = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    seen = li.groupBy("l_partkey").agg(one(_SOLD).alias("n_h"), one(_ASKED).alias("n_a"), F.sum(F.when(F.expr(_SOLD), F.col("l_quantity")).otherwise(0.0)).alias("units"))
    x = spark.read.parquet(f"{d}/part.parquet").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left").fillna({"n_h": 0, "n_a": 0, "units": 0.0})
    return x.selectExpr(*[f"{e} AS {n}" for n, e in ITEM.items()])


def _at_most(c: str, limit: float) -> Column:
    return F.col(c).isNull() | (F.col(c) <= limit)


def pricing_confidence(spark, d):
    """(status, tier, reason) of a price: which evidence carries it, how deep and how stable that is."""
    stable = _at_most("iqr", ACTIVE_IQR) & _at_most("spread", ACTIVE_RANGE)
    sure = lambda least: F.col("score").isNull() | (F.col("score") >= least)
    calm = _at_most("h_iqr", HISTORICAL_IQR)
    deep, moderate = (F.col("n_h") >= 5) | (F.col("units") >= 10), (F.col("n_h") >= 2) | (F.col("units") >= 5)
    context = (F.col("n_a") >= 5) & stable
    direct = F.col("tier").isin("AUTO_CONFIRMED", "HIGH_CONFIDENCE") & calm & sure(0.85)
    sold, asked = F.col("basis") == "HISTORICAL", F.col("basis") == "ACTIVE_ONLY"
    out = lambda tier, reason, status="PRICED": F.struct(F.lit(status).alias("status"), F.lit(tier).alias("confidence"), F.lit(reason).alias("reason"))
    x = (
        F.when(F.col("price").isNull(), out("LOW", "no price", "NO_RECOMMENDATION"))
        .when(F.col("source") == "GOVERNED", out("HIGH", "governed"))
        .when(asked & (F.col("n_a") >= 5) & stable & sure(0.80), out("MEDIUM", "stable asking prices"))
        .when(asked, out("LOW", "sparse asking prices"))
        .when(sold & direct & deep & _at_most("gap", HIGH_GAP), out("HIGH", "deep stable sales"))
        .when(sold & direct & (F.col("n_h") >= 3) & context & _at_most("gap", HIGH_GAP), out("HIGH", "sales and asking prices agree"))
        .when(sold & moderate & calm & _at_most("gap", MEDIUM_GAP), out("MEDIUM", "sales of some depth"))
        .when(sold & (F.col("n_h") == 1) & context & _at_most("gap", MEDIUM_GAP), out("MEDIUM", "one sale with stable asking prices"))
        .when(sold & (F.col("n_h") >= 1), out("LOW", "thin sales"))
        .when(sold, out("LOW", "limited history"))
        .when(F.col("tier") == "AUTO_CONFIRMED", out("MEDIUM", "direct evidence"))
        .when(F.col("tier") == "HIGH_CONFIDENCE", out("LOW", "weaker evidence"))
        .otherwise(out("LOW", "uncertain"))
    )
    return contract(spark, d).withColumn("x", x).select("item", "x.*")


def pricing_method(spark, d):
    method = (
        F.when(F.col("price").isNull(), "NO_DATA")
        .when((F.col("basis") == "HISTORICAL") & (F.col("n_a") > 0), "DIRECT_HISTORICAL_AND_ACTIVE")
        .when(F.col("basis") == "HISTORICAL", "DIRECT_HISTORICAL")
        .when(F.col("basis") == "ACTIVE_ONLY", "ACTIVE_ONLY_CALIBRATED")
        .otherwise("COMPARABLE_MARKET")
    )
    named = {"NO_CANDIDATES": "NO_CANDIDATES", "ONLY_LOW_CONFIDENCE_CANDIDATES": "ONLY_LOW_CONFIDENCE_CANDIDATES", "ONLY_INSUFFICIENT_EVIDENCE": "ONLY_INSUFFICIENT_EVIDENCE", "ALL_CANDIDATES_REJECTED": "REJECTED_ONLY", "REVIEW_PENDING": "REVIEW_REQUIRED_BEFORE_PRICING"}
    told = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("match_status")]
    why = F.coalesce(told, F.when(F.col("candidates") == 0, "NO_CANDIDATES").when((F.col("auto_high") == 0) & (F.col("rejected") > 0), "REJECTED_ONLY").when(F.col("auto_high") == 0, "NO_TRUSTWORTHY_EVIDENCE").otherwise("OTHER_EXPLICIT_REASON"))
    return contract(spark, d).select("item", method.alias("method"), F.when(F.col("price").isNull(), why).alias("no_price_reason"))


def _no_velocity() -> Column:
    return (F.col("days") >= C.max_days) & (F.col("p30") == 0) & (F.col("p90") == 0) & ((F.coalesce("basis", F.lit("")) == "ACTIVE_ONLY") | (F.col("n_h") == 0))


def _interval(days: Column) -> Column:
    """The bucket of days, rounded up to whole ones first."""
    day = F.ceil(days)
    label = F.lit(None).cast("string")
    for lo, hi in BUCKETS:
        label = F.when(day >= lo, f"{lo}+ days" if hi is None else f"{lo}-{hi} days").otherwise(label)
    return label


def turnover_state(spark, d):
    """(confidence, method, interval, status) of an item's own turnover."""
    none = F.col("days").isNull() | _no_velocity()
    status = F.when(F.col("days").isNull(), "NO_TURNOVER").when(_no_velocity(), "ACTIVE_ONLY_NO_VELOCITY").otherwise("SUPPORTED")
    trust = F.when(none, "INSUFFICIENT_DATA").when(F.col("n_h") >= 3, "HIGH").when(F.col("n_h") >= 1, "LOW").otherwise("INSUFFICIENT_DATA")
    method = F.when(~none & (F.col("n_h") >= 1), "DIRECT_ITEM_HAZARD_FIT").otherwise("NO_SOLD_VELOCITY")
    return contract(spark, d).select("item", trust.alias("confidence"), method.alias("method"), F.when(~none, _interval(F.col("days"))).alias("interval"), status.alias("status"))


def cohorts(x: DataFrame) -> DataFrame:
    """(level, brand, caliber, rate): monthly sales of an item by cohort, of cohorts with enough evidence; one pass of grouping sets.

    Rows without a brand or calibre count in the wider levels only.
    """
    sold = x.where("n_h > 0")
    g = sold.groupingSets([[F.col("brand"), F.col("caliber")], [F.col("brand")], []], F.col("brand"), F.col("caliber")).agg(F.sum("units").alias("units"), F.sum("n_h").alias("evidence"), F.count_distinct("item").alias("items"), F.grouping_id().alias("level"))
    fine = (F.col("level") == 0) & F.col("brand").isNotNull() & F.col("caliber").isNotNull() & (F.col("evidence") >= FINE[0]) & (F.col("items") >= FINE[1])
    wide = ((F.col("level") == 3) | (F.col("level") == 1) & F.col("brand").isNotNull()) & (F.col("evidence") >= BROAD[0]) & (F.col("items") >= BROAD[1])
    return g.where(fine | wide).select("level", "brand", "caliber", "evidence", "items", (F.col("units") / (F.col("items") * 24)).alias("rate"))


def turnover_contract(spark, d):
    """Turnover as the contract gives it: the item's own, else that of its brand and calibre, its brand, or all; none without a price.

    A wide cohort is reported as one of the brand whichever of both it is.
    """
    x = contract(spark, d)
    g = cohorts(x)
    none = F.col("days").isNull() | _no_velocity()
    own = ~none & (F.col("n_h") >= 1)
    pick = lambda level, name, *keys: g.where(F.col("level") == level).select(*keys, F.struct("rate", "evidence", "items").alias(name))
    total = pick(3, "everything").withColumn("one", F.lit(1))
    y = x.join(pick(0, "fine", "brand", "caliber"), ["brand", "caliber"], "left").join(pick(1, "broad", "brand"), "brand", "left").withColumn("one", F.lit(1)).join(F.broadcast(total), "one", "left")  # one row
    cohort = F.coalesce("fine", "broad", "everything")
    days = F.least(F.lit(C.max_days), 30 * math.log(2) / cohort["rate"])
    priced = F.col("price").isNotNull()
    level = F.when(~priced, None).when(own, "ITEM").when(F.col("fine").isNotNull(), "BRAND_CALIBER").when(cohort.isNotNull(), "BRAND_PORTFOLIO")
    method = F.when(~priced, "NO_PRICE_RECOMMENDATION").when(own, "DIRECT_ITEM_HAZARD_FIT").when(F.col("fine").isNotNull(), "COMPARABLE_COHORT_HAZARD_FIT").when(cohort.isNotNull(), "HIERARCHICAL_PORTFOLIO_PRIOR").otherwise("NO_SOLD_VELOCITY")
    trust = F.when(~priced, "LOW").when(own, F.when(F.col("n_h") >= 3, "HIGH").otherwise("LOW")).when(F.col("fine").isNotNull(), "MEDIUM").otherwise("LOW")
    shown = F.when(priced, F.when(own, F.col("days")).otherwise(F.round(days, 1)))
    y = y.withColumn("shown", shown)
    interval = F.when(~priced, "Sell-time estimate unavailable - no price recommendation").when(F.col("shown").isNull(), "Sell-time estimate unavailable - insufficient sold evidence").otherwise(_interval(F.col("shown")))
    by_cohort = priced & ~own
    return y.select("item", method.alias("method"), trust.alias("confidence"), level.alias("level"), F.round("shown", 1).alias("days"), interval.alias("interval"), F.when(priced & own, F.col("n_h")).when(by_cohort, cohort["evidence"]).alias("evidence"), F.when(priced & own, F.lit(1).cast("long")).when(by_cohort, cohort["items"]).alias("items"))


def unpriced_reasons(spark, d):
    """Items without a price, each with a reason that is never blank."""
    x = contract(spark, d).where("price IS NULL")
    tiers = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity <= l_partkey % 4 * 2").groupBy(F.col("l_partkey").alias("item")).agg(
        F.max(F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("medium"), F.max(F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).alias("low"), F.max(F.when(F.col("l_linenumber") == 3, 1).otherwise(0)).alias("no"), F.count("*").alias("n")
    )
    reason = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "No matching market listings found for this part yet.")
        .when(F.col("medium") == 1, "Some market evidence found, but not specific enough to confirm a price.")
        .when(F.col("low") == 1, "Weak market evidence found - not enough to recommend a price.")
        .when(F.col("no") == 1, "Matched listings did not pass brand/identity checks.")
        .otherwise("Insufficient evidence to recommend a price.")
    )
    return x.join(tiers, "item", "left").select("item", reason.alias("reason"))


def advice(spark, d):
    """Bullets for an item at a price some percent off: market balance, price, turnover, trend."""
    pct, s, t = F.col("item") % 21 - 10, F.col("scarcity"), F.col("trend")
    two = lambda x: F.format_string("%.2f", x)
    bullets = F.array(
        F.when(s > 0.6, F.concat(F.lit("High scarcity (S = "), two(s), F.lit(")"))).when(s < 0.4, F.concat(F.lit("Oversupplied market (S = "), two(s), F.lit(")"))).when(s.isNotNull(), "Balanced").otherwise("Market balance unavailable"),
        F.when(pct < -5, "discount").when(pct > 5, "premium").otherwise("competitive"),
        F.when(F.col("days").isNull(), "unknown").when(F.col("days") <= 30, "list now").when(F.col("days") <= 90, "31-90 day window").otherwise(F.concat(F.lit("extended ("), F.floor(F.col("days") + 0.5).cast("string"), F.lit(" days)"))),
        F.when(t > 0.01, F.concat(F.lit("up "), F.format_string("%.1f", t * 100))).when(t < -0.01, F.concat(F.lit("down "), F.format_string("%.1f", t * 100))).otherwise("monitor"),
    )
    return contract(spark, d).select("item", F.posexplode(bullets).alias("no", "text"))


def what_if_table(spark, d):
    """Price and days at ten percent less, as is, and ten percent more."""
    x = contract(spark, d).where("price IS NOT NULL AND days IS NOT NULL").withColumn("pct", F.explode(F.array(*[F.lit(p) for p in (-10, 0, 10)])))
    price = F.col("price") * (1 + F.col("pct") / 100)
    return x.select("item", "pct", F.round(price, 4).alias("price"), F.round(F.col("days") * F.pow(price / F.col("price"), F.lit(C.elasticity)), 4).alias("days"))


def readiness(spark, d):
    """One row: whether there is anything to show, with counts; an empty mart awaits evidence."""
    x = contract(spark, d)
    n = x.agg(F.count_if(F.expr("price IS NOT NULL AND source = 'GOVERNED'")).alias("governed"), F.count_if(F.expr("price IS NOT NULL AND source <> 'GOVERNED'")).alias("algorithmic"), F.count_if(F.expr("days IS NOT NULL")).alias("turnover"))
    return n.select(F.when(F.col("governed") + F.col("algorithmic") > 0, "READY").otherwise("AWAITING_EVIDENCE").alias("state"), "governed", "algorithmic", "turnover")


def portfolio_kpis(spark, d):
    """Totals of the mart; shares are 0 where there is nothing to share, typical days the upper median."""
    x = contract(spark, d)
    value = F.coalesce("price", F.lit(0.0)) * F.col("stock")
    y = x.agg(F.count("*").alias("items"), F.count("price").alias("priced"), F.sum("stock").alias("stock"), F.round(F.sum(value), 2).alias("value"), F.round(F.avg("price"), 4).alias("avg_price"), F.count_if(F.col("scarcity") >= 0.7).alias("scarce"), F.count_if(F.col("item") < 0).alias("none"))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.round(100 * F.col(a) / F.col(b), 4))
    days = x.where("days IS NOT NULL").groupBy("days").agg(F.count("*").alias("n"))  # a row for each number of days that occurs, bounded by the sizes
    return y.crossJoin(F.broadcast(upper_median(days, "days", "n"))).select("items", "priced", "stock", "value", "avg_price", "scarce", share("priced", "items").alias("coverage_pct"), share("priced", "none").alias("none_pct"), "typical_days")


def upper_median(counts: DataFrame, value: str, n: str) -> DataFrame:
    """One row: the element in the middle of sorted values, the upper one of two; counts: a row for each distinct value."""
    pairs = counts.agg(F.array_sort(F.collect_list(F.struct(value, n))).alias("x"), F.sum(n).alias("all"))
    at = F.floor(F.col("all") / 2)
    walk = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("hit")), lambda s, e: F.struct((s["seen"] + e[n]).alias("seen"), F.coalesce(s["hit"], F.when(s["seen"] + e[n] > at, e[value].cast("double"))).alias("hit")))
    return pairs.select(walk["hit"].alias("typical_days"))


def stale_confidence_removed(spark, d):
    """A reason without what its first writer said of confidence, which a later tier contradicts."""
    x = contract(spark, d)
    text = F.when(F.col("item") % 7 == 0, None).when(F.col("item") % 3 == 0, F.concat(F.lit("Sold at "), F.col("brand"))).otherwise(F.concat(F.lit("Sold at "), F.col("brand"), F.lit(".   Confidence: high. More")))
    return x.select("item", F.rtrim(F.substring_index(text, " Confidence:", 1)).alias("reason"))


def sort_multi_key(spark, d):
    """Ranks of the shown list by each sort key: no price below all prices, no days after all days, unknown confidence last."""
    x = contract(spark, d)
    conf = F.create_map(F.lit("AUTO_CONFIRMED"), F.lit(3), F.lit("HIGH_CONFIDENCE"), F.lit(2), F.lit("MEDIUM_CONFIDENCE"), F.lit(1))[F.col("tier")]
    y = x.select("item", F.coalesce("price", F.lit(-1.0)).alias("by_price"), F.coalesce("days", F.lit(999999.0)).alias("by_days"), F.coalesce(conf, F.lit(0)).alias("by_confidence"))
    return y.orderBy(F.desc("by_confidence"), F.asc("by_days"), F.desc("by_price"), F.asc("item")).limit(500)


def bucket_revenue_view(spark, d):
    """Of each item and bucket of days: units, their revenue; and what remains of the stock."""
    x = contract(spark, d).where("price IS NOT NULL AND days IS NOT NULL AND stock > 0").withColumn("rate", F.lit(30 * math.log(2)) / F.col("days"))
    sold = lambda t: 1 - F.exp(-F.col("rate") * t / 30)
    rows = F.array(*[F.struct(F.lit(f"{lo}-{hi}" if hi else f"{lo}+").alias("bucket"), (F.col("stock") * ((F.lit(1.0) if hi is None else sold(hi)) - sold(max(0, lo - 1)))).alias("units")) for lo, hi in BUCKETS[:-1]])
    y = x.withColumn("b", rows)
    total = F.aggregate("b", F.lit(0.0), lambda a, e: a + e["units"])
    return y.select("item", F.explode("b").alias("b"), "price", F.greatest(F.lit(0.0), F.col("stock") - total).alias("remaining")).select("item", "b.bucket", F.round("b.units", 6).alias("units"), F.round(F.col("b.units") * F.col("price"), 4).alias("revenue"), F.round("remaining", 6).alias("remaining"))


# ---------------------------------------------------------------- oracles
_X = f"WITH ev AS ({EVIDENCE}), b AS (SELECT part.*, coalesce(n_h, 0) AS n_h, coalesce(n_a, 0) AS n_a, coalesce(units, 0) AS units FROM part LEFT JOIN ev ON l_partkey = p_partkey), x AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ITEM.items()) + " FROM b)"
_STABLE = f"(coalesce(iqr, 0) <= {ACTIVE_IQR} AND coalesce(spread, 0) <= {ACTIVE_RANGE})"
_CALM = f"coalesce(h_iqr, 0) <= {HISTORICAL_IQR}"
_DIRECT = f"coalesce(tier, '') IN ('AUTO_CONFIRMED', 'HIGH_CONFIDENCE') AND {_CALM} AND coalesce(score, 1) >= 0.85"
_PRICE = [
    ("price IS NULL", "LOW", "no price"), ("source = 'GOVERNED'", "HIGH", "governed"),
    (f"basis = 'ACTIVE_ONLY' AND n_a >= 5 AND {_STABLE} AND coalesce(score, 1) >= 0.8", "MEDIUM", "stable asking prices"), ("basis = 'ACTIVE_ONLY'", "LOW", "sparse asking prices"),
    (f"basis = 'HISTORICAL' AND {_DIRECT} AND (n_h >= 5 OR units >= 10) AND coalesce(gap, 0) <= {HIGH_GAP}", "HIGH", "deep stable sales"),
    (f"basis = 'HISTORICAL' AND {_DIRECT} AND n_h >= 3 AND n_a >= 5 AND {_STABLE} AND coalesce(gap, 0) <= {HIGH_GAP}", "HIGH", "sales and asking prices agree"),
    (f"basis = 'HISTORICAL' AND (n_h >= 2 OR units >= 5) AND {_CALM} AND coalesce(gap, 0) <= {MEDIUM_GAP}", "MEDIUM", "sales of some depth"),
    (f"basis = 'HISTORICAL' AND n_h = 1 AND n_a >= 5 AND {_STABLE} AND coalesce(gap, 0) <= {MEDIUM_GAP}", "MEDIUM", "one sale with stable asking prices"),
    ("basis = 'HISTORICAL'", "LOW", "thin sales"), ("tier = 'AUTO_CONFIRMED'", "MEDIUM", "direct evidence"), ("tier = 'HIGH_CONFIDENCE'", "LOW", "weaker evidence"), ("true", "LOW", "uncertain"),
]
_NOVEL = "(days >= 3650 AND p30 = 0 AND p90 = 0 AND (coalesce(basis, '') = 'ACTIVE_ONLY' OR n_h = 0))"
_NONE = f"(days IS NULL OR {_NOVEL})"
_SPAN = lambda c: "CASE " + " ".join(f"WHEN ceil({c}) >= {lo} THEN '{f'{lo}+ days' if hi is None else f'{lo}-{hi} days'}'" for lo, hi in reversed(BUCKETS)) + " END"
_COHORTS = (
    f"s AS (SELECT * FROM x WHERE n_h > 0), fine AS (SELECT brand, caliber, sum(units) / (count(DISTINCT item) * 24) AS rate, CAST(sum(n_h) AS BIGINT) AS evidence, count(DISTINCT item) AS items FROM s WHERE brand IS NOT NULL AND caliber IS NOT NULL GROUP BY 1, 2 HAVING evidence >= {FINE[0]} AND items >= {FINE[1]}), "
    f"broad AS (SELECT brand, sum(units) / (count(DISTINCT item) * 24) AS rate, CAST(sum(n_h) AS BIGINT) AS evidence, count(DISTINCT item) AS items FROM s WHERE brand IS NOT NULL GROUP BY 1 HAVING evidence >= {BROAD[0]} AND items >= {BROAD[1]}), "
    f"every AS (SELECT sum(units) / (count(DISTINCT item) * 24) AS rate, CAST(sum(n_h) AS BIGINT) AS evidence, count(DISTINCT item) AS items FROM s HAVING evidence >= {BROAD[0]} AND items >= {BROAD[1]})"
)
_REMAIN = " + ".join(f"stock * ({'1' if hi is None else f'(1 - exp(-rate * {hi} / 30))'} - (1 - exp(-rate * {max(0, lo - 1)} / 30)))" for lo, hi in BUCKETS[:-1])
QUERIES = {f.__name__: f for f in (pricing_confidence, pricing_method, turnover_state, turnover_contract, unpriced_reasons, advice, what_if_table, readiness, portfolio_kpis, stale_confidence_removed, sort_multi_key, bucket_revenue_view)}
ORACLE_SQL = {
    "pricing_confidence": f"{_X} SELECT item, CASE WHEN price IS NULL THEN 'NO_RECOMMENDATION' ELSE 'PRICED' END AS status, CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in _PRICE) + " END AS confidence, CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in _PRICE) + " END AS reason FROM x",
    "pricing_method": f"{_X} SELECT item, CASE WHEN price IS NULL THEN 'NO_DATA' WHEN basis = 'HISTORICAL' THEN CASE WHEN n_a > 0 THEN 'DIRECT_HISTORICAL_AND_ACTIVE' ELSE 'DIRECT_HISTORICAL' END WHEN basis = 'ACTIVE_ONLY' THEN 'ACTIVE_ONLY_CALIBRATED' ELSE 'COMPARABLE_MARKET' END AS method, CASE WHEN price IS NULL THEN CASE match_status WHEN 'NO_CANDIDATES' THEN 'NO_CANDIDATES' WHEN 'ONLY_LOW_CONFIDENCE_CANDIDATES' THEN 'ONLY_LOW_CONFIDENCE_CANDIDATES' WHEN 'ONLY_INSUFFICIENT_EVIDENCE' THEN 'ONLY_INSUFFICIENT_EVIDENCE' WHEN 'ALL_CANDIDATES_REJECTED' THEN 'REJECTED_ONLY' WHEN 'REVIEW_PENDING' THEN 'REVIEW_REQUIRED_BEFORE_PRICING' ELSE CASE WHEN candidates = 0 THEN 'NO_CANDIDATES' WHEN auto_high = 0 AND rejected > 0 THEN 'REJECTED_ONLY' WHEN auto_high = 0 THEN 'NO_TRUSTWORTHY_EVIDENCE' ELSE 'OTHER_EXPLICIT_REASON' END END END AS no_price_reason FROM x",
    "turnover_state": f"{_X} SELECT item, CASE WHEN {_NONE} THEN 'INSUFFICIENT_DATA' WHEN n_h >= 3 THEN 'HIGH' WHEN n_h >= 1 THEN 'LOW' ELSE 'INSUFFICIENT_DATA' END AS confidence, CASE WHEN NOT {_NONE} AND n_h >= 1 THEN 'DIRECT_ITEM_HAZARD_FIT' ELSE 'NO_SOLD_VELOCITY' END AS method, CASE WHEN NOT {_NONE} THEN {_SPAN('days')} END AS interval, CASE WHEN days IS NULL THEN 'NO_TURNOVER' WHEN {_NOVEL} THEN 'ACTIVE_ONLY_NO_VELOCITY' ELSE 'SUPPORTED' END AS status FROM x",
    "turnover_contract": f"{_X}, {_COHORTS}, y AS (SELECT x.*, NOT {_NONE} AND n_h >= 1 AS own, fine.rate IS NOT NULL AS has_fine, coalesce(fine.rate, broad.rate, every.rate) AS rate, coalesce(fine.evidence, broad.evidence, every.evidence) AS evidence, coalesce(fine.items, broad.items, every.items) AS items FROM x LEFT JOIN fine ON fine.brand = x.brand AND fine.caliber = x.caliber LEFT JOIN broad ON broad.brand = x.brand LEFT JOIN every ON true), z AS (SELECT *, CASE WHEN price IS NOT NULL THEN CASE WHEN own THEN days ELSE round(least(3650, 30 * ln(2) / rate), 1) END END AS shown FROM y) "
    f"SELECT item, CASE WHEN price IS NULL THEN 'NO_PRICE_RECOMMENDATION' WHEN own THEN 'DIRECT_ITEM_HAZARD_FIT' WHEN has_fine THEN 'COMPARABLE_COHORT_HAZARD_FIT' WHEN rate IS NOT NULL THEN 'HIERARCHICAL_PORTFOLIO_PRIOR' ELSE 'NO_SOLD_VELOCITY' END AS method, CASE WHEN price IS NULL THEN 'LOW' WHEN own THEN CASE WHEN n_h >= 3 THEN 'HIGH' ELSE 'LOW' END WHEN has_fine THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CASE WHEN price IS NULL THEN NULL WHEN own THEN 'ITEM' WHEN has_fine THEN 'BRAND_CALIBER' WHEN rate IS NOT NULL THEN 'BRAND_PORTFOLIO' END AS level, round(shown, 1) AS days, CASE WHEN price IS NULL THEN 'Sell-time estimate unavailable - no price recommendation' WHEN shown IS NULL THEN 'Sell-time estimate unavailable - insufficient sold evidence' ELSE {_SPAN('shown')} END AS interval, CASE WHEN price IS NOT NULL THEN CASE WHEN own THEN n_h ELSE evidence END END AS evidence, CASE WHEN price IS NOT NULL THEN CASE WHEN own THEN 1 ELSE items END END AS items FROM z",
    "unpriced_reasons": f"{_X}, t AS (SELECT l_partkey, max(CAST(l_linenumber = 1 AS INT)) AS medium, max(CAST(l_linenumber = 2 AS INT)) AS low, max(CAST(l_linenumber = 3 AS INT)) AS bad, count(*) AS n FROM lineitem WHERE l_quantity <= l_partkey % 4 * 2 GROUP BY 1) SELECT item, CASE WHEN n IS NULL THEN 'No matching market listings found for this part yet.' WHEN medium = 1 THEN 'Some market evidence found, but not specific enough to confirm a price.' WHEN low = 1 THEN 'Weak market evidence found - not enough to recommend a price.' WHEN bad = 1 THEN 'Matched listings did not pass brand/identity checks.' ELSE 'Insufficient evidence to recommend a price.' END AS reason FROM x LEFT JOIN t ON l_partkey = item WHERE price IS NULL",
    "advice": f"{_X} SELECT item, CAST(no AS INT) AS no, CASE no WHEN 0 THEN CASE WHEN scarcity > 0.6 THEN 'High scarcity (S = ' || printf('%.2f', scarcity) || ')' WHEN scarcity < 0.4 THEN 'Oversupplied market (S = ' || printf('%.2f', scarcity) || ')' WHEN scarcity IS NOT NULL THEN 'Balanced' ELSE 'Market balance unavailable' END WHEN 1 THEN CASE WHEN item % 21 - 10 < -5 THEN 'discount' WHEN item % 21 - 10 > 5 THEN 'premium' ELSE 'competitive' END WHEN 2 THEN CASE WHEN days IS NULL THEN 'unknown' WHEN days <= 30 THEN 'list now' WHEN days <= 90 THEN '31-90 day window' ELSE 'extended (' || CAST(floor(days + 0.5) AS BIGINT) || ' days)' END ELSE CASE WHEN trend > 0.01 THEN 'up ' || printf('%.1f', trend * 100) WHEN trend < -0.01 THEN 'down ' || printf('%.1f', trend * 100) ELSE 'monitor' END END AS text FROM x, (SELECT unnest([0, 1, 2, 3]) AS no)",
    "what_if_table": f"{_X} SELECT item, CAST(pct AS INT) AS pct, round(price * (1 + pct / 100e0), 4) AS price, round(days * pow(price * (1 + pct / 100e0) / price, {C.elasticity}), 4) AS days FROM x, (SELECT unnest([-10, 0, 10]) AS pct) WHERE price IS NOT NULL AND days IS NOT NULL",
    "readiness": f"{_X}, n AS (SELECT count(*) FILTER (WHERE price IS NOT NULL AND source = 'GOVERNED') AS governed, count(*) FILTER (WHERE price IS NOT NULL AND source <> 'GOVERNED') AS algorithmic, count(days) AS turnover FROM x) SELECT CASE WHEN governed + algorithmic > 0 THEN 'READY' ELSE 'AWAITING_EVIDENCE' END AS state, * FROM n",
    "portfolio_kpis": f"{_X}, m AS (SELECT days, row_number() OVER (ORDER BY days) - 1 AS i, count(*) OVER () AS n FROM x WHERE days IS NOT NULL) SELECT count(*) AS items, count(price) AS priced, CAST(sum(stock) AS BIGINT) AS stock, round(sum(coalesce(price, 0) * stock), 2) AS value, round(avg(price), 4) AS avg_price, count(*) FILTER (WHERE scarcity >= 0.7) AS scarce, round(100.0 * count(price) / count(*), 4) AS coverage_pct, 0.0 AS none_pct, (SELECT days FROM m WHERE i = n // 2) AS typical_days FROM x",
    "stale_confidence_removed": f"{_X} SELECT item, CASE WHEN item % 7 = 0 THEN NULL WHEN item % 3 = 0 THEN 'Sold at ' || brand ELSE 'Sold at ' || brand || '.' END AS reason FROM x",
    "sort_multi_key": f"{_X} SELECT item, coalesce(price, -1) AS by_price, coalesce(days, 999999) AS by_days, CASE tier WHEN 'AUTO_CONFIRMED' THEN 3 WHEN 'HIGH_CONFIDENCE' THEN 2 WHEN 'MEDIUM_CONFIDENCE' THEN 1 ELSE 0 END AS by_confidence FROM x ORDER BY by_confidence DESC, by_days, by_price DESC, item LIMIT 500",
    "bucket_revenue_view": f"{_X}, r AS (SELECT *, 30 * ln(2) / days AS rate FROM x WHERE price IS NOT NULL AND days IS NOT NULL AND stock > 0), t AS (SELECT *, greatest(0, stock - ({_REMAIN})) AS remaining FROM r) " + " UNION ALL ".join(f"SELECT item, '{lo}-{hi}' AS bucket, round(u, 6) AS units, round(u * price, 4) AS revenue, round(remaining, 6) AS remaining FROM (SELECT *, stock * ((1 - exp(-rate * {hi} / 30)) - (1 - exp(-rate * {max(0, lo - 1)} / 30))) AS u FROM t)" for lo, hi in BUCKETS[:-1]),
}
