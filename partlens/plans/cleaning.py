"""Cleaning of raw inventory and listings: validation, repair of spoilt values, corrections, identities, dates and money.

Raw rows are made from the whole part table: each is an inventory line as uploaded, all text, some of it spoilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.functions import text as X
from partlens.functions.vocabulary import LOT
from partlens.operators.relational import latest_per_key

#: Expressions that both engines understand, over the part table.
RAW = {
    "id": "p_partkey",
    "batch": "CASE WHEN p_partkey % 3 = 0 THEN 'batch_9' ELSE 'batch_10' END",
    "brand": "CASE p_partkey % 11 WHEN 0 THEN 'rolex' WHEN 1 THEN 'Omega' WHEN 2 THEN ' Rolex ' WHEN 3 THEN NULL ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Rolex' ELSE 'Tudor' END END",
    "caliber": "CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 19 = 1 THEN '  ' WHEN p_partkey % 19 = 2 THEN '2019-01-01' WHEN p_partkey % 19 = 3 THEN '2135-04-01' WHEN p_partkey % 19 = 4 THEN '2135-04-09 00:00:00' ELSE CAST(1500 + p_size % 6 * 35 AS STRING) END",
    "part": "CASE p_partkey % 23 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '6655-01-01' WHEN 3 THEN '2005-07-01' WHEN 4 THEN '2005-07-15' WHEN 5 THEN '1999-01-01 00:00:00' ELSE CASE WHEN p_size % 6 = 2 AND p_partkey % 5 = 0 THEN '530-' || CAST(p_partkey % 40 AS STRING) ELSE CAST(1000 + p_partkey % 700 AS STRING) END END",
    "stock": "CASE p_partkey % 17 WHEN 0 THEN 'x' WHEN 1 THEN '-2' WHEN 2 THEN ' 5 ' WHEN 3 THEN '3.5' WHEN 4 THEN NULL ELSE CAST(p_partkey % 12 AS STRING) END",
}
BRANDS = ("Rolex", "Tudor")
DATE = r"^\d{4}-\d{2}-\d{2}(\s+\d{2}:\d{2}:\d{2})?$"
#: Siblings without a dash that corroborate a repair, at least.
SIBLINGS = 10


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr(*[f"{e} AS {n}" for n, e in RAW.items()])


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _is_date(c: str) -> Column:
    return _clean(c).rlike(DATE)


def checked(rows: DataFrame) -> DataFrame:
    """rows with the status of each field, the cleaned values (null where a check failed) and the worst status."""
    whole = _clean("stock").rlike(r"^[+-]?\d+$")
    number = F.when(whole, _clean("stock").try_cast("int"))
    x = rows.withColumns({
        "brand_status": F.when(_clean("brand").isin(*BRANDS), "PASS").otherwise("FAIL"),
        "caliber_status": F.when(_clean("caliber") == "", "WARNING").when(_is_date("caliber"), "FAIL").otherwise("PASS"),
        "part_status": F.when((_clean("part") == "") | _is_date("part"), "FAIL").otherwise("PASS"),
        "stock_status": F.when(number >= 0, "PASS").otherwise("FAIL"),
    })
    every = [F.col(f"{c}_status") for c in ("brand", "caliber", "part", "stock")]
    worst = F.when(F.array_contains(F.array(*every), "FAIL"), "FAIL").when(F.array_contains(F.array(*every), "WARNING"), "WARNING").otherwise("PASS")
    x = x.withColumn("status", worst)
    passed = lambda c: F.when(F.col(f"{c}_status") == "PASS", _clean(c))
    return x.withColumns({"clean_brand": F.nullif(_clean("brand"), F.lit("")), "clean_caliber": passed("caliber"), "clean_part": passed("part"), "clean_stock": F.when(number >= 0, number)})


def validate_rows_explode(spark, d):
    """Four report rows for each raw row."""
    x = checked(raw(spark, d))
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_status").alias("status"), F.col(c).alias("value")) for c in ("brand", "caliber", "part", "stock")])
    return x.select("id", F.explode(rows).alias("x")).select("id", "x.field", "x.status", "x.value")


def inventory_validated(spark, d):
    return checked(raw(spark, d)).select("id", "status", "clean_brand", "clean_caliber", "clean_part", "clean_stock")


def repairs(rows: DataFrame) -> DataFrame:
    """(id, field, value, proposed, classification, confidence, rule): a proposal for each spoilt calibre and part number."""
    good = (_clean("part") != "") & ~_is_date("part")
    family = Window.partitionBy("brand", "caliber")
    known = F.col("brand").isNotNull() & F.col("caliber").isNotNull()
    x = rows.withColumns({"siblings": F.when(known, F.count_if(good).over(family)).otherwise(0), "dashed": F.when(known, F.count_if(good & F.col("part").contains("-")).over(family)).otherwise(0)})
    both = F.array(F.struct(F.lit("caliber").alias("field"), F.col("caliber").alias("value")), F.struct(F.lit("part").alias("field"), F.col("part").alias("value")))
    x = x.select("id", "siblings", "dashed", F.explode(both).alias("x")).select("id", "siblings", "dashed", "x.field", "x.value").where(F.trim("value").rlike(DATE))
    y, m, day = (F.regexp_extract(F.trim("value"), r"^(\d{4})-(\d{2})-(\d{2})", i).cast("int") for i in (1, 2, 3))
    sure = (F.col("field") == "part") & (F.col("dashed") == 0) & (F.col("siblings") >= SIBLINGS)
    out = lambda proposed, kind, trust, rule: F.struct(proposed.alias("proposed"), F.lit(kind).alias("classification"), F.lit(trust).alias("confidence"), F.lit(rule).alias("rule"))
    found = (
        F.when(day != 1, out(F.lit(None).cast("string"), "UNRESOLVED", "LOW", "excel_date_coercion_nondefault_day"))
        .when((m == 1) & sure, out(y.cast("string"), "AUTO_REPAIR_ALLOWED", "HIGH", "excel_date_coercion_day_and_month_default"))
        .when(m == 1, out(y.cast("string"), "USER_CONFIRMATION_REQUIRED", "MEDIUM", "excel_date_coercion_day_and_month_default"))
        .otherwise(out(F.concat_ws("-", y.cast("string"), m.cast("string")), "USER_CONFIRMATION_REQUIRED", "MEDIUM", "excel_date_coercion_variant_suffix_ambiguous"))
    )
    return x.withColumn("r", found).select("id", "field", "value", "r.*")


def excel_date_repair(spark, d):
    return repairs(raw(spark, d))


def repair_workflow(spark, d):
    """Proposals, less those that are already at work, after automatic repair and after human decisions; a value that nobody could
    propose is never approved. Raw rows stay as they are: what is applied is a correction."""
    p = repairs(raw(spark, d))
    open_before = p.where("id % 10 = 7").select("id", "field").distinct()
    fresh = p.join(open_before, ["id", "field"], "left_anti")
    human = F.when(F.col("id") % 4 == 0, "approve").when(F.col("id") % 4 == 1, "reject")
    status = (
        F.when(F.col("classification") == "AUTO_REPAIR_ALLOWED", "AUTO_APPLIED")
        .when((human == "approve") & F.col("proposed").isNotNull(), "APPROVED")
        .when(human == "reject", "REJECTED")
        .otherwise("PROPOSED")
    )
    x = fresh.withColumn("status", status)
    return x.select("id", "field", "status", F.when(F.col("status").isin("AUTO_APPLIED", "APPROVED"), F.col("proposed")).alias("corrected"))


#: Corrections: up to two for each sixth row, the second later; some leave a field blank.
CORRECTIONS = "SELECT id AS raw_id, k AS stamp, CASE WHEN (id + k) % 5 = 0 THEN '' ELSE 'Tudor' END AS to_brand, CASE WHEN (id + k) % 4 = 0 THEN NULL ELSE CAST(3000 + k AS STRING) END AS to_caliber, CASE WHEN k = 1 THEN CAST(700 + id AS STRING) ELSE ' ' END AS to_part FROM {raw} CROSS JOIN {ks} WHERE id % 6 = 0 AND (k = 0 OR id % 12 = 0)"


def corrections(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CORRECTIONS, raw=raw(spark, d), ks=spark.range(2).withColumnRenamed("id", "k"))


def overlaid(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """rows with the value in force of each field: the latest correction of the row, else that of a row of equal raw values, else the
    raw value; a correction's blank field changes nothing."""
    fields = ("brand", "caliber", "part")
    own = latest_per_key(fixes, ["raw_id"], F.desc("stamp")).select(F.col("raw_id").alias("id"), *[F.col(f"to_{c}").alias(f"own_{c}") for c in fields], F.lit(True).alias("has_own"))
    signed = fixes.join(rows.select(F.col("id").alias("raw_id"), *fields), "raw_id").dropna(subset=list(fields))
    like = latest_per_key(signed, list(fields), F.desc("stamp"), F.desc("raw_id")).select(*fields, *[F.col(f"to_{c}").alias(f"like_{c}") for c in fields], F.lit(True).alias("has_like"))
    x = rows.join(own, "id", "left").join(like, list(fields), "left")
    said = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return x.select("id", *[F.coalesce(said(f"own_{c}"), said(f"like_{c}"), F.col(c)).alias(f"effective_{c}") for c in fields], F.coalesce("has_own", "has_like", F.lit(False)).alias("was_corrected"))


def correction_overlay(spark, d):
    return overlaid(raw(spark, d), corrections(spark, d))


def _canonical(*parts: Column) -> Column:
    return X.slug_id(*parts)


def uid_resolution(spark, d):
    """The identity of each row: of an item staged before under its canonical id, else registered for a corrected row of equal raw
    values, else registered for the row itself, else new, from a hash of the row's number."""
    rows = raw(spark, d)
    x = rows.select("id", "brand", "caliber", "part", _canonical(F.col("brand"), F.col("caliber"), F.col("part")).alias("canonical"))
    staged = x.where("id % 7 = 0").groupBy("canonical").agg(F.min("id").alias("k")).select("canonical", F.concat(F.lit("iuid_old_"), F.col("k").cast("string")).alias("uid_1"))
    registry = rows.where("id % 6 = 0 AND id % 4 = 0").select(F.col("id").alias("raw_id"), F.concat(F.lit("iuid_reg_"), F.col("id").cast("string")).alias("uid"))
    fixed = corrections(spark, d).join(registry, "raw_id").join(rows.select(F.col("id").alias("raw_id"), "brand", "caliber", "part"), "raw_id").dropna(subset=["brand", "caliber", "part"])
    signed = latest_per_key(fixed, ["brand", "caliber", "part"], F.desc("stamp"), F.desc("raw_id")).select("brand", "caliber", "part", F.col("uid").alias("uid_2"))
    own = registry.select(F.col("raw_id").alias("id"), F.col("uid").alias("uid_3"))
    mint = F.concat(F.lit("iuid_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16))
    y = x.join(staged, "canonical", "left").join(signed, ["brand", "caliber", "part"], "left").join(own, "id", "left")
    tier = F.when(F.col("uid_1").isNotNull(), 1).when(F.col("uid_2").isNotNull(), 2).when(F.col("uid_3").isNotNull(), 3).otherwise(4)
    return y.select("id", F.coalesce("uid_1", "uid_2", "uid_3", mint).alias("uid"), tier.alias("tier"))


def latest_inventory_batch(spark, d):
    """The upload that staging reflects: the newest successful one of 100 rows at least, else the largest that isn't empty."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    log = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("batch"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("at"))
    good = log.where("status = 'O'")
    full, some = good.where("n >= 100"), good.where("n > 0")
    one = lambda df, *order: df.orderBy(*order).limit(1)
    first = one(full, F.desc("at"), F.desc("n"), F.desc("batch")).withColumn("choice", F.lit(1))
    second = one(some, F.desc("n"), F.desc("at"), F.desc("batch")).withColumn("choice", F.lit(2))
    return one(first.unionByName(second), F.asc("choice")).select("batch", "n")


def latest_batch_lexicographic(spark, d):
    """The row of the last batch of each canonical id, batches compared as text ('batch_9' is after 'batch_10')."""
    x = raw(spark, d).withColumn("canonical", _canonical(F.col("brand"), F.col("caliber"), F.col("part")))
    groups = x.groupBy("canonical", "batch").agg(F.min("id").alias("anchor"), F.count("*").alias("merged"), F.sum(F.when(_clean("stock").rlike(r"^\d+$"), _clean("stock").try_cast("long"))).alias("stock"))
    return groups.groupBy("canonical").agg(F.max_by(F.struct("batch", "anchor", "merged", "stock"), "batch").alias("x")).select("canonical", "x.*")


def query_ladder(spark, d):
    """Search queries by tier, and the rows that a human must see: failed ones and vague ones without a calibre."""
    x = checked(raw(spark, d))
    lexicon = x.where("status = 'PASS' AND id % 8 = 0").select("clean_caliber", "clean_part", F.concat(F.lit("name "), F.col("clean_part")).alias("name")).distinct()
    x = x.join(lexicon, ["clean_caliber", "clean_part"], "left")
    sure = F.length(F.regexp_replace("clean_part", r"[^\p{L}\p{N}]", "")) >= 4
    b, c, p = "clean_brand", "clean_caliber", "clean_part"
    one = lambda tier, *words: F.struct(F.lit(tier).alias("tier"), F.concat_ws(" ", *words).alias("query"), F.lit(None).cast("string").alias("review"))
    review = lambda why: F.struct(F.lit(0).alias("tier"), F.lit(None).cast("string").alias("query"), F.lit(why).alias("review"))
    ladder = [one(1, b, c, p), *[one(2, F.col(b), F.lit(w), F.col(c), F.col(p)) for w in ("Cal", "Calibre", "Caliber", "Kaliber")], one(4, b, c)]
    steps = (
        F.when(F.col("status") == "FAIL", F.array(review("FAIL")))
        .when((F.col("status") == "WARNING") & sure, F.array(one(5, p)))
        .when(F.col("status") == "WARNING", F.array(review("WARNING-non-distinctive")))
        .when(F.col("name").isNotNull(), F.array(*ladder, one(3, b, c, "name")))
        .otherwise(F.array(*ladder))
    )
    return x.select("id", F.explode(steps).alias("q")).select("id", "q.*")


def shipping_and_price_reliability(spark, d):
    """How far shipping and price of a sold listing can be trusted, its cost on arrival, and whether it may be a lot."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 100).alias("shipping"), (F.col("l_linenumber") % 2 * 100).alias("free_pct"), (F.col("l_returnflag") == "R").alias("best_offer"), "l_extendedprice", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("x rolex")).alias("title"), F.col("l_linestatus").alias("flag"))
    ship = F.coalesce("shipping", F.lit(0.0))
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(ship > 0, "OBSERVED_NONZERO").when(F.col("free_pct") == 100, "ZERO_CONFIRMED_FREE_SHIPPING").otherwise("ZERO_AMBIGUOUS").alias("shipping_reliability"),
        F.when(F.col("best_offer"), "LISTED_PRICE_PROXY_BEST_OFFER").otherwise("CONFIRMED_DISPLAYED_SOLD_PRICE").alias("price_reliability"),
        F.round(F.col("l_extendedprice") + ship, 4).alias("landed"), F.when(F.col("flag") == "O", F.col("title")).otherwise("rolex dial").rlike(LOT).alias("possible_lot"),
    )


def price_reliability(spark, d):
    """Of an item: asking prices only, mostly accepted offers, or confirmed sales."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("offers"))
    x = spark.read.parquet(f"{d}/part.parquet").select("p_partkey").join(li, "p_partkey", "left")
    return x.select("p_partkey", F.when(F.col("offers").isNull(), "LISTED_PRICE_ONLY").when(F.col("offers") >= 0.5, "BEST_OFFER_PROXY").otherwise("CONFIRMED_SALE_PRICE").alias("price_reliability"))


#: Names of files that pages were saved under.
FILE = "'terapeak_' || CASE p_partkey % 3 WHEN 0 THEN 'rolex' WHEN 1 THEN 'tudor' ELSE 'rOLEX' END || CASE p_partkey % 4 WHEN 0 THEN '_caliber' WHEN 1 THEN '_original_part' WHEN 2 THEN '' ELSE '_pin' END || '_p' || CAST(p_size AS STRING) || '.html'"


def brand_keyword_from_file(spark, d):
    name = F.replace(F.replace("file", F.lit(".html"), F.lit("")), F.lit("terapeak_"), F.lit(""))
    x = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", f"{FILE} AS file").withColumn("parts", F.split(name, "_"))
    first = F.element_at("parts", 1)
    words = F.filter(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda w: ~w.rlike(r"^p\d+$"))
    return x.select("p_partkey", F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 100))).alias("brand"), F.nullif(F.concat_ws("_", words), F.lit("")).alias("keyword"))


_MONTHS = ["Jan", "Feb", "Mrz", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"]
#: Dates as German pages write them, from orders; some are no dates.
GERMAN = "CASE o_orderkey % 13 WHEN 0 THEN '-' WHEN 1 THEN '99. Jan 2020' WHEN 2 THEN NULL ELSE CAST(day(o_orderdate) AS STRING) || '. ' || " + "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(_MONTHS)) + " END || ' ' || CAST(year(o_orderdate) AS STRING) END"
#: Prices likewise: thousands by dots, cents by a comma.
MONEY = "CASE o_orderkey % 11 WHEN 0 THEN 'gratis' WHEN 1 THEN NULL ELSE 'EUR ' || CASE WHEN o_totalprice >= 1000 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0') ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END || ',' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') END"


def german_date_parse(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"{GERMAN} AS raw").select("o_orderkey", X.german_date(F.col("raw")).alias("day"))


def money_parse(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"{MONEY} AS raw").select("o_orderkey", F.round(X.german_money(F.col("raw")), 2).alias("v"))


def iso_times_and_days_listed(spark, d):
    """Times as text with an offset, read as UTC (null if they are none), and whole days between two of them, rounded down."""
    e = spark.read.parquet(f"{d}/events.parquet")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 9 == 0, "soon").when(F.col("event_id") % 2 == 0, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+02:00")))
    made = F.try_to_timestamp(text)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_timestamp(made) / 86400).cast("int"))
    seen = F.to_timestamp(F.lit("2024-06-30T12:00:00Z"))
    return e.select("event_id", (F.unix_timestamp(made)).alias("made"), F.floor((F.unix_timestamp(seen) - F.unix_timestamp(made)) / 86400).alias("days_listed"), F.year(day).alias("y"), F.month(day).alias("m"))


def secret_redaction(spark, d):
    """Keys and tokens in a log line give way to a mark."""
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.lit("GET /x?client_secret="), F.md5(F.col("event_id").cast("string")), F.lit("&q="), F.col("event_type"), F.lit(" Authorization: Bearer "), F.sha1(F.col("event_id").cast("string").cast("binary")))
    hidden = F.regexp_replace(F.regexp_replace(line, r"(?i)((?:client_secret|api_key|token)=)[^&\s]+", "$1***"), r"(?i)(bearer )\S+", "$1***")
    return e.select("event_id", hidden.alias("line"))


def query_length_limits(spark, d):
    """Search texts that a marketplace takes: 350 characters at most, 99 a word."""
    x = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), F.array_max(F.transform(F.split("text", " "), lambda w: F.length(w))).alias("longest"))
    return x.select("doc_id", "n", "longest", ((F.col("n") <= 350) & (F.col("longest") <= 99)).alias("fits"))


def maintenance_dedup(spark, d):
    """Three rules by which repeated raw rows go: of equal values the one with a file hash, then the lowest id; by item id, else by a
    hash of the row; by row hash only."""
    r = raw(spark, d).withColumn("file_hash", F.when(F.col("id") % 3 == 1, "h").otherwise(""))
    one = latest_per_key(r, ["brand", "caliber", "part", "stock"], F.desc(F.col("file_hash") != ""), F.asc("id")).select(F.lit("inventory").alias("t"), "id")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 > 0, F.col("user_id").cast("string")).alias("item"), F.sha2(F.concat_ws("||", F.coalesce("event_type", F.lit("")), F.date_format("ts", "yyyy-MM-dd")), 256).alias("hash"))
    two = latest_per_key(e.withColumn("k", F.coalesce("item", "hash")), ["k"], F.asc("id")).select(F.lit("listings").alias("t"), "id")
    three = latest_per_key(e, ["hash"], F.asc("id")).select(F.lit("history").alias("t"), "id")
    return one.unionByName(two).unionByName(three)


# ---------------------------------------------------------------- oracles
_RAW = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RAW.items()) + " FROM part)"
_T = lambda c: f"trim(coalesce({c}, ''))"
_D = lambda c: f"regexp_matches({_T(c)}, '{DATE}')"
_NUM = f"CASE WHEN regexp_matches({_T('stock')}, '^[+-]?\\d+$') THEN TRY_CAST({_T('stock')} AS INTEGER) END"
_CHECKED = (
    f"checked AS (SELECT *, CASE WHEN {_T('brand')} IN ('Rolex', 'Tudor') THEN 'PASS' ELSE 'FAIL' END AS brand_status, CASE WHEN {_T('caliber')} = '' THEN 'WARNING' WHEN {_D('caliber')} THEN 'FAIL' ELSE 'PASS' END AS caliber_status, "
    f"CASE WHEN {_T('part')} = '' OR {_D('part')} THEN 'FAIL' ELSE 'PASS' END AS part_status, CASE WHEN {_NUM} >= 0 THEN 'PASS' ELSE 'FAIL' END AS stock_status FROM raw), "
    "v AS (SELECT *, CASE WHEN 'FAIL' IN (brand_status, caliber_status, part_status, stock_status) THEN 'FAIL' WHEN caliber_status = 'WARNING' THEN 'WARNING' ELSE 'PASS' END AS status, "
    f"nullif({_T('brand')}, '') AS clean_brand, CASE WHEN caliber_status = 'PASS' THEN {_T('caliber')} END AS clean_caliber, CASE WHEN part_status = 'PASS' THEN {_T('part')} END AS clean_part, CASE WHEN stock_status = 'PASS' THEN {_NUM} END AS clean_stock FROM checked)"
)
_REPAIRS = (
    f"sib AS (SELECT brand, caliber, count(*) FILTER (WHERE {_T('part')} <> '' AND NOT {_D('part')}) AS siblings, count(*) FILTER (WHERE {_T('part')} <> '' AND NOT {_D('part')} AND contains(part, '-')) AS dashed FROM raw WHERE brand IS NOT NULL AND caliber IS NOT NULL GROUP BY 1, 2), "
    f"bad AS (SELECT id, brand, caliber AS fam, 'caliber' AS field, caliber AS value FROM raw WHERE {_D('caliber')} UNION ALL SELECT id, brand, caliber, 'part', part FROM raw WHERE {_D('part')}), "
    "q AS (SELECT id, field, value, CAST(substr(trim(value), 1, 4) AS INT) AS y, CAST(substr(trim(value), 6, 2) AS INT) AS m, CAST(substr(trim(value), 9, 2) AS INT) AS dd, coalesce(siblings, 0) AS siblings, coalesce(dashed, 0) AS dashed FROM bad LEFT JOIN sib ON bad.brand = sib.brand AND bad.fam = sib.caliber), "
    f"r AS (SELECT id, field, value, CASE WHEN dd <> 1 THEN NULL WHEN m = 1 THEN CAST(y AS VARCHAR) ELSE y || '-' || m END AS proposed, CASE WHEN dd <> 1 THEN 'UNRESOLVED' WHEN m = 1 AND field = 'part' AND dashed = 0 AND siblings >= {SIBLINGS} THEN 'AUTO_REPAIR_ALLOWED' ELSE 'USER_CONFIRMATION_REQUIRED' END AS classification, "
    f"CASE WHEN dd <> 1 THEN 'LOW' WHEN m = 1 AND field = 'part' AND dashed = 0 AND siblings >= {SIBLINGS} THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, CASE WHEN dd <> 1 THEN 'excel_date_coercion_nondefault_day' WHEN m = 1 THEN 'excel_date_coercion_day_and_month_default' ELSE 'excel_date_coercion_variant_suffix_ambiguous' END AS rule FROM q)"
)
_FIXES = "fixes AS (" + CORRECTIONS.format(raw="raw", ks="(SELECT unnest([0, 1]) AS k)") + ")"
_OVER = lambda c: f"coalesce(CASE WHEN trim(o.to_{c}) <> '' THEN o.to_{c} END, CASE WHEN trim(l.to_{c}) <> '' THEN l.to_{c} END, r.{c}) AS effective_{c}"
_SIGNED = "SELECT f.*, brand, caliber, part FROM fixes f JOIN raw ON id = raw_id WHERE brand IS NOT NULL AND caliber IS NOT NULL AND part IS NOT NULL"
_SLUG = lambda c: f"coalesce(nullif(regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"
_CANON = f"{_SLUG('brand')} || '_' || {_SLUG('caliber')} || '_' || {_SLUG('part')}"
_STEPS = "SELECT id, 1 AS tier, clean_brand || ' ' || clean_caliber || ' ' || clean_part AS query, NULL AS review FROM v WHERE status = 'PASS' UNION ALL SELECT id, 2, clean_brand || ' ' || w || ' ' || clean_caliber || ' ' || clean_part, NULL FROM v, (SELECT unnest(['Cal', 'Calibre', 'Caliber', 'Kaliber']) AS w) WHERE status = 'PASS' UNION ALL SELECT id, 4, clean_brand || ' ' || clean_caliber, NULL FROM v WHERE status = 'PASS'"
_LONG = "length(regexp_replace(clean_part, '[^a-zA-Z0-9]', '', 'g')) >= 4"
QUERIES = {f.__name__: f for f in (validate_rows_explode, inventory_validated, excel_date_repair, repair_workflow, correction_overlay, uid_resolution, latest_inventory_batch, latest_batch_lexicographic, query_ladder, shipping_and_price_reliability, price_reliability, brand_keyword_from_file, german_date_parse, money_parse, iso_times_and_days_listed, secret_redaction, query_length_limits, maintenance_dedup)}
ORACLE_SQL = {
    "validate_rows_explode": f"WITH {_RAW}, {_CHECKED} " + " UNION ALL ".join(f"SELECT id, '{c}' AS field, {c}_status AS status, {c} AS value FROM v" for c in ("brand", "caliber", "part", "stock")),
    "inventory_validated": f"WITH {_RAW}, {_CHECKED} SELECT id, status, clean_brand, clean_caliber, clean_part, clean_stock FROM v",
    "excel_date_repair": f"WITH {_RAW}, {_REPAIRS} SELECT * FROM r",
    "repair_workflow": f"WITH {_RAW}, {_REPAIRS}, s AS (SELECT id, field, proposed, CASE WHEN classification = 'AUTO_REPAIR_ALLOWED' THEN 'AUTO_APPLIED' WHEN id % 4 = 0 AND proposed IS NOT NULL THEN 'APPROVED' WHEN id % 4 = 1 THEN 'REJECTED' ELSE 'PROPOSED' END AS status FROM r WHERE id % 10 <> 7) SELECT id, field, status, CASE WHEN status IN ('AUTO_APPLIED', 'APPROVED') THEN proposed END AS corrected FROM s",
    "correction_overlay": f"WITH {_RAW}, {_FIXES}, o AS (SELECT * FROM fixes QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY stamp DESC) = 1), l AS (SELECT * FROM ({_SIGNED}) QUALIFY row_number() OVER (PARTITION BY brand, caliber, part ORDER BY stamp DESC, raw_id DESC) = 1) SELECT r.id, {_OVER('brand')}, {_OVER('caliber')}, {_OVER('part')}, o.raw_id IS NOT NULL OR l.raw_id IS NOT NULL AS was_corrected FROM raw r LEFT JOIN o ON o.raw_id = r.id LEFT JOIN l ON l.brand = r.brand AND l.caliber = r.caliber AND l.part = r.part",
    "uid_resolution": f"WITH {_RAW}, {_FIXES}, x AS (SELECT *, {_CANON} AS canonical FROM raw), st AS (SELECT canonical, 'iuid_old_' || min(id) AS uid_1 FROM x WHERE id % 7 = 0 GROUP BY 1), reg AS (SELECT id AS raw_id, 'iuid_reg_' || id AS uid FROM raw WHERE id % 6 = 0 AND id % 4 = 0), sg AS (SELECT brand, caliber, part, uid AS uid_2 FROM ({_SIGNED}) JOIN reg USING (raw_id) QUALIFY row_number() OVER (PARTITION BY brand, caliber, part ORDER BY stamp DESC, raw_id DESC) = 1) "
    "SELECT x.id, coalesce(uid_1, uid_2, reg.uid, 'iuid_' || substr(sha256(CAST(x.id AS VARCHAR)), 1, 16)) AS uid, CASE WHEN uid_1 IS NOT NULL THEN 1 WHEN uid_2 IS NOT NULL THEN 2 WHEN reg.uid IS NOT NULL THEN 3 ELSE 4 END AS tier FROM x LEFT JOIN st USING (canonical) LEFT JOIN sg ON sg.brand = x.brand AND sg.caliber = x.caliber AND sg.part = x.part LEFT JOIN reg ON reg.raw_id = x.id",
    "latest_inventory_batch": "WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS batch, count(*) AS n, max(o_orderdate) AS stamp FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT batch, n FROM g ORDER BY n >= 100 DESC, CASE WHEN n >= 100 THEN stamp END DESC NULLS LAST, n DESC, stamp DESC, batch DESC LIMIT 1",
    "latest_batch_lexicographic": f"WITH {_RAW}, g AS (SELECT {_CANON} AS canonical, batch, min(id) AS anchor, count(*) AS merged, CAST(sum(CASE WHEN regexp_matches({_T('stock')}, '^\\d+$') THEN TRY_CAST({_T('stock')} AS BIGINT) END) AS BIGINT) AS stock FROM raw GROUP BY 1, 2) SELECT canonical, batch, anchor, merged, stock FROM g QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY batch DESC) = 1",
    "query_ladder": f"WITH {_RAW}, {_CHECKED}, lex AS (SELECT DISTINCT clean_caliber, clean_part, 'name ' || clean_part AS name FROM v WHERE status = 'PASS' AND id % 8 = 0) {_STEPS} UNION ALL SELECT id, 3, clean_brand || ' ' || clean_caliber || ' ' || name, NULL FROM v JOIN lex USING (clean_caliber, clean_part) WHERE status = 'PASS' UNION ALL SELECT id, 5, clean_part, NULL FROM v WHERE status = 'WARNING' AND {_LONG} UNION ALL SELECT id, 0, NULL, CASE status WHEN 'FAIL' THEN 'FAIL' ELSE 'WARNING-non-distinctive' END FROM v WHERE status = 'FAIL' OR (status = 'WARNING' AND NOT {_LONG})",
    "shipping_and_price_reliability": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0.01 THEN 'OBSERVED_NONZERO' WHEN l_linenumber % 2 = 1 THEN 'ZERO_CONFIRMED_FREE_SHIPPING' ELSE 'ZERO_AMBIGUOUS' END AS shipping_reliability, CASE WHEN l_returnflag = 'R' THEN 'LISTED_PRICE_PROXY_BEST_OFFER' ELSE 'CONFIRMED_DISPLAYED_SOLD_PRICE' END AS price_reliability, round(l_extendedprice + CASE WHEN l_tax > 0.01 THEN l_tax * 100 ELSE 0 END, 4) AS landed, regexp_matches(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) || 'x rolex' ELSE 'rolex dial' END, '{LOT}') AS possible_lot FROM lineitem",
    "price_reliability": "WITH o AS (SELECT l_partkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS offers FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT p_partkey, CASE WHEN offers IS NULL THEN 'LISTED_PRICE_ONLY' WHEN offers >= 0.5 THEN 'BEST_OFFER_PROXY' ELSE 'CONFIRMED_SALE_PRICE' END AS price_reliability FROM part LEFT JOIN o ON l_partkey = p_partkey",
    "brand_keyword_from_file": "SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 'Tudor' ELSE 'Rolex' END AS brand, CASE p_partkey % 4 WHEN 0 THEN 'caliber' WHEN 1 THEN 'original_part' WHEN 3 THEN 'pin' END AS keyword FROM part",
    "german_date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 13 > 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "money_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 1 THEN round(o_totalprice, 2) END AS v FROM orders",
    "iso_times_and_days_listed": "WITH t AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7200 END END AS made FROM events) SELECT event_id, made, CAST(floor((epoch(TIMESTAMP '2024-06-30 12:00:00') - made) / 86400) AS BIGINT) AS days_listed, CAST(year(make_timestamp(made * 1000000)) AS INT) AS y, CAST(month(make_timestamp(made * 1000000)) AS INT) AS m FROM t",
    "secret_redaction": "SELECT event_id, 'GET /x?client_secret=***&q=' || event_type || ' Authorization: Bearer ***' AS line FROM events",
    "query_length_limits": "WITH x AS (SELECT doc_id, length(text) AS n, list_max(list_transform(string_split(text, ' '), lambda w: length(w))) AS longest FROM documents WHERE text IS NOT NULL) SELECT doc_id, n, longest, n <= 350 AND longest <= 99 AS fits FROM x",
    "maintenance_dedup": f"WITH {_RAW}, e AS (SELECT event_id AS id, CASE WHEN user_id % 5 > 0 THEN CAST(user_id AS VARCHAR) END AS item, sha256(coalesce(event_type, '') || '||' || strftime(ts, '%Y-%m-%d')) AS hash FROM events) SELECT 'inventory' AS t, id FROM (SELECT id FROM raw QUALIFY row_number() OVER (PARTITION BY brand, caliber, part, stock ORDER BY id % 3 = 1 DESC, id) = 1) UNION ALL SELECT 'listings', id FROM (SELECT id FROM e QUALIFY row_number() OVER (PARTITION BY coalesce(item, hash) ORDER BY id) = 1) UNION ALL SELECT 'history', id FROM (SELECT id FROM e QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1)",
}
