"""Validation by review: samples, returned labels with their checks, precision by segment, clusters, comparison of reviewers.

Review rows are made from the whole event table: an event is a candidate pair, its type the rule, its user the evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partlens.functions.intervals import interval
from partlens.operators.relational import latest_per_key
from partlens.storage import materialize

#: What labels, methods, diagnostics and failure categories may be.
LABELS = ("TRUE_MATCH", "FALSE_MATCH", "AMBIGUOUS", "UNREVIEWABLE")
METHODS = ("MANUAL_REVIEW", "ADJUDICATION", "SECONDARY_REVIEW")
CHECKS = ("YES", "NO", "UNKNOWN")
CATEGORIES = ("NOT_A_WATCH_PART", "WRONG_BRAND", "WRONG_CALIBRE", "WRONG_PART_NUMBER", "MODEL_REFERENCE_NOT_PART", "COMPATIBILITY_ONLY", "BUNDLE_OR_LOT", "INSUFFICIENT_INFORMATION", "OTHER", "NOT_APPLICABLE")
#: Expressions that both engines understand, over events: the manifest that was sent out,
SENT = {"row_id": "event_id", "key": "'K' || CAST(event_id AS STRING)", "rule": "event_type", "source": "CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'sold' ELSE 'vcp' END", "evidence": "user_id", "title": "event_type || ' ' || CAST(user_id AS STRING)"}
_TRUTH = "CASE WHEN event_id % 10 < 6 THEN 'TRUE_MATCH' WHEN event_id % 10 < 8 THEN 'FALSE_MATCH' WHEN event_id % 10 = 8 THEN 'AMBIGUOUS' ELSE 'UNREVIEWABLE' END"
#: and what came back, with faults.
BACK = {
    "row_id": "event_id + CASE WHEN event_id % 97 = 5 THEN 100000000 ELSE 0 END",
    "title": "CASE WHEN event_id % 89 = 3 THEN 'altered' ELSE event_type || ' ' || CAST(user_id AS STRING) END",
    "label": f"CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 61 = 1 THEN ' ' WHEN event_id % 61 = 2 THEN 'MAYBE' WHEN event_id % 61 = 3 THEN ' ' || {_TRUTH} || ' ' ELSE {_TRUTH} END",
    "name": "CASE WHEN event_id % 53 = 0 THEN NULL ELSE 'ann' END",
    "stamp": "CASE WHEN event_id % 59 = 0 THEN '' ELSE '2026-01-01' END",
    "method": "CASE WHEN event_id % 47 = 0 THEN NULL WHEN event_id % 47 = 1 THEN 'GUESS' ELSE 'manual_review' END",
    "category": f"CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 43 = 1 THEN 'WHATEVER' WHEN event_id % 43 = 2 THEN 'OTHER' WHEN event_id % 43 = 3 THEN 'NOT_APPLICABLE' WHEN {_TRUTH} = 'FALSE_MATCH' THEN 'WRONG_BRAND' ELSE 'NOT_APPLICABLE' END",
    "brand_check": "CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 41 = 1 THEN 'PERHAPS' ELSE 'yes' END",
}


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def sent(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).selectExpr(*[f"{e} AS {n}" for n, e in SENT.items()])


def returned(spark: SparkSession, d: str) -> DataFrame:
    """Rows as reviewers returned them: some are gone, some there twice."""
    x = _events(spark, d).where("event_id % 37 <> 0")
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 71 == 7, 2).otherwise(1)))
    return x.withColumn("copy", twice).selectExpr("copy", *[f"{e} AS {n}" for n, e in BACK.items()])


def _said(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))


def label_errors(back: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row_id, fault): a row for each fault of returned labels; an import goes ahead only if there is none."""
    again = back.groupBy("row_id").agg(F.count("*").alias("n")).where("n > 1").select("row_id", F.lit("duplicate").alias("fault"))
    unknown = back.select("row_id").distinct().join(manifest, "row_id", "left_anti").select("row_id", F.lit("unknown row").alias("fault"))
    lost = manifest.select("row_id").join(back, "row_id", "left_anti").select("row_id", F.lit("missing row").alias("fault"))
    both = back.join(manifest.select("row_id", F.col("title").alias("title_sent")), "row_id", "left")
    label, method, category, check = _said("label"), F.upper(_said("method")), F.upper(_said("category")), F.upper(_said("brand_check"))
    has = label.isNotNull()
    faults = {
        "content altered": F.col("title_sent").isNotNull() & ~F.coalesce("title", F.lit("")).eqNullSafe(F.col("title_sent")),
        "label missing": ~has,
        "label invalid": has & ~label.isin(*LABELS),
        "name missing": has & _said("name").isNull(),
        "timestamp missing": has & _said("stamp").isNull(),
        "method missing": has & method.isNull(),
        "method invalid": has & ~method.isin(*METHODS),
        "category missing": has & category.isNull(),
        "category invalid": has & ~category.isin(*CATEGORIES),
        "category needed": has & (label == "FALSE_MATCH") & (category == "NOT_APPLICABLE"),
        "category not applicable": has & (label != "FALSE_MATCH") & category.isin(*CATEGORIES) & (category != "NOT_APPLICABLE"),
        "check missing": has & check.isNull(),
        "check invalid": has & ~check.isin(*CHECKS),
    }
    rows = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in faults.items()]))
    return again.unionByName(unknown).unionByName(lost).unionByName(both.select("row_id", F.explode(rows).alias("fault")))


def label_validation(spark, d):
    return label_errors(returned(spark, d), sent(spark, d)).groupBy("row_id", "fault").agg(F.count("*").alias("n"))


def sound_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a fault, joined with their manifest: (key, rule, source, evidence, label, category)."""
    back, manifest = returned(spark, d), sent(spark, d)
    good = back.join(label_errors(back, manifest).select("row_id").distinct(), "row_id", "left_anti")
    return good.join(manifest.drop("title"), "row_id").select("row_id", "key", "rule", "source", "evidence", _said("label").alias("label"), F.upper(_said("category")).alias("category"), F.upper(_said("brand_check")).alias("brand_check"))


def label_import(spark, d):
    """Sound labels put into what was imported before: equal keys of the same version give way, each row stamped with a hash of its file."""
    new = sound_labels(spark, d).select("key", F.lit("v2").alias("version"), "label", F.lit(1).alias("batch"))
    old = sent(spark, d).where("row_id % 2 = 0").select("key", F.when(F.col("row_id") % 4 == 0, "v2").otherwise("v1").alias("version"), F.lit("OLD").alias("label"), F.lit(0).alias("batch"))
    x = old.join(new.select("key", "version", F.lit(True).alias("gone")), ["key", "version"], "left")
    kept = x.where("gone IS NULL").drop("gone")
    return kept.unionByName(new).withColumn("stamp", F.sha2(F.concat_ws("|", "version", F.col("batch").cast("string")), 256))


def _segments(x: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("label") == s)
    return x.groupBy(F.concat_ws("|", "rule", "source").alias("segment")).agg(F.count("*").alias("rows"), F.count_distinct("evidence").alias("evidence"), n("TRUE_MATCH").alias("true_n"), n("FALSE_MATCH").alias("false_n"), n("AMBIGUOUS").alias("ambiguous"), n("UNREVIEWABLE").alias("unreviewable"))


def segment_precision(spark, d):
    """Precision of each segment over true and false labels; none, and a refusal, where there are neither."""
    x = sound_labels(spark, d).where("NOT (rule = 'click' AND source = 'vcp' AND label IN ('TRUE_MATCH', 'FALSE_MATCH'))")
    s = _segments(x).withColumn("n", F.col("true_n") + F.col("false_n"))
    return s.select("*", F.round(F.try_divide(F.col("true_n"), F.col("n")), 6).alias("precision"), F.when(F.col("n") > 0, "OK").otherwise("REFUSED").alias("note"))


def segment_intervals(spark, d):
    """Exact 95 percent intervals of the segments' precision."""
    s = _segments(sound_labels(spark, d)).withColumn("n", F.col("true_n") + F.col("false_n"))
    return s.where("n > 0").withColumn("i", interval("true_n", "n")).select("segment", "true_n", "n", "i.lo", "i.hi")


def evidence_cluster_sensitivity(spark, d):
    """Precision if evidence that several candidates share counts once, by its most usual label; ties are counted, not broken."""
    x = sound_labels(spark, d).withColumn("segment", F.concat_ws("|", "rule", "source"))
    n = x.groupBy("segment", "evidence", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("segment", "evidence").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("label"), F.collect_list("n").alias("ns"))
    c = top.where("all > 1").withColumn("tie", F.size(F.filter("ns", lambda v: v == F.col("most"))) > 1)
    t, f = F.count_if(F.col("label") == "TRUE_MATCH"), F.count_if(F.col("label") == "FALSE_MATCH")
    return c.groupBy("segment").agg(F.count("*").alias("shared"), F.round(F.try_divide(t, t + f), 6).alias("precision"), F.count_if("tie").alias("ties"))


def reviewer_comparison(spark, d):
    """Two reviewers' labels against a classifier's: agreement, dangerous confusions, and which rows a human must see."""
    e = _events(spark, d)
    classes = F.array(*[F.lit(c) for c in ("WATCH_PART", "COMPLETE_WATCH", "ACCESSORY", "WRONG_BRAND", "UNKNOWN")])
    pick = lambda a, b: F.element_at(classes, ((F.col("event_id") * a + b) % 7 % 5 + 1).cast("int"))
    x = e.select("event_id", pick(1, 0).alias("predicted"), pick(3, 1).alias("one"), pick(3, F.when(F.col("event_id") % 3 == 0, 2).otherwise(1)).alias("two"))
    either = lambda label: (F.col("one") == label) | (F.col("two") == label)
    part, watch = F.col("predicted") == "WATCH_PART", F.col("predicted") == "COMPLETE_WATCH"
    risks = F.array_compact(F.array(*[F.when(part & either(c), F.lit(f"{c} predicted as WATCH_PART")) for c in ("COMPLETE_WATCH", "ACCESSORY", "WRONG_BRAND")], F.when(watch & either("WATCH_PART"), F.lit("WATCH_PART predicted as COMPLETE_WATCH"))))
    agreed = F.col("one") == F.col("two")
    other = (F.col("predicted") != F.col("one")) & (F.col("predicted") != F.col("two"))
    x = x.withColumn("risks", risks)
    return x.select("event_id", F.when(agreed, "AGREED").otherwise("DISAGREED").alias("agreement"), F.when(F.size("risks") > 0, F.array_join("risks", "; ")).otherwise("NONE").alias("risk"), (~agreed | other | (F.size("risks") > 0)).alias("needs_review"))


def label_preconditions(spark, d):
    """Why metrics would be refused: rows without a label, with one that isn't a class, or that differ from the frozen sample."""
    frozen = sent(spark, d).select("row_id", "title")
    back = latest_per_key(returned(spark, d), ["row_id"], F.asc("copy")).select("row_id", "title", _said("label").alias("label"))
    x = frozen.join(back.withColumnRenamed("title", "now"), "row_id", "left")
    fault = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("title"), "altered").when(F.col("label").isNull(), "unlabelled").when(~F.col("label").isin(*LABELS), "invalid").otherwise("sound")
    return x.groupBy(fault.alias("fault")).agg(F.count("*").alias("n"), F.min("row_id").alias("first"))


def blinded_manifest(spark, d):
    """Review rows under numbers that tell nothing, with all candidates of a pair collapsed into one row that keeps their lineage."""
    x = sent(spark, d).groupBy("evidence", "source").agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("all_keys"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("all_rules"), F.min("key").alias("key"))
    return x.select(F.concat(F.lit("CAL-"), F.substring(F.sha2(F.concat(F.lit("20260727|"), F.col("key")), 256), 1, 12)).alias("row_id"), "all_keys", "all_rules")


# ---------------------------------------------------------------- samples
def _draw(seed: str) -> Column:
    """A number for each key that a seed fixes, whatever the partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")), 256)


def drawn(spark: SparkSession, pool: DataFrame, strata: list[tuple[str, str, int | None]], seed: str) -> DataFrame:
    """(id, stratum): of each stratum (name, condition, size) in turn that many rows (None: all) not taken by one before; fewer if there are no more."""
    taken = None
    for name, condition, size in strata:
        left = pool.where(condition)
        left = left if taken is None else left.join(taken.select("id"), "id", "left_anti")
        left = left if size is None else left.orderBy(_draw(seed), "id").limit(size)
        one = materialize(spark, left.select("id", F.lit(name).alias("stratum")), "drawn")  # else each draw would repeat all before
        taken = one if taken is None else taken.unionByName(one)
    return taken


#: Expressions over parts: what is known of an item when a sample is drawn.
PROFILE = {"id": "p_partkey", "a": "p_partkey % 7 = 0", "b": "p_partkey % 3 = 0", "c": "p_partkey % 5 = 0", "rare": "p_partkey % 101 = 0", "short": "p_size < 3", "listed": "p_size = 17", "measured": "p_size = 29", "tudor": "p_brand = 'Brand#7'"}
PILOT = [("D_NO_CANDIDATES", "NOT a AND NOT b AND NOT c", 20), ("B_TIER_B_ONLY", "NOT a AND b", 30), ("A_TIER_A", "a", 30), ("C_TIER_C_ONLY", "NOT a AND NOT b AND c", 10), ("E_RARE", "rare", None), ("E_SHORT", "short", 4), ("E_LISTED", "listed", 4), ("E_MEASURED", "measured", 4), ("F_TUDOR", "tudor", 6)]
REVIEW = [("A_PART", "rule = 'click'", 50), ("A_BRAND", "rule = 'purchase'", 50), ("B_ACTIVE", "source = 'active'", 50), ("C_VCP", "source = 'vcp'", 50), ("D_RISK", "id % 9 = 0", 50), ("E_CLEAN", "id % 2 = 1", 50)]
CALIBRATION = [("clean", "rule = 'click' AND source = 'active'", 8), ("risk", "rule = 'click'", 8), ("tier_b", "source = 'sold'", 8), ("tier_c", "source = 'vcp'", 8), ("no_match", "id % 10 = 7", 8)]
PRIORITY = [("rule_1", "rule = 'click'", 30), ("rule_2", "rule = 'view'", 30), ("rule_3", "rule = 'purchase'", 30), *[(f"risk_{i}", f"id % 11 = {i}", 7) for i in range(7)]]


def stratified_sample(spark, d):
    """A pilot: strata in turn, rare ones whole, none twice, the rest filled from two strata to 300, in batches of 25."""
    pool = spark.read.parquet(f"{d}/part.parquet").selectExpr(*[f"{e} AS {n}" for n, e in PROFILE.items()])
    first = drawn(spark, pool, PILOT, "20260726")
    n = first.count()  # a few hundred rows
    half = max(0, 300 - n) // 2
    more = drawn(spark, pool.join(first.select("id"), "id", "left_anti"), [("A_TOPUP", "a", half), ("B_TOPUP", "NOT a AND b", max(0, 300 - n) - half)], "20260726")
    both = first.unionByName(more)
    place = F.row_number().over(Window.orderBy("stratum", "id"))  # the sample's rows only
    return both.select("id", "stratum", (F.floor((place - 1) / 25) + 1).cast("long").alias("batch"))


def _review_pool(spark: SparkSession, d: str) -> DataFrame:
    return sent(spark, d).select(F.col("row_id").alias("id"), "rule", "source")


def review_sample(spark, d):
    return drawn(spark, _review_pool(spark, d), REVIEW, "20260726")


def calibration_and_priority(spark, d):
    """Two samples, the second without any row of the first."""
    pool = _review_pool(spark, d)
    one = drawn(spark, pool, CALIBRATION, "20260727")
    two = drawn(spark, pool.join(one.select("id"), "id", "left_anti"), PRIORITY, "20260728")
    return one.withColumn("sample", F.lit("calibration")).unionByName(two.withColumn("sample", F.lit("priority")))


# ---------------------------------------------------------------- oracles
_SENT = "sent AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SENT.items()) + " FROM events)"
_BACK = "back AS (SELECT c.copy, " + ", ".join(f"{e} AS {n}" for n, e in BACK.items()) + " FROM events, (SELECT unnest([1, 2]) AS copy) c WHERE event_id % 37 <> 0 AND (c.copy = 1 OR event_id % 71 = 7))"
_S = lambda c: f"nullif(trim(coalesce({c}, '')), '')"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_FAULTS = {
    "content altered": "s.title IS NOT NULL AND coalesce(b.title, '') <> s.title", "label missing": "lab IS NULL", "label invalid": f"lab NOT IN {_IN(LABELS)}",
    "name missing": f"lab IS NOT NULL AND {_S('name')} IS NULL", "timestamp missing": f"lab IS NOT NULL AND {_S('stamp')} IS NULL", "method missing": "lab IS NOT NULL AND met IS NULL", "method invalid": f"lab IS NOT NULL AND met NOT IN {_IN(METHODS)}",
    "category missing": "lab IS NOT NULL AND cat IS NULL", "category invalid": f"lab IS NOT NULL AND cat NOT IN {_IN(CATEGORIES)}", "category needed": "lab = 'FALSE_MATCH' AND cat = 'NOT_APPLICABLE'",
    "category not applicable": f"lab <> 'FALSE_MATCH' AND cat IN {_IN(CATEGORIES)} AND cat <> 'NOT_APPLICABLE'", "check missing": "lab IS NOT NULL AND chk IS NULL", "check invalid": f"lab IS NOT NULL AND chk NOT IN {_IN(CHECKS)}",
}
_ERRORS = (
    f"{_SENT}, {_BACK}, bb AS (SELECT *, {_S('label')} AS lab, upper({_S('method')}) AS met, upper({_S('category')}) AS cat, upper({_S('brand_check')}) AS chk FROM back), "
    "err AS (SELECT row_id, 'duplicate' AS fault FROM back GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT row_id, 'unknown row' FROM back WHERE row_id NOT IN (SELECT row_id FROM sent) UNION ALL SELECT row_id, 'missing row' FROM sent WHERE row_id NOT IN (SELECT row_id FROM back) UNION ALL "
    + " UNION ALL ".join(f"SELECT b.row_id, '{n}' FROM bb b LEFT JOIN sent s ON s.row_id = b.row_id WHERE {c}" for n, c in _FAULTS.items())
    + ")"
)
_SOUND = f"{_ERRORS}, ok AS (SELECT b.row_id, s.key, s.rule, s.source, s.evidence, lab AS label, cat AS category FROM bb b JOIN sent s ON s.row_id = b.row_id WHERE b.row_id NOT IN (SELECT row_id FROM err))"
_SEG = "SELECT rule || '|' || source AS segment, count(*) AS rows, count(DISTINCT evidence) AS evidence, count(*) FILTER (WHERE label = 'TRUE_MATCH') AS true_n, count(*) FILTER (WHERE label = 'FALSE_MATCH') AS false_n, count(*) FILTER (WHERE label = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE label = 'UNREVIEWABLE') AS unreviewable"
_CLASSES = "['WATCH_PART', 'COMPLETE_WATCH', 'ACCESSORY', 'WRONG_BRAND', 'UNKNOWN']"


def _draw_sql(strata, seed: str, pool: str, prefix: str) -> tuple[str, str]:
    """CTEs that draw strata in turn from a relation, and the union of them."""
    ctes, names = [], []
    for i, (name, condition, size) in enumerate(strata):
        before = "".join(f" AND id NOT IN (SELECT id FROM {n})" for n in names)
        ctes.append(f"{prefix}{i} AS (SELECT id, '{name}' AS stratum FROM {pool} WHERE ({condition}){before} ORDER BY sha256('{seed}|' || id), id {f'LIMIT {size}' if size else ''})")
        names.append(f"{prefix}{i}")
    return ", ".join(ctes), " UNION ALL ".join(f"SELECT id, stratum FROM {n}" for n in names)


_POOL = f"{_SENT}, pool AS (SELECT row_id AS id, rule, source FROM sent)"
_PROFILE = "pool AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PROFILE.items()) + " FROM part)"
_P1, _P1U = _draw_sql(PILOT, "20260726", "pool", "s")
_R1, _R1U = _draw_sql(REVIEW, "20260726", "pool", "s")
_C1, _C1U = _draw_sql(CALIBRATION, "20260727", "pool", "s")
_Q1, _Q1U = _draw_sql(PRIORITY, "20260728", "rest", "t")
_TOP = "(SELECT greatest(0, 300 - count(*)) FROM first)"
QUERIES = {f.__name__: f for f in (label_validation, label_import, segment_precision, segment_intervals, evidence_cluster_sensitivity, reviewer_comparison, label_preconditions, blinded_manifest, stratified_sample, review_sample, calibration_and_priority)}
ORACLE_SQL = {
    "label_validation": f"WITH {_ERRORS} SELECT row_id, fault, count(*) AS n FROM err GROUP BY 1, 2",
    "label_import": f"WITH {_SOUND}, old AS (SELECT key, CASE WHEN row_id % 4 = 0 THEN 'v2' ELSE 'v1' END AS version FROM sent WHERE row_id % 2 = 0) SELECT key, version, 'OLD' AS label, 0 AS batch, sha256(version || '|0') AS stamp FROM old WHERE NOT (version = 'v2' AND key IN (SELECT key FROM ok)) UNION ALL SELECT key, 'v2', label, 1, sha256('v2|1') FROM ok",
    "segment_precision": f"WITH {_SOUND}, s AS ({_SEG} FROM ok WHERE NOT (rule = 'click' AND source = 'vcp' AND label IN ('TRUE_MATCH', 'FALSE_MATCH')) GROUP BY 1) SELECT *, true_n + false_n AS n, round(true_n / nullif(true_n + false_n, 0), 6) AS precision, CASE WHEN true_n + false_n > 0 THEN 'OK' ELSE 'REFUSED' END AS note FROM s",
    "evidence_cluster_sensitivity": f"WITH {_SOUND}, n AS (SELECT rule || '|' || source AS segment, evidence, label, count(*) AS n FROM ok GROUP BY 1, 2, 3), t AS (SELECT segment, evidence, sum(n) AS al, max(n) AS most, arg_max(label, (n, label)) AS label, list(n) AS ns FROM n GROUP BY 1, 2), c AS (SELECT *, len(list_filter(ns, lambda v: v = most)) > 1 AS tie FROM t WHERE al > 1) SELECT segment, count(*) AS shared, round(count(*) FILTER (WHERE label = 'TRUE_MATCH') / nullif(count(*) FILTER (WHERE label IN ('TRUE_MATCH', 'FALSE_MATCH')), 0), 6) AS precision, count(*) FILTER (WHERE tie) AS ties FROM c GROUP BY 1",
    "reviewer_comparison": f"WITH x AS (SELECT event_id, {_CLASSES}[event_id % 7 % 5 + 1] AS p, {_CLASSES}[(event_id * 3 + 1) % 7 % 5 + 1] AS a, {_CLASSES}[(event_id * 3 + CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) % 7 % 5 + 1] AS b FROM events), r AS (SELECT *, list_filter([CASE WHEN p = 'WATCH_PART' AND 'COMPLETE_WATCH' IN (a, b) THEN 'COMPLETE_WATCH predicted as WATCH_PART' END, CASE WHEN p = 'WATCH_PART' AND 'ACCESSORY' IN (a, b) THEN 'ACCESSORY predicted as WATCH_PART' END, CASE WHEN p = 'WATCH_PART' AND 'WRONG_BRAND' IN (a, b) THEN 'WRONG_BRAND predicted as WATCH_PART' END, CASE WHEN p = 'COMPLETE_WATCH' AND 'WATCH_PART' IN (a, b) THEN 'WATCH_PART predicted as COMPLETE_WATCH' END], lambda v: v IS NOT NULL) AS risks FROM x) SELECT event_id, CASE WHEN a = b THEN 'AGREED' ELSE 'DISAGREED' END AS agreement, CASE WHEN len(risks) > 0 THEN array_to_string(risks, '; ') ELSE 'NONE' END AS risk, a <> b OR p NOT IN (a, b) OR len(risks) > 0 AS needs_review FROM r",
    "label_preconditions": f"WITH {_SENT}, {_BACK}, x AS (SELECT s.row_id, CASE WHEN b.row_id IS NULL THEN 'gone' WHEN b.title <> s.title THEN 'altered' WHEN {_S('b.label')} IS NULL THEN 'unlabelled' WHEN {_S('b.label')} NOT IN {_IN(LABELS)} THEN 'invalid' ELSE 'sound' END AS fault FROM sent s LEFT JOIN (SELECT * FROM back WHERE copy = 1) b ON b.row_id = s.row_id) SELECT fault, count(*) AS n, min(row_id) AS first FROM x GROUP BY 1",
    "blinded_manifest": f"WITH {_SENT} SELECT 'CAL-' || substr(sha256('20260727|' || min(key)), 1, 12) AS row_id, string_agg(DISTINCT key, ',' ORDER BY key) AS all_keys, string_agg(DISTINCT rule, ',' ORDER BY rule) AS all_rules FROM sent GROUP BY evidence, source",
    "stratified_sample": f"WITH {_PROFILE}, {_P1}, first AS ({_P1U}), ta AS (SELECT id, 'A_TOPUP' AS stratum FROM pool WHERE a AND id NOT IN (SELECT id FROM first) ORDER BY sha256('20260726|' || id), id LIMIT ({_TOP} // 2)), tb AS (SELECT id, 'B_TOPUP' AS stratum FROM pool WHERE NOT a AND b AND id NOT IN (SELECT id FROM first) ORDER BY sha256('20260726|' || id), id LIMIT ({_TOP} - {_TOP} // 2)), u AS (SELECT * FROM first UNION ALL SELECT * FROM ta UNION ALL SELECT * FROM tb) SELECT id, stratum, (row_number() OVER (ORDER BY stratum, id) - 1) // 25 + 1 AS batch FROM u",
    "review_sample": f"WITH {_POOL}, {_R1} {_R1U}",
    "calibration_and_priority": f"WITH {_POOL}, {_C1}, one AS ({_C1U}), rest AS (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM one)), {_Q1}, two AS ({_Q1U}) SELECT id, stratum, 'calibration' AS sample FROM one UNION ALL SELECT id, stratum, 'priority' FROM two",
}
