"""The decision layer: contradictions and risks of a candidate pair, policy gates, decision and reason, item status.

Fixed values: rule tiers, flag names with their reason codes in the order in which the first active one gives the reason,
statuses and thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlens.functions import vocabulary as V
from partlens.functions.text import alnum_count, escape, has_token
from partlens.operators.matching import any_of, words_of

TIERS = {
    "PART_NUMBER_EXACT": "A", "BRAND_PART_NUMBER": "A", "CALIBER_PART_NUMBER": "A",
    "CALIBER_EXACT": "B", "BRAND_CALIBER": "B",
    "CALIBER_COMPONENT": "C", "BRAND_CALIBER_COMPONENT": "C",
}
CONTRADICTIONS = {
    "brand_conflict": "BRAND_CONFLICT_OTHER_BRAND_PRESENT_OWN_ABSENT",
    "calibre_conflict": "CALIBRE_CONFLICT_EXPLICIT_LABEL_MISMATCH",
    "product_type_conflict": "PRODUCT_TYPE_CONFLICT_WHOLE_WATCH_SIGNAL",
}
RISKS = {
    "measurement_collision": "MEASUREMENT_COLLISION_DIMENSION_PATTERN",
    "longer_identifier_collision": "LONGER_IDENTIFIER_COLLISION_UNRELATED_COMPOUND",
    "model_name_number_collision": "MODEL_NAME_NUMBER_COLLISION",
    "proper_noun_or_event_collision": "PROPER_NOUN_EVENT_COLLISION",
    "bundle_or_lot_risk": "BUNDLE_OR_LOT_LANGUAGE_PRESENT",
    "multiple_inventory_collision": "MULTIPLE_INVENTORY_ITEMS_MATCH_SAME_EVIDENCE_ROW",
    "short_identifier_risk": "SHORT_IDENTIFIER_LOW_ALNUM_LENGTH",
    "compatibility_language_risk": "COMPATIBILITY_LANGUAGE_PRESENT",
    "multiple_reference_list_risk": "REFERENCE_OR_COMPATIBILITY_LIST_AMBIGUITY",
    "multiple_calibre_list_risk": "MULTIPLE_CALIBRE_LIST_PRESENT",
    "unverified_calibre_compatibility": "UNVERIFIED_CALIBRE_COMPATIBILITY",
    "cross_evidence_calibre_corroboration": "CROSS_EVIDENCE_CALIBRE_CORROBORATION",
    "ambiguous_component_type": "COMPONENT_RULE_NEVER_VALIDATES_SPECIFIC_PART",
    "evidence_missing_identifier": "INVENTORY_PART_NUMBER_MISSING",
}
SCORE_THRESHOLD = 0.95
VERIFIED = ("VERIFIED_FROM_PROJECT_SOURCE", "VERIFIED_EXTERNAL_REFERENCE")


def tier_of(rule: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[rule]


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def tokens(rule: Column, caliber: Column, part: Column) -> Column:
    """The identifiers that a rule rests on, each with the other one if it rests on both; lower case, blank ones left out."""
    pair = lambda t, p: F.struct(F.lower(t).alias("t"), F.lower(p).alias("p"))
    none = F.lit(None).cast("string")
    found = (
        F.when(rule.isin("PART_NUMBER_EXACT", "BRAND_PART_NUMBER"), F.array(pair(part, none)))
        .when(rule == "CALIBER_PART_NUMBER", F.array(pair(caliber, part), pair(part, caliber)))
        .otherwise(F.array(pair(caliber, none)))
    )
    return F.filter(found, lambda x: ~_blank(x["t"]))


def _labelled(title: Column) -> Column:
    """What every label of a calibre holds; a title without it needs no pattern."""
    return F.contains(title, F.lit("cal")) | F.contains(title, F.lit("kal"))


def conflicting_labels(title: Column, caliber: Column) -> Column:
    """Labelled calibres other than the item's own, if that stands nowhere in the title."""
    labels = F.array_distinct(F.regexp_extract_all(title, F.lit(V.CALIBRE_LABEL), 1))
    return F.when(~_labelled(title) | _blank(caliber) | F.coalesce(has_token(title, caliber), F.lit(False)), F.array().cast("array<string>")).otherwise(F.filter(labels, lambda x: x != caliber))


def calibre_list(title: Column) -> Column:
    runs = F.regexp_extract_all(title, F.lit(V.CALIBRE_LIST), 1)
    return _labelled(title) & F.exists(runs, lambda x: F.size(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\d{2,4})"), 1))) >= 2)


def compatible(title: Column) -> Column:
    return title.rlike(V.COMPATIBLE)


def told_by_title(title: Column) -> dict[str, Column]:
    """What a title tells whatever the item is, and whatever its numbers are."""
    return {"lot": title.rlike(V.LOT), "compatible": compatible(title), "whole_watch": title.rlike(V.WHOLE_WATCH)}


def _measurement(t: Column, x: Column) -> Column:
    tok = escape(x["t"])
    whole = F.regexp_count(t, F.concat(F.lit(r"\b"), tok, F.lit(r"\b")))
    decimal = F.regexp_count(t, F.concat(F.lit(r"(?:\d[.,]"), tok, F.lit(r"\b|\b"), tok, F.lit(r"[.,]\d)")))
    return (F.contains(t, F.lit(".")) | F.contains(t, F.lit(","))) & (whole > 0) & (decimal > 0) & (decimal >= whole)


def _longer(t: Column, x: Column) -> Column:
    inside = F.concat(F.lit("(?:^|-)"), escape(x["t"]), F.lit("(?:-|$)"))
    own = F.array(F.concat_ws("-", x["t"], x["p"]), F.concat_ws("-", x["p"], x["t"]))
    codes = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}-]+)"), 1)
    # such a code has a hyphen beside the token
    return F.contains(t, F.lit("-")) & F.exists(codes, lambda c: F.rlike(c, inside) & (c != x["t"]) & (x["p"].isNull() | ~F.array_contains(own, c)))


def _model(t: Column, x: Column) -> Column:
    pattern = F.concat(F.lit(rf"\b(?:{any_of(V.MODEL_WORDS)})\b[\s\-iv]{{0,15}}"), escape(x["t"]), F.lit(r"\b"))
    return (alnum_count(x["t"]) <= 2) & F.rlike(t, pattern)


def _event(t: Column, x: Column) -> Column:
    return (alnum_count(x["t"]) <= 2) & F.rlike(t, F.concat(F.lit(r"\b"), escape(x["t"]), F.lit(r"\b\s*hours?\s*(?:of|at)\b")))


def _in_list(t: Column, x: Column) -> Column:
    runs = F.regexp_extract_all(t, F.lit(f"({V.REFERENCE_LIST})"), 1)
    return (F.contains(t, F.lit("/")) | F.contains(t, F.lit(","))) & x["t"].rlike(r"^\d{4,6}$") & F.exists(runs, lambda r: F.array_contains(F.regexp_extract_all(r, F.lit(r"(\d{4,6})"), 1), x["t"]))


def contradictions(title: Column, brand: Column, conflict: Column, told: dict[str, Column] | None = None) -> Column:
    """Names of contradictions in their order; conflict: of calibres, resolved; told: whole_watch and words where they are told already."""
    told = told or {"whole_watch": told_by_title(title)["whole_watch"], "words": None}
    own = has_token(title, F.lower(brand), told["words"])
    other = has_token(title, F.when(brand == "Rolex", F.lit("tudor")).otherwise(F.lit("rolex")), told["words"])
    named = {"brand_conflict": other & ~own, "calibre_conflict": conflict, "product_type_conflict": told["whole_watch"]}
    return _active(named)


def risks(title: Column, rule: Column, caliber: Column, part: Column, collides: Column, unverified: Column, cross: Column, told: dict[str, Column] | None = None) -> Column:
    """Names of risks in their order; told: lot, compatible and listed where they are told already."""
    told = told or {**told_by_title(title), "listed": calibre_list(title)}
    # each of these risks needs the token in the title; patterns are made for each row, so only for tokens that are found there
    toks = F.filter(tokens(rule, caliber, part), lambda x: F.contains(title, x["t"]))
    any_token = lambda f: F.exists(toks, lambda x: F.coalesce(f(title, x), F.lit(False)))
    anchor = F.when(tier_of(rule) == "A", part).otherwise(caliber)
    named = {
        "measurement_collision": any_token(_measurement),
        "longer_identifier_collision": any_token(_longer),
        "model_name_number_collision": any_token(_model),
        "proper_noun_or_event_collision": any_token(_event),
        "bundle_or_lot_risk": told["lot"],
        "multiple_inventory_collision": collides,
        "short_identifier_risk": alnum_count(anchor) < 3,
        "compatibility_language_risk": told["compatible"],
        "multiple_reference_list_risk": any_token(_in_list),
        "multiple_calibre_list_risk": told["listed"],
        "unverified_calibre_compatibility": unverified,
        "cross_evidence_calibre_corroboration": cross,
        "ambiguous_component_type": tier_of(rule) == "C",
        "evidence_missing_identifier": _blank(part),
    }
    return _active(named)


def deciding_risks(title: Column, rule: Column, caliber: Column, part: Column, collides: Column, unverified: Column, cross: Column, against: Column, told: dict[str, Column] | None = None) -> Column:
    """Of ``risks`` those that ``decide`` asks for: all of pairs of tier A without a contradiction, of others the short identifier."""
    short = _active({"short_identifier_risk": alnum_count(F.when(tier_of(rule) == "A", part).otherwise(caliber)) < 3})
    return F.when((tier_of(rule) == "A") & (F.size(against) == 0), risks(title, rule, caliber, part, collides, unverified, cross, told)).otherwise(short)


def _active(named: dict[str, Column]) -> Column:
    # names differ, and without a lambda the whole is compiled
    return F.array_except(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in named.items()]), F.array(F.lit(None).cast("string")))


def first_code(flags: Column, codes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.try_element_at(flags, F.lit(1))]


def decide(rule: Column, against: Column, risk: Column, policy: Column, score: Column) -> Column:
    """(status, reason, clean) from active contradictions and risks, the segment's policy and the score of the listing."""
    tier, short = tier_of(rule), F.array_contains(risk, "short_identifier_risk")
    out = lambda status, reason, clean=False: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(clean).alias("clean"))
    return (
        F.when(F.size(against) > 0, out("NO_MATCH", first_code(against, CONTRADICTIONS)))
        .when((tier == "A") & (F.size(risk) > 0), out("REVIEW_REQUIRED", first_code(risk, RISKS)))
        .when((tier == "A") & (policy != "APPROVED"), out("REVIEW_REQUIRED", "AUTO_CONFIRM_POLICY_NOT_VALIDATED", True))
        .when((tier == "A") & (F.coalesce(score, F.lit(0.0)) >= SCORE_THRESHOLD), out("MATCH_CONFIRMED", "TIER_A_CLEAN_NO_CONTRADICTION_NO_RISK", True))
        .when(tier == "A", out("REVIEW_REQUIRED", "MATCHING_V2_SCORE_BELOW_THRESHOLD", True))
        .when((tier == "B") & ((rule == "BRAND_CALIBER") | ~short), out("LOW_CONFIDENCE_CANDIDATE", "TIER_B_PLAUSIBLE_PENDING_REVIEW"))
        .when(tier == "B", out("INSUFFICIENT_EVIDENCE", "TIER_B_CALIBER_ONLY_SHORT_IDENTIFIER"))
        .when((rule == "BRAND_CALIBER_COMPONENT") & ~short, out("LOW_CONFIDENCE_CANDIDATE", "TIER_C_HIGH_VALUE_EDGE_CASE"))
        .otherwise(out("INSUFFICIENT_EVIDENCE", "TIER_C_DISCOVERY_ONLY_DEFAULT"))
    )


def with_policy(pairs: DataFrame, policy: DataFrame) -> DataFrame:
    """pairs (rule, source, relationship) with the status of their segment: the exact one's, that of relationship ANY, else pending.

    policy: (rule, source, relationship, status); only approved rows count.
    """
    approved = policy.where("status = 'APPROVED'").select("rule", "source", "relationship").distinct()
    exact = approved.where("relationship <> 'ANY'").withColumn("exact", F.lit(True))
    wild = approved.where("relationship = 'ANY'").select("rule", "source", F.lit(True).alias("wild"))
    both = pairs.join(exact, ["rule", "source", "relationship"], "left").join(wild, ["rule", "source"], "left")
    return both.withColumn("policy", F.when(F.coalesce("exact", "wild"), "APPROVED").otherwise("VALIDATION_PENDING")).drop("exact", "wild")


def authorized(conflicts: DataFrame, verified: DataFrame, allowed: DataFrame) -> DataFrame:
    """Keys of conflicts (key, brand, caliber, label) of which a label is both verified and allowed.

    verified: (brand, caliber, label, kind, status); allowed: (kind, status, brand or null for any).
    """
    sure = verified.where(F.col("status").isin(*VERIFIED)).select("brand", "caliber", "label", "kind", "status")
    granted = allowed.select("kind", "status", F.col("brand").alias("limit"))
    known = sure.join(granted, ["kind", "status"]).where("limit IS NULL OR limit = brand").select("brand", "caliber", "label").distinct()
    return conflicts.join(known, ["brand", "caliber", "label"], "left_semi").select("key").distinct()


def corroborated(conflicts: DataFrame, titles: DataFrame) -> DataFrame:
    """Keys of conflicts (key, title_id, part, caliber, label) for which another title holds part, caliber and label.

    Titles are looked up by the words that calibre and label begin with, both at once, and equal titles are one with its least and
    largest id. The part number counts anywhere in a title, also inside words, so the titles that are left are then looked up by its
    first characters too: all runs of one to three characters are their index.
    """
    asked = conflicts.where("part IS NOT NULL AND trim(part) <> ''").withColumn("part", F.lower("part"))
    # an identifier without a word is looked up by the empty word, which every title has
    first = lambda c: F.coalesce(F.try_element_at(words_of(F.col(c)), F.lit(1)), F.lit(""))
    wanted = asked.select("caliber", "label").distinct().withColumn("one", first("caliber")).withColumn("two", first("label"))
    words = wanted.select(F.explode(F.array("one", "two")).alias("word")).distinct()
    index = titles.select("title_id", "title", F.explode(F.array_distinct(F.concat(words_of(F.col("title")), F.array(F.lit(""))))).alias("word"))
    some = index.join(words, "word").groupBy("title_id", "title").agg(F.collect_set("word").alias("words"))
    both = some.select("title_id", "title", "words", F.explode("words").alias("one")).select("title_id", "title", "one", F.explode("words").alias("two")).join(wanted, ["one", "two"])
    both = both.where(has_token(F.col("title"), F.col("caliber")) & has_token(F.col("title"), F.col("label")))
    texts = both.groupBy("caliber", "label", "title").agg(F.min("title_id").alias("least"), F.max("title_id").alias("most"))

    def runs_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("title") - (n - 1))), lambda i: F.substring(F.col("title"), i, F.lit(n)))

    runs = texts.withColumn("run", F.explode(F.array_distinct(F.flatten(F.array(*[runs_of(n) for n in (1, 2, 3)])))))
    parts = asked.select("part", "caliber", "label").distinct().withColumn("run", F.substring("part", 1, 3))
    met = parts.join(runs, ["caliber", "label", "run"]).where("contains(title, part)").groupBy("part", "caliber", "label").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return asked.join(met, ["part", "caliber", "label"]).where("least <> title_id OR most <> title_id").select("key").distinct()


def item_status(decided: DataFrame) -> DataFrame:
    """(item, counts, status) of decided pairs (item, status, source, relationship)."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = decided.groupBy("item").agg(
        F.count("*").alias("total"), n("MATCH_CONFIRMED").alias("confirmed"), n("REVIEW_REQUIRED").alias("review"),
        n("LOW_CONFIDENCE_CANDIDATE").alias("low"), n("INSUFFICIENT_EVIDENCE").alias("insufficient"), n("NO_MATCH").alias("rejected"),
        F.size(F.collect_set("source")).cast("long").alias("sources"),
        F.bool_or((F.col("source") == "active") & (F.col("relationship") == "SELF_SOURCED")).alias("has_self"),
        F.bool_or((F.col("source") == "active") & (F.col("relationship") == "CROSS_REFERENCED")).alias("has_cross"),
    )
    status = (
        F.when(F.col("confirmed") > 0, "HAS_CONFIRMED_MATCH").when(F.col("review") > 0, "REVIEW_PENDING").when(F.col("low") > 0, "ONLY_LOW_CONFIDENCE_CANDIDATES")
        .when(F.col("rejected") == F.col("total"), "ALL_CANDIDATES_REJECTED").otherwise("ONLY_INSUFFICIENT_EVIDENCE")
    )
    return counts.withColumn("status", status)
