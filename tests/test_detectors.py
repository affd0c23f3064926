import pytest
from pyspark.sql import functions as F

from partlens.operators import decisions as D

#: Title, rule, calibre, part number, and the risks that they have.
CASES = [
    ("screw 1.24680 mm", "PART_NUMBER_EXACT", "3135", "24680", ["measurement_collision"]),
    ("screw 1.24680 mm or 24680", "PART_NUMBER_EXACT", "3135", "24680", []),
    ("rolex 9-24680-1", "PART_NUMBER_EXACT", "3135", "24680", ["longer_identifier_collision"]),
    ("rolex 9-24680-1", "PART_NUMBER_EXACT", "3135", "9-24680-1", []),
    ("rolex 3135-24680", "CALIBER_PART_NUMBER", "3135", "24680", []),
    ("rolex 3135-24680", "PART_NUMBER_EXACT", "3135", "24680", ["longer_identifier_collision"]),
    ("rolex 246801", "PART_NUMBER_EXACT", "3135", "24680", []),
    ("rolex gmt master 2", "CALIBER_PART_NUMBER", "3135", "2", ["model_name_number_collision", "short_identifier_risk"]),
    ("rolex explorer ii 2", "BRAND_PART_NUMBER", "3135", "2", ["model_name_number_collision", "short_identifier_risk"]),
    ("24 hours of daytona rolex", "CALIBER_EXACT", "24", "24680", ["proper_noun_or_event_collision", "short_identifier_risk"]),
    ("rolex dial 14000/14010/24680", "PART_NUMBER_EXACT", "3135", "24680", ["multiple_reference_list_risk"]),
    ("rolex dial 14000/14010/14060 24680", "PART_NUMBER_EXACT", "3135", "24680", []),
    ("rolex cal. 1520, 1530", "BRAND_CALIBER", "3135", "24680", ["multiple_calibre_list_risk"]),
    ("rolex 3135 wheel", "CALIBER_COMPONENT", "3135", None, ["ambiguous_component_type", "evidence_missing_identifier"]),
    ("5 x rolex fits 24680", "PART_NUMBER_EXACT", "3135", "24680", ["bundle_or_lot_risk", "compatibility_language_risk"]),
]


def test_risks_by_hand(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, t string, r string, c string, p string")
    no = F.lit(False)
    got = {r.i: r.f for r in df.select("i", D.risks(F.col("t"), F.col("r"), F.col("c"), F.col("p"), no, no, no).alias("f")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[4] for c in CASES]


#: Rule, contradictions, risks, policy, score, and the status and reason that follow.
DECISIONS = [
    ("PART_NUMBER_EXACT", ["product_type_conflict"], ["bundle_or_lot_risk"], "APPROVED", 1.0, "NO_MATCH", "PRODUCT_TYPE_CONFLICT_WHOLE_WATCH_SIGNAL"),
    ("PART_NUMBER_EXACT", [], ["bundle_or_lot_risk", "short_identifier_risk"], "APPROVED", 1.0, "REVIEW_REQUIRED", "BUNDLE_OR_LOT_LANGUAGE_PRESENT"),
    ("PART_NUMBER_EXACT", [], [], "VALIDATION_PENDING", 1.0, "REVIEW_REQUIRED", "AUTO_CONFIRM_POLICY_NOT_VALIDATED"),
    ("PART_NUMBER_EXACT", [], [], "APPROVED", 0.9, "REVIEW_REQUIRED", "MATCHING_V2_SCORE_BELOW_THRESHOLD"),
    ("PART_NUMBER_EXACT", [], [], "APPROVED", None, "REVIEW_REQUIRED", "MATCHING_V2_SCORE_BELOW_THRESHOLD"),
    ("PART_NUMBER_EXACT", [], [], "APPROVED", 0.95, "MATCH_CONFIRMED", "TIER_A_CLEAN_NO_CONTRADICTION_NO_RISK"),
    ("BRAND_CALIBER", [], ["short_identifier_risk"], "VALIDATION_PENDING", 1.0, "LOW_CONFIDENCE_CANDIDATE", "TIER_B_PLAUSIBLE_PENDING_REVIEW"),
    ("CALIBER_EXACT", [], ["short_identifier_risk"], "APPROVED", 1.0, "INSUFFICIENT_EVIDENCE", "TIER_B_CALIBER_ONLY_SHORT_IDENTIFIER"),
    ("CALIBER_EXACT", [], [], "APPROVED", 1.0, "LOW_CONFIDENCE_CANDIDATE", "TIER_B_PLAUSIBLE_PENDING_REVIEW"),
    ("BRAND_CALIBER_COMPONENT", [], ["ambiguous_component_type"], "APPROVED", 1.0, "LOW_CONFIDENCE_CANDIDATE", "TIER_C_HIGH_VALUE_EDGE_CASE"),
    ("BRAND_CALIBER_COMPONENT", [], ["short_identifier_risk", "ambiguous_component_type"], "APPROVED", 1.0, "INSUFFICIENT_EVIDENCE", "TIER_C_DISCOVERY_ONLY_DEFAULT"),
    ("CALIBER_COMPONENT", [], ["ambiguous_component_type"], "APPROVED", 1.0, "INSUFFICIENT_EVIDENCE", "TIER_C_DISCOVERY_ONLY_DEFAULT"),
]


def test_decisions_by_hand(spark):
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(DECISIONS)], "i int, r string, a array<string>, k array<string>, p string, s double")
    got = {x.i: (x.d.status, x.d.reason) for x in df.select("i", D.decide(F.col("r"), F.col("a"), F.col("k"), F.col("p"), F.col("s")).alias("d")).collect()}
    assert [got[i] for i in range(len(DECISIONS))] == [c[5:] for c in DECISIONS]


def test_other_titles_corroborate_but_not_the_title_itself(spark):
    titles = spark.createDataFrame([(1, "rolex calibre 3035 x99y jewel"), (2, "rolex 1535 3035 x99yz"), (3, "rolex 1535 x99y"), (4, "3035 1535 wheel")], "title_id long, title string")
    conflicts = spark.createDataFrame([("a", 1, "x99y", "1535", "3035"), ("b", 2, "x99yz", "1535", "3035"), ("c", 9, None, "1535", "3035")], "key string, title_id long, part string, caliber string, label string")
    assert [r.key for r in D.corroborated(conflicts, titles).collect()] == ["a"]


@pytest.mark.parametrize("brand", ["Rolex", "Tudor"])
def test_policy_falls_back_to_any_relationship(spark, brand):
    policy = spark.createDataFrame([("R", "s", "ANY", "APPROVED"), ("Q", "s", "SELF", "APPROVED"), ("Q", "s", "ANY", "PENDING")], "rule string, source string, relationship string, status string")
    pairs = spark.createDataFrame([("R", "s", "SELF"), ("Q", "s", "SELF"), ("Q", "s", "CROSS"), ("Z", "s", "SELF")], "rule string, source string, relationship string")
    got = {(r.rule, r.relationship): r.policy for r in D.with_policy(pairs, policy).collect()}
    assert got == {("R", "SELF"): "APPROVED", ("Q", "SELF"): "APPROVED", ("Q", "CROSS"): "VALIDATION_PENDING", ("Z", "SELF"): "VALIDATION_PENDING"}


def test_titles_with_one_number_of_several_digits_corroborate(spark):
    titles = spark.createDataFrame([(1, "rolex cal 3035 x99y"), (2, "rolex 8 3035 ax99yz"), (3, "rolex 8 2130")], "title_id long, title string")
    conflicts = spark.createDataFrame([("a", 1, "X99Y", "8", "3035"), ("b", 2, "x99y", "8", "3035"), ("c", 1, "x99y", "8", "2130")], "key string, title_id long, part string, caliber string, label string")
    assert [r.key for r in D.corroborated(conflicts, titles).collect()] == ["a"]



def test_what_a_title_scores_is_told_once_for_each_title(spark, tmp_path):
    """Not for each pair and rule: patterns that depend on the title alone stand below the rules in the plan."""
    from partlens.plans import decisions as P

    spark.range(1, 60).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    for query in (P.decide_cascade, P.match_score_tiers, P.inventory_match_summary):
        # plans are printed from the result down to the tables
        lines = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
        rules = [i for i, x in enumerate(lines) if "Generate explode" in x and "BRAND_CALIBER_COMPONENT" in x]
        scores = [i for i, x in enumerate(lines) if "homage" in x]
        assert len(rules) == 1 and scores and min(scores) > rules[0], query.__name__


def test_tokens_are_found_in_any_case(spark):
    from partlens.functions.text import has_token

    cases = [("ROLEX 1575 dial", "rolex", True), ("rolex 1575", "ROLEX", True), ("rolex 15750", "1575", False), ("a+b 5", "A+B", True), ("", "x", False), (None, "x", None), ("x", None, None)]
    greek = [("wheel ΑΣ 5", "ΑΣ", None), ("wheel 5Σ-x", "5Σ", None), ("ΣΑΣ", "Σ", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases + greek)], "i int, t string, k string, w boolean")
    plain = F.rlike("t", F.concat(F.lit(r"(?i)\b"), F.regexp_replace("k", r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\b")))
    got = df.select(has_token(F.col("t"), F.col("k")).alias("x"), plain.alias("plain"), "w").orderBy("i").collect()
    assert [r.x for r in got] == [r.plain for r in got]
    assert [r.x for r in got[: len(cases)]] == [c[2] for c in cases]


def test_pairs_are_dealt_once_and_by_title(spark, tmp_path):
    """Rows by rule don't move to be told apart: equal ones are left out of items and titles, and of the rules of a pair."""
    from partlens.plans import decisions as P

    rows = spark.range(0, 120).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size")
    rows.unionByName(rows.where("p_partkey < 30")).write.parquet(f"{tmp_path}/part.parquet")
    plan = P.match_score_tiers(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]
    for query in (P.match_score_tiers, P.decide_cascade, P.detector_flags):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == len(set(got)) and len({r.item for r in got}) == 120, query.__name__


def test_shapes_tell_what_titles_tell():
    """Patterns that are tried on a title with its numbers as 0 hold no number, nor count its digits."""
    import re

    from partlens.functions import vocabulary as V

    lists = (V.COMPETITORS, V.BRANDS, V.DOCUMENTATION, V.LINK_OR_CLASP, V.ACCESSORY, V.SPARE_PART, V.COMPLETE_WATCH, V.STRONG_COMPONENT, V.WATCH_PART, V.NEGATIVE)
    patterns = [p for words in lists for p in words] + [V.COMPATIBLE, V.WHOLE_WATCH, V.LOT.replace(r"\d+", "")]
    for p in patterns:
        assert not re.search(r"[0-9.{}\[\]]|\\[dwDWS]", p), p


def test_words_need_no_pattern_and_tell_the_same(spark):
    from partlens.functions.text import has_token, spaced

    titles = ["ROLEX 1575 dial", "rolex 15750", "rolex_1575", "a-1575/2", "1575", "", None, "uhr ä1575", "ä 1575 x", "x1575 1575.", "5 Σ"]
    tokens = ["1575", "rolex", "ROLEX", "_", "a-1575", "5", "", None, "x", "Σ"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").crossJoin(spark.createDataFrame([(k,) for k in tokens], "k string"))
    got = df.select("t", "k", has_token(F.col("t"), F.col("k")).alias("plain"), has_token(F.col("t"), F.col("k"), spaced(F.col("t"))).alias("x")).collect()
    assert [r for r in got if r.plain != r.x] == []


def test_deciding_risks_decide_alike(spark):
    df = spark.createDataFrame([(t, r, c, p, a) for t in ("rolex 9-12345-1 stem", "cal. 1520, 1530 lot of 5", "rolex 12345", "rolex 12345 2135") for r in D.TIERS for c in ("2135", "8", None) for p in ("12345", "7", None) for a in ([], ["brand_conflict"])], "t string, r string, c string, p string, a array<string>")
    asked = (F.col("t"), F.col("r"), F.col("c"), F.col("p"), F.lit(False), F.lit(False), F.lit(False))
    decide = lambda risk: D.decide(F.col("r"), F.col("a"), risk, F.lit("APPROVED"), F.lit(1.0))
    got = df.select(decide(D.risks(*asked)).alias("all"), decide(D.deciding_risks(*asked, F.col("a"))).alias("some")).collect()
    assert len({r.all.status for r in got}) == 5 and all(r.all == r.some for r in got)
