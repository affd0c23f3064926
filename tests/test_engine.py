import re

import pytest
from pyspark.sql import functions as F

from partlens.functions import stats as S
from partlens.functions import text as X
from partlens.operators import matching as M
from partlens.operators import relational as R

def test_asof_join_nulls_and_rows_before_the_first(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "a", None), (4, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 5, 20.0), ("a", None, 99.0)], "k string, u int, v double")
    got = {r.id: r.v for r in R.asof_join(left, right, "t", "u", "v", ["k"]).collect()}
    assert got == {1: 20.0, 2: None, 3: None, 4: None}


def test_decayed_mean_by_hand(spark):
    df = spark.createDataFrame([(10.0, 1.0, 0.0), (20.0, 3.0, 12.0)], "p double, v double, age double").withColumn("w", S.decay_weight("age"))
    assert abs(df.agg(S.decayed_mean("p", "v", "w")).first()[0] - (10 + 0.5 * 3 * 20) / 2.5) < 1e-9


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ｒolex  X ", "7. Aug 2025", "EUR 1.234,56")], "a string, b string, c string")
    r = df.select(X.normalize_title(F.col("a")).alias("a"), X.german_date(F.col("b")).alias("b"), X.german_money(F.col("c")).alias("c")).first()
    assert (r.a, str(r.b), r.c) == ("rolex x", "2025-08-07", 1234.56)


def test_classes_of_titles(spark):
    df = spark.createDataFrame([("omega seamaster link",), ("rolex bracelet link",), ("rolex watch box",), (None,)], "t string")
    assert [r[0] for r in df.select(M.classify(F.col("t"))).collect()] == ["WRONG_BRAND", "WATCH_PART", "ACCESSORY", "UNKNOWN"]


def test_asof_join_by_buckets_equals_the_plain_one(spark):
    import random

    rng = random.Random(4)
    left = spark.createDataFrame([(i, rng.choice("ab"), rng.choice([None, *range(60)])) for i in range(300)], "id int, k string, t int")
    right = spark.createDataFrame([(rng.choice("ab"), rng.choice([None, *range(20, 55, 3)]), float(i)) for i in range(30)], "k string, u int, v double")
    plain = sorted(map(tuple, R.asof_join(left, right, "t", "u", "v", ["k"]).collect()))
    assert sorted(map(tuple, R.asof_join(left, right, "t", "u", "v", ["k"], lambda t: F.floor(F.col(t) / 7)).collect())) == plain
    assert sorted(map(tuple, R.asof_join(left.drop("k"), right.drop("k"), "t", "u", "v", [], lambda t: F.floor(F.col(t) / 7)).collect())) == sorted(map(tuple, R.asof_join(left.drop("k"), right.drop("k"), "t", "u", "v").collect()))


def test_rank_share_of_small_groups_is_taken_over_all(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", None), ("c", -5.0), ("c", 9.0)]
    got = {(r.g, r.v): r.s for r in S.with_pct_rank(spark.createDataFrame(rows, "g string, v double"), "v", "g", "s").collect()}
    assert got == {("a", 1.0): 1 / 3, ("a", 2.0): 2.5 / 3, ("b", 2.0): pytest.approx(4 / 6), ("b", None): 0.5, ("c", -5.0): pytest.approx(1 / 6), ("c", 9.0): pytest.approx(1.0)}


def test_exact_intervals():
    from partlens.functions.intervals import clopper_pearson

    assert clopper_pearson(0, 0) == (None, None)
    assert clopper_pearson(0, 10) == (0.0, pytest.approx(0.30850, abs=1e-5))
    assert clopper_pearson(15, 15) == (pytest.approx(0.78198, abs=1e-5), 1.0)
    assert clopper_pearson(28, 30) == (pytest.approx(0.77926, abs=1e-5), pytest.approx(0.99182, abs=1e-5))


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    from partlens.operators.sinks import Table

    t = Table(spark, str(tmp_path / "t")).replace(spark.range(5))
    with pytest.raises(Exception):
        t.replace(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")))
    assert t.read().count() == 5
    t.replace(spark.range(3))
    assert t.read().count() == 3


def test_numbers_are_consecutive_in_order(spark):
    from partlens.operators.sinks import numbered

    df = spark.range(1000).withColumn("k", (F.col("id") * 7919 % 1000))
    got = sorted((r.k, r.no) for r in numbered(spark, df, [F.col("k")], "no", 11).collect())
    assert got == [(i, i + 11) for i in range(1000)]


def test_candidates_meet_in_tiles_without_loss(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", (2, 3))
    items = [(i, b, c, p) for i, (b, c, p) in enumerate([("Rolex", "1535", "24680"), ("Tudor", "1535", "42"), (None, "1535", "1535-7"), ("Rolex", "8", "600"), ("Rolex", None, "24680"), ("Rolex", " ", None), ("Rolex", "1535", "24680")])]
    titles = [(i, t) for i, t in enumerate(["rolex 1535 wheel 24680", "tudor 1535-7 dial", "ROLEX 8 42 600", "1535", "rolex 15350 wheel", "1535 tudor 24680 1535", "8-600 crown"])]
    hold = lambda t, x: x and x.strip() and re.search(rf"(?i)\b{re.escape(x)}\b", t)
    want = set()
    for i, b, c, p in items:
        for k, t in titles:
            cal, prt, brd, cmp = hold(t, c), hold(t, p), hold(t, b), re.search("wheel|dial|crown", t)
            n = len(re.sub("[^a-zA-Z0-9]", "", p or ""))
            on = {"PART_NUMBER_EXACT": prt and n >= 5, "CALIBER_EXACT": cal, "BRAND_CALIBER": cal and brd, "BRAND_PART_NUMBER": prt and brd and n >= 5, "CALIBER_PART_NUMBER": prt and cal and n >= 3, "CALIBER_COMPONENT": cal and cmp, "BRAND_CALIBER_COMPONENT": cal and brd and cmp}
            want |= {(i, k, r) for r, x in on.items() if x}
    got = [tuple(r) for r in M.candidates(spark.createDataFrame(items, "item long, brand string, caliber string, part string"), spark.createDataFrame(titles, "title_id long, title string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["evidence_category", "evidence_fan_out"])
def test_evidence_of_items_is_told_without_their_pairs(spark, monkeypatch, name):
    from partlens.plans import registry

    monkeypatch.setattr(M, "candidates", None)
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["evidence_category", "token_candidates_7rules"])
def test_what_few_bytes_explode_to_is_not_sent_to_the_driver(spark, name):
    """Words, tokens and runs look small by the part table's bytes, but must not become broadcasts for it."""
    from partlens.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
