"""Queries work on all rows of their tables."""

import pytest

from partlens.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["fx_asof_keyed", "fx_asof_single", "fx_asof_fallback"])
def test_every_line_item_meets_the_asof_join(spark, name):
    assert registry.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


def test_set_coverage_by_hand(spark, tmp_path):
    rows = [(1, "a", 70.0), (1, "a", 5.0), (500, "a", 90.0), (501, "a", 10.0), (None, "a", 80.0), (502, "b", None), (503, "b", 30.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: tuple(r)[1:] for r in registry.queries()["set_coverage_compare"](spark, str(tmp_path)).collect()}
    assert got == {"a": (2, 2, 3, 1), "b": (0, 0, 0, 0)}


def test_every_part_has_a_match_summary(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey").collect()
    got = registry.queries()["inventory_match_summary"](spark, DATA).select("item").collect()
    assert sorted(r.item for r in got) == sorted(r.p_partkey for r in parts)
