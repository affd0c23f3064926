import random

from pyspark.sql import functions as F

from partlens.functions import stats as S
from partlens.plans import registry

DATA = "/root/testdata/sf0.001"


def test_binomial_quantiles_by_hand(spark):
    rows = [(2, 0.5, 0, 2), (10, 0.3, 1, 5), (1, 0.04, 0, 0), (1, 0.06, 0, 1), (0, 0.7, 0, 0), (50, 0.0, 0, 0), (50, 1.0, 50, 50), (2000, 0.999, 1995, 2000)]
    df = spark.createDataFrame(rows, "n int, p double, lo int, hi int").withColumn("q", S.binomial_quantiles(F.col("n"), F.col("p")))
    assert [(r.q.q0, r.q.q1) for r in df.collect()] == [(r[2], r[3]) for r in rows]


def test_units_are_those_of_two_thousand_trials(spark):
    got = {r.p_partkey: r for r in registry.queries()["monte_carlo_units"](spark, DATA).collect()}
    probs = {r["item"]: r for r in registry.queries()["turnover_hazard"](spark, DATA).collect()}
    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    assert set(got) == {r.p_partkey for r in parts}
    rng = random.Random(1)
    for r in parts[:40]:
        x = got[r.p_partkey]
        for name, mean, lo, hi in (("p30", x.mean30, x.p5_30, x.p95_30), ("p90", x.mean90, x.p5_90, x.p95_90)):
            p = probs[r.p_partkey][name] if r.p_partkey in probs else 0.0
            runs = sorted(sum(rng.random() < p for _ in range(r.p_size)) for _ in range(2000))
            assert abs(mean - r.p_size * p) < 1e-3
            assert abs(mean - sum(runs) / 2000) < 0.5
            assert abs(lo - runs[100]) <= 1 and abs(hi - runs[1900]) <= 1
