"""The embedding join over tiles: equal to brute force for vectors far apart, near and equal, and in proportion to the input in what it writes."""

import numpy as np
import pytest

from partlens.llm import embedding_join

RNG = np.random.default_rng(12)


def _far(n, dim):
    return RNG.standard_normal((n, dim))


def _around(n, dim, noise):
    return RNG.standard_normal(dim) + noise * RNG.standard_normal((n, dim))


def _plain(x):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = np.stack([(u * v).sum(axis=1) >= 0.9 for v in u]) & ~np.eye(len(u), dtype=bool)
    least = np.arange(len(u))
    while True:
        new = np.where(link, least, len(u)).min(axis=1, initial=len(u))
        new = np.minimum(least, new)
        if (new == least).all():
            return [(i, int(n), int(c), bool(i == c)) for i, (n, c) in enumerate(zip(link.sum(axis=1), least, strict=True))]
        least = new


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("dim", [3, 64])
def test_tiles_equal_brute_force(spark, monkeypatch, kind, dim):
    monkeypatch.setattr(embedding_join, "TILE", 70)
    some = _far(300, dim)
    # around one vector most pairs are near, about half of them link; chains and copies cross tiles
    x = np.concatenate([some, some[:60] + 0.2 * _far(60, dim), _around(200, dim, 0.33), some[:40]])[RNG.permutation(600)].astype("f4" if kind == "float" else "f8")
    got = embedding_join.near_vectors(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>"))
    assert sorted(map(tuple, got.collect())) == _plain(x)


def _written(spark):
    """Bytes that each stage has written, for shuffles and to tables; a long session forgets the first of them."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {s.stageId(): s.shuffleWriteBytes() + s.outputBytes() for s in map(stages.apply, range(stages.size()))}


def test_vectors_are_not_written_for_each_cell_they_lie_in(spark):
    x = _far(6000, 64).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4).cache()
    assert df.count() == 6000
    before = _written(spark)
    assert embedding_join.near_vectors(spark, df).count() == 6000
    assert x.nbytes < sum(n for stage, n in _written(spark).items() if stage > max(before)) < 4 * x.nbytes


def test_leading_dimensions_select():
    for dim in (64, 100, 768):
        k = embedding_join.lead(dim, 0.2)
        x, y = (embedding_join._unit(_far(20000, dim))[:, :k] for _ in range(2))
        assert k < dim and (((x - y) ** 2).sum(axis=1) <= 0.2).mean() < 1e-3
    assert embedding_join.lead(3, 0.2) == 3
