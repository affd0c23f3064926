"""Components of few links, in one task, and of many, in steps over all tasks."""

import numpy as np
import pytest

from partlens.llm import common

RNG = np.random.default_rng(7)


def _links():
    chain = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5000, i) for i in range(5001, 5200)]
    some = [tuple(map(int, x)) for x in RNG.integers(-300, 300, (250, 2))]
    return [*chain, *star, *some, (7, 7), (9999, 9999), (None, 3), *some[:20], *((b, a) for a, b in some[:20])]


def _plain(links):
    group = {x: x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    for a, b in links:
        if a in group and b in group and group[a] != group[b]:
            lo, hi = sorted((group[a], group[b]))
            group = {k: lo if v == hi else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("few, most", [(common.FEW_LINKS, 1), (-1, 99)])
def test_components_of_few_and_of_many_links(spark, monkeypatch, few, most):
    tables = []
    monkeypatch.setattr(common, "FEW_LINKS", few)
    monkeypatch.setattr(common, "materialize", lambda s, df, tag, write=common.materialize: tables.append(tag) or write(s, df, tag))
    links = _links()
    got = {r.node: r.component for r in common.components(spark, spark.createDataFrame(links, "a long, b long"), "test-cc").collect()}
    assert got == _plain(links)
    # a table for each step is what takes time where links are few
    assert len(tables) <= most and (few > 0 or len(tables) > 2)


def test_no_links_have_no_components(spark):
    assert common.components(spark, spark.createDataFrame([], "a long, b long"), "test-cc").count() == 0
