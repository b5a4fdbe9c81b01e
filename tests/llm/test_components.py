import random

import pytest
from pyspark.sql import functions as F

from kgspark.llm import components as C


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a in up and b in up and a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {n: root(n) for n in nodes}


def frames(spark, nodes, links):
    return spark.createDataFrame([(n,) for n in nodes], "n bigint"), spark.createDataFrame(links, "a bigint, b bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_union_find(spark, seed):
    r = random.Random(seed)
    nodes = list(range(300))
    links = [(r.randrange(320), r.randrange(320)) for _ in range(200)]
    want = union_find(nodes, links)
    got = {x.node: x.group for x in C.grouped(*frames(spark, nodes, links)).collect()}
    assert got == want


def test_chain_and_hub(spark):
    nodes = list(range(1, 201))
    chain = [(i, i + 1) for i in range(1, 100)]
    hub = [(150, i) for i in range(101, 201)]
    got = {x.node: x.group for x in C.linked(*frames(spark, nodes, chain + hub)).collect()}
    assert got == union_find(nodes, chain + hub)


def test_hot_keys_take_the_spread_path(spark, monkeypatch):
    from kgspark.plans import skew

    monkeypatch.setattr(skew, "HOT_FLOOR", 5)
    monkeypatch.setattr(skew, "HOT_MAX", 10)
    nodes = list(range(60))
    links = [(7, i) for i in range(40)] + [(50, 51), (52, 51)]
    got = {x.node: x.group for x in C.grouped(*frames(spark, nodes, links)).collect()}
    assert got == union_find(nodes, links)


def test_odd_rows(spark):
    nodes, links = frames(spark, [1, 2, 2, None, 3, 9], [(1, 2), (2, 1), (1, 1), (3, None), (None, None), (3, 77), (1, 2)])
    got = {(x.node, x.group) for x in C.linked(nodes, links).collect()}
    assert got == {(1, 1), (2, 1)}
    assert {(x.node, x.group) for x in C.grouped(nodes, links).collect()} == {(1, 1), (2, 1), (3, 3), (9, 9)}


def test_empty(spark):
    nodes, links = frames(spark, [], [])
    assert C.linked(nodes, links).count() == 0
    assert C.grouped(nodes, links).count() == 0


def test_only_true_verdicts(spark):
    p = spark.createDataFrame([(1, 2, True, "x"), (2, 3, None, "x"), (3, 4, False, "x")], "left_no bigint, right_no bigint, verdict boolean, hi string")
    assert [tuple(r) for r in C.accepted_links(p).collect()] == [(1, 2)]


def test_too_few_rounds_is_an_error(spark):
    with pytest.raises(RuntimeError):
        C.star_edges(*frames(spark, list(range(50)), [(i, i + 1) for i in range(49)]), max_rounds=1)


def test_result_is_stable_under_shuffling(spark):
    links = [(5, 4), (4, 3), (9, 8)]
    a = C.linked(*frames(spark, range(10), links)).orderBy("node").collect()
    n, e = frames(spark, range(10), [(b, a) for a, b in reversed(links)])
    assert C.linked(n.orderBy(F.desc("n")), e).orderBy("node").collect() == a
