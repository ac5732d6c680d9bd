import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import check, connect

from tesserae.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    check(spark, con, SMALL, QUERIES[name], ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_communities_cover_every_node_once_and_join_what_belongs_together(spark):
    from tesserae.operators.graph import modularity
    from tesserae.operators.modularity import communities

    two = [(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.1)]
    pairs = spark.createDataFrame(two, "u long, v long, w double")
    first, second = communities(pairs), communities(pairs.repartition(3))
    rows = {r.node: r.community for r in first.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert rows == {r.node: r.community for r in second.collect()}
    assert len({rows[1], rows[2], rows[3]}) == 1 and len({rows[4], rows[5], rows[6]}) == 1 and rows[1] != rows[4]
    assert modularity(pairs, first).first()[0] > 0.3


def _clusters(sizes, bridge=0.1):
    """Cliques of consecutive numbers, each with a weak link to the next."""
    pairs, start = [], 0
    for n in sizes:
        pairs += [(i, j, 1.0) for i in range(start, start + n) for j in range(i + 1, start + n)]
        start += n
        pairs.append((start - 1, start, bridge))
    return pairs[:-1]


def test_communities_by_rounds_equal_those_of_one_task(spark):
    from tesserae.operators.modularity import communities

    pairs = spark.createDataFrame(_clusters([4, 3, 5]), "u long, v long, w double")
    # here greedy merges and moves end where the levels of one task do
    alone = {r.node: r.community for r in communities(pairs).collect()}
    assert alone == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(4, 7), 4), **dict.fromkeys(range(7, 12), 7)}
    assert alone == {r.node: r.community for r in communities(pairs.repartition(3), few=0).collect()}


def test_large_communities_are_split(spark):
    from tesserae.operators.modularity import communities

    # at resolution 2 the seven of a clique score -2/7 apart and -1 together
    rows = _clusters([4, 4], 0.5) + [(100 + i, 100 + j, 1.0) for i in range(7) for j in range(i + 1, 7)]
    pairs = spark.createDataFrame(rows, "u long, v long, w double")
    got = {}
    for r in communities(pairs, resolution=0.05, most=5).collect():
        got.setdefault(r.community, set()).add(r.node)
    assert got == {0: set(range(4)), 4: set(range(4, 8)), **{100 + i: {100 + i} for i in range(7)}}
    whole = communities(pairs, resolution=0.05)
    assert sorted(r["count"] for r in whole.groupBy("community").count().collect()) == [7, 8]


def test_communities_of_odd_pairs(spark):
    from tesserae.operators.modularity import communities

    odd = [(1, 2, 1.0), (2, 1, 1.0), (1, 2, 1.0), (3, 3, 9.0), (None, 4, 1.0), (5, 6, None), (7, 8, 0.0), (-9, -8, 1.0)]
    shape = "u long, v long, w double"
    assert sorted(map(tuple, communities(spark.createDataFrame(odd, shape)).collect())) == [(-9, -9), (-8, -9), (1, 1), (2, 1)]
    assert communities(spark.createDataFrame([], shape)).count() == 0


def test_communities_beat_given_folders(spark):
    import random

    from tesserae.operators.graph import modularity
    from tesserae.operators.modularity import communities

    r = random.Random(5)
    rows = [(i, j, 1.0) for i in range(40) for j in range(i) if r.random() < (0.6 if i % 4 == j % 4 else 0.05)]
    pairs = spark.createDataFrame(rows, "u long, v long, w double")
    folders = spark.createDataFrame([(i, i % 4) for i in range(40)], "node long, community long")
    assert modularity(pairs, communities(pairs)).first()[0] >= modularity(pairs, folders).first()[0]
