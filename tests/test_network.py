"""Micro-networks with results worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from meshwright.functions.conditions import condition, holds, is_missing
from meshwright.operators import blocks, graph, reports, traces, versions
from meshwright.operators.traces import Network

POINT = "node long, class string, fid long, ag int, at int, closed boolean, assetid string, lifecycle int, categories array<string>, attrs map<string,string>"
EDGE = "eid long, class string, fid long, a long, b long, length double, size double, lifecycle int, tier string, reverse boolean"


def network(spark, points, edges) -> Network:
    """``points``: node, category, closed. ``edges``: a, b."""
    p = [(n, "D", n, 1, 1, closed, f"id{n}", 3, [cat] if cat else [], {}) for n, cat, closed in points]
    e = [(k, "L", k, a, b, 1.0, None, 3, None, False) for k, (a, b) in enumerate(edges)]
    return Network(spark.createDataFrame(p, POINT), spark.createDataFrame(e, EDGE))


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def ids(df):
    return {r[0] for r in df.collect()}


@pytest.fixture()
def line3(spark):
    """Source 1, valve 2, joint 3, customer 4."""
    return network(spark, [(1, "source", False), (2, "isolating", False), (3, None, False), (4, "customer", False)], [(1, 2), (2, 3), (3, 4)])


def test_connected_stops_behind_a_wall(spark, line3):
    got = traces.connected(line3, nodes(spark, 1), nodes(spark, 2)).collect()
    assert {(r.kind, r.fid) for r in got} == {("point", 1), ("point", 2), ("line", 0)}


def test_blocked_start_spreads(spark, line3):
    assert ids(graph.reach(graph.both_ways(line3.edges), nodes(spark, 2), nodes(spark, 2))) == {1, 2, 3, 4}


def test_isolation(spark, line3):
    got = traces.isolation(line3, nodes(spark, 3))
    assert ids(got["to_close"]) == {2}
    assert ids(got["customers"]) == {4}


def test_shortest_path(spark, line3):
    assert {tuple(r) for r in traces.shortest_path(line3, nodes(spark, 4), nodes(spark, 1)).collect()} == {(4, 0.0), (3, 1.0), (2, 2.0), (1, 3.0)}
    assert traces.shortest_path(line3, nodes(spark, 4), nodes(spark, 99)).count() == 0


def test_two_sources_meet(spark):
    points = [(1, "source", False), (2, "isolating", True), (3, "source", False), (4, "customer", False)]
    net = network(spark, points, [(1, 2), (2, 3), (3, 4)])
    stats = {r.name: (r.points, r.customers) for r in traces.subnetwork_stats(net, net.controllers()).collect()}
    assert stats == {"id1": (2, 0), "id3": (3, 1)}


def test_empty_network(spark):
    net = network(spark, [], [])
    assert traces.connected(net, nodes(spark)).count() == 0
    assert traces.loops(net).count() == 0


def parts(n, edges, skip_edge=None, skip_node=None):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for k, (a, b) in enumerate(edges):
            if k == skip_edge or skip_node in (a, b):
                continue
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_and_losses_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 12
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(13)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(edges)], "eid long, a long, b long")
    whole = len(set(parts(n, edges)))
    want = {k for k, (a, b) in enumerate(edges) if a != b and len(set(parts(n, edges, skip_edge=k))) > whole}
    assert ids(blocks.bridges(frame)) == want
    root = edges[0][0]
    fed = {x for x, label in enumerate(parts(n, edges)) if label == parts(n, edges)[root]}
    weights = spark.createDataFrame([(x, 1) for x in range(n)], "node long, weight long")
    got = {r.node: r.lost for r in blocks.lost_below(frame, nodes(spark, root), weights).collect()}
    for x in fed:
        label = parts(n, edges, skip_node=x)
        still = set() if x == root else {y for y in fed if y != x and label[y] == label[root]}
        assert got[x] == len(fed) - len(still)


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(spark.range(201).withColumnRenamed("id", "node"), chain)
    assert ids(got.select("component")) == {0}


def test_conditions(spark):
    row = spark.range(1).select(
        condition(F.lit("10"), ">", 9), condition(F.lit("B"), "=", "b"), condition(F.lit(None), "=", "b"), condition(F.lit(""), "is empty"), holds(F.lit("No")), holds(F.lit("yes")), is_missing(F.lit(""))
    )
    assert tuple(row.first()) == (True, True, False, True, False, True, True)


def test_best_price(spark):
    counted = spark.createDataFrame([("Line", "L", 1, 1, 50.0, 2, 30), ("Line", "L", 2, 1, 50.0, 1, 5)], "role string, class string, ag int, at int, size double, pieces long, length long")
    prices = spark.createDataFrame(
        [("L", 1, None, None, 1.0, "m", 0), ("L", 1, 1, 50.0, 3.0, "m", 1), ("L", 1, 1, 50.0, 4.0, "m", 2)], "class string, ag int, at int, size double, price double, unit string, price_row int"
    )
    got = {r.ag: (r.price, r.cost, r.missing) for r in reports.cost_estimate(counted, prices).collect()}
    assert got == {1: (3.0, 90.0, False), 2: (None, None, True)}


def test_three_way_merge(spark):
    schema = "gid long, x string, y string"
    base = spark.createDataFrame([(1, "a", "a"), (2, "a", "a"), (3, "a", "a"), (4, "a", "a"), (5, "a", None)], schema)
    mine = spark.createDataFrame([(1, "v", "a"), (2, "v", "a"), (4, "a", "v"), (5, "a", None), (6, "n", "n")], schema)
    theirs = spark.createDataFrame([(1, "a", "p"), (2, "p", "a"), (3, "p", "a"), (5, None, "q")], schema)
    keys, fields = ["gid"], ["x", "y"]
    found = {r.gid: (r.version_kind, r.parent_kind, r.conflict) for r in versions.diff(base, mine, theirs, keys, fields).collect()}
    assert found == {1: ("update", "update", False), 2: ("update", "update", True), 3: ("delete", "update", True), 4: ("update", "delete", True), 5: (None, "update", False), 6: ("insert", None, False)}
    merged = {tuple(r) for r in versions.reconcile(base, mine, theirs, keys, fields).collect()}
    assert merged == {(1, "v", "p"), (2, "v", "a"), (4, "a", "v"), (5, None, "q"), (6, "n", "n")}
    with pytest.raises(ValueError):
        versions.post(mine, theirs, base, keys, fields)
