"""Edges of a map are cut by way of their places, and near networks are walked without components."""

import random

from meshwright.operators import graph
from meshwright.operators import topology as top

PATHS = "line long, part int, path array<struct<x:double,y:double>>, level_a int, level_b int, endvertex boolean"


def test_edges_cut_at_places_are_those_cut_at_tokens(spark):
    rng = random.Random(3)
    place = lambda: (float(rng.randrange(4)), float(rng.randrange(4)))
    rows = [(k, k % 2, [place() for _ in range(1 + rng.randrange(5))], rng.choice([None, 0, 1]), rng.choice([None, 1]), rng.choice([None, True, False])) for k in range(40)]
    lines = spark.createDataFrame(rows, PATHS)
    points = spark.createDataFrame([(k, *place()) for k in range(5)], "point long, x double, y double")
    at = top.hub_nodes(lines, points, 0.1).cache()
    cut = top.edges_at(lines, at)
    expected = top.split_edges(lines, top.tokens_at(lines, points, at).select("token", "node"))
    assert sorted(cut.collect()) == sorted(expected.collect())
    # By place, by line, and once for the places themselves.
    assert cut._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3


def test_levels_find_what_components_find(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(32)] + [(None, 3)], "a long, b long")
    starts = spark.createDataFrame([(1,), (2,)], "node long")
    ends = spark.createDataFrame([(4,), (9,)], "node long")
    walls = spark.createDataFrame([(k,) for k in (2, 4, 7, 11, 20)], "node long")
    found = lambda levels: {r["node"] for r in graph.spread(edges, starts, walls, ends, levels).collect()}
    assert found(0) == found(1) == found(40)


def test_edges_of_a_search_with_walls(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(25), rng.randrange(25)) for k in range(40)] + [(90, None, 1), (91, 1, None), (92, None, 2), (93, 2, None)]
    edges = spark.createDataFrame(rows, "eid long, a long, b long")
    walls, first = {2, 5, 8, 13, 21}, {1, 5}
    blocked, starts = spark.createDataFrame([(w,) for w in walls], "node long"), spark.createDataFrame([(s,) for s in first], "node long")
    reached = graph.reach(graph.both_ways(edges), starts, blocked)
    gone = {r["node"] for r in reached.collect()} - walls - {None} | first
    got = graph.crossed_edges(edges, reached, blocked, starts)
    assert sorted(r["eid"] for r in got.collect()) == sorted(k for k, a, b in rows if a in gone or b in gone)


def test_ways_need_no_names(spark):
    rows = [(1, 2, "a", 1.0), (2, 3, "b", 1.0), (1, 4, "c", 1.0), (4, 3, "d", 1.0), (3, 5, "e", 2.0)]
    ways = graph.both_ways(spark.createDataFrame(rows, "a long, b long, line string, weight double"), "line", "weight")
    starts = spark.createDataFrame([(1,)], "node long")
    named = {(r["node"], r["dist"], r["parent"]) for r in graph.distances(ways, starts).collect()}
    bare = graph.distances(ways.drop("line"), starts).collect()
    assert {(r["node"], r["dist"], r["parent"]) for r in bare} == named
    assert {r["via"] for r in bare} == {None}


def test_conditions_are_judged_before_lines_are_staged(spark, monkeypatch):
    from meshwright.plans import graph_queries as gq

    written = []
    monkeypatch.setattr(gq, "staged", lambda df, label="stage": written.append(df.columns) or df)
    monkeypatch.setattr(gq.traces, "connected", lambda net, starts, walls: walls)
    gq.trace_condition_barriers(spark, "/root/testdata/sf0.001")
    assert written == [list(gq.LINE)]
