"""Places that many features share: rows grow with the features, pairs are made only where they are the result."""

from itertools import combinations
from math import hypot
from random import Random

import pytest

import __spark_entry__
from meshwright.operators import graph
from meshwright.operators import topology as top
from meshwright.plans.staging import measured_joins, staged
from pyspark.sql import functions as F

from .test_map_network import lines, points

TOL = 0.1


def test_no_broadcast_by_file_size(spark):
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        query = measured_joins(lambda session, _: staged(session.range(9)).join(staged(session.range(9)), "id"))
        plan = query(spark, "")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert all(hasattr(__spark_entry__.queries()[k], "__wrapped__") for k in __spark_entry__.NETWORK)


def crowd(spark, seed):
    rng = Random(seed)
    spot = lambda: (rng.choice((0, 5, 10)) + rng.choice((0, 0, 0.05, 0.4)), float(rng.choice((0, 5))))
    drawn = lines(spark, *[(k, [spot() for _ in range(rng.choice((1, 2, 3, 3)))], {"level_b": rng.choice((0, 1)), "endvertex": rng.random() < 0.3}) for k in range(40)])
    spots = points(spark, *[(k, *spot(), {}) for k in range(8)]).selectExpr("*", "point % 4 = 0 as structure")
    return drawn, spots


@pytest.mark.parametrize("seed", [1, 2])
def test_as_by_all_pairs(spark, monkeypatch, seed):
    drawn, spots = crowd(spark, seed)
    pairs = staged(top.hits(drawn, spots, TOL), "all-pairs")
    looking = top.candidates(drawn, spots)
    joined = pairs.filter("not refused").select(F.col("token").alias("a"), F.col("other").alias("b"))
    nodes = graph.components(looking.select(F.col("token").alias("node")).union(joined.select("b")), joined)
    refused = pairs.filter("refused").select("token", F.split("other", ":")[1].cast("long").alias("line")).distinct()
    lonely = looking.join(pairs, "token", "left_anti")
    want = [sorted(map(tuple, d.collect())) for d in (nodes, refused, lonely.select("token"))]

    def no_pairs(*_):
        raise AssertionError("all pairs of a place")

    monkeypatch.setattr(top, "hits", no_pairs)
    assert sorted(map(tuple, top.coincident(drawn, spots, TOL).collect())) == want[0]
    assert sorted(map(tuple, top.refused_hits(drawn, spots, TOL).collect())) == want[1]
    assert sorted(map(tuple, top.alone(drawn, spots, TOL).select("token").collect())) == want[2]
    found = {r.token for r in top.connection_issues(drawn, spots, TOL, 0.5, 5.0).collect()}
    assert found <= {t for (t,) in want[2]}


def shared(p, q):
    """What two paths share: places where they cross freely, and the length along which they overlap."""
    spots, length = set(), 0.0
    for (x1, y1), (x2, y2) in zip(p, p[1:]):
        for (u1, w1), (u2, w2) in zip(q, q[1:]):
            dx, dy, ex, ey = x2 - x1, y2 - y1, u2 - u1, w2 - w1
            d, norm = dx * ey - dy * ex, hypot(dx, dy)
            side = (u1 - x1) * dy - (w1 - y1) * dx
            if d:
                t, u = ((u1 - x1) * ey - (w1 - y1) * ex) / d, side / d
                x, y = x1 + t * dx, y1 + t * dy
                off = lambda a, b: hypot(x - a, y - b) > TOL  # noqa: B023, E731
                if 0 <= t <= 1 and 0 <= u <= 1 and ((off(x1, y1) and off(x2, y2)) or (off(u1, w1) and off(u2, w2))):
                    spots.add((round(x, 6), round(y, 6)))
            elif norm and abs(side) / norm <= 1e-9:
                a, b = (((g - x1) * dx + (h - y1) * dy) / norm for g, h in ((u1, w1), (u2, w2)))
                length += max(0.0, min(max(a, b), norm) - max(min(a, b), 0))
    return spots, length


def test_crossings_compare_shapes(spark, monkeypatch):
    rng = Random(3)
    some = [[(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(3)] for _ in range(6)]
    paths = {k: rng.choice(some) for k in range(60)}
    drawn = lines(spark, *[(k, p, {}) for k, p in paths.items()])
    want = set()
    for a, b in combinations(sorted(paths), 2):
        spots, length = shared(paths[a], paths[b])
        want |= {("E19", a, b, x + 0.0, y + 0.0, None) for x, y in spots}
        if length > TOL:
            want.add(("E18", a, b, None, None, round(length, 6)))
    compared = []
    known = top.segment_pairs
    monkeypatch.setattr(top, "segment_pairs", lambda *a: compared.append(staged(known(*a))) or compared[0])
    found = [tuple(v if v is None or isinstance(v, str) else v + 0 for v in r) for r in top.crossings(drawn, TOL, 2.5).collect()]
    assert len(found) == len(want) and set(found) == want
    assert compared[0].count() <= (6 * 2) ** 2
