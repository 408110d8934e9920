"""Snapping and service connections against a plain walk through the features by number."""

import math
import random

import pytest

from meshwright.operators import placing

LINES = "line long, part int, path array<struct<x:double,y:double>>, level_a int, level_b int, endvertex boolean"
TOL, GAP = 0.05, 1.0


def lines(spark, paths):
    return spark.createDataFrame([(k, 0, [(float(x), float(y)) for x, y in p], 0, 0, False) for k, p in paths], LINES)


def nearest(x, y, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / n)) if n else 0.0
    px, py = x1 + t * dx, y1 + t * dy
    return math.hypot(x - px, y - py), px, py


def walk(points, paths):
    """One point after the other; new vertices are seen by later ones."""
    corners = {k: [(float(x), float(y)) for x, y in p] for k, p in paths}
    shape = {k: list(v) for k, v in corners.items()}
    out = {}
    for n, x, y in sorted(points):
        if any(math.hypot(x - a, y - b) <= TOL for v in corners.values() for a, b in v):
            continue
        best = None
        for k, p in shape.items():
            if len(p) < 2:
                continue
            sd, sx, sy = min(nearest(x, y, *a, *b) for a, b in zip(p, p[1:], strict=False))
            vd, vx, vy = min((math.hypot(x - a, y - b), a, b) for a, b in corners[k])
            cand = (vd, k, vx, vy, True) if vd <= max(1.5 * sd, TOL) else (sd, k, sx, sy, False)
            if cand[0] <= GAP and (best is None or cand < best):
                best = cand
        if best:
            out[n] = (round(best[2], 9), round(best[3], 9), best[1], best[4])
            if not best[4]:
                corners[best[1]].append(best[2:4])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_points_snap_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    paths = [(k, [(rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(rng.choice([2, 3]))]) for k in range(8)]
    points = [(n, rng.uniform(0, 12), rng.uniform(0, 12)) for n in range(50)] + [(60, *paths[0][1][0])]
    found = placing.snapped_points(spark.createDataFrame(points, "point long, x double, y double"), lines(spark, paths), TOL, GAP, 3.0).collect()
    assert {r.point: (round(r.x, 9), round(r.y, 9), r.line, r.vertex) for r in found} == walk(points, paths)


def test_new_vertices_lie_in_order(spark):
    road = lines(spark, [(1, [(0, 0), (10, 0), (10, 10)]), (2, [(0, 5), (5, 5)])])
    made = spark.createDataFrame([(1, 0, 0, 7.0, 0.0), (1, 0, 0, 3.0, 0.0), (1, 0, 1, 10.0, 4.0), (1, 0, 0, 3.0, 0.0)], "line long, part int, seg int, x double, y double")
    got = {r.line: [tuple(p) for p in r.path] for r in placing.with_vertices(road, made).collect()}
    assert got == {1: [(0, 0), (3, 0), (7, 0), (10, 0), (10, 4), (10, 10)], 2: [(0, 5), (5, 5)]}


def test_which_main_serves(spark):
    mains = lines(spark, [(1, [(0, 0), (20, 0)]), (2, [(0, 4), (20, 4)]), (3, [(8, -9), (8, -1)])])
    spots = [(1, 3.0, 1.0), (2, 3.0, 6.5), (3, 5.0, 0.01), (4, 3.0, 30.0), (5, 8.5, -5.0), (6, None, 1.0), (7, 5.0, 4.0)]
    found = {r.customer: (r.result, r.line) for r in placing.service_choices(spark.createDataFrame(spots, "customer long, x double, y double"), mains, 6.0, 0.5, TOL, 5.0).collect()}
    # The third touches main 1 and goes to main 2; the seventh lies on main 2, which its way to main 1 would touch.
    assert found == {1: ("created", 1), 2: ("created", 2), 3: ("created", 2), 4: ("too_far", None), 5: ("created", 3), 6: ("no_geometry", None), 7: ("touching", None)}
    near = spark.createDataFrame([(1, 5.0, 0.01), (2, 30.0, 5.0)], "customer long, x double, y double")
    only = placing.service_choices(near, lines(spark, [(1, [(0, 0), (20, 0)])]), 6.0, 0.5, TOL, 5.0)
    assert {r.customer: r.result for r in only.collect()} == {1: "touching", 2: "too_far"}
    between = spark.createDataFrame([(1, 5.0, 2.0)], "customer long, x double, y double")
    walls = lines(spark, [(1, [(0, 0), (20, 0)]), (2, [(5, -5), (5, 0)])])
    assert placing.service_choices(between, walls, 6.0, 0.5, TOL, 5.0).collect()[0].result == "crossing"
    assert placing.service_choices(between, walls, 6.0, 0.5, TOL, 5.0, crossing=True).collect()[0].line == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_taps_serve_again(spark, seed):
    rng = random.Random(seed)
    choices = [(n, "created" if rng.random() < 0.9 else "too_far", n % 3, rng.uniform(0, 15), 0.0) for n in range(60)]
    old = [(2.0, 0.0), (11.5, 0.0)]
    taps, want = list(old), {}
    for n, result, line, x, y in choices:
        if result != "created":
            continue
        best = min(((math.hypot(x - a, y - b), a, b) for a, b in taps if math.hypot(x - a, y - b) <= 0.4), default=None)
        want[n] = (line, *(best[1:] if best else (x, y)), best is not None)
        if not best:
            taps.append((x, y))
    found = placing.service_taps(spark.createDataFrame(choices, "customer long, result string, line long, tap_x double, tap_y double"), spark.createDataFrame(old, "x double, y double"), 0.4)
    assert {r.customer: (r.line, r.tap_x, r.tap_y, r.reused) for r in found.collect()} == want


def test_nothing_to_place(spark):
    none = spark.createDataFrame([], "point long, x double, y double")
    assert placing.snapped_points(none, lines(spark, []), TOL, GAP, 3.0).count() == 0
    assert placing.service_choices(none.withColumnRenamed("point", "customer"), lines(spark, []), 6.0, 0.5, TOL, 5.0).count() == 0
