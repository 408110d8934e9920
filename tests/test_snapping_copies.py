"""Points of one place share a turn, and lines of one shape are compared once, with the results of a walk one by one."""

import random

import pytest

from meshwright.operators import placing
from tests.test_placing import GAP, TOL, lines, walk


@pytest.mark.parametrize("seed", [3])
def test_copies_of_points_and_lines_snap_as_if_one_by_one(spark, seed):
    rng = random.Random(seed)
    drawn = [[(rng.uniform(0, 7), rng.uniform(0, 7)) for _ in range(rng.choice([1, 2, 3]))] for _ in range(6)]
    paths = [(k, drawn[k % 6]) for k in range(18)]
    places = [(rng.uniform(0, 7), rng.uniform(0, 7)) for _ in range(22)]
    points = [(n, *rng.choice(places)) for n in range(70)]
    found = placing.snapped_points(spark.createDataFrame(points, "point long, x double, y double"), lines(spark, paths), TOL, GAP, 3.0).collect()
    assert {r.point: (round(r.x, 9), round(r.y, 9), r.line, r.vertex) for r in found} == walk(points, paths)


def test_points_of_one_place_take_one_turn(spark, monkeypatch):
    turns, plain = [], placing.in_turn
    monkeypatch.setattr(placing, "in_turn", lambda waiting, radius, act: turns.append(waiting.count()) or plain(waiting, radius, act))
    points = spark.createDataFrame([(n, 2.0, 0.5) for n in range(30)], "point long, x double, y double")
    found = placing.snapped_points(points, lines(spark, [(k, [(0, 0), (5, 0)]) for k in range(4)]), TOL, GAP, 3.0).collect()
    assert turns == [1]
    assert {(r.point, r.line, r.x, r.y, r.vertex) for r in found} == {(n, 0, 2.0, 0.0, n > 0) for n in range(30)}
