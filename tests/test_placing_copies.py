"""Customers and mains that share their place: each place is judged once, and rounds don't grow with its customers."""

import math
import random

import pytest

from meshwright.operators import placing
from meshwright.operators import topology as top

from .test_placing import TOL, lines


@pytest.mark.parametrize("seed", [1, 2])
def test_taps_of_shared_places(spark, monkeypatch, seed):
    rng = random.Random(seed)
    spots = [rng.uniform(0, 6) for _ in range(12)]
    choices = [(n, "created", n % 3, rng.choice(spots), 0.0) for n in range(120)]
    old = [(2.0, 0.0), (2.0, 0.0)]
    taps, want = list(old), {}
    for n, _, line, x, y in choices:
        best = min(((math.hypot(x - a, y - b), a, b) for a, b in taps if math.hypot(x - a, y - b) <= 0.4), default=None)
        want[n] = (line, *(best[1:] if best else (x, y)), best is not None)
        if not best:
            taps.append((x, y))
    turns = []
    known = placing.in_turn
    monkeypatch.setattr(placing, "in_turn", lambda waiting, *a: turns.append(waiting.count()) or known(waiting, *a))
    found = placing.service_taps(spark.createDataFrame(choices, "customer long, result string, line long, tap_x double, tap_y double"), spark.createDataFrame(old, "x double, y double"), 0.4)
    assert {r.customer: (r.line, r.tap_x, r.tap_y, r.reused) for r in found.collect()} == want
    assert turns == [len({x for *_, x, _ in choices})]


def test_choices_of_shared_places(spark, monkeypatch):
    road, wall = [(0, 0), (20, 0)], [(5, -5), (5, 0.5)]
    mains = lines(spark, [(k, road) for k in range(10, 30)] + [(k, [(0, 4), (20, 4)]) for k in range(30, 33)] + [(40, wall), (41, wall)])
    spots = [(k, 3.0, 1.0) for k in range(50)] + [(k, 5.0, 2.0) for k in range(50, 60)]
    compared = []
    known = top.near_segments
    monkeypatch.setattr(top, "near_segments", lambda *a: compared.append(known(*a)) or compared[-1])
    found = placing.service_choices(spark.createDataFrame(spots, "customer long, x double, y double"), mains, 6.0, 0.5, TOL, 5.0).collect()
    # Every road touches its own copies where a service ends.
    assert {r.customer: (r.result, r.line) for r in found} == {k: ("crossing", None) for k in range(60)}
    free = placing.service_choices(spark.createDataFrame(spots, "customer long, x double, y double"), mains, 6.0, 0.5, TOL, 5.0, crossing=True).collect()
    assert {r.customer: (r.result, r.line) for r in free} == {k: ("created", 10 if k < 50 else 40) for k in range(60)}
    assert compared[0].count() <= 2 * 3
