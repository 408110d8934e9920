"""Profiles of shuffled paths, and the paths that are refused."""

import random

import pytest

from meshwright.operators import profiles

PATH = "eid long, a long, b long, length double, reverse boolean"


def frame(spark, rows):
    rows = list(rows)
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, PATH)


def told(spark, rows, start=None):
    attributes = spark.createDataFrame([(r[0], 10.0 - r[0], 9.5 - r[0], 100.0 + r[0], f"p{r[0]}") for r in rows], "eid long, us_invert double, ds_invert double, diameter double, pipe string")
    ground = spark.createDataFrame([(5, 20.0)], "node long, elevation double")
    first = spark.createDataFrame([(start,)], "node long") if start is not None else None
    return [tuple(r) for r in profiles.profile(frame(spark, rows), attributes, ground, first).orderBy("seq").collect()]


#: 9 -> 5 -> 7 -> 3, the second one drawn against the flow, the third without direction.
ROWS = [(0, 9, 5, 1.5, False), (1, 7, 5, 2.0, True), (2, 7, 3, 4.25, None)]


def test_from_where_the_flow_leaves(spark):
    assert told(spark, ROWS) == [
        (0, 9, 0.0, None, None, 10.0, "p0", 100.0), (1, 5, 1.5, 20.0, 9.5, 9.0, "p1", 101.0), (2, 7, 3.5, None, 8.5, 8.0, "p2", 102.0), (3, 3, 7.75, None, 7.5, None, None, None),
    ]


def test_from_a_picked_end(spark):
    got = told(spark, ROWS, start=3)
    assert [r[1:3] for r in got] == [(3, 0.0), (7, 4.25), (5, 6.25), (9, 7.75)]
    assert [r[4:6] for r in got] == [(None, 7.5), (8.0, 8.5), (9.0, 9.5), (10.0, None)]
    assert [r[1] for r in told(spark, ROWS, start=7)][0] == 9


def test_a_long_shuffled_path(spark):
    rows = [(k, k, k + 1, 1.0, False) for k in range(3000)]
    got = profiles.ordered(frame(spark, rows)).collect()
    assert {(r.eid, r.seq, r.chainage) for r in got} == {(k, k + 1, k + 1.0) for k in range(3000)}


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(0, 1, 2, 1.0, False), (1, 2, 3, 1.0, False), (2, 2, 4, 1.0, False)],
        [(0, 1, 2, 1.0, False), (1, 2, 3, 1.0, False), (2, 3, 1, 1.0, False)],
        [(0, 1, 2, 1.0, False), (1, 5, 6, 1.0, False)],
        [(0, 1, 2, 1.0, False), (1, 5, 6, 1.0, False), (2, 6, 7, 1.0, False), (3, 7, 5, 1.0, False)],
    ],
)
def test_refused_paths(spark, rows):
    with pytest.raises(ValueError):
        profiles.ordered(frame(spark, rows))
