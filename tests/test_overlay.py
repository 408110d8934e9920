"""Polygon overlay against shapes worked out by hand, unit squares, and a raster of random triangles."""

import random
from collections import deque

import pytest

from meshwright.operators import overlay

RING = "area long, ring array<struct<x:double,y:double>>"


def polygons(spark, *rows):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in ring]) for k, ring in rows], RING)


def box(x1, y1, x2, y2):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def holes(df):
    return sorted((round(r.gap_area, 6), round(r.x, 6), round(r.y, 6), r.area) for r in df.collect())


def test_a_frame_has_a_gap_in_every_cell_size(spark):
    frame = polygons(spark, (1, box(0, 0, 10, 2)), (2, box(0, 8, 10, 10)), (3, box(0, 1, 2, 9)), (4, box(8, 2, 10, 8)))
    for size in (3.0, 7.3, 100.0):
        assert holes(overlay.gaps(frame, 0.01, size)) == [(36.0, 5.0, 5.0, 1)]
        assert sorted((r.area, r.other, round(r.overlap, 6)) for r in overlay.overlaps(frame, 0.01, size).collect()) == [(1, 3, 2.0), (2, 3, 2.0)]
    assert [(r.code, r.message) for r in overlay.overlay_issues("T02", overlay.gaps(frame, 0.01, 7.3)).collect()] == [("T02", "Must not have gaps: gap of 36.00")]


def test_gaps_that_touch_in_a_corner_are_two(spark):
    squares = [(10 * i + j, box(i, j, i + 1, j + 1)) for i in range(4) for j in range(4) if (i, j) not in ((1, 1), (2, 2))]
    assert holes(overlay.gaps(polygons(spark, *squares), 0.01, 1.7)) == [(1.0, 1.5, 1.5, 0), (1.0, 2.5, 2.5, 12)]


def test_an_open_bay_is_no_gap_and_an_island_splits_none(spark):
    bay = polygons(spark, (1, [(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)]))
    assert overlay.gaps(bay, 0.01, 2.3).count() == 0
    ring = polygons(spark, (1, box(0, 0, 9, 9)), (1, box(2, 2, 7, 7)), (2, box(4, 4, 5, 5)))
    assert sum(g[0] for g in holes(overlay.gaps(ring, 0.01, 2.3))) == 25.0


def test_slanted_edges_and_half_hidden_sides(spark):
    shapes = polygons(spark, (1, [(0, 0), (6, 0), (3, 6)]), (2, [(0, 4), (3, -2), (6, 4)]), (3, box(100, 100, 101, 101)))
    # Two triangles cross to a star; their common part is a hexagon.
    found = overlay.overlaps(shapes, 0.01, 2.1).collect()
    assert [(r.area, r.other, round(r.overlap, 9)) for r in found] == [(1, 2, 12.0)]
    cover = polygons(spark, (9, box(-1, -3, 3, 9)), (8, box(2, -3, 7, 2)))
    bare = {r.area: round(r.bare, 9) for r in overlay.uncovered(shapes, cover, 0.01, 2.1).collect()}
    assert bare == {1: 4.0, 2: 5.0, 3: 1.0}
    hit = overlay.overlaps_with(shapes, cover, 0.01, 2.1).collect()
    assert {(r.area, r.other) for r in hit} == {(1, 8), (2, 8)}


def by_squares(rects):
    covered = {(x, y) for x1, y1, x2, y2 in rects for x in range(x1, x2) for y in range(y1, y2)}
    free = {(x, y) for x in range(-1, 31) for y in range(-1, 31)} - covered
    out = []
    while free:
        queue, part = deque([free.pop()]), []
        part.append(queue[0])
        while queue:
            x, y = queue.popleft()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in free:
                    free.remove(n)
                    part.append(n)
                    queue.append(n)
        if (-1, -1) not in part:
            out.append(len(part))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_rectangles(spark, monkeypatch, seed):
    monkeypatch.setattr(overlay, "CELL_EDGES", 60)
    rng = random.Random(seed)
    rects = []
    for _ in range(70):
        x, y = rng.randint(0, 26), rng.randint(0, 26)
        rects.append((x, y, x + rng.randint(1, 4), y + rng.randint(1, 4)))
    shapes = polygons(spark, *[(k, box(*r)) for k, r in enumerate(rects)])
    assert sorted(round(r.gap_area, 6) for r in overlay.gaps(shapes, 0.01, 40.0).collect()) == by_squares(rects)
    want = {}
    for i, a in enumerate(rects):
        for j in range(i + 1, len(rects)):
            b = rects[j]
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if w > 0 and h > 0:
                want[i, j] = float(w * h)
    assert {(r.area, r.other): round(r.overlap, 6) for r in overlay.overlaps(shapes, 0.01, 11.0).collect()} == want


def test_crowded_cells_are_cut(spark):
    shapes = polygons(spark, *[(k, box(k % 20, k // 20, k % 20 + 1, k // 20 + 1)) for k in range(400)])
    cells = overlay.in_cells(shapes.selectExpr("0 as layer", "*"), 50.0, 40)
    crowd = cells.groupBy("level", "cx", "cy").agg({"*": "count"}).collect()
    assert max(r["count(1)"] for r in crowd) <= 10 and max(r.level for r in crowd) >= 2
    assert overlay.gaps(shapes, 0.01, 50.0).count() == 0


def test_empty_and_degenerate(spark):
    assert overlay.gaps(polygons(spark), 0.1, 5.0).count() == 0
    flat = polygons(spark, (1, [(0, 0), (1, 1)]), (2, [(0, 0), (5, 0), (9, 0)]), (3, []))
    assert overlay.overlaps(flat, 0.0, 5.0).count() == 0 and overlay.gaps(flat, 0.0, 5.0).count() == 0
