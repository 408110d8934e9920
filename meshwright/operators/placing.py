"""Placing features on lines: points that snap to the network, and service connections with their taps.

One placement can depend on another (a new vertex draws later points, a new tap serves later customers), and the result is that of working through
features by number. Only neighbours depend on each other, so all features act at once that have no smaller neighbour still
waiting; rounds go on until none waits. They are as many as the longest run of neighbours with rising numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators import topology as top
from meshwright.plans.staging import any_rows, staged

c = F.col
#: Mains that a customer looks at.
NEAREST = 5
#: A vertex is preferred to a place between vertices up to so many times its distance.
VERTEX_FACTOR = 1.5


def in_turn(waiting: DataFrame, radius: float, act: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """All results of ``act(ready, done)`` for features ``id, x, y``, as if they acted one after the other by ``id``.

    ``ready`` are the features of a round, ``done`` the results so far (null at first). Features farther apart than ``radius`` must not depend on each other.
    """
    places = waiting.select(c("id").alias("smaller"), c("x").alias("ox"), c("y").alias("oy"))
    before = staged(top.near(waiting.select("id", "x", "y"), places, radius).filter("smaller < id").select("id", "smaller"), "before")
    left, done = staged(waiting, "waiting"), None
    while any_rows(left):
        held = before.join(left.select(c("id").alias("smaller")), "smaller", "left_semi").select("id").distinct()
        ready = staged(left.join(held, "id", "left_anti"), "ready")
        found = staged(act(ready, done), "placed")
        done = found if done is None else done.unionByName(found)
        left = staged(left.join(ready.select("id"), "id", "left_anti"), "waiting")
    return done if done is not None else act(left, None)


def _at(t: Column) -> tuple[Column, Column]:
    return c("x1") + t * (c("x2") - c("x1")), c("y1") + t * (c("y2") - c("y1"))


def _apart(x: Column, y: Column) -> Column:
    return F.sqrt(F.pow(c("x") - x, 2) + F.pow(c("y") - y, 2))


def snapped_points(points: DataFrame, lines: DataFrame, tol: float, gap: float, size: float) -> DataFrame:
    """``point, x, y, line, part, seg, vertex``: points (``point, x, y``) that go onto a line within ``gap``, and where.

    A point at a vertex (within ``tol``) stays and has no row. Of all lines the nearest place counts, ties going to the smaller line and part; a vertex stands for its line if it is at
    most one and a half times as far as the nearest place between vertices, or within ``tol``. Where ``vertex`` is false a new vertex is
    made there, which later points see.

    Only the first point of a place can make a vertex: what it chose stays as near for those after it and is a vertex then, and a line whose vertices are
    all too far has no nearer place than before. So places take turns, however many points stand there, and all points are judged once
    by the vertices made before them. Of lines of one shape that got no vertex, only the least can be chosen.
    """
    drawn, members = top.shapes(lines)
    corners = staged(top.vertices(lines).select("ox", "oy").distinct(), "corners")
    shapes = staged(drawn.select(c("line").alias("shape"), "part", "path"), "shape-paths")
    waiting = points.select(c("point").alias("id"), "x", "y").filter("x is not null and y is not null")
    here = waiting.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y")
    close = staged(top.near(here, corners, tol).select("x", "y").distinct(), "at-vertex")
    waiting = staged(waiting.join(close, ["x", "y"], "left_anti").select("id", "x", "y"), "free-points")
    firsts = staged(here.join(close, ["x", "y"], "left_anti").select("id", "x", "y"), "first-points")
    t = top.along(*map(c, ("x", "y", "x1", "y1", "x2", "y2")))
    reach = max(VERTEX_FACTOR * gap, tol)

    def act(ready: DataFrame, done: DataFrame | None) -> DataFrame:
        met = members
        if done is not None:
            made = done.filter("not vertex").select("line", "part", c("id").alias("maker"), c("x").alias("ox"), c("y").alias("oy"))
            # A vertex made meanwhile may lie at the point itself.
            there = top.near(ready, made.select("maker", "ox", "oy"), tol).filter("maker < id").select("id").distinct()
            ready = ready.join(there, "id", "left_anti")
            touched = made.select("line").distinct()
            met = members.join(touched, "line", "left_anti")
        least = met.groupBy("shape").agg(F.min("line").alias("line"))
        if done is not None:
            least = least.unionByName(members.join(touched, "line", "left_semi").select("shape", "line"))
        chosen = least.join(shapes, "shape").select("line", "part", "path")
        segments = top.segments_of(chosen)
        spots = chosen.select("line", "part", F.explode("path").alias("at")).select("line", "part", c("at.x").alias("ox"), c("at.y").alias("oy"), F.lit(None).cast("long").alias("maker"))
        if done is not None:
            spots = spots.unionByName(made)
        on = top.near_segments(ready, segments, reach, size).withColumn("t", t)
        px, py = _at(c("t"))
        on = on.select("id", "line", "part", "seg", px.alias("sx"), py.alias("sy"), c("distance").alias("sd"))
        on = on.groupBy("id", "line", "part").agg(F.min(F.struct("sd", "seg", "sx", "sy")).alias("s")).select("id", "line", "part", "s.*")
        at = top.near(ready, spots, reach).filter(c("maker").isNull() | (c("maker") < c("id"))).groupBy("id", "line", "part").agg(F.min(F.struct(c("distance").alias("vd"), "ox", "oy")).alias("w")).select("id", "line", "part", "w.*")
        both = on.join(at, ["id", "line", "part"], "left")
        vertex = F.coalesce(c("vd") <= F.greatest(VERTEX_FACTOR * c("sd"), F.lit(tol)), F.lit(False))
        cand = both.select(
            "id", F.when(vertex, c("vd")).otherwise(c("sd")).alias("d"), "line", "part", "seg", F.when(vertex, c("ox")).otherwise(c("sx")).alias("x"), F.when(vertex, c("oy")).otherwise(c("sy")).alias("y"), vertex.alias("vertex")
        ).filter(c("d") <= gap)
        best = cand.groupBy("id").agg(F.min(F.struct("d", "line", "part", "seg", "x", "y", "vertex")).alias("b"))
        return best.select("id", "b.x", "b.y", "b.line", "b.part", "b.seg", "b.vertex")

    turns = staged(in_turn(firsts, 2 * reach, act), "turns")
    return act(waiting, turns).withColumnRenamed("id", "point")


def _meets(px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """Whether the segments p - q and (x1, y1) - (x2, y2) touch."""
    side = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    x1, y1, x2, y2 = map(c, ("x1", "y1", "x2", "y2"))
    a, b = side(px, py, qx, qy, x1, y1), side(px, py, qx, qy, x2, y2)
    d, e = side(x1, y1, x2, y2, px, py), side(x1, y1, x2, y2, qx, qy)
    boxes = (F.greatest(px, qx) >= F.least(x1, x2)) & (F.greatest(x1, x2) >= F.least(px, qx)) & (F.greatest(py, qy) >= F.least(y1, y2)) & (F.greatest(y1, y2) >= F.least(py, qy))
    return boxes & (a * b <= 0) & (d * e <= 0)


def service_choices(customers: DataFrame, mains: DataFrame, farthest: float, shortest: float, tol: float, size: float, crossing: bool = False) -> DataFrame:
    """``customer, result, line, part, seg, tap_x, tap_y, distance``: the main that each customer (``customer, x, y``) connects to.

    Of the five nearest mains the nearest counts that is at least ``shortest`` away and whose service touches no other main (unless
    ``crossing`` is allowed). Else ``result`` says why there is none: touching, crossing or too_far; a customer without a place has no_geometry.
    """
    placed = staged(customers.select("customer", c("x").cast("double").alias("x"), c("y").cast("double").alias("y")), "customers")
    # Customers of one place choose alike, and mains of one shape differ by their number alone.
    here = staged(placed.filter("x is not null and y is not null").select("x", "y").distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    drawn, members = top.shapes(mains)
    met = top.near_segments(here, top.segments_of(drawn), farthest, size).withColumn("t", top.along(*map(c, ("x", "y", "x1", "y1", "x2", "y2"))))
    tx, ty = _at(c("t"))
    on = met.select("place", "x", "y", "line", "part", "seg", tx.alias("tap_x"), ty.alias("tap_y"), "distance")
    nearest = on.groupBy("place", "x", "y", "line").agg(F.min(F.struct("distance", "part", "seg", "tap_x", "tap_y")).alias("m")).select("place", "x", "y", c("line").alias("shape"), "m.*")
    # The nearest five mains are among the first five of the nearest five shapes.
    shape_rank = F.row_number().over(Window.partitionBy("place").orderBy("distance", "shape"))
    first = members.withColumn("rank", F.row_number().over(Window.partitionBy("shape").orderBy("line"))).filter(c("rank") <= NEAREST).drop("rank")
    several = nearest.withColumn("rank", shape_rank).filter(c("rank") <= NEAREST).drop("rank").join(first, "shape").drop("shape")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("distance", "line"))
    few = staged(several.withColumn("rank", rank).filter(c("rank") <= NEAREST), "nearest-mains")
    touching = c("distance") < F.lit(max(shortest, tol))
    crossed = few.limit(0).select("place", "line").withColumn("crosses", F.lit(True))
    if not crossing:
        spans = few.withColumn("cx", F.explode(top.cells(F.least("x", "tap_x"), F.greatest("x", "tap_x"), size)))
        spans = spans.withColumn("cy", F.explode(top.cells(F.least("y", "tap_y"), F.greatest("y", "tap_y"), size)))
        spread = top.distinct_segments(mains).withColumn("cx", F.explode(top.cells(F.least("x1", "x2"), F.greatest("x1", "x2"), size)))
        spread = spread.withColumn("cy", F.explode(top.cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)))
        other = (c("first.line") != c("line")) | (c("last.line") != c("line"))
        hit = spans.join(spread, ["cx", "cy"]).filter(other & _meets(c("tap_x"), c("tap_y"), c("x"), c("y")))
        crossed = hit.select("place", "line").distinct().withColumn("crosses", F.lit(True))
    judged = few.join(crossed, ["place", "line"], "left").withColumns({"touches": touching, "crosses": F.coalesce("crosses", F.lit(False)) & ~touching})
    fits = ~c("touches") & ~c("crosses")
    best = judged.groupBy("place", "x", "y").agg(
        F.min(F.when(fits, F.struct("distance", "line", "part", "seg", "tap_x", "tap_y"))).alias("b"), F.max("touches").alias("touches"), F.max("crosses").alias("crosses")
    )
    result = (
        F.when(c("x").isNull() | c("y").isNull(), "no_geometry").when(c("b").isNotNull(), "created").when(F.coalesce("touches", F.lit(False)), "touching")
        .when(F.coalesce("crosses", F.lit(False)), "crossing").otherwise("too_far")
    )
    return placed.join(best.drop("place"), ["x", "y"], "left").select("customer", result.alias("result"), "b.line", "b.part", "b.seg", "b.tap_x", "b.tap_y", "b.distance")


def service_taps(choices: DataFrame, taps: DataFrame, reuse: float) -> DataFrame:
    """``customer, line, tap_x, tap_y, reused``: each connection with its tap, in the order of customers.

    The nearest tap (``x, y``, or one made for an earlier customer) within ``reuse`` of the place on the main serves again; ties go to the smaller x, then y.
    Else a tap is made there.
    """
    wanted = staged(choices.filter("result = 'created'").select(c("customer").alias("id"), c("tap_x").alias("x"), c("tap_y").alias("y"), "line"), "wanted")
    given = staged(taps.select(c("x").cast("double").alias("ox"), c("y").cast("double").alias("oy"), F.lit(None).cast("long").alias("maker")).distinct(), "given-taps")
    # Whoever wants a place where another wanted one before finds a tap within reach: only the first can make one.
    firsts = staged(wanted.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"), "first-wanted")

    def reached(ready: DataFrame, known: DataFrame) -> DataFrame:
        # A tap serves those after its maker.
        near = top.near(ready.select("id", "x", "y"), known, reuse).filter(c("maker").isNull() | (c("maker") < c("id")))
        near = near.groupBy("id").agg(F.min(F.struct("distance", "ox", "oy")).alias("n"))
        return ready.join(near, "id", "left").select(*ready.columns, F.coalesce("n.ox", "x").alias("tap_x"), F.coalesce("n.oy", "y").alias("tap_y"), c("n").isNotNull().alias("reused"))

    made_by = lambda done: done.filter("not reused").select(c("tap_x").alias("ox"), c("tap_y").alias("oy"), c("id").alias("maker"))
    known_by = lambda done: given if done is None else given.unionByName(made_by(done))
    made = staged(made_by(in_turn(firsts, reuse, lambda ready, done: reached(ready, known_by(done)))), "made-taps")
    return reached(wanted, given.unionByName(made)).select(c("id").alias("customer"), "line", "tap_x", "tap_y", "reused")


def with_vertices(lines: DataFrame, made: DataFrame) -> DataFrame:
    """Lines with the new vertices (``line, part, seg, x, y``) in their paths, in the order they lie on the segment."""
    away = F.pow(c("x") - c("path")[c("seg")]["x"], 2) + F.pow(c("y") - c("path")[c("seg")]["y"], 2)
    of = made.join(lines.select("line", "part", "path"), ["line", "part"]).select("line", "part", F.struct(c("seg").alias("k"), away.alias("away"), F.struct("x", "y").alias("at")).alias("new"))
    new = of.groupBy("line", "part").agg(F.collect_set("new").alias("new"))
    own = F.transform("path", lambda p, i: F.struct(i.alias("k"), F.lit(-1.0).alias("away"), F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")).alias("at")))
    path = F.transform(F.array_sort(F.concat(own, "new")), lambda e: e["at"])
    joined = lines.join(new, ["line", "part"], "left")
    return joined.select(*[F.when(c("new").isNull(), c("path")).otherwise(path).alias("path") if k == "path" else c(k) for k in lines.columns])
