"""Polygon overlay: overlaps, gaps of a union, and what another layer leaves uncovered.

Polygons (``area, ring``: vertices as array of struct ``x, y``; several rings of one area count by the even-odd rule, so holes and
parts are rings) are clipped to square cells. In a cell a plane sweep cuts the ground into slabs in which no edges cross,
and knows for each stretch which polygons cover it. Areas are summed over cells; the rim of the union comes out
as directed pieces with the covered side on their left, which are stitched to rings across cells: a ring that runs
clockwise is a gap. A crowded cell is cut into four until it holds few enough edges, so no task meets more than one cell.

Cells are shifted by an irrational part of their size, so that given edges don't run along their borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators import graph
from meshwright.plans.staging import any_rows, spread_out, staged

#: Where cell borders lie, as a part of the cell's size.
SHIFT = math.sqrt(2) / 10
#: Edges that a cell may hold before it is cut into four, and how often it may be cut.
CELL_EDGES = 400
MOST_CUTS = 24
#: Decimals by which places are told apart.
DIGITS = 9

PIECES = "level int, cx long, cy long, layer int, area long, xs array<double>, ys array<double>"
SWEPT = "kind string, one long, two long, area double, x1 double, y1 double, x2 double, y2 double"

c = F.col


def _clip(x: np.ndarray, y: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of a ring with ``low <= x <= high``; it may run along the border, there and back."""
    for bound, sign in ((low, 1.0), (high, -1.0)):
        if not len(x):
            break
        inside = sign * (x - bound) >= 0
        nx, ny, nin = np.roll(x, -1), np.roll(y, -1), np.roll(inside, -1)
        cross = inside != nin
        with np.errstate(divide="ignore", invalid="ignore"):
            # From the smaller end, whichever way the edge runs: both cells of a border get the same place.
            first = (x < nx) | ((x == nx) & (y < ny))
            ax, ay, bx, by = np.where(first, x, nx), np.where(first, y, ny), np.where(first, nx, x), np.where(first, ny, y)
            at = ay + (bound - ax) * (by - ay) / (bx - ax)
        n = len(x)
        out_x, out_y, kept = np.empty(2 * n), np.empty(2 * n), np.empty(2 * n, bool)
        out_x[0::2], out_y[0::2], kept[0::2] = x, y, inside
        out_x[1::2], out_y[1::2], kept[1::2] = bound, at, cross
        x, y = out_x[kept], out_y[kept]
    return x, y


def _cut(frames: Iterator[pd.DataFrame], size: float) -> Iterator[pd.DataFrame]:
    """Pieces of rings (``level, layer, area, xs, ys``) in the cells of their level."""
    for frame in frames:
        rows = []
        for level, layer, area, xs, ys in zip(frame["level"], frame["layer"], frame["area"], frame["xs"], frame["ys"], strict=True):
            x, y, s = np.asarray(xs, float), np.asarray(ys, float), size / 2**level
            border = lambda k: (k + SHIFT) * s  # noqa: B023, E731
            for cx in range(math.floor(x.min() / s - SHIFT), math.floor(x.max() / s - SHIFT) + 1):
                sx, sy = _clip(x, y, border(cx), border(cx + 1))
                if len(sx) < 3:
                    continue
                for cy in range(math.floor(sy.min() / s - SHIFT), math.floor(sy.max() / s - SHIFT) + 1):
                    py, px = _clip(sy, sx, border(cy), border(cy + 1))
                    if len(px) >= 3:
                        rows.append((level, cx, cy, layer, area, px.tolist(), py.tolist()))
        yield pd.DataFrame(rows, columns=["level", "cx", "cy", "layer", "area", "xs", "ys"])


def _events(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """All places where an edge ends or two cross, from left to right."""
    dx, dy = x2 - x1, y2 - y1
    wx, wy = x1[None, :] - x1[:, None], y1[None, :] - y1[:, None]
    cross = dx[:, None] * dy[None, :] - dy[:, None] * dx[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (wx * dy[None, :] - wy * dx[None, :]) / cross
        u = (wx * dy[:, None] - wy * dx[:, None]) / cross
    met = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    at = (x1[:, None] + t * dx[:, None])[met]
    return np.unique(np.round(np.concatenate([x1, x2, at]), DIGITS))


def _merged(stretches: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in stretches:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        elif high > low:
            out.append((low, high))
    return out


def _sweep(frame: pd.DataFrame, size: float, wanted: tuple[str, ...], layers: int) -> pd.DataFrame:
    """One cell: areas of pairs (``pair``), what the other layer leaves of an area (``bare``), and the rim of layer 0 (``rim``)."""
    level, cx, cy = (int(frame[k].iloc[0]) for k in ("level", "cx", "cy"))
    s = size / 2**level
    left, right, low, high = (round((k + SHIFT) * s, DIGITS) for k in (cx, cx + 1, cy, cy + 1))
    names = sorted(set(zip(frame["layer"], frame["area"], strict=True)))
    number = {k: n for n, k in enumerate(names)}
    parts = [(number[la, ar], np.round(xs, DIGITS), np.round(ys, DIGITS)) for la, ar, xs, ys in zip(frame["layer"], frame["area"], frame["xs"], frame["ys"], strict=True)]
    x1, y1 = np.concatenate([x for _, x, _ in parts]), np.concatenate([y for _, _, y in parts])
    x2, y2 = np.concatenate([np.roll(x, -1) for _, x, _ in parts]), np.concatenate([np.roll(y, -1) for _, _, y in parts])
    owner = np.concatenate([np.full(len(x), k) for k, x, _ in parts])
    solid = x1 != x2
    x1, y1, x2, y2, owner = x1[solid], y1[solid], x2[solid], y2[solid], owner[solid]
    flip = x1 > x2
    x1, y1, x2, y2 = np.where(flip, x2, x1), np.where(flip, y2, y1), np.where(flip, x1, x2), np.where(flip, y1, y2)
    rows: list[tuple] = []
    areas: dict[tuple[str, int, int], float] = {}
    cuts = _events(x1, y1, x2, y2) if len(x1) else np.zeros(0)
    before: list[tuple[float, float]] = []
    for xa, xb in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        on = np.flatnonzero((x1 <= xa) & (x2 >= xb))
        slope = (y2[on] - y1[on]) / (x2[on] - x1[on])
        ya, yb = np.round(y1[on] + (xa - x1[on]) * slope, DIGITS), np.round(y1[on] + (xb - x1[on]) * slope, DIGITS)
        order = np.lexsort((yb, ya, ya + yb))
        ya, yb, who = ya[order].tolist(), yb[order].tolist(), owner[on][order].tolist()
        inside: set[int] = set()
        at_left: list[tuple[float, float]] = []
        at_right: list[tuple[float, float]] = []
        k, n = 0, len(who)
        while k < n:
            was, here = any(names[i][0] == 0 for i in inside), (ya[k], yb[k])
            while k < n and (ya[k], yb[k]) == here:
                inside ^= {who[k]}
                k += 1
            now = any(names[i][0] == 0 for i in inside)
            if was != now and "rim" in wanted and not (here[0] == here[1] and here[0] in (low, high)):
                ends = (xa, here[0], xb, here[1]) if now else (xb, here[1], xa, here[0])
                rows.append(("rim", 0, 0, 0.0, *ends))
            if k < n and inside:
                height = (ya[k] + yb[k] - here[0] - here[1]) / 2 * (xb - xa)
                covering = sorted(inside)
                if now:
                    at_left.append((here[0], ya[k]))
                    at_right.append((here[1], yb[k]))
                if "pair" in wanted:
                    for p, i in enumerate(covering):
                        for j in covering[p + 1 :]:
                            if layers == 1 or names[i][0] != names[j][0]:
                                key = ("pair", names[i][1], names[j][1])
                                areas[key] = areas.get(key, 0.0) + height
                if "bare" in wanted and not any(names[i][0] == 1 for i in covering):
                    for i in covering:
                        key = ("bare", names[i][1], 0)
                        areas[key] = areas.get(key, 0.0) + height
        if "rim" in wanted:
            rows += _steps(before, _merged(at_left), xa, xa in (left, right))
            before = _merged(at_right)
    if "rim" in wanted and len(cuts):
        rows += _steps(before, [], float(cuts[-1]), cuts[-1] in (left, right))
    rows += [(*key, area, None, None, None, None) for key, area in areas.items()]
    return pd.DataFrame(rows, columns=["kind", "one", "two", "area", "x1", "y1", "x2", "y2"])


def _steps(west: list[tuple[float, float]], east: list[tuple[float, float]], x: float, at_border: bool) -> list[tuple]:
    """Upright pieces of the rim, where one side of ``x`` is covered and the other isn't."""
    if at_border:
        return []
    places = sorted({y for pair in west + east for y in pair})
    covered = lambda side, y: any(a < y < b for a, b in side)
    out = []
    for low, high in zip(places, places[1:], strict=False):
        w, e = covered(west, (low + high) / 2), covered(east, (low + high) / 2)
        if w != e:
            out.append(("rim", 0, 0, 0.0, *((x, low, x, high) if w else (x, high, x, low))))
    return out


def in_cells(polygons: DataFrame, size: float, crowd: int = CELL_EDGES) -> DataFrame:
    """Rings (``layer, area, ring``) as pieces in cells that hold up to ``crowd`` edges, as far as cutting helps; staged."""
    xs, ys = (c(f"ring.{k}").cast("array<double>").alias(f"{k}s") for k in "xy")
    waiting = polygons.filter(F.size("ring") >= 3).select(F.lit(0).alias("level"), "layer", "area", xs, ys)
    done = None
    for level in range(MOST_CUTS):
        cut = staged(spread_out(waiting).mapInPandas(lambda frames: _cut(frames, size), PIECES), "pieces")
        full = cut.groupBy("level", "cx", "cy").agg(F.sum(F.size("xs")).alias("edges"), F.count(F.lit(1)).alias("n")).filter(c("edges") > crowd)
        full = staged(full.select("level", "cx", "cy"), "crowded")
        ready = cut.join(full, ["level", "cx", "cy"], "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if level == MOST_CUTS - 1 or not any_rows(full):
            return done if not any_rows(full) else done.unionByName(cut.join(full, ["level", "cx", "cy"], "left_semi"))
        crowded = cut.join(full, ["level", "cx", "cy"], "left_semi")
        waiting = crowded.select((c("level") + 1).alias("level"), "layer", "area", "xs", "ys")
    return done


def swept(polygons: DataFrame, size: float, *wanted: str, layers: int = 1) -> DataFrame:
    cells = spread_out(in_cells(polygons, size), "level", "cx", "cy")
    return cells.groupBy("level", "cx", "cy").applyInPandas(lambda frame: _sweep(frame, size, wanted, layers), SWEPT)


def _layers(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(F.lit(0).alias("layer"), "area", "ring").unionByName(b.select(F.lit(1).alias("layer"), "area", "ring"))


def overlaps(polygons: DataFrame, tol: float, size: float) -> DataFrame:
    """``area, other, overlap``: pairs (smaller number first) that share more ground than ``tol`` squared."""
    found = swept(polygons.select(F.lit(0).alias("layer"), "area", "ring"), size, "pair")
    sums = found.groupBy(c("one").alias("area"), c("two").alias("other")).agg(F.sum(found["area"]).alias("overlap"))
    return sums.filter(c("overlap") > tol * tol)


def overlaps_with(a: DataFrame, b: DataFrame, tol: float, size: float) -> DataFrame:
    """``area, other, overlap``: polygons of ``a`` that share ground with one of ``b``, and the least such one."""
    found = swept(_layers(a, b), size, "pair", layers=2)
    sums = found.groupBy("one", "two").agg(F.sum("area").alias("overlap")).filter(c("overlap") > tol * tol)
    return sums.groupBy(c("one").alias("area")).agg(F.min(F.struct(c("two").alias("other"), c("overlap"))).alias("hit")).select("area", "hit.*")


def uncovered(a: DataFrame, b: DataFrame, tol: float, size: float) -> DataFrame:
    """``area, bare``: polygons of ``a`` of whose ground the union of ``b`` leaves more than ``tol`` squared uncovered."""
    found = swept(_layers(a, b), size, "bare", layers=2)
    return found.groupBy(c("one").alias("area")).agg(F.sum(found["area"]).alias("bare")).filter(c("bare") > tol * tol)


def _angle(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)


def rings(pieces: DataFrame) -> DataFrame:
    """``ring`` for each piece ``piece, x1, y1, x2, y2``: pieces follow each other around one free stretch of ground.

    Where several pass one place, the next piece is the first one counter-clockwise of the way back, so that rings that touch in a
    point stay two.
    """
    turn = 2 * math.pi
    arriving = pieces.select("piece", c("x2").alias("x"), c("y2").alias("y"), _angle(c("x1") - c("x2"), c("y1") - c("y2")).alias("back"))
    leaving = pieces.groupBy(c("x1").alias("x"), c("y1").alias("y")).agg(F.collect_list(F.struct(_angle(c("x2") - c("x1"), c("y2") - c("y1")).alias("to"), c("piece").alias("next"))).alias("ways"))
    met = arriving.join(leaving, ["x", "y"])
    # A piece that leads straight back is the last choice.
    turned = F.transform("ways", lambda w: F.struct(F.pmod(w["to"] - c("back") - 1e-9, F.lit(turn)).alias("by"), w["next"].alias("next")))
    links = staged(met.select(c("piece").alias("a"), F.array_min(turned)["next"].alias("b")), "rim-links")
    named = graph.components(pieces.select(c("piece").alias("node")), links)
    return named.select(c("node").alias("piece"), c("component").alias("ring"))


def gaps(polygons: DataFrame, tol: float, size: float) -> DataFrame:
    """``gap_area, x, y, minx, miny, maxx, maxy, area``: holes of the union of all polygons, larger than ``tol`` squared.

    ``x, y`` is the middle of the hole's weight; ``area`` the least polygon whose box meets the hole's.
    """
    found = swept(polygons.select(F.lit(0).alias("layer"), "area", "ring"), size, "rim")
    pieces = found.filter((c("x1") != c("x2")) | (c("y1") != c("y2"))).select("x1", "y1", "x2", "y2")
    pieces = staged(pieces.withColumn("piece", F.monotonically_increasing_id()), "rim")
    whole = staged(pieces.join(rings(pieces), "piece"), "rings")
    # Areas are summed around a place of the ring's own, which keeps digits.
    base = whole.groupBy("ring").agg(F.min("x1").alias("minx"), F.min("y1").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))
    near = whole.join(base, "ring")
    ax, ay, bx, by = c("x1") - c("minx"), c("y1") - c("miny"), c("x2") - c("minx"), c("y2") - c("miny")
    cross = ax * by - bx * ay
    sums = near.groupBy("ring", "minx", "miny", "maxx", "maxy").agg((F.sum(cross) / 2).alias("signed"), F.sum((ax + bx) * cross).alias("mx"), F.sum((ay + by) * cross).alias("my"))
    holes = sums.filter(-c("signed") > tol * tol).select(
        "ring", (-c("signed")).alias("gap_area"), (c("minx") + c("mx") / (6 * c("signed"))).alias("x"), (c("miny") + c("my") / (6 * c("signed"))).alias("y"), "minx", "miny", "maxx", "maxy"
    )
    holes = staged(holes, "holes")
    span = lambda low, high: F.sequence(F.floor(low / size), F.floor(high / size))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = polygons.select("area", F.array_min(xs).alias("l"), F.array_min(ys).alias("b"), F.array_max(xs).alias("r"), F.array_max(ys).alias("t"))
    boxes = boxes.groupBy("area").agg(F.min("l").alias("l"), F.min("b").alias("b"), F.max("r").alias("r"), F.max("t").alias("t"))
    boxes = boxes.withColumn("cx", F.explode(span(c("l"), c("r")))).withColumn("cy", F.explode(span(c("b"), c("t"))))
    spread = holes.withColumn("cx", F.explode(span(c("minx"), c("maxx")))).withColumn("cy", F.explode(span(c("miny"), c("maxy"))))
    meets = (c("l") <= c("maxx")) & (c("r") >= c("minx")) & (c("b") <= c("maxy")) & (c("t") >= c("miny"))
    first = spread.join(boxes, ["cx", "cy"]).filter(meets).groupBy("ring").agg(F.min("area").alias("area"))
    return holes.join(first, "ring", "left").drop("ring")


def overlay_issues(kind: str, found: DataFrame) -> DataFrame:
    """``code, severity, message, area`` of what :func:`overlaps`, :func:`gaps`, :func:`overlaps_with` or :func:`uncovered` found."""
    said = {
        "T01": F.concat(F.lit("Must not overlap: overlaps feature "), c("other").cast("string")) if "other" in found.columns else None,
        "T02": F.concat(F.lit("Must not have gaps: gap of "), F.format_string("%.2f", c("gap_area"))) if "gap_area" in found.columns else None,
        "T03": F.lit("Must not overlap with: overlaps the other layer"),
        "T04": F.lit("Must be covered by: not inside the other layer"),
    }
    if said.get(kind) is None:
        raise ValueError(f"no such rule for these rows: {kind}")
    return found.select(F.lit(kind).alias("code"), F.lit("error").alias("severity"), said[kind].alias("message"), "area")
