"""Polygon overlay over parcels drawn from parts and zones drawn from suppliers, each with SQL that counts unit squares.

Parcels fill a lattice of 4 x 4 squares; some reach into their neighbours, some leave a strip, some are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import overlay
from meshwright.sources.network_view import table

TOL, CELL, COLUMNS = 0.01, 17.0, 50
c = F.col


def _boxes(rows: DataFrame) -> DataFrame:
    """``area, ring`` of boxes ``area, x1, y1, x2, y2``."""
    corner = lambda x, y: F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    return rows.select("area", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")).alias("ring"))


def parcels(spark, sf_dir: str) -> DataFrame:
    k = c("p_partkey").cast("long")
    x, y = k % COLUMNS * 4, F.floor(k / COLUMNS) * 4
    rows = table(spark, sf_dir, "part").filter(k % 13 != 0)
    return _boxes(
        rows.select(
            k.alias("area"), (x + (k % 7 == 0).cast("int")).alias("x1"), y.alias("y1"), (x + 4 + (k % 5 == 0).cast("int")).alias("x2"), (y + 4 - (k % 11 == 0).cast("int")).alias("y2")
        )
    )


def zones(spark, sf_dir: str) -> DataFrame:
    k = c("s_suppkey").cast("long")
    x, y = k % 30 * 7, F.floor(k / 30) * 6 + k % 3
    return _boxes(table(spark, sf_dir, "supplier").select(k.alias("area"), x.alias("x1"), y.alias("y1"), (x + 5 + k % 2).alias("x2"), (y + 5).alias("y2")))


def parcel_overlaps(spark, sf_dir):
    return overlay.overlaps(parcels(spark, sf_dir), TOL, CELL).withColumn("overlap", F.round("overlap", 6))


def parcel_gaps(spark, sf_dir):
    found = overlay.gaps(parcels(spark, sf_dir), TOL, CELL)
    return found.select(*[F.round(k, 6).alias(k) for k in ("gap_area", "x", "y", "minx", "miny", "maxx", "maxy")], "area")


def zone_overlaps(spark, sf_dir):
    found = overlay.overlaps_with(zones(spark, sf_dir), parcels(spark, sf_dir), TOL, CELL)
    return found.withColumn("overlap", F.round("overlap", 6))


def uncovered_zones(spark, sf_dir):
    return overlay.uncovered(zones(spark, sf_dir), parcels(spark, sf_dir), TOL, CELL).withColumn("bare", F.round("bare", 6))


_PARCELS = f"""box AS MATERIALIZED (SELECT p_partkey AS area, p_partkey % {COLUMNS} * 4 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS x1, p_partkey // {COLUMNS} * 4 AS y1,
  p_partkey % {COLUMNS} * 4 + 4 + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS x2, p_partkey // {COLUMNS} * 4 + 4 - CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS y2 FROM part WHERE p_partkey % 13 <> 0)"""
_ZONES = "zone AS (SELECT s_suppkey AS area, s_suppkey % 30 * 7 AS x1, s_suppkey // 30 * 6 + s_suppkey % 3 AS y1, s_suppkey % 30 * 7 + 5 + s_suppkey % 2 AS x2, s_suppkey // 30 * 6 + s_suppkey % 3 + 5 AS y2 FROM supplier)"
_COMMON = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_MEET = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
_SQUARES = "(SELECT area, x, unnest(range(y1, y2)) AS y FROM (SELECT *, unnest(range(x1, x2)) AS x FROM {}))"

QUERIES = {
    "parcel_overlaps": (parcel_overlaps, f"WITH {_PARCELS} SELECT a.area, b.area AS other, CAST({_COMMON} AS DOUBLE) AS overlap FROM box a JOIN box b ON a.area < b.area AND {_MEET}"),
    "parcel_gaps": (
        parcel_gaps,
        f"""WITH RECURSIVE {_PARCELS}, full_squares AS MATERIALIZED (SELECT DISTINCT x, y FROM {_SQUARES.format("box")}),
        edge AS (SELECT min(x) - 1 AS l, max(x) + 1 AS r, min(y) - 1 AS b, max(y) + 1 AS t FROM full_squares),
        free AS MATERIALIZED (SELECT x, y FROM (SELECT x, unnest(range(b, t + 1)) AS y FROM (SELECT *, unnest(range(l, r + 1)) AS x FROM edge)) ANTI JOIN full_squares USING (x, y)),
        outside AS (SELECT l AS x, b AS y FROM edge UNION SELECT f.x, f.y FROM outside o JOIN free f ON (f.x = o.x + 1 AND f.y = o.y) OR (f.x = o.x - 1 AND f.y = o.y) OR (f.x = o.x AND f.y = o.y + 1) OR (f.x = o.x AND f.y = o.y - 1)),
        hole AS MATERIALIZED (SELECT x, y, row_number() OVER (ORDER BY x, y) AS n FROM free ANTI JOIN outside USING (x, y)),
        step AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM hole a JOIN hole b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
        near AS (SELECT n, n AS root FROM hole UNION SELECT b, root FROM near JOIN step ON a = n), part AS (SELECT n, min(root) AS ring FROM near GROUP BY n),
        gap AS (SELECT ring, CAST(count(*) AS DOUBLE) AS gap_area, round(avg(x + 0.5::DOUBLE), 6) AS x, round(avg(y + 0.5::DOUBLE), 6) AS y, CAST(min(h.x) AS DOUBLE) AS minx, CAST(min(h.y) AS DOUBLE) AS miny,
          CAST(max(h.x) + 1 AS DOUBLE) AS maxx, CAST(max(h.y) + 1 AS DOUBLE) AS maxy FROM part JOIN hole h USING (n) GROUP BY ring)
        SELECT gap_area, x, y, minx, miny, maxx, maxy, (SELECT min(area) FROM box WHERE x1 <= maxx AND x2 >= minx AND y1 <= maxy AND y2 >= miny) AS area FROM gap""",
    ),
    "zone_overlaps": (
        zone_overlaps,
        f"WITH {_PARCELS}, {_ZONES} SELECT a.area, min(b.area) AS other, CAST(arg_min({_COMMON}, b.area) AS DOUBLE) AS overlap FROM zone a JOIN box b ON {_MEET} GROUP BY a.area",
    ),
    "uncovered_zones": (
        uncovered_zones,
        f"WITH {_PARCELS}, {_ZONES} SELECT area, CAST(count(*) AS DOUBLE) AS bare FROM {_SQUARES.format('zone')} z ANTI JOIN {_SQUARES.format('box')} b USING (x, y) GROUP BY area",
    ),
}
