"""Topology queries over a map drawn from the star-schema tables, each with its SQL by comparing all pairs.

Every customer is a line of three vertices on a lattice, every supplier a point. Some ends miss their place by less than the
tolerance or by a gap, some lie on another level or on the middle of a segment, some lines connect at their ends only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import topology as top
from meshwright.plans.staging import staged
from meshwright.sources.network_view import table

TOL, GAP, CELL = 0.01, 0.6, 12.0
c = F.col


def lines(spark, sf_dir: str) -> DataFrame:
    k = c("c_custkey").cast("long")
    x, y = (k % 37 * 10).cast("double"), (F.floor(k / 37) % 40 * 10).cast("double")
    miss = F.when(k % 7 == 0, 0.004).when(k % 11 == 0, 0.3).otherwise(0.0)
    # Most lines go right over a vertex on the lattice; others go up, half a step or nowhere.
    tx = F.when(k % 5 == 0, x).when(k % 17 == 0, x + 5).when(k % 101 == 0, x).otherwise(x + 20)
    ty = F.when(k % 5 == 0, y + 20).when(k % 19 == 0, y + 5).otherwise(y)
    place = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    path = F.array(place(x, y), place((x + tx) / 2, (y + ty) / 2), place(tx + miss, ty))
    return table(spark, sf_dir, "customer").select(
        k.alias("line"), F.lit(0).alias("part"), F.when(k % 97 == 0, F.slice(path, 1, 1)).otherwise(path).alias("path"), F.lit(0).alias("level_a"),
        F.when(k % 13 == 0, 1).otherwise(0).alias("level_b"), (k % 23 == 0).alias("endvertex"), F.when(k % 29 != 0, c("c_nationkey")).cast("int").alias("ag"),
    )


def points(spark, sf_dir: str) -> DataFrame:
    k = c("s_suppkey").cast("long")
    # Every ninth stands where the one before does.
    at = k - (k % 9 == 0).cast("long")
    x = (at % 37 * 10).cast("double") + F.when(at % 3 == 0, 0.2).when(at % 4 == 0, 5.0).otherwise(0.0)
    y = (F.floor(at / 2) % 40 * 10).cast("double") + F.when(at % 10 == 0, 3.0).otherwise(0.0)
    return table(spark, sf_dir, "supplier").select(k.alias("point"), x.alias("x"), y.alias("y"), (k % 8 == 0).alias("structure"), F.when(k % 31 != 0, c("s_nationkey")).cast("int").alias("ag"))


def _map(spark, sf_dir):
    return staged(lines(spark, sf_dir), "lines"), staged(points(spark, sf_dir), "points")


def coincident_points(spark, sf_dir):
    return top.hits(*_map(spark, sf_dir), TOL)


def coincidence_components(spark, sf_dir):
    return top.coincident(*_map(spark, sf_dir), TOL)


def split_edges(spark, sf_dir):
    drawn, placed = _map(spark, sf_dir)
    return top.split_edges(drawn, top.coincident(drawn, placed, TOL)).withColumn("length", F.round("length", 6))


def connection_issues(spark, sf_dir):
    return top.connection_issues(*_map(spark, sf_dir), TOL, GAP, CELL).withColumn("distance", F.round("distance", 6))


def refused_hits(spark, sf_dir):
    return top.refused_hits(*_map(spark, sf_dir), TOL)


def geometry_issues(spark, sf_dir):
    return top.geometry_issues(*_map(spark, sf_dir), TOL, 6.0)


def stacked_points(spark, sf_dir):
    drawn, placed = _map(spark, sf_dir)
    return top.stacked(placed, top.coincident(drawn, placed, TOL)).select("n", "point")


def crossings(spark, sf_dir):
    return top.crossings(lines(spark, sf_dir), TOL, CELL)


def issue_summary(spark, sf_dir):
    drawn, placed = _map(spark, sf_dir)
    found = top.connection_issues(drawn, placed, TOL, GAP, CELL).select("code", "severity")
    return top.summary_of(found.unionByName(top.geometry_issues(drawn, placed, TOL, 6.0).select("code", "severity")))


def touching_segments(spark, sf_dir):
    """Points within the gap of a segment."""
    drawn, placed = _map(spark, sf_dir)
    met = top.touching(placed, drawn, GAP, CELL)
    return met.select("point", "line", "seg", F.round("t", 9).alias("t"), F.round("distance", 9).alias("distance"))


def nearest_structure(spark, sf_dir):
    places = points(spark, sf_dir)
    structures = places.filter("structure").select(c("point").alias("structure_point"), c("x").alias("ox"), c("y").alias("oy"))
    found = top.nearest(places.filter("not structure").select("point", "x", "y"), structures, 25.0, "point", "structure_point")
    return found.withColumn("distance", F.round("distance", 9))


def areas(spark, sf_dir) -> DataFrame:
    """A six-cornered area for each nation."""
    k = c("n_nationkey").cast("long")
    x, y = k % 5 * 80 + 7.0, F.floor(k / 5) * 80 + 3.0
    corners = ((0, 20), (30, 0), (75, 10), (60, 45), (70, 75), (10, 60))
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in corners])
    return table(spark, sf_dir, "nation").select(k.alias("area"), ring.alias("ring"))


def contained_points(spark, sf_dir):
    return top.containing(points(spark, sf_dir), areas(spark, sf_dir), 20.0)


def map_pages(spark, sf_dir):
    return top.page_grid(points(spark, sf_dir), 100.0, 70.0, 0.1).select("page", "column", "row", F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"))


MAP_SQL = f"""
raw AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey % 37 * 10 AS DOUBLE) AS x, CAST(c_custkey // 37 % 40 * 10 AS DOUBLE) AS y, c_nationkey FROM customer),
ends AS (SELECT *, CASE WHEN k % 5 = 0 THEN x WHEN k % 17 = 0 THEN x + 5 WHEN k % 101 = 0 THEN x ELSE x + 20 END AS tx,
  CASE WHEN k % 5 = 0 THEN y + 20 WHEN k % 19 = 0 THEN y + 5 ELSE y END AS ty, CASE WHEN k % 7 = 0 THEN 0.004::DOUBLE WHEN k % 11 = 0 THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS miss FROM raw),
verts AS MATERIALIZED (SELECT k AS line, 0 AS v, x, y, CASE WHEN k % 97 = 0 THEN 0 ELSE 2 END AS last, 0 AS level, k % 23 = 0 AS endvertex FROM ends
  UNION ALL SELECT k, 1, (x + tx) / 2, (y + ty) / 2, 2, 0, k % 23 = 0 FROM ends WHERE k % 97 <> 0
  UNION ALL SELECT k, 2, tx + miss, ty, 2, CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END, k % 23 = 0 FROM ends WHERE k % 97 <> 0),
pts AS MATERIALIZED (SELECT CAST(s_suppkey AS BIGINT) AS point, CAST(k % 37 * 10 AS DOUBLE) + CASE WHEN k % 3 = 0 THEN 0.2::DOUBLE WHEN k % 4 = 0 THEN 5::DOUBLE ELSE 0::DOUBLE END AS x,
  CAST(CAST(floor(k / 2) AS BIGINT) % 40 * 10 AS DOUBLE) + CASE WHEN k % 10 = 0 THEN 3::DOUBLE ELSE 0::DOUBLE END AS y, s_suppkey % 8 = 0 AS structure, CASE WHEN s_suppkey % 31 <> 0 THEN s_nationkey END AS ag
  FROM (SELECT *, s_suppkey - CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS k FROM supplier)),
cand AS MATERIALIZED (SELECT concat('V:', line, ':0:', v) AS token, line, x, y, level FROM verts WHERE last > 0 AND v IN (0, last) UNION ALL SELECT concat('P:', point), NULL, x, y, NULL FROM pts),
seg AS MATERIALIZED (SELECT a.line, a.v AS seg, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM verts a JOIN verts b ON a.line = b.line AND b.v = a.v + 1),
hit AS MATERIALIZED (SELECT token, concat('V:', o.line, ':0:', v) AS other, v > 0 AND v < last AND endvertex AS refused FROM cand c JOIN verts o
    ON o.x BETWEEN c.x - 1 AND c.x + 1 AND o.y BETWEEN c.y - 1 AND c.y + 1 AND sqrt((c.x - o.x) ** 2 + (c.y - o.y) ** 2) <= {TOL} AND token <> concat('V:', o.line, ':0:', v)
    WHERE NOT (c.level IS NOT NULL AND v IN (0, last) AND c.level <> o.level)
  UNION ALL SELECT token, concat('P:', point), FALSE FROM cand c JOIN pts o ON sqrt((c.x - o.x) ** 2 + (c.y - o.y) ** 2) <= {TOL} AND token <> concat('P:', point))
"""
_TOGETHER = """both_ways AS (SELECT DISTINCT token AS a, other AS b FROM hit WHERE NOT refused UNION SELECT other, token FROM hit WHERE NOT refused),
tokens AS (SELECT token FROM cand UNION SELECT b FROM both_ways),
reach AS (SELECT token, token AS root FROM tokens UNION SELECT b, root FROM reach JOIN both_ways ON a = reach.token),
nodes AS MATERIALIZED (SELECT token, min(root) AS node FROM reach GROUP BY token)"""
_T = "greatest(0.0, least(1.0, ((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"


def _near_segments(probes: str, keys: str) -> str:
    """Pairs of probes and segments within the gap; a segment that is a point counts by its start."""
    return f"""(SELECT *, sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2) AS distance FROM (SELECT {keys}, c.x, c.y, s.line AS other_line, seg, x1, y1, x2, y2,
    CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0 ELSE {_T} END AS t FROM {probes} c JOIN seg s ON c.x BETWEEN least(x1, x2) - 1 AND greatest(x1, x2) + 1 AND c.y BETWEEN least(y1, y2) - 1 AND greatest(y1, y2) + 1))"""


_ISSUES = f"""alone AS MATERIALIZED (SELECT * FROM cand WHERE token NOT IN (SELECT token FROM hit)),
by_seg AS (SELECT token, min(distance) AS d1, bool_or(distance <= {TOL} AND t > 0 AND t < 1) AS touches FROM {_near_segments("alone", "token, c.line")} WHERE distance <= {GAP} AND line IS DISTINCT FROM other_line GROUP BY token),
by_point AS (SELECT token, min(d) AS d2 FROM (SELECT token, sqrt((c.x - o.x) ** 2 + (c.y - o.y) ** 2) AS d FROM alone c, pts o WHERE token <> concat('P:', point)) WHERE d <= {GAP} GROUP BY token),
judged AS (SELECT a.*, least(d1, d2) AS d, touches, p.structure FROM alone a LEFT JOIN by_seg USING (token) LEFT JOIN by_point USING (token) LEFT JOIN pts p ON a.token = concat('P:', p.point)),
coded AS (SELECT *, CASE WHEN coalesce(touches, FALSE) THEN 'E03' WHEN line IS NOT NULL AND d <= {TOL} THEN 'E21' WHEN d <= {GAP} THEN 'E07' WHEN line IS NOT NULL THEN 'E01' WHEN NOT structure THEN 'E02' END AS code FROM judged),
connection AS (SELECT token, code, CASE WHEN code IN ('E03', 'E07', 'E02') THEN 'error' ELSE 'warning' END AS severity, x, y, CASE WHEN code = 'E07' THEN round(d, 6) END AS distance FROM coded WHERE code IS NOT NULL)"""
_GEOMETRY = f"""long AS (SELECT k, coalesce(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 0) AS length, k % 97 <> 0 AS fine, k % 29 = 0 AS bare FROM raw LEFT JOIN seg ON line = k GROUP BY k),
geometry AS (SELECT 'E09' AS code, 'error' AS severity, 'line' AS kind, k AS key FROM long WHERE NOT fine UNION ALL SELECT 'E09', 'error', 'line', k FROM long WHERE fine AND length <= {TOL}
  UNION ALL SELECT 'E06', 'error', 'line', k FROM long WHERE fine AND bare UNION ALL SELECT 'E20', 'warning', 'line', k FROM long WHERE fine AND length < 6
  UNION ALL SELECT 'E06', 'error', 'point', point FROM pts WHERE ag IS NULL)"""
_PAIRS = """pairs AS (SELECT a.line, b.line AS other, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS w1, b.x2 AS u2, b.y2 AS w2, a.x2 - a.x1 AS dx, a.y2 - a.y1 AS dy, b.x2 - b.x1 AS ex, b.y2 - b.y1 AS ey
  FROM seg a JOIN seg b ON a.line < b.line AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)),
solved AS (SELECT *, dx * ey - dy * ex AS d, sqrt(dx * dx + dy * dy) AS norm, (u1 - x1) * dy - (w1 - y1) * dx AS side, ((u1 - x1) * ey - (w1 - y1) * ex) / nullif(dx * ey - dy * ex, 0) AS t,
  ((u1 - x1) * dy - (w1 - y1) * dx) / nullif(dx * ey - dy * ex, 0) AS u FROM pairs),
met AS (SELECT *, x1 + t * dx AS x, y1 + t * dy AS y FROM solved WHERE d <> 0 AND t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
shared AS (SELECT line, other, least(greatest(a, b), norm) - greatest(least(a, b), 0) AS common FROM (SELECT *, ((u1 - x1) * dx + (w1 - y1) * dy) / norm AS a, ((u2 - x1) * dx + (w2 - y1) * dy) / norm AS b FROM solved WHERE d = 0 AND norm > 0 AND abs(side) / norm <= 1e-9))"""
_OFF = lambda x, y: f"sqrt((x - {x}) ** 2 + (y - {y}) ** 2) > {TOL}"
_RING = [(0, 20), (30, 0), (75, 10), (60, 45), (70, 75), (10, 60)]
_SIDES = " + ".join(
    f"CASE WHEN (ay + {q} > y) <> (ay + {s} > y) AND x < (ax + {r} - (ax + {p})) * (y - (ay + {q})) / (ay + {s} - (ay + {q})) + ax + {p} THEN 1 ELSE 0 END"
    for (p, q), (r, s) in zip(_RING, _RING[1:] + _RING[:1], strict=True)
)
_W, _WR = f"WITH {MAP_SQL}", f"WITH RECURSIVE {MAP_SQL}"

QUERIES = {
    "coincident_points": (coincident_points, f"{_W} SELECT * FROM hit"),
    "coincidence_components": (coincidence_components, f"{_WR}, {_TOGETHER} SELECT token, node FROM nodes"),
    "split_edges": (
        split_edges,
        f"""{_WR}, {_TOGETHER}, runs AS (SELECT line, v, concat('V:', line, ':0:', v) AS token, sum(step) OVER (PARTITION BY line ORDER BY v) AS along FROM
        (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM verts WINDOW w AS (PARTITION BY line ORDER BY v))),
        cut AS (SELECT line, 0 AS part, v AS v0, lead(v) OVER w AS v1, node AS a, lead(node) OVER w AS b, round(lead(along) OVER w - along, 6) AS length FROM runs JOIN nodes USING (token) WINDOW w AS (PARTITION BY line ORDER BY v))
        SELECT * FROM cut WHERE v1 IS NOT NULL""",
    ),
    "connection_issues": (connection_issues, f"{_W}, {_ISSUES} SELECT * FROM connection"),
    "refused_hits": (refused_hits, f"{_W} SELECT DISTINCT token, CAST(split_part(other, ':', 2) AS BIGINT) AS line FROM hit WHERE refused"),
    "geometry_issues": (geometry_issues, f"{_W}, {_GEOMETRY} SELECT * FROM geometry"),
    "stacked_points": (
        stacked_points,
        f"{_WR}, {_TOGETHER} SELECT count(*) AS n, min(point) AS point FROM pts JOIN nodes ON token = concat('P:', point) WHERE NOT structure GROUP BY node HAVING count(*) > 1",
    ),
    "crossings": (
        crossings,
        f"""{_W}, {_PAIRS} SELECT DISTINCT 'E19' AS code, line, other, round(x, 6) AS x, round(y, 6) AS y, NULL::DOUBLE AS length FROM met
        WHERE ({_OFF('x1', 'y1')} AND {_OFF('x2', 'y2')}) OR ({_OFF('u1', 'w1')} AND {_OFF('u2', 'w2')})
        UNION ALL SELECT 'E18', line, other, NULL, NULL, round(sum(common), 6) FROM shared WHERE common > 0 GROUP BY line, other HAVING sum(common) > {TOL}""",
    ),
    "issue_summary": (issue_summary, f"{_W}, {_ISSUES}, {_GEOMETRY} SELECT code, severity, count(*) AS n FROM (SELECT code, severity FROM connection UNION ALL SELECT code, severity FROM geometry) GROUP BY ALL"),
    "touching_segments": (touching_segments, f"{_W} SELECT point, other_line AS line, seg, round(t, 9) AS t, round(distance, 9) AS distance FROM {_near_segments('pts', 'point')} WHERE distance <= {GAP}"),
    "nearest_structure": (
        nearest_structure,
        f"""{_W}, found AS (SELECT a.point, b.point AS structure_point, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM pts a, pts b WHERE NOT a.structure AND b.structure)
        SELECT point, arg_min(structure_point, (distance, structure_point)) AS structure_point, round(min(distance), 9) AS distance FROM found WHERE distance <= 25 GROUP BY point""",
    ),
    "contained_points": (
        contained_points,
        f"{_W}, areas AS (SELECT CAST(n_nationkey AS BIGINT) AS area, n_nationkey % 5 * 80 + 7.0::DOUBLE AS ax, n_nationkey // 5 * 80 + 3.0::DOUBLE AS ay FROM nation) SELECT point, area FROM pts, areas WHERE ({_SIDES}) % 2 = 1",
    ),
    "map_pages": (
        map_pages,
        f"""{_W}, box AS (SELECT min(x) AS l, max(y) AS t FROM pts), held AS (SELECT DISTINCT unnest(range(greatest(0, CAST(ceil((x - l - 100) / 90) AS BIGINT)), CAST(floor((x - l) / 90) AS BIGINT) + 1)) AS c, y FROM pts, box),
        cells AS (SELECT DISTINCT c, unnest(range(greatest(0, CAST(ceil((t - y - 70) / 63) AS BIGINT)), CAST(floor((t - y) / 63) AS BIGINT) + 1)) AS r FROM held, box)
        SELECT CAST(row_number() OVER (ORDER BY r, c) AS INTEGER) AS page, c AS "column", r AS "row", round(l + c * 90, 6) AS minx, round(t - r * 63, 6) AS maxy FROM cells, box""",
    ),
}
