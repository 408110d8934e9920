"""Queries over networks that are built from coordinates: the drawn map with associations and terminals, and the lattice of the network view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import issues as iss
from meshwright.operators import located_traces as lt
from meshwright.operators import map_network as mn
from meshwright.operators import placing
from meshwright.operators import traces
from meshwright.plans import topology_queries as tq
from meshwright.plans.graph_queries import QUERIES as GRAPH
from meshwright.plans.staging import staged
from meshwright.sources import network_view as nv

c = F.col
#: The lattice's points are whole units apart.
LATTICE_TOL = 0.25


def lines(spark, sf_dir: str) -> DataFrame:
    k = c("line")
    tier = F.when(c("ag") % 3 == 0, "High").when(c("ag") % 3 == 1, "Low")
    return tq.lines(spark, sf_dir).withColumns(
        {"class": F.lit("Main"), "fid": k, "tier": tier, "reverse": k % 6 == 0, "oneway": (k % 4).cast("int"), "size": (k % 5 * 50).cast("double"), "lifecycle": F.when(k % 41 == 0, 4).otherwise(3)}
    )


def points(spark, sf_dir: str) -> DataFrame:
    k = c("point")
    category = F.when(k % 10 == 0, "source").when((k % 10).isin(3, 6), "isolating").when((k % 10).isin(4, 5, 7), "customer").otherwise("main")
    return tq.points(spark, sf_dir).withColumns(
        {"class": F.lit("Device"), "fid": k, "at": F.lit(1), "closed": k % 14 == 0, "assetid": k.cast("string"), "lifecycle": F.lit(3), "categories": F.array(category)}
    )


def associations(spark, sf_dir: str) -> DataFrame:
    k = c("s_suppkey").cast("long")
    rows = nv.table(spark, sf_dir, "supplier").filter(k % 10 == 2)
    kinds = F.explode(F.array(F.struct(F.lit("connectivity").alias("kind"), F.lit(9).alias("step")), F.struct(F.lit("containment").alias("kind"), F.lit(1).alias("step"))))
    return rows.select(k.alias("from_point"), kinds.alias("x")).select("x.kind", "from_point", (c("from_point") + c("x.step")).alias("to_point"))


def terminals(spark, sf_dir: str) -> DataFrame:
    """Devices of every fourth nation have a high and a low side, those of the next ones an inlet without tier and two low outlets."""
    made = lambda seq, name, tier: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("terminal"), F.lit(tier).cast("string").alias("tier"))
    two, three = F.array(made(1, "hv", "High"), made(2, "lv", "Low")), F.array(made(1, "in", None), made(2, "out", "Low"), made(3, "spare", "Low"))
    ag = c("n_nationkey").cast("int")
    sides = F.when(ag % 4 == 0, two).when(ag % 4 == 1, three)
    return nv.table(spark, sf_dir, "nation").select(F.lit("Device").alias("class"), ag.alias("ag"), F.explode(sides).alias("t")).select("class", "ag", "t.*")


def drawn(spark, sf_dir: str) -> mn.MapNetwork:
    return mn.build(lines(spark, sf_dir), points(spark, sf_dir), tq.TOL, associations(spark, sf_dir), terminals(spark, sf_dir))


def _named(net: mn.MapNetwork, edges: DataFrame) -> DataFrame:
    names = staged(net.node_names(), "names")
    return edges.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b")


def map_edges(spark, sf_dir):
    net = drawn(spark, sf_dir)
    return _named(net, net.edges).select("kind", "line", "v0", "v1", "name_a", "name_b", F.round("length", 6).alias("length"), "device", "terminal")


def terminal_edges(spark, sf_dir):
    """How many line ends each terminal of a device took."""
    net = drawn(spark, sf_dir)
    sides = net.edges.filter(c("kind") == mn.TERMINAL).select("device", "terminal", c("b").alias("node"))
    of = net.edges.filter("line is not null")
    ends = of.select(c("a").alias("node")).unionByName(of.select(c("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return sides.join(ends, "node", "left").select("device", "terminal", F.coalesce("n", F.lit(0)).alias("line_ends"))


def terminal_mismatches(spark, sf_dir):
    return mn.mismatch_issues(drawn(spark, sf_dir))


def association_edges(spark, sf_dir):
    placed = mn.nodes_of(lines(spark, sf_dir), points(spark, sf_dir), tq.TOL)
    tied = mn.association_edges(associations(spark, sf_dir), staged(placed, "placed"))
    return tied.select("from_point", "to_point")


def _picked(spark, kind: str, *fids: int) -> DataFrame:
    return spark.range(1).select(F.lit(kind).alias("class"), F.explode(F.array(*[F.lit(f).cast("long") for f in fids])).alias("fid"))


def _trace(spark, sf_dir, kind, picked, **how):
    net = drawn(spark, sf_dir).network()
    return lt.trace(net, kind, lt.locate(net, picked), **how)


def map_connected(spark, sf_dir):
    """All that is connected to a picked line behind closed devices and lines out of use."""
    return _trace(spark, sf_dir, "connected", _picked(spark, "Main", 75), lifecycle=(4,)).features


def map_isolation(spark, sf_dir):
    extra = _trace(spark, sf_dir, "isolation", _picked(spark, "Main", 75)).extra
    return extra["to_close"].withColumn("role", F.lit("close")).unionByName(extra["customers"].withColumn("role", F.lit("customer")))


def map_downstream(spark, sf_dir):
    return _trace(spark, sf_dir, "downstream", _picked(spark, "Main", 75), flow="gravity").features


def map_oneway_path(spark, sf_dir):
    """The length of the shortest way over one-way lines between two devices."""
    net = drawn(spark, sf_dir).network()
    picks, targets = lt.locate(net, _picked(spark, "Device", 2)), lt.locate(net, net.points.filter("fid % 5 = 4").select("class", "fid"))
    return lt.trace(net, "shortest_path", picks, flow="undirected", targets=targets).extra["length"].select(F.round("dist", 6).alias("dist"))


def nearest_parts(spark, sf_dir):
    """For a click beside each line the part of it that is nearest."""
    net = drawn(spark, sf_dir)
    at = tq.lines(spark, sf_dir).select("line", c("path")[0]["x"].alias("x"), c("path")[0]["y"].alias("y"))
    clicks = at.select(c("line").alias("click"), "line", (c("x") + c("line") % 23).alias("x"), (c("y") + 0.25).alias("y"))
    return net.edges_near(clicks).join(net.edges.select("eid", "v0", "v1"), "eid").select("click", "v0", "v1")


#: Rounds that a trace over the lattice tries before it asks for components; lines of the network view lead anywhere within fewer.
NEAR = 12


def lattice(spark, sf_dir: str, fields: Sequence[str]) -> mn.MapNetwork:
    """The network view, built again from nothing but coordinates; lines bring the ``fields`` that are named."""
    place = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    drawn_lines = nv.lines(spark, sf_dir).select(
        (c("ag").cast("long") * 10**17 + c("fid")).alias("line"), F.lit(0).alias("part"), F.array(place("xa", "ya"), place("xb", "yb")).alias("path"),
        F.lit(0).alias("level_a"), F.lit(0).alias("level_b"), F.lit(False).alias("endvertex"), *fields,
    )
    return mn.build(staged(drawn_lines, "lattice"), nv.points(spark, sf_dir).withColumnRenamed("node", "point"), LATTICE_TOL, fields=fields)


def lattice_connected(spark, sf_dir):
    """What ``trace_connected_barriers`` finds over key edges, over coordinates."""
    net = lattice(spark, sf_dir, ("class", "fid")).network()
    return lt.trace(net, "connected", lt.locate(net, _picked(spark, "Source", 0)), levels=NEAR).features


def lattice_distances(spark, sf_dir):
    """``source_distance`` over coordinates."""
    net = lattice(spark, sf_dir, ()).network()
    tree = traces.source_lengths(net, net.closed())
    return net.points.select(c("point").alias("node"), c("node").alias("at")).join(tree.select(c("node").alias("at"), "dist"), "at").select("node", F.round("dist", 3).alias("dist"))


#: Lines under this length are very short.
SHORT = 6.0


def _checks(spark, sf_dir):
    return drawn(spark, sf_dir), lines(spark, sf_dir), points(spark, sf_dir), tq.TOL, tq.GAP, tq.CELL, SHORT


def issue_table(spark, sf_dir):
    """All issues of the map and its network."""
    found = iss.validate(*_checks(spark, sf_dir))
    return found.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


def issue_messages(spark, sf_dir):
    """Issues by message, without those of every tenth line and point, which are exceptions."""
    # Exceptions cover whole features, so issues are counted by feature and pairs of lines aren't listed.
    found = staged(iss.validated_features(*_checks(spark, sf_dir)), "issues")
    exceptions = iss.marked(found.filter("fid % 10 = 0"), found.limit(0))
    return iss.summary_of_features(iss.without_exceptions(found, exceptions))


#: Farthest and shortest service, and how near an earlier tap may lie to serve again.
FARTHEST, SHORTEST, REUSE = 6.0, 0.5, 2.5


def homes(spark, sf_dir: str) -> DataFrame:
    """A customer for each part, beside the lattice of the lines; every 19th has no place."""
    k = c("p_partkey").cast("long")
    x, y = (k % 41 * 9 + 3.25).cast("double"), (F.floor(k / 41) % 40 * 10 + 1.5 + k % 3).cast("double")
    return nv.table(spark, sf_dir, "part").select(k.alias("customer"), F.when(k % 19 != 0, x).alias("x"), y.alias("y"))


def _choices(spark, sf_dir):
    return placing.service_choices(homes(spark, sf_dir), tq.lines(spark, sf_dir).filter(F.size("path") > 1), FARTHEST, SHORTEST, tq.TOL, tq.CELL)


def service_choices(spark, sf_dir):
    return _choices(spark, sf_dir).select("customer", "result", "line", "seg", *[F.round(k, 6).alias(k) for k in ("tap_x", "tap_y", "distance")])


def service_taps(spark, sf_dir):
    """The taps of all services; points of the map that stand in the way of none serve as the first ones."""
    first = tq.points(spark, sf_dir).filter("not structure").select("x", "y")
    return placing.service_taps(_choices(spark, sf_dir), first, REUSE).select("customer", "line", F.round("tap_x", 6).alias("tap_x"), F.round("tap_y", 6).alias("tap_y"), "reused")


def snapped_points(spark, sf_dir):
    """Points of the map that go onto a line within the gap."""
    found = placing.snapped_points(tq.points(spark, sf_dir).select("point", "x", "y"), tq.lines(spark, sf_dir), tq.TOL, tq.GAP, tq.CELL)
    return found.select("point", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "line", "seg", "vertex")


# ---------------------------------------------------------------- oracles

_EDGES = f"""WITH RECURSIVE {tq.MAP_SQL}, {tq._TOGETHER},
attr AS (SELECT k AS line, CASE WHEN k % 29 <> 0 THEN c_nationkey END AS ag, k % 6 = 0 AS reverse, k % 4 AS oneway, CASE WHEN k % 41 = 0 THEN 4 ELSE 3 END AS lifecycle FROM raw),
cut AS (SELECT * FROM (SELECT line, v AS v0, lead(v) OVER w AS v1, node AS a, lead(node) OVER w AS b, lead(along) OVER w - along AS length FROM
  (SELECT line, v, concat('V:', line, ':0:', v) AS token, sum(step) OVER (PARTITION BY line ORDER BY v) AS along FROM
    (SELECT *, coalesce(sqrt((x - lag(x) OVER u) ** 2 + (y - lag(y) OVER u) ** 2), 0) AS step FROM verts WINDOW u AS (PARTITION BY line ORDER BY v))) JOIN nodes USING (token)
  WINDOW w AS (PARTITION BY line ORDER BY v)) WHERE v1 IS NOT NULL),
named AS (SELECT *, CASE ag % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' END AS tier FROM cut JOIN attr USING (line)),
place AS MATERIALIZED (SELECT point, node, ag, x, y FROM pts JOIN nodes ON token = concat('P:', point)),
sides AS (SELECT n_nationkey AS ag, unnest([1, 2]) AS seq, unnest(['hv', 'lv']) AS terminal, unnest(['High', 'Low']) AS tier FROM nation WHERE n_nationkey % 4 = 0
  UNION ALL SELECT n_nationkey, unnest([1, 2, 3]), unnest(['in', 'out', 'spare']), unnest([NULL, 'Low', 'Low']) FROM nation WHERE n_nationkey % 4 = 1),
dev AS MATERIALIZED (SELECT *, seq = max(seq) OVER (PARTITION BY point, tier) AS last FROM place JOIN sides USING (ag)),
taken AS MATERIALIZED (SELECT * FROM dev WHERE last QUALIFY row_number() OVER (PARTITION BY node, tier ORDER BY point) = 1),
line_ends AS (SELECT line, a AS node, tier FROM named UNION ALL SELECT line, b, tier FROM named),
mismatch AS (SELECT DISTINCT d.point, e.line FROM line_ends e JOIN (SELECT DISTINCT node, point FROM dev) d USING (node) LEFT JOIN taken t ON t.node = e.node AND t.tier IS NOT DISTINCT FROM e.tier WHERE t.point IS NULL OR d.point < t.point),
tied AS (SELECT s AS from_point, s + 9 AS to_point, p.node AS a, q.node AS b FROM (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 10 = 2) JOIN place p ON p.point = s JOIN place q ON q.point = s + 9 WHERE p.node <> q.node),
edges AS MATERIALIZED (SELECT row_number() OVER () AS eid, * FROM (
  SELECT 'line' AS kind, n.line, v0, v1, CASE WHEN s.node IS NULL THEN a ELSE concat('T:', s.point, ':', s.terminal) END AS a, CASE WHEN t.node IS NULL THEN b ELSE concat('T:', t.point, ':', t.terminal) END AS b,
    length, NULL::BIGINT AS device, NULL::VARCHAR AS terminal, reverse, oneway, lifecycle
  FROM named n LEFT JOIN taken s ON s.node = a AND s.tier IS NOT DISTINCT FROM n.tier LEFT JOIN taken t ON t.node = b AND t.tier IS NOT DISTINCT FROM n.tier
  UNION ALL SELECT 'terminal', NULL, NULL, NULL, node, concat('T:', point, ':', terminal), 0, point, terminal, FALSE, 0, NULL FROM dev
  UNION ALL SELECT 'association', NULL, NULL, NULL, a, b, 0, NULL, NULL, FALSE, 0, NULL FROM tied)),
shut AS (SELECT node FROM place WHERE point % 14 = 0),
picked AS (SELECT a AS node, eid, a, b, reverse FROM edges WHERE line = 75),
picked_ends AS (SELECT a AS node FROM picked UNION SELECT b FROM picked)"""


def _ways(edges: str) -> str:
    return f"(SELECT a AS src, b AS dst FROM {edges} UNION ALL SELECT b, a FROM {edges})"


_CONNECTED = f"""open AS MATERIALIZED (SELECT * FROM edges WHERE coalesce(lifecycle, 0) <> 4),
got AS (SELECT node FROM picked_ends UNION SELECT dst FROM got JOIN {_ways("open")} ON src = node WHERE node NOT IN (SELECT node FROM shut)),
free AS (SELECT node FROM got WHERE node NOT IN (SELECT node FROM shut))
SELECT 'point' AS kind, 'Device' AS class, point AS fid FROM place JOIN got USING (node)
UNION ALL SELECT * FROM (SELECT 'line', 'Main', line FROM open WHERE kind = 'line' AND (a IN (SELECT node FROM free) OR b IN (SELECT node FROM free)) UNION SELECT 'line', 'Main', 75)"""

_GRAVITY = """directed AS MATERIALIZED (SELECT eid, line, CASE WHEN reverse THEN b ELSE a END AS src, CASE WHEN reverse THEN a ELSE b END AS dst FROM edges UNION ALL SELECT eid, line, b, a FROM edges WHERE line IS NULL),
got AS (SELECT CASE WHEN reverse THEN a ELSE b END AS node FROM picked UNION SELECT dst FROM got JOIN directed ON src = node WHERE node NOT IN (SELECT node FROM shut))
SELECT 'point' AS kind, 'Device' AS class, point AS fid FROM place JOIN got USING (node)
UNION ALL SELECT * FROM (SELECT 'line', 'Main', line FROM directed WHERE line IS NOT NULL AND src IN (SELECT node FROM got) AND src NOT IN (SELECT node FROM shut) UNION SELECT 'line', 'Main', 75)"""

_CUT_OFF = f"""valves AS (SELECT node, point FROM place WHERE point % 10 IN (3, 6)), live AS (SELECT node FROM valves WHERE point % 14 <> 0), sources AS (SELECT node FROM place WHERE point % 10 = 0),
area AS (SELECT node FROM picked_ends UNION SELECT dst FROM area JOIN {_ways("edges")} ON src = node WHERE node NOT IN (SELECT node FROM shut UNION SELECT node FROM live)),
inner_area AS (SELECT node FROM area WHERE node NOT IN (SELECT node FROM shut UNION SELECT node FROM live)),
gone AS (SELECT eid FROM edges WHERE a IN (SELECT node FROM inner_area) OR b IN (SELECT node FROM inner_area) UNION SELECT eid FROM picked),
closing AS (SELECT node FROM area WHERE node IN (SELECT node FROM live)),
before AS (SELECT node FROM sources UNION SELECT dst FROM before JOIN {_ways("edges")} ON src = node WHERE node NOT IN (SELECT node FROM shut) OR node IN (SELECT node FROM sources)),
rest AS MATERIALIZED (SELECT * FROM edges WHERE eid NOT IN (SELECT eid FROM gone)),
fed AS (SELECT node FROM sources WHERE node NOT IN (SELECT node FROM area)),
later AS (SELECT node FROM fed UNION SELECT dst FROM later JOIN {_ways("rest")} ON src = node WHERE node NOT IN (SELECT node FROM shut UNION SELECT node FROM closing) OR node IN (SELECT node FROM fed)),
lost AS (SELECT node FROM before WHERE node NOT IN (SELECT node FROM later) UNION SELECT node FROM area WHERE node NOT IN (SELECT node FROM closing))
SELECT 'Device' AS class, point AS fid, 'close' AS role FROM valves JOIN (SELECT DISTINCT node FROM closing) USING (node)
UNION ALL SELECT 'Device', point, 'customer' FROM place JOIN lost USING (node) WHERE point % 10 IN (4, 5, 7)"""

_WAYS = """ways AS MATERIALIZED (SELECT a AS src, b AS dst, length FROM edges WHERE coalesce(oneway, 0) <> 2 OR line IS NULL UNION ALL SELECT b, a, length FROM edges WHERE coalesce(oneway, 0) <> 1 OR line IS NULL),
d0 AS MATERIALIZED (SELECT node, 0.0::DOUBLE AS dist FROM place WHERE point = 2)"""
_ROUNDS = 40
_STEPS = ", ".join(
    f"d{k} AS MATERIALIZED (SELECT node, min(dist) AS dist FROM (SELECT * FROM d{k - 1} UNION ALL SELECT dst, dist + length FROM d{k - 1} JOIN ways ON src = node WHERE node NOT IN (SELECT node FROM shut)) GROUP BY node)"
    for k in range(1, _ROUNDS + 1)
)

_SIDE = "sign(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"
_HITS = " AND ".join(
    [
        "greatest(tap_x, f.x) >= least(s.x1, s.x2) AND greatest(s.x1, s.x2) >= least(tap_x, f.x) AND greatest(tap_y, f.y) >= least(s.y1, s.y2) AND greatest(s.y1, s.y2) >= least(tap_y, f.y)",
        f"{_SIDE.format('tap_x', 'tap_y', 'f.x', 'f.y', 's.x1', 's.y1')} * {_SIDE.format('tap_x', 'tap_y', 'f.x', 'f.y', 's.x2', 's.y2')} <= 0",
        f"{_SIDE.format('s.x1', 's.y1', 's.x2', 's.y2', 'tap_x', 'tap_y')} * {_SIDE.format('s.x1', 's.y1', 's.x2', 's.y2', 'f.x', 'f.y')} <= 0",
    ]
)
_SERVICES = f"""WITH {tq.MAP_SQL}, home AS (SELECT p_partkey AS customer, CASE WHEN p_partkey % 19 <> 0 THEN p_partkey % 41 * 9 + 3.25::DOUBLE END AS x, CAST(p_partkey // 41 % 40 * 10 + p_partkey % 3 AS DOUBLE) + 1.5 AS y FROM part),
met AS (SELECT *, x1 + t * (x2 - x1) AS tap_x, y1 + t * (y2 - y1) AS tap_y FROM (SELECT customer, c.x, c.y, s.line, seg, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0 ELSE {tq._T} END AS t
  FROM home c JOIN seg s ON c.x BETWEEN least(x1, x2) - 6 AND greatest(x1, x2) + 6 AND c.y BETWEEN least(y1, y2) - 6 AND greatest(y1, y2) + 6)),
away AS (SELECT *, sqrt((x - tap_x) ** 2 + (y - tap_y) ** 2) AS distance FROM met WHERE sqrt((x - tap_x) ** 2 + (y - tap_y) ** 2) <= {FARTHEST}),
nearest AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY customer, line ORDER BY distance, seg) = 1),
few AS MATERIALIZED (SELECT *, distance < {SHORTEST} AS touches FROM nearest QUALIFY row_number() OVER (PARTITION BY customer ORDER BY distance, line) <= 5),
judged AS (SELECT f.*, NOT touches AND EXISTS (SELECT 1 FROM seg s WHERE s.line <> f.line AND {_HITS}) AS crosses FROM few f),
best AS (SELECT * FROM judged WHERE NOT touches AND NOT crosses QUALIFY row_number() OVER (PARTITION BY customer ORDER BY distance, line) = 1),
why AS (SELECT customer, bool_or(touches) AS touches, bool_or(crosses) AS crosses FROM judged GROUP BY customer)
SELECT h.customer, CASE WHEN h.x IS NULL THEN 'no_geometry' WHEN b.line IS NOT NULL THEN 'created' WHEN w.touches THEN 'touching' WHEN w.crosses THEN 'crossing' ELSE 'too_far' END AS result,
  b.line, b.seg, round(tap_x, 6) AS tap_x, round(tap_y, 6) AS tap_y, round(distance, 6) AS distance FROM home h LEFT JOIN best b USING (customer) LEFT JOIN why w USING (customer)"""

_OF_TOKEN = "CASE WHEN token LIKE 'V:%' THEN 'Main' ELSE 'Device' END AS class, CAST(split_part(token, ':', 2) AS BIGINT) AS fid"
_AT_LINE = "coalesce(f.x, 0) AS x, coalesce(f.y, 0) AS y, 'Main' AS class"
_TABLE = f"""{_EDGES}, {tq._ISSUES}, {tq._GEOMETRY}, {tq._PAIRS},
first_at AS (SELECT line, x, y FROM verts WHERE v = 0 AND last > 0),
touch AS (SELECT token, min(other_line) AS other FROM {tq._near_segments("alone", "token, c.line")} WHERE distance <= {tq.TOL} AND t > 0 AND t < 1 AND line IS DISTINCT FROM other_line GROUP BY token),
spot AS (SELECT concat('V:', line, ':0:', v) AS token, x, y FROM verts UNION ALL SELECT concat('P:', point), x, y FROM pts),
sized AS (SELECT e.line, e.line % 5 * 50 AS size, unnest([a, b]) AS node FROM edges e WHERE kind = 'line'),
differ AS (SELECT node, list_sort(list_distinct(list(size))) AS sizes, min(line) AS line FROM sized WHERE node NOT IN (SELECT node FROM place) GROUP BY node HAVING count(DISTINCT size) > 1),
issue AS (
  SELECT code, severity, CASE code WHEN 'E03' THEN concat('Touches line Main:', other, ' between vertices (needs a vertex / split)') WHEN 'E21' THEN 'Meets another line end at a different elevation level (F_ELEV / T_ELEV): not connected'
    WHEN 'E07' THEN printf('Gap of %.3f to the nearest feature (not connected)', distance) WHEN 'E02' THEN 'Point is not connected to any line' ELSE 'Dangling line end' END AS message, x, y, {_OF_TOKEN}, 'point' AS geom
    FROM connection LEFT JOIN touch USING (token)
  UNION ALL SELECT code, severity, CASE WHEN code = 'E06' THEN 'Asset group is empty' WHEN code = 'E20' THEN printf('Very short line (%.3f)', length) WHEN NOT fine THEN 'Line without a valid geometry' ELSE 'Zero-length line' END, {_AT_LINE}, key, 'line'
    FROM geometry JOIN long ON k = key LEFT JOIN first_at f ON f.line = key WHERE kind = 'line'
  UNION ALL SELECT code, severity, 'Asset group is empty', x, y, 'Device', key, 'point' FROM geometry JOIN pts ON point = key WHERE kind = 'point'
  UNION ALL SELECT 'E08', 'warning', concat(n, ' point features at the same location'), x, y, 'Device', point, 'point' FROM (SELECT node, count(*) AS n, min(s.point) AS point FROM place p JOIN pts s USING (point) WHERE NOT structure GROUP BY node HAVING count(*) > 1) JOIN pts USING (point)
  UNION ALL SELECT 'E12', 'warning', concat('Size changes (', array_to_string(sizes, ' / '), ') without a fitting / reducer'), coalesce(s.x, p.x), coalesce(s.y, p.y), 'Main', d.line, 'point'
    FROM differ d LEFT JOIN spot s ON s.token = node LEFT JOIN pts p ON node LIKE 'T:%' AND p.point = TRY_CAST(split_part(node, ':', 2) AS BIGINT)
  UNION ALL SELECT 'E15', 'error', concat('Connects in the middle of Main:', other, ', which only connects at its ends'), x, y, {_OF_TOKEN}, 'point' FROM (SELECT DISTINCT token, split_part(other, ':', 2) AS other FROM hit WHERE refused) JOIN cand USING (token)
  UNION ALL SELECT 'E11', 'error', 'Line tier matches no terminal of the device (check the line asset group)', x, y, 'Main', line, 'point' FROM mismatch JOIN pts USING (point)
  UNION ALL SELECT 'E18', 'error', concat('Overlaps line Main:', other, printf(' over %.2f', round(sum(common), 6))), {_AT_LINE}, line, 'point' FROM shared JOIN first_at f USING (line) WHERE common > 0 GROUP BY line, other, f.x, f.y HAVING sum(common) > {tq.TOL}
  UNION ALL SELECT DISTINCT 'E19', 'warning', concat('Crosses line Main:', other, ' without a junction'), round(x, 6), round(y, 6), 'Main', line, 'point' FROM met
    WHERE ({tq._OFF("x1", "y1")} AND {tq._OFF("x2", "y2")}) OR ({tq._OFF("u1", "w1")} AND {tq._OFF("u2", "w2")}))"""

QUERIES = {
    "issue_table": (issue_table, f"{_TABLE} SELECT code, severity, message, round(x, 6) AS x, round(y, 6) AS y, class, fid, geom FROM issue"),
    "issue_messages": (issue_messages, f"{_TABLE} SELECT code, severity, split_part(split_part(message, ' (', 1), ':', 1) AS what, count(*) AS n FROM issue WHERE fid % 10 <> 0 GROUP BY ALL"),
    "service_choices": (service_choices, _SERVICES),
    "service_taps": (service_taps, None),
    "snapped_points": (snapped_points, None),
    "map_edges": (map_edges, f"{_EDGES} SELECT kind, line, v0, v1, a AS name_a, b AS name_b, round(length, 6) AS length, device, terminal FROM edges"),
    "terminal_edges": (
        terminal_edges,
        f"""{_EDGES}, taking AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM edges WHERE kind = 'line' UNION ALL SELECT b FROM edges WHERE kind = 'line') GROUP BY node)
        SELECT device, terminal, coalesce(n, 0) AS line_ends FROM edges LEFT JOIN taking ON node = b WHERE kind = 'terminal'""",
    ),
    "terminal_mismatches": (
        terminal_mismatches,
        f"{_EDGES} SELECT 'E11' AS code, 'error' AS severity, 'Line tier matches no terminal of the device (check the line asset group)' AS message, x, y, 'Main' AS class, line AS fid FROM mismatch JOIN pts USING (point)",
    ),
    "association_edges": (association_edges, f"{_EDGES} SELECT from_point, to_point FROM tied"),
    "map_connected": (map_connected, f"{_EDGES}, {_CONNECTED}"),
    "map_isolation": (map_isolation, f"{_EDGES}, {_CUT_OFF}"),
    "map_downstream": (map_downstream, f"{_EDGES}, {_GRAVITY}"),
    "map_oneway_path": (map_oneway_path, f"{_EDGES}, {_WAYS}, {_STEPS} SELECT round(min(dist), 6) AS dist FROM d{_ROUNDS} WHERE node IN (SELECT node FROM place WHERE point % 5 = 4) HAVING count(*) > 0"),
    "nearest_parts": (
        nearest_parts,
        f"""{_EDGES}, clicks AS (SELECT line, x + line % 23 AS x, y + 0.25::DOUBLE AS y FROM verts WHERE v = 0), held AS (SELECT c.line AS click, v0, v1, seg, c.x, c.y, x1, y1, x2, y2,
          CASE WHEN x1 = x2 AND y1 = y2 THEN 0.0 ELSE {tq._T} END AS t FROM clicks c JOIN named n ON n.line = c.line JOIN seg s ON s.line = c.line AND seg >= v0 AND seg < v1)
        SELECT click, v0, v1 FROM held QUALIFY row_number() OVER (PARTITION BY click ORDER BY sqrt((x - (x1 + t * (x2 - x1))) ** 2 + (y - (y1 + t * (y2 - y1))) ** 2), v0) = 1""",
    ),
    "lattice_connected": (lattice_connected, GRAPH["trace_connected_barriers"][1]),
    "lattice_distances": (lattice_distances, GRAPH["source_distance"][1]),
}
