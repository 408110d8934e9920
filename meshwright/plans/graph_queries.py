"""Graph queries over the network view, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import blocks as blk
from meshwright.operators import graph, traces
from meshwright.operators.traces import Network
from meshwright.plans.staging import spread_out, staged
from meshwright.sources import network_view as nv

#: Edge numbers: place of the class times this, plus the line's number.
EDGE_STRIDE = 10**17
#: Rounds to which the distance oracle is written out; more than shortest ways have edges.
ORACLE_ROUNDS = 14
#: Conditions of the barrier query.
CONDITIONS = (("segment", "=", "building"), ("balance", "<", 0), ("brand", "=", "Brand#11"), ("built", "<", 1985))


#: Columns of lines that every trace needs; others are read where a query names them.
LINE = ("eid", "class", "fid", "a", "b")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nv.lines(spark, sf_dir).withColumn("eid", F.col("ag").cast("long") * EDGE_STRIDE + F.col("fid"))


def network(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> Network:
    """Points and lines; ``columns`` of the lines, if not all are needed."""
    lines = _lines(spark, sf_dir)
    # Lines are an aggregate of lineitem that every step of a trace reads again.
    return Network(nv.points(spark, sf_dir), staged(lines if columns is None else lines.select(*columns), "lines"))


def _at(spark: SparkSession, kind: str, key: int) -> DataFrame:
    return spark.range(1).select(nv.node(kind, F.lit(key)).alias("node"))


def net_nodes(spark, sf_dir):
    return nv.points(spark, sf_dir).select("node", "class", "fid", "x", "y")


def net_edges(spark, sf_dir):
    return nv.lines(spark, sf_dir).select("class", "fid", "a", "b", F.round("length", 3).alias("length"))


def adjacency(spark, sf_dir):
    # Dealt first: counting before the shuffle would hold a row of nearly every pair in memory.
    dealt = spread_out(graph.both_ways(nv.lines(spark, sf_dir)), "src", "dst")
    pairs = dealt.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("lines"))
    return pairs.groupBy(F.col("src").alias("node")).agg(F.sum("lines").alias("degree"), F.count("dst").alias("neighbours"))


def trace_connected(spark, sf_dir):
    return traces.connected(network(spark, sf_dir, LINE), _at(spark, "Source", 0))


def trace_connected_barriers(spark, sf_dir):
    net = network(spark, sf_dir, LINE)
    return traces.connected(net, _at(spark, "Source", 0), net.closed())


def trace_condition_barriers(spark, sf_dir):
    # Conditions are judged before lines are staged, so what they read isn't written.
    kept, walls = traces.restrict(Network(nv.points(spark, sf_dir), _lines(spark, sf_dir)), conditions=CONDITIONS)
    net = Network(kept.points, staged(kept.edges.select(*LINE), "lines"))
    return traces.connected(net, _at(spark, "Valve", 1), walls)


def trace_lifecycle_size(spark, sf_dir):
    net, walls = traces.restrict(network(spark, sf_dir), lifecycle=(2, 4), min_size=30, closed=False)
    return traces.connected(net, _at(spark, "Source", 0), walls)


def trace_output_groups(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "ag"))
    return traces.connected(net, _at(spark, "Source", 2), net.closed(), groups=[(4, None), (5, 2)])


def trace_downstream_gravity(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "reverse"))
    return traces.along_flow(net, _at(spark, "Source", 0), walls=net.closed()).select("node", "hops")


def trace_upstream_gravity(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "reverse"))
    return traces.along_flow(net, _at(spark, "Station", 1), upstream=True).select("node", "hops")


def source_distance(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "length"))
    return traces.source_lengths(net, net.closed()).select("node", F.round("dist", 3).alias("dist"))


def trace_downstream(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "length"))
    return traces.downstream_of_source(net, _at(spark, "Valve", 1), net.closed()).select("node")


def trace_upstream(spark, sf_dir):
    return traces.upstream_of_source(network(spark, sf_dir, (*LINE, "length")), _at(spark, "Meter", 1)).select("node")


def shortest_path_length(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "length"))
    way = traces.shortest_path(net, _at(spark, "Meter", 1), net.having(traces.SOURCE))
    return way.agg(F.round(F.max("dist"), 3).alias("dist"))


def shortest_path(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "length"))
    return traces.shortest_path(net, _at(spark, "Meter", 1), net.having(traces.SOURCE)).select("node", F.round("dist", 3).alias("dist"))


def isolation_valves(spark, sf_dir):
    return traces.isolation(network(spark, sf_dir, LINE), _at(spark, "Station", 1))["to_close"]


def isolation_customers(spark, sf_dir):
    return traces.isolation(network(spark, sf_dir, LINE), _at(spark, "Valve", 1))["customers"]


def subnetworks(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "tier"))
    return traces.subnetworks(net, net.controllers()).select("controller", "node")


def subnetwork_stats(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "tier"))
    return traces.subnetwork_stats(net, net.controllers()).select("name", "points", "customers")


def subnetworks_of_start(spark, sf_dir):
    net = network(spark, sf_dir, (*LINE, "tier"))
    fed = traces.subnetworks(net, net.controllers()).select("controller", "node")
    mine = fed.join(_at(spark, "Meter", 1), "node", "left_semi").select("controller").distinct()
    return fed.join(mine, "controller", "left_semi").select("node").distinct()


def is_connected(spark, sf_dir):
    net = network(spark, sf_dir, LINE)
    got = graph.reach(graph.both_ways(net.edges), net.controllers().select("node")).select("node").withColumn("hit", F.lit(1))
    return net.points.select("node", "class").join(got, "node", "left").groupBy("class").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("connected"))


def without_trunks(net: Network) -> Network:
    """A network in which every other trunk is missing, so that some nations are fed by nothing."""
    return Network(net.points, net.edges.filter("not (class = 'Trunk' and fid % 2 = 1) and class <> 'Mesh'"))


def islands(spark, sf_dir):
    """Lines of components without a source, whatever is closed."""
    net = without_trunks(network(spark, sf_dir, LINE))
    got = graph.reach(graph.both_ways(net.edges), net.having(traces.SOURCE)).select(F.col("node").alias("a"))
    return net.edges.join(got, "a", "left_anti").select("class", "fid")


def fed_features(net: Network, controllers: DataFrame) -> DataFrame:
    """``kind, class, fid, name``: points and lines of each subnetwork; a line belongs to what its fed ends feed."""
    members = traces.subnetworks(net, controllers).join(controllers.select(F.col("node").alias("controller"), "name"), "controller").select("controller", "node", "name")
    walls = net.closed().union(controllers.select("node")).distinct().withColumn("wall", F.lit(True))
    spread = members.join(walls, "node", "left").filter(F.col("wall").isNull() | (F.col("node") == F.col("controller")))
    tiers = controllers.select(F.col("node").alias("controller"), F.col("tier").alias("own_tier"))
    spread = spread.join(tiers, "controller").select("node", "name", "own_tier")
    # An end brings the names of all its controllers at once, and a line puts those of its ends together.
    standing = spread.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("name", "own_tier"))).alias("standing"))
    lines = net.edges.select("class", "fid", "tier", F.explode(F.array("a", "b")).alias("node")).join(standing, "node")
    fits = F.filter("standing", lambda s: s["own_tier"].isNull() | F.col("tier").isNull() | (s["own_tier"] == F.col("tier")))
    lines = lines.select("class", "fid", F.transform(fits, lambda s: s["name"]).alias("names")).groupBy("class", "fid").agg(F.flatten(F.collect_set("names")).alias("names"))
    lines = lines.select(F.lit("line").alias("kind"), "class", "fid", F.explode(F.array_distinct("names")).alias("name"))
    points = net.points.join(members, "node").select(F.lit("point").alias("kind"), "class", "fid", "name").distinct()
    return points.unionByName(lines)


#: Settings of the tiers: whether a feature may be in several subnetworks, and whether its lines need a controller.
TIERS = {"Transmission": {"multi": False, "require": False}, "Distribution": {"multi": True, "require": True}}


def tiered(net: Network) -> DataFrame:
    """Controllers with a tier: even regions are of tier Transmission, the others have none."""
    return net.controllers().withColumn("tier", F.when(F.col("node") % 2 == 0, "Transmission"))


def multi_fed(spark, sf_dir):
    """Features of several subnetworks, one of them of a tier that allows one only."""
    net = network(spark, sf_dir, (*LINE, "tier"))
    controllers = tiered(net)
    single = [t for t, s in TIERS.items() if not s["multi"]]
    named = controllers.groupBy("name").agg(F.min_by("tier", "node").alias("tier"))
    fed = fed_features(net, controllers).join(F.broadcast(named), "name").groupBy("kind", "class", "fid")  # few controllers
    found = fed.agg(F.count(F.lit(1)).alias("feeds"), F.max(F.coalesce(F.col("tier").isin(*single), F.lit(False))).alias("single"))
    return found.filter("feeds > 1 and single").select("kind", "class", "fid", "feeds")


def no_controller(spark, sf_dir):
    """Lines of a tier that requires a controller and that none feeds."""
    net = without_trunks(network(spark, sf_dir, (*LINE, "tier")))
    required = [t for t, s in TIERS.items() if s["require"]]
    fed = fed_features(net, net.controllers()).filter("kind = 'line'").select("class", "fid").distinct()
    return net.edges.filter(F.col("tier").isin(*required)).select("class", "fid").join(fed, ["class", "fid"], "left_anti")


def star_components(spark, sf_dir):
    """Parts of the network that feeders and services alone hold together."""
    net = network(spark, sf_dir, LINE)
    some = net.edges.filter(F.col("class").isin("Feeder", "Service"))
    nodes = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
    return graph.components(nodes, some).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def component_sizes(net: Network) -> DataFrame:
    """Components over all points and lines, and their points."""
    return graph.components(net.points.select("node"), net.edges).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def all_components(spark, sf_dir):
    return component_sizes(network(spark, sf_dir, LINE))


def loop_edges(spark, sf_dir):
    net = network(spark, sf_dir, LINE)
    return net.edges.join(traces.loops(net), "eid", "left_semi").select("class", "fid")


def block_sizes(spark, sf_dir):
    net = network(spark, sf_dir, LINE)
    return blk.blocks(net.edges.select("eid", "a", "b")).groupBy("block").agg(F.count(F.lit(1)).alias("edges"))


def upstream_all(spark, sf_dir):
    net = network(spark, sf_dir, LINE)
    return net.edges.join(traces.upstream_all(net, _at(spark, "Station", 1), net.closed()), "eid", "left_semi").select("class", "fid")


def criticality(spark, sf_dir):
    return traces.criticality(network(spark, sf_dir, LINE)).select("class", "fid", "customers")


# ---------------------------------------------------------------- oracles

_BOTH = "both_ways AS (SELECT a AS src, b AS dst FROM lines UNION ALL SELECT b, a FROM lines)"
_CLOSED = "SELECT node FROM points WHERE closed"


def node_sql(kind: str, key: int) -> str:
    return f"SELECT {(nv.POINT_CLASSES.index(kind) + 1) * nv.STRIDE + key} AS node"


def reach_sql(start: str, walls: str | None, body: str, both: str = _BOTH, more: str = "", lines: str = "lines") -> str:
    beyond = "" if walls is None else "WHERE r.node NOT IN (SELECT node FROM walls) OR r.node IN (SELECT node FROM starts)"
    return f"""WITH RECURSIVE {nv.VIEW_SQL}, {more} starts AS ({start}), walls AS ({walls or "SELECT node FROM points WHERE FALSE"}), {both},
    reach AS (SELECT node FROM starts UNION SELECT dst FROM reach r JOIN both_ways ON src = r.node {beyond}),
    spread AS (SELECT node FROM reach WHERE node NOT IN (SELECT node FROM walls) OR node IN (SELECT node FROM starts))
    {body}"""


_FEATURES = """SELECT 'point' AS kind, p.class, p.fid FROM points p JOIN reach USING (node)
UNION ALL SELECT 'line', class, fid FROM lines WHERE a IN (SELECT node FROM spread) OR b IN (SELECT node FROM spread)"""
_CONDITION_WALLS = f"""{_CLOSED} UNION SELECT node FROM points WHERE lower(segment) = 'building' OR balance < 0 OR lower(brand) = 'brand#11'"""
_SMALL = "both_ways AS (SELECT a AS src, b AS dst FROM kept UNION ALL SELECT b, a FROM kept)"
_HALF = "kept AS (SELECT * FROM lines WHERE NOT (class = 'Trunk' AND fid % 2 = 1) AND class <> 'Mesh'),"
_NOT_OLD = "kept AS (SELECT * FROM lines WHERE NOT coalesce(built < 1985, FALSE)),"
_KEPT = "kept AS (SELECT * FROM lines WHERE lifecycle NOT IN (2, 4) AND NOT coalesce(size < 30, FALSE)),"
_FLOW = "both_ways AS (SELECT CASE WHEN reverse THEN b ELSE a END AS src, CASE WHEN reverse THEN a ELSE b END AS dst FROM lines)"
_AGAINST = "both_ways AS (SELECT CASE WHEN reverse THEN a ELSE b END AS src, CASE WHEN reverse THEN b ELSE a END AS dst FROM lines)"


def hops_sql(start: str, walls: str | None, both: str, rounds: int = 12) -> str:
    beyond = "" if walls is None else f"AND (h.node NOT IN (SELECT node FROM walls) OR h.hops = 0)"
    levels = ["h0 AS MATERIALIZED (SELECT node, 0 AS hops FROM starts)"]
    for k in range(1, rounds + 1):
        levels.append(f"h{k} AS MATERIALIZED (SELECT node, min(hops) AS hops FROM (SELECT * FROM h{k - 1} UNION ALL SELECT dst, h.hops + 1 FROM h{k - 1} h JOIN both_ways ON src = h.node WHERE TRUE {beyond}) GROUP BY node)")
    return f"""WITH RECURSIVE {nv.VIEW_SQL}, starts AS ({start}), walls AS ({walls or "SELECT node FROM points WHERE FALSE"}), {both}, {", ".join(levels)}
    SELECT node, hops FROM h{rounds}"""


def distance_sql(start: str, walls: str, body: str) -> str:
    """Bellman-Ford written out; ``d`` has node, dist."""
    levels = ["d0 AS MATERIALIZED (SELECT node, 0.0::DOUBLE AS dist, TRUE AS origin FROM starts)"]
    for k in range(1, ORACLE_ROUNDS + 1):
        levels.append(
            f"""d{k} AS MATERIALIZED (SELECT node, min(dist) AS dist, bool_or(origin) AS origin FROM (SELECT * FROM d{k - 1} UNION ALL
            SELECT w.dst, p.dist + w.length, FALSE FROM d{k - 1} p JOIN ways w ON w.src = p.node WHERE p.origin OR p.node NOT IN (SELECT node FROM walls)) GROUP BY node)"""
        )
    return f"""WITH RECURSIVE {nv.VIEW_SQL}, starts AS ({start}), walls AS ({walls}),
    ways AS MATERIALIZED (SELECT a AS src, b AS dst, length FROM lines UNION ALL SELECT b, a, length FROM lines), {", ".join(levels)},
    d AS (SELECT node, dist FROM d{ORACLE_ROUNDS}) {body}"""


_SOURCES = "SELECT node FROM points WHERE class = 'Source'"
_NONE = "SELECT node FROM points WHERE FALSE"
#: Tight ways: the parent of a node is the one before it on a shortest way, the nearer and then smaller first.
_PARENTS = """parents AS MATERIALIZED (SELECT w.dst AS node, min_by(w.src, (p.dist, w.src)) AS parent FROM ways w JOIN d p ON p.node = w.src JOIN d c ON c.node = w.dst
WHERE p.dist + w.length = c.dist AND w.dst NOT IN (SELECT node FROM starts) AND (w.src NOT IN (SELECT node FROM walls) OR w.src IN (SELECT node FROM starts)) GROUP BY w.dst)"""

_SUBNETS = f"""WITH RECURSIVE {nv.VIEW_SQL}, {_BOTH}, controllers AS ({_SOURCES}), walls AS ({_CLOSED} UNION {_SOURCES}),
fed AS (SELECT node AS controller, node FROM controllers UNION SELECT controller, dst FROM fed f JOIN both_ways ON src = f.node
  WHERE f.node = controller OR f.node NOT IN (SELECT node FROM walls)) """

_ISOLATION = """WITH RECURSIVE {view}, {both}, starts AS ({start}), shut AS (SELECT node FROM points WHERE closed), valves AS (SELECT node FROM points WHERE class = 'Valve'), sources AS ({sources}),
area AS (SELECT node FROM starts UNION SELECT dst FROM area r JOIN both_ways ON src = r.node WHERE r.node IN (SELECT node FROM starts) OR r.node NOT IN (SELECT node FROM valves UNION SELECT node FROM shut)),
to_close AS (SELECT node FROM area WHERE node IN (SELECT node FROM valves) AND node NOT IN (SELECT node FROM shut) AND node NOT IN (SELECT node FROM starts)),
inside AS (SELECT node FROM area WHERE node NOT IN (SELECT node FROM to_close)),
before AS (SELECT node FROM sources UNION SELECT dst FROM before r JOIN both_ways ON src = r.node WHERE r.node IN (SELECT node FROM sources) OR r.node NOT IN (SELECT node FROM shut)),
later AS (SELECT node FROM sources WHERE node NOT IN (SELECT node FROM inside) UNION SELECT dst FROM later r JOIN both_ways ON src = r.node
  WHERE r.node IN (SELECT node FROM sources) OR r.node NOT IN (SELECT node FROM shut UNION SELECT node FROM to_close)),
lost AS ((SELECT node FROM before EXCEPT SELECT node FROM later UNION SELECT node FROM inside) EXCEPT SELECT node FROM to_close)
{body}"""


def _isolation(start: str, body: str) -> str:
    return _ISOLATION.format(view=nv.VIEW_SQL, both=_BOTH, start=start, sources=_SOURCES, body=body)


QUERIES = {
    "net_nodes": (net_nodes, f"WITH {nv.VIEW_SQL} SELECT node, class, fid, x, y FROM places"),
    "net_edges": (net_edges, f"WITH {nv.VIEW_SQL} SELECT class, fid, a, b, round(length, 3) AS length FROM lines"),
    "adjacency": (adjacency, f"WITH {nv.VIEW_SQL}, {_BOTH} SELECT src AS node, count(*) AS degree, count(DISTINCT dst) AS neighbours FROM both_ways GROUP BY src"),
    "trace_connected": (trace_connected, reach_sql(node_sql("Source", 0), None, _FEATURES)),
    "trace_connected_barriers": (trace_connected_barriers, reach_sql(node_sql("Source", 0), _CLOSED, _FEATURES)),
    "trace_condition_barriers": (trace_condition_barriers, reach_sql(node_sql("Valve", 1), _CONDITION_WALLS, _FEATURES.replace("FROM lines", "FROM kept"), _SMALL, _NOT_OLD)),
    "trace_lifecycle_size": (
        trace_lifecycle_size,
        reach_sql(node_sql("Source", 0), "SELECT node FROM points WHERE lifecycle IN (2, 4)", _FEATURES.replace("FROM lines", "FROM kept"), _SMALL, _KEPT),
    ),
    "trace_output_groups": (
        trace_output_groups,
        reach_sql(node_sql("Source", 2), _CLOSED, _FEATURES.replace("JOIN reach USING (node)", 'JOIN reach USING (node) WHERE ag = 4 OR (ag = 5 AND "at" = 2)').replace("WHERE a IN", "WHERE ag = 4 AND (a IN") + ")"),
    ),
    "trace_downstream_gravity": (trace_downstream_gravity, hops_sql(node_sql("Source", 0), _CLOSED, _FLOW)),
    "trace_upstream_gravity": (trace_upstream_gravity, hops_sql(node_sql("Station", 1), None, _AGAINST)),
    "source_distance": (source_distance, distance_sql(_SOURCES, _CLOSED, "SELECT node, round(dist, 3) AS dist FROM d")),
    "trace_downstream": (
        trace_downstream,
        distance_sql(_SOURCES, _CLOSED, f", {_PARENTS}, below AS ({node_sql('Valve', 1)} UNION SELECT p.node FROM below JOIN parents p ON p.parent = below.node) SELECT node FROM below"),
    ),
    "trace_upstream": (
        trace_upstream,
        distance_sql(_SOURCES, _NONE, f", {_PARENTS}, up AS ({node_sql('Meter', 1)} UNION SELECT p.parent FROM up JOIN parents p USING (node)) SELECT node FROM up"),
    ),
    "shortest_path_length": (shortest_path_length, distance_sql(node_sql("Meter", 1), _NONE, f"SELECT round(min(dist), 3) AS dist FROM d WHERE node IN ({_SOURCES})")),
    "shortest_path": (
        shortest_path,
        distance_sql(
            node_sql("Meter", 1), _NONE,
            f", {_PARENTS}, up AS ((SELECT node FROM d WHERE node IN ({_SOURCES}) ORDER BY dist, node LIMIT 1) UNION SELECT p.parent FROM up JOIN parents p USING (node)) SELECT node, round(dist, 3) AS dist FROM up JOIN d USING (node)",
        ),
    ),
    "isolation_valves": (isolation_valves, _isolation(node_sql("Station", 1), "SELECT node FROM to_close")),
    "isolation_customers": (isolation_customers, _isolation(node_sql("Valve", 1), "SELECT node FROM lost WHERE node IN (SELECT node FROM points WHERE class = 'Meter')")),
    "subnetworks": (subnetworks, _SUBNETS + "SELECT controller, node FROM fed"),
    "subnetwork_stats": (
        subnetwork_stats,
        _SUBNETS + "SELECT c.assetid AS name, count(DISTINCT f.node) AS points, count(DISTINCT CASE WHEN p.class = 'Meter' THEN f.node END) AS customers FROM fed f JOIN points c ON c.node = f.controller JOIN points p ON p.node = f.node GROUP BY 1",
    ),
    "subnetworks_of_start": (subnetworks_of_start, _SUBNETS + f"SELECT DISTINCT node FROM fed WHERE controller IN (SELECT controller FROM fed WHERE node = ({node_sql('Meter', 1)}))"),
    "is_connected": (is_connected, reach_sql(_SOURCES, None, "SELECT class, count(*) AS total, count(r.node) AS connected FROM points p LEFT JOIN reach r ON r.node = p.node GROUP BY class")),
    "islands": (islands, reach_sql(_SOURCES, None, "SELECT class, fid FROM kept WHERE a NOT IN (SELECT node FROM reach)", _SMALL, _HALF)),
    "multi_fed": (
        multi_fed,
        f"""WITH RECURSIVE {nv.VIEW_SQL}, tiers AS (SELECT node AS controller, assetid AS name, CASE WHEN node % 2 = 0 THEN 'Transmission' END AS own FROM points WHERE class = 'Source'),
        ways AS (SELECT a AS src, b AS dst, tier FROM lines UNION ALL SELECT b, a, tier FROM lines), walls AS ({_CLOSED} UNION {_SOURCES}),
        fed AS (SELECT controller, controller AS node, own FROM tiers UNION SELECT controller, dst, own FROM fed f JOIN ways ON src = f.node
          WHERE (f.node = controller OR f.node NOT IN (SELECT node FROM walls)) AND (own IS NULL OR tier IS NULL OR own = tier)),
        spread AS (SELECT * FROM fed WHERE node = controller OR node NOT IN (SELECT node FROM walls)),
        members AS (SELECT 'point' AS kind, class, fid, controller, own FROM points JOIN fed USING (node)
          UNION SELECT 'line', class, fid, controller, own FROM lines JOIN spread ON spread.node IN (a, b) WHERE own IS NULL OR tier IS NULL OR own = tier)
        SELECT kind, class, fid, count(DISTINCT controller) AS feeds FROM members GROUP BY ALL HAVING count(DISTINCT controller) > 1 AND bool_or(coalesce(own = 'Transmission', FALSE))""",
    ),
    "no_controller": (
        no_controller,
        f"""WITH RECURSIVE {nv.VIEW_SQL}, {_HALF} {_SMALL}, walls AS ({_CLOSED} UNION {_SOURCES}), fed AS (SELECT node AS controller, node FROM points WHERE class = 'Source' UNION SELECT controller, dst FROM fed f
        JOIN both_ways ON src = f.node WHERE f.node = controller OR f.node NOT IN (SELECT node FROM walls)), spread AS (SELECT node FROM fed WHERE node = controller OR node NOT IN (SELECT node FROM walls))
        SELECT class, fid FROM kept WHERE tier = 'Distribution' AND a NOT IN (SELECT node FROM spread) AND b NOT IN (SELECT node FROM spread)""",
    ),
    "star_components": (
        star_components,
        f"""WITH RECURSIVE {nv.VIEW_SQL}, few AS (SELECT a, b FROM lines WHERE class IN ('Feeder', 'Service')), both_ways AS (SELECT a AS src, b AS dst FROM few UNION ALL SELECT b, a FROM few),
        pairs AS (SELECT DISTINCT src AS node, src AS root FROM both_ways UNION SELECT dst, root FROM pairs JOIN both_ways ON src = node),
        least AS (SELECT node, min(root) AS component FROM pairs GROUP BY node) SELECT component, count(*) AS nodes FROM least GROUP BY component""",
    ),
    "all_components": (all_components, None),
    "loop_edges": (loop_edges, None),
    "block_sizes": (block_sizes, None),
    "upstream_all": (upstream_all, None),
    "criticality": (criticality, None),
}
