"""Traces over a network: ``points`` and ``edges`` of :class:`Network` in, feature rows out.

A trace result has ``kind`` (point or line), ``class`` and ``fid``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions.conditions import any_condition, excluded_lifecycle, output_groups, too_small
from meshwright.operators import blocks as blk
from meshwright.operators import graph
from meshwright.plans.staging import dealt, staged

SOURCE, ISOLATING, CUSTOMER = "source", "isolating", "customer"
FLOWS = ("source", "gravity", "undirected")


@dataclass(frozen=True)
class Network:
    """``points``: node, class, fid, ag, at, closed, lifecycle, categories, attrs. ``edges``: eid, class, fid, a, b, length, size, lifecycle, tier, reverse."""

    points: DataFrame
    edges: DataFrame

    def having(self, category: str) -> DataFrame:
        return self.points.filter(F.array_contains("categories", category)).select("node")

    def closed(self) -> DataFrame:
        return self.points.filter("closed").select("node")

    def controllers(self, explicit: DataFrame | None = None) -> DataFrame:
        """``node, name, tier``: the listed controllers if there are any, else every source."""
        if explicit is not None and not explicit.isEmpty():
            return explicit.select("node", "name", "tier")
        name = F.coalesce("assetid", F.concat_ws("-", "class", "fid"))
        return self.points.filter(F.array_contains("categories", SOURCE)).select("node", name.alias("name"), F.lit(None).cast("string").alias("tier"))


def start_of(net: Network, starts: DataFrame) -> DataFrame:
    """Nodes of picked features ``class, fid``: a point's node, or both ends of a line's edges."""
    p = net.points.join(starts, ["class", "fid"]).select("node")
    lines = net.edges.join(starts, ["class", "fid"])
    return p.union(lines.select("a")).union(lines.select("b")).distinct()


def features(net: Network, nodes: DataFrame | None, edges: DataFrame | None) -> DataFrame:
    """``kind, class, fid`` of nodes and edges; edges of associations have no feature."""
    out = None
    if nodes is not None:
        out = net.points.join(nodes.select("node").distinct(), "node", "left_semi").select(F.lit("point").alias("kind"), "class", "fid")
    if edges is not None:
        of_lines = edges.filter("class is not null").select(F.lit("line").alias("kind"), "class", "fid").distinct()
        out = of_lines if out is None else out.unionByName(of_lines)
    return out


def restrict(
    net: Network, lifecycle: Sequence[int] = (), min_size: float | None = None, conditions: Sequence[tuple[str, str, object]] = (), closed: bool = True
) -> tuple[Network, DataFrame]:
    """The network without blocked lines, and the nodes at which a trace stops."""
    gone = excluded_lifecycle(F.col("lifecycle"), lifecycle) | too_small(F.col("lifecycle"), F.col("size"), lifecycle, min_size)
    if conditions and "attrs" in net.edges.columns:
        gone = gone | any_condition(F.col("attrs"), conditions)
    wall: Column = excluded_lifecycle(F.col("lifecycle"), lifecycle) | any_condition(F.col("attrs"), conditions)
    if closed:
        wall = wall | F.col("closed")
    return Network(net.points, net.edges.filter(~gone)), net.points.filter(wall).select("node")


def connected(net: Network, starts: DataFrame, walls: DataFrame | None = None, groups: Sequence[tuple[int, int | None]] | None = None) -> DataFrame:
    """Everything connected to ``starts`` (``node``); walls are visited and not gone beyond."""
    got = staged(graph.reach(graph.both_ways(net.edges), starts, walls), "connected")
    points, edges = net.points, net.edges
    if groups is not None:
        # A feature's group is its own, so what isn't asked for takes no part in the joins.
        points, edges = points.filter(output_groups(F.col("ag"), F.col("at"), groups)), edges.filter(output_groups(F.col("ag"), F.lit(None), groups))
    crossed = graph.crossed_edges(edges.select("class", "fid", "a", "b"), got, walls, starts)
    return features(Network(points, edges), got, crossed)


def along_flow(net: Network, starts: DataFrame, upstream: bool = False, walls: DataFrame | None = None) -> DataFrame:
    """Downstream or upstream where lines have a direction of their own: ``node, hops``."""
    way = graph.directed(net.edges, F.col("reverse"))
    if upstream:
        way = way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(way, starts, walls)


def _named(named: bool) -> list[Column]:
    return [F.concat_ws(":", "class", "fid").alias("line")] if named else []


def source_tree(net: Network, walls: DataFrame | None = None, named: bool = True) -> DataFrame:
    """``node, dist, parent, via``: shortest ways from the nearest source; ``via`` only if ``named``."""
    return graph.distances(graph.both_ways(net.edges, *_named(named), F.col("length").alias("weight")), net.having(SOURCE), walls)


def source_lengths(net: Network, walls: DataFrame | None = None) -> DataFrame:
    """``node, dist`` of :func:`source_tree`."""
    return graph.lengths(graph.both_ways(net.edges, F.col("length").alias("weight")), net.having(SOURCE), walls)


def downstream_of_source(net: Network, starts: DataFrame, walls: DataFrame | None = None) -> DataFrame:
    """What is fed over the start: its subtree in the tree of shortest ways."""
    return graph.subtree(source_tree(net, walls, named=False), starts)


def upstream_of_source(net: Network, starts: DataFrame, walls: DataFrame | None = None) -> DataFrame:
    """The way from the start back to its source."""
    tree = source_tree(net, walls, named=False)
    return graph.chain(tree, starts.join(tree, "node", "left_semi"))


def shortest_path(net: Network, starts: DataFrame, targets: DataFrame, walls: DataFrame | None = None, oneway: bool = False) -> DataFrame:
    """``node, dist`` along the shortest way to the nearest target; no rows if there is none. Ties go to the smaller node."""
    weight = F.col("length").alias("weight")
    ways = graph.directed(net.edges, F.col("reverse"), weight) if oneway else graph.both_ways(net.edges, weight)
    tree = staged(graph.distances(ways, starts, walls, targets), "ways")
    goal = tree.join(targets, "node", "left_semi").orderBy("dist", "node").limit(1)
    return graph.chain(tree, goal).join(tree, "node").select("node", "dist")


def loops(net: Network, starts: DataFrame | None = None, walls: DataFrame | None = None) -> DataFrame:
    """``eid`` of edges that lie on a loop, in what is connected to the starts or everywhere."""
    edges = net.edges.select("eid", "class", "fid", "a", "b")
    if starts is not None:
        edges = staged(graph.crossed_edges(edges, graph.reach(graph.both_ways(edges), starts, walls), walls, starts), "area")
    return edges.join(blk.bridges(edges), "eid", "left_anti").select("eid")


def upstream_all(net: Network, starts: DataFrame, walls: DataFrame | None = None) -> DataFrame:
    """``eid`` of all edges on any simple way between a start and a source.

    Such an edge lies in a block on the way through the tree of blocks and cut nodes; those are the
    blocks that an edge between a virtual node on the start side and one on the source side would join.
    """
    edges = net.edges.select("eid", "a", "b").filter("a <> b")
    if walls is not None:
        shut = walls.select("node").distinct()
        edges = edges.join(shut.withColumnRenamed("node", "a"), "a", "left_anti").join(shut.withColumnRenamed("node", "b"), "b", "left_anti").select("eid", "a", "b")
    reached = graph.reach(graph.both_ways(edges), starts)
    sources = staged(net.having(SOURCE).join(reached, "node", "left_semi"), "sources")

    def tied(nodes: DataFrame, virtual: int) -> DataFrame:
        return nodes.select((-2 * F.col("node") - 2 + virtual).alias("eid"), F.lit(virtual).cast("long").alias("a"), F.col("node").alias("b"))

    closing = edges.sparkSession.createDataFrame([(-1, -1, -2)], "eid long, a long, b long")
    whole = staged(edges.unionByName(tied(starts.join(reached, "node", "left_semi"), -1)).unionByName(tied(sources, -2)).unionByName(closing), "closed")
    named = staged(blk.blocks(whole), "blocks")
    wanted = named.filter("eid = -1").select("block")
    return named.join(F.broadcast(wanted), "block", "left_semi").filter("eid >= 0").select("eid")  # one row on the right


def isolation(net: Network, starts: DataFrame) -> dict[str, DataFrame]:
    """What to close around the starts and who loses supply.

    ``area``: nodes reached before an open isolating device stops the search; ``to_close``: those
    devices, the picked ones left out; ``lost``: fed nodes that are not fed once they are closed, and the area.
    """
    around = graph.both_ways(net.edges)
    shut = net.closed()
    stops = staged(net.having(ISOLATING).union(shut).distinct(), "stops")
    area = staged(graph.reach(around, starts, stops), "area")
    touched = area.join(net.having(ISOLATING), "node", "left_semi").join(shut, "node", "left_anti")
    to_close = staged(touched.join(starts.select("node"), "node", "left_anti").select("node"), "to-close")
    sources = net.having(SOURCE)
    before = staged(graph.reach(around, sources, shut).select("node"), "fed")
    after = graph.reach(around, sources.join(area.join(to_close, "node", "left_anti"), "node", "left_anti"), shut.union(to_close)).select("node")
    inside = area.select("node").join(to_close, "node", "left_anti")
    lost = before.exceptAll(after.distinct()).union(inside).distinct()
    lost = lost.join(to_close, "node", "left_anti")
    return {"area": area.select("node"), "to_close": to_close, "lost": lost, "customers": lost.join(net.having(CUSTOMER), "node", "left_semi")}


def subnetworks(net: Network, controllers: DataFrame) -> DataFrame:
    """``controller, node, hops``: what each controller feeds, stopping at closed devices and other controllers.

    All controllers advance at once, those at one node together. A line is gone along if its tier or the controller's is null or they are equal.
    """
    edges = dealt(graph.both_ways(net.edges, "tier"), "src", "tiers")
    walls = net.closed().union(controllers.select("node")).distinct().withColumnRenamed("node", "wall")
    tiers = controllers.select(F.col("node").alias("controller"), F.col("tier").alias("own_tier"))
    seen = front = staged(controllers.select(F.col("node").alias("controller"), "node", F.lit(0).alias("hops")).distinct(), "fed")
    hops = 0
    while not front.isEmpty():
        hops += 1
        if hops > 1:
            front = front.join(walls, front["node"] == walls["wall"], "left_anti")
        # A line is met once by all who stand at its end, and not once by each.
        standing = front.groupBy("node").agg(F.sort_array(F.collect_set("controller")).alias("standing"))
        step = standing.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "tier", "standing").distinct()
        step = step.select("node", "tier", F.explode("standing").alias("controller")).join(tiers, "controller")
        step = step.filter("own_tier is null or tier is null or own_tier = tier").select("controller", "node").distinct()
        front = staged(step.join(seen.select("controller", "node"), ["controller", "node"], "left_anti").withColumn("hops", F.lit(hops)), "fed")
        seen = seen.unionByName(front)
        if hops % 8 == 0:
            seen = staged(seen, "fed")
    return seen


def subnetwork_stats(net: Network, controllers: DataFrame) -> DataFrame:
    """``name, tier, points, customers``; controllers of one name count together, with the first one's tier."""
    members = subnetworks(net, controllers).join(controllers.select(F.col("node").alias("controller"), "name", "tier"), "controller")
    flagged = members.join(net.having(CUSTOMER).withColumn("customer", F.lit(1)), "node", "left")
    return flagged.groupBy("name").agg(
        F.min_by("tier", "controller").alias("tier"), F.countDistinct("node").alias("points"), F.countDistinct(F.when(F.col("customer") == 1, F.col("node"))).alias("customers")
    )


def criticality(net: Network) -> DataFrame:
    """``class, fid, segment, customers``: customers without supply while the valve segment of a line is shut.

    Segments are the parts of the network between isolating or closed devices. Each is a node of a
    smaller graph whose edges are the open isolating devices; what a segment's loss cuts off from the
    sources follows from the blocks of that graph.
    """
    stops = staged(net.having(ISOLATING).union(net.closed()).distinct(), "stops")
    inner = net.points.select("node").join(stops, "node", "left_anti")
    core = net.edges.select("eid", "class", "fid", "a", "b")
    s = stops.withColumnRenamed("node", "stop")
    # A line between two stops is a segment of its own; it has no inner node.
    flags = core.join(s.withColumnRenamed("stop", "a").withColumn("stop_a", F.lit(True)), "a", "left").join(s.withColumnRenamed("stop", "b").withColumn("stop_b", F.lit(True)), "b", "left")
    flags = staged(flags.select("eid", "class", "fid", "a", "b", F.coalesce("stop_a", F.lit(False)).alias("stop_a"), F.coalesce("stop_b", F.lit(False)).alias("stop_b")), "flags")
    inside = flags.filter("not stop_a and not stop_b")
    segment = staged(graph.components(inner, inside).withColumnRenamed("component", "segment"), "segments")
    own = -2 - F.col("eid")
    at = flags.select("eid", "class", "fid", F.when(~F.col("stop_a"), F.col("a")).when(~F.col("stop_b"), F.col("b")).alias("inner"), own.alias("own"))
    of_line = staged(at.join(segment, at["inner"] == segment["node"], "left").select("eid", "class", "fid", F.coalesce("segment", "own").alias("segment")), "of-line")
    # Segments that meet at an open isolating device: device - segment edges keep the device as a node, never all pairs of its segments.
    valves = stops.join(net.closed(), "node", "left_anti")
    ends = flags.join(of_line.select("eid", "segment"), "eid")
    meets = ends.filter("stop_a").select(F.col("a").alias("valve"), "segment").union(ends.filter("stop_b").select(F.col("b").alias("valve"), "segment")).distinct()
    meets = meets.join(valves.withColumnRenamed("node", "valve"), "valve", "left_semi")
    joints = meets.select((-(F.lit(1 << 61)) - F.col("valve")).alias("a"), F.col("segment").alias("b"))
    edges = joints.withColumn("eid", F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 60) - 1)))
    weights = segment.join(net.having(CUSTOMER), "node", "left_semi").groupBy("segment").agg(F.count(F.lit(1)).alias("weight")).withColumnRenamed("segment", "node")
    roots = segment.join(net.having(SOURCE), "node", "left_semi").select(F.col("segment").alias("node")).distinct()
    lost = blk.lost_below(staged(edges.select("eid", "a", "b"), "segment-graph"), roots, weights)
    return of_line.join(lost, of_line["segment"] == lost["node"], "left").select("class", "fid", "segment", F.coalesce("lost", F.lit(0)).cast("long").alias("customers"))
