"""Traces from picked features: points, whole lines, or single parts of a line.

A picked point spreads even if it is blocked; the ends of a picked edge are visited, but a blocked one is not gone
beyond (a closed valve at the end of a broken pipe must hold).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.conditions import output_groups
from meshwright.operators import blocks as blk
from meshwright.operators import graph, traces
from meshwright.operators.traces import CUSTOMER, ISOLATING, SOURCE, Network
from meshwright.plans.staging import staged

SOURCE_FLOW, GRAVITY_FLOW, UNDIRECTED_FLOW = traces.FLOWS
c = F.col


@dataclass(frozen=True)
class Picks:
    """``nodes`` (``node``) and ``edges`` (``eid``)."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Found:
    """``nodes`` (``node``), ``edges`` (``eid``) and the features on them (``kind, class, fid``); ``extra`` by the kind of trace."""

    nodes: DataFrame
    edges: DataFrame
    features: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def locate(net: Network, keys: DataFrame) -> Picks:
    """Picked features ``class, fid``: a point's node, and all edges of a line."""
    nodes = net.points.join(keys, ["class", "fid"], "left_semi").select("node").distinct()
    return Picks(nodes, net.edges.join(keys, ["class", "fid"], "left_semi").select("eid"))


def at_nodes(net: Network, nodes: DataFrame) -> Picks:
    return Picks(nodes.select("node"), net.edges.select("eid").limit(0))


def ends_of(net: Network, eids: DataFrame) -> DataFrame:
    edges = net.edges.join(eids, "eid", "left_semi")
    return edges.select(c("a").alias("node")).union(edges.select("b")).distinct()


def all_nodes(net: Network, picks: Picks) -> DataFrame:
    return picks.nodes.select("node").union(ends_of(net, picks.edges)).distinct()


def _found(net: Network, nodes: DataFrame, eids: DataFrame, **extra: DataFrame) -> Found:
    eids = eids.select("eid").distinct()
    of = net.edges.join(eids, "eid", "left_semi")
    return Found(nodes, eids, traces.features(net, nodes, of), extra)


def _spread(net: Network, open_edges: DataFrame, picks: Picks, walls: DataFrame, levels: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges reached both ways over ``open_edges``."""
    nodes = staged(graph.spread(open_edges, picks.nodes, walls, ends_of(net, picks.edges), levels), "spread")
    crossed = graph.crossed_edges(open_edges.select("eid", "a", "b"), nodes, walls, picks.nodes)
    return nodes, staged(crossed.select("eid").union(picks.edges.select("eid")).distinct(), "spread-edges")


def one_way(edges: DataFrame, flow: str, *kept: str) -> DataFrame:
    """``src, dst`` of every direction that may be gone: along a gravity line's flow, along a one-way street, else both."""
    oneway = F.coalesce("oneway", F.lit(0)) if "oneway" in edges.columns else F.lit(0)
    feature = c("class").isNotNull()
    back = F.coalesce("reverse", F.lit(False)) if "reverse" in edges.columns else F.lit(False)
    if flow == GRAVITY_FLOW:
        forth, home = ~(feature & back), ~feature | back
    elif flow == UNDIRECTED_FLOW:
        forth, home = ~(feature & (oneway == 2)), ~(feature & (oneway == 1))
    else:
        forth = home = F.lit(True)
    along = edges.filter(forth).select(c("a").alias("src"), c("b").alias("dst"), *kept)
    return along.unionByName(edges.filter(home).select(c("b").alias("src"), c("a").alias("dst"), *kept))


def connected(net: Network, open_edges: DataFrame, picks: Picks, walls: DataFrame, levels: int = 0) -> Found:
    return _found(net, *_spread(net, open_edges, picks, walls, levels))


def by_gravity(net: Network, open_edges: DataFrame, picks: Picks, walls: DataFrame, down: bool) -> Found:
    """Along the lines' own directions; a picked edge begins at its lower (or upper) end."""
    way = one_way(open_edges, GRAVITY_FLOW, "eid")
    # An edge without direction, picked, begins at its second end downstream, at its first upstream.
    flipped = c("class").isNotNull() & F.coalesce("reverse", F.lit(False))
    lower, upper = F.when(flipped, c("a")).otherwise(c("b")), F.when(flipped, c("b")).otherwise(c("a"))
    ends = net.edges.join(picks.edges, "eid", "left_semi").select((lower if down else upper).alias("node"))
    if not down:
        way = way.select(c("dst").alias("src"), c("src").alias("dst"), "eid")
    way = staged(way, "gravity")
    nodes = staged(graph.reach(way, picks.nodes, walls, ends=ends).select("node"), "flowed")
    left = nodes.join(walls, "node", "left_anti").union(picks.nodes.select("node")).distinct()
    crossed = way.join(left, way["src"] == left["node"], "left_semi").select("eid")
    return _found(net, nodes, crossed.union(picks.edges.select("eid")))


def by_source(net: Network, open_edges: DataFrame, picks: Picks, walls: DataFrame, down: bool, sources: DataFrame | None = None) -> Found:
    """Below the picks in the tree of shortest ways from the sources, or from the picks up to their source.

    A picked edge begins at the end that is nearer to its source upstream, at the farther one downstream.
    """
    ways = graph.both_ways(open_edges, c("eid").cast("string").alias("line"), c("length").alias("weight"))
    tree = staged(graph.distances(ways, net.having(SOURCE) if sources is None else sources, walls), "tree")
    picked = net.edges.join(picks.edges, "eid", "left_semi").select("a", "b")
    at = lambda end: tree.select(c("node").alias(end), c("dist").alias(f"dist_{end}"))
    far = F.lit(float("inf"))
    da, db = F.coalesce("dist_a", far), F.coalesce("dist_b", far)
    root = F.when(da > db if down else da <= db, c("a")).otherwise(c("b"))
    roots = picked.join(at("a"), "a", "left").join(at("b"), "b", "left").select(root.alias("node"))
    roots = staged(picks.nodes.select("node").union(roots).distinct().join(tree, "node", "left_semi"), "roots")
    nodes = staged(graph.subtree(tree, roots) if down else graph.chain(tree, roots), "along-tree")
    inside = tree.join(nodes, "node", "left_semi").filter("via is not null")
    if down:
        inside = inside.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi")
    return _found(net, nodes, inside.select(c("via").cast("long").alias("eid")).union(picks.edges.select("eid")), roots=roots)


def all_paths(net: Network, open_edges: DataFrame, picks: Picks, walls: DataFrame) -> Found:
    """Everything on any simple way between the picks and a source."""
    starts = staged(all_nodes(net, picks), "starts")
    eids = traces.upstream_all(Network(net.points, open_edges), starts, walls.join(starts, "node", "left_anti"))
    eids = staged(eids.union(picks.edges.select("eid")).distinct(), "all-paths")
    return _found(net, ends_of(net, eids).union(starts).distinct(), eids)


def isolation(net: Network, open_edges: DataFrame, picks: Picks, walls: DataFrame) -> Found:
    """What loses supply when the picks are cut off; ``to_close`` and ``customers`` are features ``class, fid``."""
    valves = net.points.filter(F.array_contains("categories", ISOLATING))
    live = staged(valves.filter(~F.coalesce("closed", F.lit(False))).select("node").distinct(), "live")
    area_nodes, area_edges = _spread(net, open_edges, picks, walls.union(live).distinct())
    closing = staged(area_nodes.join(live, "node", "left_semi").join(picks.nodes, "node", "left_anti"), "closing")
    sources, none = net.having(SOURCE).distinct(), picks.edges.limit(0)
    before = _spread(net, open_edges, Picks(sources, none), walls)
    fed = sources.join(closing, "node", "left_anti").join(area_nodes, "node", "left_anti")
    after = _spread(net, open_edges.join(area_edges, "eid", "left_anti"), Picks(fed, none), walls.union(closing).distinct())
    lost = staged(before[0].join(after[0], "node", "left_anti").union(area_nodes.join(closing, "node", "left_anti")).distinct(), "lost")
    lost_edges = before[1].join(after[1], "eid", "left_anti").union(area_edges)
    to_close = valves.join(closing, "node", "left_semi").select("class", "fid")
    customers = net.points.filter(F.array_contains("categories", CUSTOMER)).join(lost, "node", "left_semi").select("class", "fid")
    found = _found(net, lost.join(closing, "node", "left_anti"), lost_edges)
    shown = found.features.union(to_close.select(F.lit("point").alias("kind"), "class", "fid")).distinct()
    return Found(found.nodes, found.edges, shown, {"to_close": to_close, "customers": customers})


def shortest_path(net: Network, open_edges: DataFrame, picks: Picks, walls: DataFrame, targets: Picks, flow: str) -> Found:
    """The shortest way to the nearest target, over one-way streets where the flow is undirected; ``length`` is its length, no row if there is none."""
    way = one_way(open_edges, flow if flow == UNDIRECTED_FLOW else SOURCE_FLOW, c("eid").cast("string").alias("line"), c("length").alias("weight"))
    ends = staged(all_nodes(net, targets), "targets")
    tree = staged(graph.distances(way, all_nodes(net, picks), walls, ends), "ways")
    goal = staged(tree.join(ends, "node", "left_semi").orderBy("dist", "node").limit(1), "goal")
    nodes = staged(graph.chain(tree, goal), "way")
    there = goal.select("dist")
    eids = tree.join(nodes, "node", "left_semi").filter("via is not null").select(c("via").cast("long").alias("eid"))
    picked = picks.edges.select("eid").union(targets.edges.select("eid"))
    return _found(net, nodes, eids.union(picked.join(there.limit(1), how="left_semi")), length=there)


def loops(net: Network, open_edges: DataFrame, picks: Picks | None, walls: DataFrame) -> Found:
    """Lines that lie on loops, in what is connected to the picks or everywhere."""
    edges = open_edges
    if picks is not None:
        edges = net.edges.join(_spread(net, open_edges, picks, walls)[1], "eid", "left_semi")
    edges = staged(edges.select("eid", "a", "b"), "area")
    eids = staged(edges.join(blk.bridges(edges), "eid", "left_anti").select("eid"), "loops")
    nodes = ends_of(net, eids)
    return Found(nodes, eids, traces.features(net, None, net.edges.join(eids, "eid", "left_semi")), {"loop_nodes": nodes})


def trace(
    net: Network, kind: str, picks: Picks | None, flow: str = SOURCE_FLOW, barriers: Picks | None = None, targets: Picks | None = None, use_status: bool = True,
    lifecycle: Sequence[int] = (), min_size: float | None = None, conditions: Sequence[tuple[str, str, object]] = (), groups: Sequence[tuple[str, int]] | None = None,
    levels: int = 0,
) -> Found:
    """A trace of one ``kind``: connected, downstream, upstream, upstream_all, isolation, shortest_path or loops.

    Barriers, closed devices, stages, sizes and conditions restrict it as in :func:`traces.restrict`; ``groups`` (class and group) keeps only their
    features. A kind that the flow hasn't got (a direction or isolation without flow) raises an error, as do a trace without a pick and a path
    without a target. A connected trace tries ``levels`` rounds from neighbour to neighbour first, for networks where all lies near (:func:`graph.spread`).
    """
    if flow not in traces.FLOWS:
        raise ValueError(f"no such flow: {flow}")
    if picks is None and kind != "loops":
        raise ValueError("add at least one starting point")
    if flow == UNDIRECTED_FLOW and kind in ("downstream", "upstream", "isolation"):
        raise ValueError(f"a network without flow has no {kind} trace")
    kept, walls = traces.restrict(net, lifecycle, min_size, conditions, closed=use_status)
    open_edges = kept.edges
    # Edges that stand for no feature are never filtered.
    if lifecycle or min_size is not None or conditions:
        open_edges = open_edges.unionByName(net.edges.filter("class is null").join(open_edges.select("eid"), "eid", "left_anti"))
    if barriers is not None:
        walls = walls.union(barriers.nodes.select("node"))
        open_edges = open_edges.join(barriers.edges, "eid", "left_anti")
    # Edges that nothing was taken from are read where they lie.
    restricted = lifecycle or min_size is not None or conditions or barriers is not None
    walls, open_edges = staged(walls.distinct(), "walls"), staged(open_edges, "open-edges") if restricted else net.edges
    if kind == "connected":
        found = connected(net, open_edges, picks, walls, levels)
    elif kind in ("downstream", "upstream") or (kind == "upstream_all" and flow != SOURCE_FLOW):
        found = (by_gravity if flow == GRAVITY_FLOW else by_source)(net, open_edges, picks, walls, kind == "downstream")
    elif kind == "upstream_all":
        found = all_paths(net, open_edges, picks, walls)
    elif kind == "isolation":
        found = isolation(net, open_edges, picks, walls)
    elif kind == "shortest_path":
        if targets is None:
            raise ValueError("a shortest path needs a start and an end")
        found = shortest_path(net, open_edges, picks, walls, targets, flow)
    elif kind == "loops":
        found = loops(net, open_edges, picks, walls)
    else:
        raise ValueError(f"no such trace: {kind}")
    if groups is None:
        return found
    of = {}
    for name, ag in groups:
        of.setdefault(name, []).append((ag, None))
    wanted = lambda df: df.filter(F.coalesce(F.array_max(F.array(F.lit(False), *[(c("class") == k) & output_groups(c("ag"), F.lit(None), v) for k, v in of.items()])), F.lit(False)))
    keys = wanted(net.points).select("class", "fid").union(wanted(net.edges).select("class", "fid")).distinct()
    return Found(found.nodes, found.edges, found.features.join(keys, ["class", "fid"], "left_semi").select("kind", "class", "fid"), found.extra)
