"""Graph loops on edge tables.

``adjacency`` frames have ``src, dst`` (and ``line`` and ``weight`` where named). Every loop joins a
frontier to the edges, keeps what it has seen as a staged table and stops when a round finds
nothing new; only the question "is there anything new" comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.plans.staging import any_rows, dealt, staged


def both_ways(edges: DataFrame, *kept: str) -> DataFrame:
    """``src, dst`` and the kept columns, for either direction of every edge ``a, b``."""
    out = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), *kept)
    return out.unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), *kept))


def directed(edges: DataFrame, reverse: Column, *kept: str) -> DataFrame:
    """``src, dst`` along the flow; ``reverse`` flips an edge, and association edges (no class) go both ways."""
    src = F.when(reverse, F.col("b")).otherwise(F.col("a"))
    dst = F.when(reverse, F.col("a")).otherwise(F.col("b"))
    out = edges.select(src.alias("src"), dst.alias("dst"), *kept)
    if "class" in edges.columns:
        out = out.unionByName(edges.filter(F.col("class").isNull()).select(dst.alias("src"), src.alias("dst"), *kept))
    return out


def reach(adjacency: DataFrame, starts: DataFrame, blocked: DataFrame | None = None, keys: tuple[str, ...] = (), ends: DataFrame | None = None) -> DataFrame:
    """``node, hops`` (and ``keys``) of all nodes reached from ``starts`` (``node`` and ``keys``).

    Nodes in ``blocked`` are visited and not gone beyond, but a start goes on even if it is blocked. ``ends`` (of picked
    edges) are visited from the beginning too, and go on only if they aren't blocked.
    With ``keys`` many searches run at once, each with its own visited nodes. Nulls among starts
    are dropped; repeated starts count once.
    """
    return _walk(adjacency, starts, blocked, keys, ends)[0]


def _walk(
    adjacency: DataFrame, starts: DataFrame, blocked: DataFrame | None = None, keys: tuple[str, ...] = (), ends: DataFrame | None = None, most: int | None = None
) -> tuple[DataFrame, bool]:
    """What :func:`reach` finds in ``most`` rounds, or in all of them, and whether that is all."""
    by = [*keys, "node"]
    walls = blocked.select(F.col("node").alias("wall")).distinct() if blocked is not None else None
    # Parallel edges stay: a round drops what it finds twice, which is less than a shuffle of all edges.
    # They are moved once, into buckets; rounds move what they find.
    edges = dealt(adjacency.select("src", "dst"), "src", "adjacency")
    seen = front = staged(starts.select(*by).dropna().distinct().withColumn("hops", F.lit(0)), "reach")
    if ends is not None:
        both = ends.select(*by).dropna().distinct()
        seen = staged(seen.select(*by).union(both).distinct().withColumn("hops", F.lit(0)), "reach")
        free = both.join(walls, both["node"] == walls["wall"], "left_anti") if walls is not None else both
        front = staged(front.select(*by).union(free).distinct().withColumn("hops", F.lit(0)), "front")
    hops = 0
    while any_rows(front):
        if hops == most:
            return seen, False
        hops += 1
        if walls is not None and hops > 1:
            front = front.join(walls, front["node"] == walls["wall"], "left_anti")
        found = front.join(edges, front["node"] == edges["src"]).select(*keys, F.col("dst").alias("node")).distinct()
        front = staged(found.join(seen.select(*by), by, "left_anti").withColumn("hops", F.lit(hops)), "front")
        seen = seen.unionByName(front)
        if hops % 8 == 0:
            seen = staged(seen, "reach")
    return seen, True


def spread(edges: DataFrame, starts: DataFrame, blocked: DataFrame, ends: DataFrame | None = None, levels: int = 0) -> DataFrame:
    """``node``: what :func:`reach` finds both ways over ``edges`` (``a, b``), in rounds that grow with the logarithm of the distance.

    Nodes that aren't blocked fall into components without the blocked ones; the components of the starts are reached, and so are the
    blocked nodes beside them. For long networks; where everything lies within some hops, :func:`reach` reads less. So ``levels`` rounds of
    that are tried first, and if they find all, components aren't asked for.
    """
    if levels:
        whole = edges.filter("a is not null and b is not null")
        got, done = _walk(both_ways(whole), starts, blocked, ends=ends, most=levels)
        if done:
            return got.select("node").distinct()
    walls = blocked.select("node").dropna().distinct()
    at = lambda end: walls.select(F.col("node").alias(end), F.lit(True).alias(f"wall_{end}"))
    flagged = edges.select("a", "b").filter("a <> b").distinct().join(at("a"), "a", "left").join(at("b"), "b", "left")
    flagged = staged(flagged.select("a", "b", F.coalesce("wall_a", F.lit(False)).alias("wall_a"), F.coalesce("wall_b", F.lit(False)).alias("wall_b")), "flagged")
    free = flagged.filter("not wall_a and not wall_b").select("a", "b")
    parts = components(free.select(F.col("a").alias("node")).union(free.select("b")), free)
    first = starts.select("node").dropna().distinct()
    # A blocked start reaches its neighbours, whatever they are.
    open_starts = first.join(walls, "node", "left_semi")
    beside = flagged.join(open_starts.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node"))
    beside = beside.union(flagged.join(open_starts.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")))
    seeds = first.union(beside) if ends is None else first.union(beside).union(ends.select("node").dropna())
    seeds = staged(seeds.distinct(), "seeds")
    inside = parts.join(parts.join(seeds, "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")
    inside = staged(inside.union(seeds.join(walls, "node", "left_anti")).distinct(), "inside")
    touched = flagged.filter("wall_b and not wall_a").join(inside.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node"))
    touched = touched.union(flagged.filter("wall_a and not wall_b").join(inside.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node")))
    return inside.union(touched).union(seeds).distinct()


def crossed_edges(edges: DataFrame, reached: DataFrame, blocked: DataFrame | None, starts: DataFrame) -> DataFrame:
    """The edges a search both ways went along: those with an end that was reached and gone beyond."""
    if blocked is None:
        # Nothing stopped the search, so an edge has both its ends reached or none.
        ends = reached.select(F.col("node").alias("_end")).distinct()
        return edges.join(ends, F.coalesce("a", "b") == F.col("_end"), "left_semi")
    # All edges ask for one end only: where that was gone beyond, so was the edge; where it wasn't reached, the other end was no way in.
    # Where it stopped the search, the other end is asked.
    first = starts.select("node").dropna().distinct()
    stops = reached.select("node").distinct().join(blocked.select("node").dropna().distinct(), "node", "left_semi").join(first, "node", "left_anti")
    # A start among the ends has been reached, whoever asks.
    states = reached.select("node").union(first).dropna().distinct().join(stops.withColumn("_stop", F.lit(True)), "node", "left")
    states = states.select(F.col("node").alias("_end"), F.coalesce("_stop", F.lit(False)).alias("_stop"))
    asked = staged(edges.join(states, F.coalesce("a", "b") == F.col("_end")).select(*edges.columns, "_stop"), "crossed")
    through = states.filter("not _stop").select("_end")
    other = asked.filter("_stop").join(through, F.col("b") == F.col("_end"), "left_semi")
    return asked.filter("not _stop").unionByName(other).select(*edges.columns)


def _led(chosen: DataFrame) -> DataFrame:
    """``part, top`` for ``part, other``, each part's choice: of two that chose each other the lesser is a top, and chains of choices end there."""
    back = chosen.select(F.col("part").alias("other"), F.col("other").alias("back"))
    leads = (F.col("back") == F.col("part")) & (F.col("part") < F.col("other"))
    now = staged(chosen.join(back, "other").select("part", F.when(leads, F.col("part")).otherwise(F.col("other")).alias("top")), "led")
    while True:
        beyond = now.select(F.col("part").alias("top"), F.col("top").alias("beyond"))
        further = staged(now.join(beyond, "top").select("part", F.col("beyond").alias("top"), (F.col("beyond") != F.col("top")).alias("moved")), "led")
        now = further.select("part", "top")
        if not any_rows(further.filter("moved")):
            return now


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the least node that is reachable from each node over ``a, b``.

    In every round each part of the graph joins its least neighbour, so that at least half of the parts that have one go, and
    only edges between different parts stay, each pair once. Ends of edges that are no nodes are ignored.
    """
    now = staged(nodes.select("node").dropna().distinct().withColumn("component", F.col("node")), "labels")
    left = staged(edges.select("a", "b").filter("a <> b"), "left")

    def choices(pairs: DataFrame) -> DataFrame:
        return staged(both_ways(pairs).groupBy(F.col("src").alias("part")).agg(F.min("dst").alias("other")), "choices")

    chosen = choices(left)
    if any_rows(chosen.join(now, chosen["part"] == now["node"], "left_anti")):
        for end in ("a", "b"):
            left = left.join(now.select(F.col("node").alias(end)), end, "left_semi").select("a", "b")
        left = staged(left, "left")
        chosen = choices(left)
    while any_rows(chosen):
        tops = _led(chosen)
        now = staged(now.join(tops, now["component"] == tops["part"], "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
        moved = left.join(tops.toDF("a", "top_a"), "a").join(tops.toDF("b", "top_b"), "b").filter("top_a <> top_b")
        left = staged(moved.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), "left")
        chosen = choices(left)
    least = now.groupBy("component").agg(F.min("node").alias("least"))
    return staged(now.join(least, "component").select("node", F.col("least").alias("component")), "labels")


def _dealt_ways(adjacency: DataFrame, *kept: str) -> DataFrame:
    return dealt(adjacency.select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"), *kept), "src", "weighted")


def _settled(edges: DataFrame, starts: DataFrame, walls: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    """``node, dist, round``: distances over ``src, dst, weight`` and the round in which each was found."""
    best = front = staged(starts.select("node").dropna().distinct().select("node", F.lit(0.0).alias("dist"), F.lit(0).alias("round")), "dist")
    goals = staged(targets.select("node").distinct(), "goals") if targets is not None else None
    rounds = 0
    while any_rows(front):
        rounds += 1
        if walls is not None and rounds > 1:
            front = front.join(walls, front["node"] == walls["wall"], "left_anti")
        # Numbers alone are added up in a hash table; who offered is asked once, at the end.
        offers = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("dist"))
        merged = (
            best.withColumn("old", F.lit(True))
            .unionByName(offers.withColumns({"round": F.lit(rounds), "old": F.lit(False)}))
            .groupBy("node")
            .agg(F.min("dist").alias("dist"), F.min(F.when(F.col("old"), F.col("dist"))).alias("before"), F.min(F.when(F.col("old"), F.col("round"))).alias("at"))
        )
        moved = F.col("before").isNull() | (F.col("dist") < F.col("before"))
        merged = staged(merged.select("node", "dist", F.when(moved, F.lit(rounds)).otherwise(F.col("at")).alias("round")), "dist")
        best = merged
        front = merged.filter(F.col("round") == rounds)
        if targets is not None:
            nearest = best.join(goals, "node", "left_semi").agg(F.min("dist")).first()[0]
            front = front if nearest is None else front.filter(F.col("dist") < nearest)
    return best


def _walls(blocked: DataFrame | None) -> DataFrame | None:
    return blocked.select(F.col("node").alias("wall")).distinct() if blocked is not None else None


def lengths(adjacency: DataFrame, starts: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """``node, dist`` of :func:`distances` alone, which takes no pass over the edges for the ways."""
    return _settled(_dealt_ways(adjacency), starts, _walls(blocked), None).select("node", "dist")


def distances(adjacency: DataFrame, starts: DataFrame, blocked: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``node, dist, parent, via``: the shortest way by ``weight`` from the nearest start.

    With ``targets`` (``node``) only what lies nearer than the nearest target is right and followed further; that target and
    all on the way to it are.

    Only nodes whose distance fell are relaxed in the next round. Of equally short ways the one
    over the parent with the smaller distance, then the smaller node and then the smaller ``line``, is kept; parents
    at no distance count by the round that reached them first, so that no way runs in a circle.
    Weights must not be negative; null weights count as zero. Without ``line``, which all edges would carry along, ``via`` is null.
    """
    named = "line" in adjacency.columns
    edges, walls = _dealt_ways(adjacency, *["line"] * named), _walls(blocked)
    best = _settled(edges, starts, walls, targets)
    offering = best
    if walls is not None:
        # A start goes on even if it is blocked.
        offering = best.filter("round > 0").join(walls, best["node"] == walls["wall"], "left_anti").unionByName(best.filter("round = 0"))
    total = F.col("dist") + F.col("weight")
    way = F.struct(total.alias("total"), F.col("dist").alias("of"), F.when(total == F.col("dist"), F.col("round")).otherwise(0).alias("round"), F.col("src").alias("parent"), (F.col("line") if named else F.lit(None).cast("string")).alias("via"))
    ways = offering.join(edges, offering["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(way).alias("way"))
    tree = best.join(ways, "node", "left")
    own = lambda k: F.when(F.col("round") > 0, F.col(f"way.{k}")).alias(k)
    return staged(tree.select("node", "dist", own("parent"), own("via")), "tree")


def chain(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes on the ways from ``starts`` up to their roots; ``parents`` has ``node, parent``."""
    up = staged(parents.select("node", "parent"), "parents")
    seen = front = staged(starts.select("node").distinct(), "chain")
    while any_rows(front):
        above = front.join(up, "node").select(F.col("parent").alias("node")).dropna().distinct()
        front = staged(above.join(seen, "node", "left_anti"), "chain")
        seen = seen.union(front)
    return seen


def subtree(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes below ``starts`` in the forest ``node, parent``, themselves included."""
    return reach(parents.dropna(subset=["parent"]).select(F.col("parent").alias("src"), F.col("node").alias("dst")), starts).select("node")
