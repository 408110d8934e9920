"""Linked lists, ordered totals and spanning trees in rounds that grow with the logarithm of the data.

A list that is followed step by step takes as many rounds as it is long.  Here every element doubles the distance it looks ahead
in each round (pointer doubling), totals along an order come from range partitions with carried offsets, and trees are
walked as lists of arcs (Euler tours).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.graph import both_ways, components
from meshwright.plans.staging import any_rows, staged

c = F.col
#: Trees of at most so many levels are walked level by level, deeper ones as lists.
LEVELS = 12


def ranked(links: DataFrame) -> DataFrame:
    """``node, last, hops, length``: where each list ends, and how far it is until there.

    ``links`` has ``node, next, length``, one row a node; next is null at an end, and no two nodes have the same next. Nodes of a
    ring have no end: their last is null.
    """
    done = staged(links.filter("next is null").select("node", c("node").alias("last"), F.lit(0).cast("long").alias("hops"), F.lit(0.0).alias("length")), "ranked")
    ahead = staged(links.filter("next is not null").select("node", "next", F.lit(1).cast("long").alias("hops"), c("length").cast("double").alias("length")), "ahead")
    rest = ahead.count()
    # Elements that wait look twice as far ahead after each round; what still waits after so many rounds runs in a ring.
    for _ in range(max(1, rest).bit_length() + 1):
        if not any_rows(ahead):
            break
        reached = done.select(c("node").alias("next"), "last", c("hops").alias("more"), c("length").alias("further"))
        ended = staged(ahead.join(reached, "next").select("node", "last", (c("hops") + c("more")).alias("hops"), (c("length") + c("further")).alias("length")), "ranked")
        onward = ahead.select(c("node").alias("next"), c("next").alias("then"), c("hops").alias("more"), c("length").alias("further"))
        ahead = staged(ahead.join(onward, "next").select("node", c("then").alias("next"), (c("hops") + c("more")).alias("hops"), (c("length") + c("further")).alias("length")), "ahead")
        done = done.unionByName(ended)
    none = F.lit(None)
    return done.unionByName(ahead.select("node", none.cast("long").alias("last"), none.cast("long").alias("hops"), none.cast("double").alias("length")))


def _running(frames: Iterator[pd.DataFrame], sums: list[str]) -> Iterator[pd.DataFrame]:
    part, at, totals = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
    for frame in frames:
        n = len(frame)
        if not n:
            continue
        frame = frame.assign(part=np.int32(part), place=np.arange(at + 1, at + n + 1))
        for k in sums:
            run = np.cumsum(frame[k].to_numpy()) + totals[k]
            totals[k] = run[-1]
            frame[f"run_{k}"] = run
        at += n
        yield frame


def running(rows: DataFrame, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``place`` (from 1) in the order of ``keys`` over the whole table, and ``run_<column>``: totals up to there, itself included.

    ``keys`` are unique; the columns of ``sums`` are numbers without nulls. Every partition counts for itself; what partitions add to each other
    is one row each.
    """
    kinds = dict(rows.dtypes)
    of = {k: "double" if kinds[k] == "double" else "long" for k in sums}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in rows.columns), "part int", "place long", *(f"run_{k} {of[k]}" for k in sums)])
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    done = staged(ordered.mapInPandas(lambda frames: _running(frames, list(sums)), schema), "running")
    ends = done.groupBy("part").agg(F.max("place").alias("n"), *[F.max_by(f"run_{k}", "place").alias(k) for k in sums])
    held = sorted(ends.collect(), key=lambda r: r.part)  # one row a partition
    offsets, before = [], [0, *(0.0 if of[k] == "double" else 0 for k in sums)]
    for r in held:
        offsets.append((r.part, *before))
        before = [b + r[k] for b, k in zip(before, ("n", *sums), strict=True)]
    carried = rows.sparkSession.createDataFrame(offsets, "part int, _place long" + "".join(f", _{k} {of[k]}" for k in sums))
    whole = done.join(F.broadcast(carried), "part")
    return whole.select(*rows.columns, (c("place") + c("_place")).alias("place"), *[(c(f"run_{k}") + c(f"_{k}")).alias(f"run_{k}") for k in sums])


def spanning(edges: DataFrame) -> DataFrame:
    """``eid`` of a spanning forest of ``eid, a, b``: in each round every part of the graph takes its least edge to another part."""
    left = edges.filter("a <> b").select("eid", "a", "b")
    taken = left.select("eid").limit(0)
    while any_rows(left):
        ends = left.select("eid", c("a").alias("part")).unionByName(left.select("eid", c("b").alias("part")))
        least = staged(ends.groupBy("part").agg(F.min("eid").alias("eid")), "least")
        chosen = staged(least.select("eid").distinct(), "chosen")
        taken = taken.unionByName(chosen)
        named = components(least.select(c("part").alias("node")), left.join(chosen, "eid", "left_semi"))
        moved = left.join(named.toDF("a", "pa"), "a").join(named.toDF("b", "pb"), "b").filter("pa <> pb")
        # Of several edges between two parts only the least can be taken.
        pair = (F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = staged(moved.select("eid", *pair).groupBy("a", "b").agg(F.min("eid").alias("eid")).select("eid", "a", "b"), "left")
    return staged(taken, "taken")


def _levels(arcs: DataFrame, roots: DataFrame) -> list[DataFrame] | None:
    """``node, root, parent, via`` of each level below the roots; None if there are more than ``LEVELS``."""
    none = F.lit(None).cast("long")
    front = staged(roots.select("node").distinct().select("node", c("node").alias("root"), none.alias("parent"), none.alias("via")), "level")
    found = []
    while any_rows(front):
        if len(found) > LEVELS:
            return None
        found.append(front)
        step = front.join(arcs, c("node") == c("src")).filter("via is null or eid <> via")
        front = staged(step.select(c("dst").alias("node"), "root", c("node").alias("parent"), c("eid").alias("via")), "level")
    return found


def _numbered(levels: list[DataFrame]) -> DataFrame:
    """The columns of :func:`toured` for trees given by levels: sizes come up from below, places go down."""
    sized: list[DataFrame] = []
    for depth, level in reversed(list(enumerate(levels))):
        own = level.withColumn("depth", F.lit(depth).cast("long"))
        if sized:
            more = sized[-1].groupBy(c("parent").alias("node")).agg(F.sum("size").alias("more"))
            own = own.join(more, "node", "left").withColumn("size", F.coalesce("more", F.lit(0)) + 1).drop("more")
        sized.append(staged(own.withColumn("size", (c("size") if "size" in own.columns else F.lit(1)).cast("long")), "sized"))
    sized.reverse()
    top = running(sized[0], ["node"], ("size",))
    placed = staged(top.select(*sized[0].columns, (c("run_size") - c("size")).alias("pre")), "pre")
    done = placed
    if len(sized) > 1:
        below = sized[1]
        for level in sized[2:]:
            below = below.unionByName(level)
        # What stands between a node and its parent: the sizes of its siblings before it.
        along = running(below, ["parent", "node"], ("size",))
        first = along.groupBy("parent").agg(F.min(c("run_size") - c("size")).alias("base"))
        beside = staged(along.join(first, "parent").select(*below.columns, (c("run_size") - c("size") - c("base")).alias("beside")), "beside")
        for depth in range(1, len(sized)):
            above = placed.select(c("node").alias("parent"), c("pre").alias("above"))
            level = beside.filter(c("depth") == depth).join(above, "parent")
            placed = staged(level.select(*sized[0].columns, (c("above") + 1 + c("beside")).alias("pre")), "pre")
            done = done.unionByName(placed)
    return done.select("node", "root", "parent", "via", "depth", "pre", "size")


def toured(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, root, parent, via, depth, pre, size`` of the trees of ``tree`` (``eid, a, b``, a forest) that hold a root.

    ``roots`` has ``node``, one in each tree. ``pre`` counts from 0 over all trees, a tree's nodes and a subtree's stand together. Trees
    of few levels are numbered level by level. Of deeper ones the arcs, each edge there and back, make one list for each tree; ranking it gives every number.
    """
    arcs = both_ways(tree, "eid")
    if not any_rows(arcs):
        none = F.lit(None).cast("long")
        alone = running(roots.select("node").distinct(), ["node"])
        return alone.select("node", c("node").alias("root"), none.alias("parent"), none.alias("via"), F.lit(0).cast("long").alias("depth"), (c("place") - 1).alias("pre"), F.lit(1).cast("long").alias("size"))
    levels = _levels(arcs, roots)
    if levels:
        return _numbered(levels)
    placed = staged(running(arcs, ["src", "dst", "eid"]).withColumnRenamed("place", "arc"), "arcs")
    first = placed.groupBy("src").agg(F.min("arc").alias("first"), F.max("arc").alias("last"))
    # After arriving over an edge the next arc is the one behind the way back, in the order of the node, around and around.
    twin = placed.select("eid", c("src").alias("dst"), c("arc").alias("back"))
    come = placed.join(twin, ["eid", "dst"]).join(first.withColumnRenamed("src", "dst"), "dst")
    is_root = roots.select(c("node").alias("dst"), F.lit(True).alias("is_root"))
    come = come.join(is_root, "dst", "left")
    around = F.when(c("back") < c("last"), c("back") + 1).when(c("is_root").isNull(), c("first"))
    links = staged(come.select(c("arc").alias("node"), around.alias("next"), F.lit(1.0).alias("length"), "src", "dst", "eid", "back"), "tour")
    at = ranked(links.select("node", "next", "length")).filter("last is not null").select(c("node").alias("arc"), c("last").alias("tour"), c("hops").alias("to_end"))
    ended = placed.select(c("arc").alias("tour"), c("dst").alias("root"))
    walked = links.withColumnRenamed("node", "arc").join(at, "arc").join(ended, "tour")
    there = at.select(c("arc").alias("back"), c("to_end").alias("back_end"))
    walked = staged(walked.join(there, "back").select("root", "src", "dst", "eid", "to_end", "back_end", (c("to_end") > c("back_end")).alias("down")), "walked")
    # A root comes before all arcs of its tree. Depth rises with every arc down and falls with every one up.
    down = F.when(c("down"), 1).otherwise(0).cast("long")
    rows = walked.select("root", c("dst").alias("node"), c("src").alias("parent"), c("eid").alias("via"), (-c("to_end")).alias("at"), ((c("to_end") - c("back_end") + 1) / 2).cast("long").alias("size"), down.alias("down"), (2 * down - 1).alias("rise"))
    sizes = walked.groupBy("root").agg((F.count(F.lit(1)) / 2 + 1).cast("long").alias("size"))
    null, low = F.lit(None).cast("long"), F.lit(-(1 << 62))
    tops = roots.select(c("node").alias("root")).distinct().join(sizes, "root", "left")
    tops = tops.select("root", c("root").alias("node"), null.alias("parent"), null.alias("via"), low.alias("at"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), F.lit(1).cast("long").alias("down"), F.lit(0).cast("long").alias("rise"))
    numbered = running(rows.unionByName(tops), ["root", "at"], ("down", "rise"))
    return staged(numbered.filter("down = 1").select("node", "root", "parent", "via", c("run_rise").alias("depth"), (c("run_down") - 1).alias("pre"), "size"), "toured")


def extremes(tree: DataFrame, values: DataFrame) -> DataFrame:
    """``node, low, high``: the least and the greatest of ``values`` (``node, low, high``, one row a node) in each subtree of a toured tree.

    In trees of few levels values come up level by level. Else least values of stretches of 1, 2, 4, ... places in preorder are taken; a subtree is
    two such stretches that may overlap.
    """
    at = staged(tree.join(values, "node").select("node", "parent", "depth", "pre", "size", "low", "high"), "values")
    longest, deepest = at.agg(F.max("size"), F.max("depth")).first()
    longest = longest or 0
    if deepest is not None and deepest <= LEVELS:
        below = done = None
        for depth in range(deepest, -1, -1):
            level = at.filter(c("depth") == depth).select("node", "parent", "low", "high")
            if below is not None:
                least = below.groupBy(c("parent").alias("node")).agg(F.min("low").alias("low_2"), F.max("high").alias("high_2"))
                level = level.join(least, "node", "left").select("node", "parent", F.least("low", "low_2").alias("low"), F.greatest("high", "high_2").alias("high"))
            below = staged(level, "extremes")
            done = below if done is None else done.unionByName(below)
        return done.select("node", "low", "high")
    level, width, done = at.select("pre", "low", "high"), 1, None
    while width <= longest:
        fits = at.filter((c("size") >= width) & (c("size") < 2 * width)).select("node", "pre", (c("pre") + c("size") - width).alias("end"))
        end = level.select(c("pre").alias("end"), c("low").alias("low_2"), c("high").alias("high_2"))
        found = fits.join(level, "pre").join(end, "end").select("node", F.least("low", "low_2").alias("low"), F.greatest("high", "high_2").alias("high"))
        done = found if done is None else done.unionByName(found)
        if 2 * width <= longest:
            beyond = level.select((c("pre") - width).alias("pre"), c("low").alias("low_2"), c("high").alias("high_2"))
            level = staged(level.join(beyond, "pre").select("pre", F.least("low", "low_2").alias("low"), F.greatest("high", "high_2").alias("high")), "stretches")
        width *= 2
    return staged(at.select("node", "low", "high") if done is None else done, "extremes")
