"""Bridges, biconnected blocks and cut nodes of very large graphs.

A spanning forest is walked level by level, or as one list of arcs for each tree where it is deep, which gives every node its parent, its number in preorder and the size of its
subtree. The least and greatest number that a subtree can reach over other edges is a minimum and maximum over its stretch of
numbers. From these:

* a tree edge is a bridge if its subtree reaches nothing outside itself,
* tree edges belong to one block if they are joined by the usual two rules, closed by components.

Every step takes rounds by the logarithm of the graph's size, however long its paths are, and is made of joins and
aggregations, so no part of the graph meets in one task. Parallel edges count as a loop; edges from a node to itself are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import lists
from meshwright.operators.graph import components
from meshwright.plans.staging import any_rows, staged


def walked(edges: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`numbered`, and ``eid, a, b, pre_a, size_a, pre_b, size_b`` of the edges that are in no tree."""
    edges = staged(edges.filter("a <> b").select("eid", "a", "b"), "plain")
    taken = lists.spanning(edges)
    held = staged(edges.join(taken, "eid", "left_semi"), "trees")
    # The forest has the parts of the graph and far fewer edges.
    parts = components(held.select(F.col("a").alias("node")).union(held.select("b")), held)
    if roots is None:
        tops = parts.select(F.col("component").alias("node")).distinct()
    else:
        tops = parts.join(roots.select("node").distinct(), "node", "left_semi").groupBy("component").agg(F.min("node").alias("node"))
        inside = parts.join(tops.select("component"), "component", "left_semi").select(F.col("node").alias("a"))
        held = staged(held.join(inside, "a", "left_semi"), "trees")
        tops = tops.select("node")
    tree = lists.toured(held, staged(tops, "tops"))

    def end(name: str) -> DataFrame:
        return tree.select(F.col("node").alias(name), F.col("pre").alias(f"pre_{name}"), F.col("size").alias(f"size_{name}"))

    across = edges.join(taken, "eid", "left_anti").join(end("a"), "a").join(end("b"), "b")
    across = staged(across.select("eid", "a", "b", "pre_a", "size_a", "pre_b", "size_b"), "others")
    seen = across.select(F.col("a").alias("src"), F.col("pre_b").alias("seen")).union(across.select("b", "pre_a"))
    touched = seen.groupBy("src").agg(F.min("seen").alias("least"), F.max("seen").alias("most"))
    own = tree.join(touched, tree["node"] == touched["src"], "left").select("node", F.least("pre", F.coalesce("least", "pre")).alias("low"), F.greatest("pre", F.coalesce("most", "pre")).alias("high"))
    return staged(tree.join(lists.extremes(tree, own), "node").select("node", "root", "parent", "via", "depth", "pre", "size", "low", "high"), "numbered"), across


def numbered(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``node, root, parent, via, depth, pre, size, low, high`` over ``eid, a, b``; empty for a graph without edges.

    One tree for each component, from its least node, or from the least of ``roots`` in it (then only components that hold one).
    """
    return walked(edges, roots)[0]


def bridges(edges: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """``eid`` of edges without which their ends part."""
    tree = numbered(edges) if tree is None else tree
    return tree.filter("via is not null and low >= pre and high < pre + size").select(F.col("via").alias("eid"))


def blocks(edges: DataFrame, walk: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``eid, block`` for every edge between two nodes (of a ``walk`` from :func:`walked`, if there is one); a block is named by its least lower node."""
    slim, others = walk or walked(edges)
    down = slim.filter("via is not null")
    a_first = F.col("pre_a") < F.col("pre_b")
    across = others.select(
        "eid",
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("first"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("last"),
        (F.when(a_first, F.col("pre_a") + F.col("size_a")).otherwise(F.col("pre_b") + F.col("size_b")) <= F.greatest("pre_a", "pre_b")).alias("apart"),
    )
    above = slim.filter("via is not null").select(F.col("node").alias("up"), F.col("pre").alias("up_pre"), F.col("size").alias("up_size"))
    joined = down.join(above, down["parent"] == above["up"]).filter((F.col("low") < F.col("up_pre")) | (F.col("high") >= F.col("up_pre") + F.col("up_size")))
    links = across.filter("apart").select(F.col("first").alias("a"), F.col("last").alias("b")).union(joined.select(F.col("node"), F.col("parent")))
    named = components(down.select("node"), links)
    of_tree = down.join(named, "node").select(F.col("via").alias("eid"), F.col("component").alias("block"))
    of_rest = across.join(named, across["last"] == named["node"]).select("eid", F.col("component").alias("block"))
    return of_tree.unionByName(of_rest)


def lost_below(edges: DataFrame, roots: DataFrame, weights: DataFrame) -> DataFrame:
    """``node, own, lost``: weight that is cut off from the roots if a node goes, its own included.

    ``roots`` are first joined to one virtual root (node -1), so that what two roots both feed is not lost.
    ``weights`` has ``node, weight``; nodes that no root reaches are left out.
    """
    # Virtual edges have negative numbers, which no given edge has.
    virtual = roots.select("node").distinct().select((-1 - 2 * F.abs("node") - (F.col("node") < 0).cast("long")).alias("eid"), F.lit(-1).cast("long").alias("a"), F.col("node").alias("b"))
    whole = staged(edges.select("eid", "a", "b").unionByName(virtual), "rooted")
    root = edges.sparkSession.createDataFrame([(-1,)], "node long")
    tree, others = walked(whole, root)
    named = blocks(whole, (tree, others)).withColumnRenamed("eid", "edge")
    weighted = tree.join(weights.groupBy("node").agg(F.sum("weight").alias("own")), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    # A subtree's weight is the difference of two totals along the preorder.
    along = staged(lists.running(weighted.select("node", "parent", "via", "own", "pre", "size"), ["pre"], ("own",)), "weights")
    end = along.select((F.col("pre") + 1).alias("after"), F.col("run_own").alias("upto"))
    summed = along.withColumn("after", F.col("pre") + F.col("size")).join(end, "after").select("node", "parent", "via", "own", (F.col("upto") - F.col("run_own") + F.col("own")).alias("total"))
    blocked = staged(summed.join(named, summed["via"] == named["edge"], "left").select("node", "parent", "own", "total", "block"), "blocked")
    child = blocked.select(F.col("parent").alias("above"), F.col("block").alias("child_block"), F.col("total").alias("child_total"))
    pairs = child.join(blocked.select("node", "block"), child["above"] == F.col("node")).filter(~F.col("child_block").eqNullSafe(F.col("block")))
    below = pairs.groupBy("node").agg(F.sum("child_total").alias("below"))
    return blocked.filter("node <> -1").join(below, "node", "left").select("node", "own", (F.col("own") + F.coalesce("below", F.lit(0))).cast("long").alias("lost"))


def is_cyclic(edges: DataFrame) -> bool:
    """Whether any loop exists: an edge that is no bridge."""
    return any_rows(edges.filter("a <> b").join(bridges(edges), "eid", "left_anti"))
