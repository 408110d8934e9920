"""Longitudinal profiles: an unbranched path of lines, put in order by ranking, with chainage, ground and inverts.

The path comes as a set of edges in no order. Each edge is two arcs; an arc leads on to the arc that leaves its end by another edge, and the ranking
of these lists tells at once where each edge lies and whether all of them are one path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import lists
from meshwright.plans.staging import staged

c = F.col
#: What a path may not be.
BRANCHED = "The pipes must form one continuous path without branches."
EMPTY = "Select or trace the pipes of the profile first."


def ordered(path: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``arc, seq, src, dst, eid, chainage``: the edges (``eid, a, b, length, reverse``) from one end of the path to the other.

    ``reverse`` is true where the flow runs from b to a, null where a line has no direction. The path begins at the end that is among ``start`` (``node``), else
    at the one the flow leaves, else at the smaller one. A path with a branch, a ring or several parts raises an error, as does no path.
    """
    edges = staged(path.select("eid", "a", "b", c("length").cast("double").alias("length"), "reverse"), "path")
    n = edges.count()
    if not n:
        raise ValueError(EMPTY)
    both = edges.select("eid", c("a").alias("src"), c("b").alias("dst"), "length", (~c("reverse")).alias("along"))
    both = both.unionByName(edges.select("eid", c("b").alias("src"), c("a").alias("dst"), "length", c("reverse").alias("along")))
    arcs = staged(both.withColumn("arc", F.monotonically_increasing_id()), "arcs")
    degree = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("along").alias("leaves"))
    # Two rows or an error; a path of any length has two ends.
    tips = degree.filter("n = 1").limit(3).collect()
    if len(tips) != 2 or degree.filter("n > 2").limit(1).count():
        raise ValueError(BRANCHED)
    picked = set()
    if start is not None:
        picked = {r.node for r in start.filter(c("node").isin([r.src for r in tips])).select("node").distinct().collect()}
    first = min(tips, key=lambda r: (r.src not in picked, not r.leaves, r.src)).src
    last = next(r.src for r in tips if r.src != first)
    back = arcs.select(c("src").alias("at"), c("arc").alias("next"), c("eid").alias("by"))
    onward = arcs.join(back, (c("dst") == c("at")) & (c("eid") != c("by")), "left").select(c("arc").alias("node"), "next", "length")
    found = lists.ranked(onward).filter("last is not null").select(c("node").alias("arc"), "last", c("hops").alias("to_end"), c("length").alias("before_end"))
    goal = arcs.filter(c("dst") == last).select(c("arc").alias("last"), c("length").alias("last_length"))
    mine = staged(arcs.join(found, "arc").join(goal, "last"), "profile")
    total = mine.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).first()
    if total.n != n:
        raise ValueError(BRANCHED)
    chainage = F.lit(total.length) - c("last_length") - c("before_end") + c("length")
    return mine.select("arc", (F.lit(n) - c("to_end")).alias("seq"), "src", "dst", "eid", "along", chainage.alias("chainage"))


def profile(path: DataFrame, attributes: DataFrame, ground: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``seq, node, chainage, ground, invert_in, invert_out, pipe, diameter`` of each node along the path, from 0.

    ``attributes`` has ``eid, us_invert, ds_invert, diameter, pipe``, ``ground`` ``node, elevation``; what they lack is null. Inverts swap where the path runs
    against the flow. ``pipe`` and ``diameter`` are those of the pipe that goes on from the node.
    """
    along = staged(ordered(path, start), "ordered")
    told = along.join(attributes, "eid", "left")
    # A pipe without direction counts as drawn; its first arc has a null along.
    against = F.coalesce(~c("along"), c("src") != c("a_drawn"))
    drawn = path.select("eid", c("a").alias("a_drawn"))
    told = told.join(drawn, "eid").withColumn("against", against)
    low, high = F.when(c("against"), c("us_invert")).otherwise(c("ds_invert")), F.when(c("against"), c("ds_invert")).otherwise(c("us_invert"))
    told = staged(told.select("seq", "src", "dst", "chainage", low.alias("invert_in"), high.alias("invert_out"), "pipe", "diameter"), "told")
    none = F.lit(None).cast("double")
    nodes = told.select("seq", c("dst").alias("node"), F.round("chainage", 2).alias("chainage"), "invert_in")
    nodes = nodes.unionByName(told.filter("seq = 1").select(F.lit(0).cast("long").alias("seq"), c("src").alias("node"), F.lit(0.0).alias("chainage"), none.alias("invert_in")))
    on = told.select((c("seq") - 1).alias("seq"), "invert_out", "pipe", "diameter")
    rows = nodes.join(on, "seq", "left").join(ground.select("node", c("elevation").alias("ground")), "node", "left")
    return rows.select("seq", "node", "chainage", "ground", "invert_in", "invert_out", "pipe", "diameter")
