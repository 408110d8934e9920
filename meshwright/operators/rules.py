"""Connectivity checks at nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ("one_class", "one_ag", "other_class", "other_ag")


def ends(lines: DataFrame) -> DataFrame:
    kept = (F.col("class").alias("line_class"), F.col("ag").alias("line_ag"), F.col("fid").alias("line_fid"), "size")
    return lines.select(F.col("a").alias("node"), *kept).unionByName(lines.select(F.col("b").alias("node"), *kept))


def pairs(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Kinds (class and group) that meet at each node, in text order, named by their least line; unknown groups are skipped.

    Lines meet the points of a node other than structures or, where there is none, each other. Lines are counted by
    kind at a node before they meet, so a busy node costs one row a kind.
    """
    kinds = ends(lines).groupBy("node", "line_class", "line_ag").agg(F.countDistinct("line_fid").alias("n"), F.min("line_fid").alias("fid"))
    at = points.filter(~F.array_contains("categories", "structure")).select("node", F.col("class").alias("o_class"), F.col("ag").alias("o_ag"))
    with_points = kinds.join(at.distinct(), "node")
    bare = kinds.join(at.select("node").distinct(), "node", "left_anti")
    other = bare.select("node", F.col("line_class").alias("o_class"), F.col("line_ag").alias("o_ag"), F.col("n").alias("o_n"), F.col("fid").alias("o_fid"))
    # Two kinds once, and a kind with itself where two of its lines meet.
    one, two = F.struct("line_class", "line_ag"), F.struct("o_class", "o_ag")
    among = bare.join(other, "node").filter((one < two) | ((one == two) & (F.col("n") > 1))).withColumn("fid", F.least("fid", "o_fid"))
    met = with_points.select("node", "line_class", "line_ag", "o_class", "o_ag", "fid").unionByName(among.select("node", "line_class", "line_ag", "o_class", "o_ag", "fid"))
    met = met.dropna(subset=["line_ag", "o_ag"])
    first = F.least(F.struct(F.col("line_class").alias("k"), F.col("line_ag").alias("g")), F.struct(F.col("o_class").alias("k"), F.col("o_ag").alias("g")))
    last = F.greatest(F.struct(F.col("line_class").alias("k"), F.col("line_ag").alias("g")), F.struct(F.col("o_class").alias("k"), F.col("o_ag").alias("g")))
    named = met.select("node", first.alias("p"), last.alias("q"), "fid").select("node", *[F.col(x).alias(n) for x, n in zip(("p.k", "p.g", "q.k", "q.g"), PAIR, strict=True)], "fid")
    return named.groupBy("node", *PAIR).agg(F.min("fid").alias("fid"))


def missing(points: DataFrame, lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pairs at a node that no rule allows, once for each node and pair."""
    return pairs(points, lines).join(allowed, list(PAIR), "left_anti").select("node", *PAIR, "fid")


def learned(points: DataFrame, lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pairs in use that aren't rules yet."""
    return missing(points, lines, allowed).select(*PAIR).distinct()


def size_changes(points: DataFrame, lines: DataFrame, services: Sequence[str] = ()) -> DataFrame:
    """``node, sizes, fid``: nodes without a point where lines of several sizes meet; ``services`` are classes that don't count."""
    counted = ends(lines).filter(~F.col("line_class").isin(*services)) if services else ends(lines)
    bare = counted.filter("size is not null").join(points.select("node"), "node", "left_anti")
    return bare.groupBy("node").agg(F.countDistinct("size").alias("sizes"), F.min("line_fid").alias("fid")).filter("sizes > 1")


def stacked(points: DataFrame) -> DataFrame:
    """``x, y, n``: places with several points that are no structure."""
    return points.filter(~F.array_contains("categories", "structure")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
