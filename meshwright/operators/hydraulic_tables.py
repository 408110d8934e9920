"""Tables around a hydraulic model: what is summed up, classified, joined back and compared; the solver itself isn't built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators import lists


def classed(value: Column, limits: Sequence[float]) -> Column:
    """Number of the class of a value: how many limits it reaches."""
    out = F.lit(0)
    for limit in limits:
        out = out + F.when(value >= limit, 1).otherwise(0)
    return F.when(value.isNotNull(), out)


def class_counts(results: DataFrame, value: str, limits: Sequence[float], low: float) -> DataFrame:
    """``band, n, customers_low``: results in each class, and the customers of those below ``low``."""
    below = F.when(F.col(value) < low, F.coalesce("customers", F.lit(0))).otherwise(0)
    return results.filter(F.col(value).isNotNull()).groupBy(classed(F.col(value), limits).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(below).cast("long").alias("customers_low"))


def solver_summary(nodes: DataFrame, pipes: DataFrame) -> DataFrame:
    """One row: least and greatest pressure, total demand, greatest velocity."""
    of_nodes = nodes.agg(F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"), F.sum("demand").alias("demand"))
    return of_nodes.crossJoin(F.broadcast(pipes.agg(F.max(F.abs("velocity")).alias("max_velocity"))))  # one row each


def first_values(points: DataFrame, field: str, roles: Sequence[str]) -> DataFrame:
    """``node, value``: the first value of a node's points that isn't null, by role and then number."""
    order = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    known = points.filter(F.col(field).isNotNull())
    return known.groupBy("node").agg(F.min_by(field, F.struct(order, "fid")).alias("value"))


def node_demands(customers: DataFrame) -> DataFrame:
    """``node, demand, customers``."""
    return customers.groupBy("node").agg(F.sum("demand").alias("demand"), F.count(F.lit(1)).alias("customers"))


def group_means(pipes: DataFrame, value: str) -> DataFrame:
    return pipes.groupBy("label").agg(F.avg(value).alias("mean"))


def fit_quality(pairs: DataFrame) -> DataFrame:
    """One row for ``observed, computed``: RMSE, mean and greatest absolute error, and R squared (null without spread)."""
    error = F.col("computed") - F.col("observed")
    sums = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.max(F.abs(error)).alias("max_error"),
        F.sum(error * error).alias("residual"), F.var_pop("observed").alias("spread"),
    )
    return sums.select("n", "rmse", "mae", "max_error", F.when(F.col("spread") > 0, 1 - F.col("residual") / (F.col("spread") * F.col("n"))).alias("r_squared"))


def period_extremes(steps: DataFrame) -> DataFrame:
    """``node, min_pressure, max_pressure`` over all steps (``step, node, pressure``)."""
    return steps.groupBy("node").agg(F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"))


def lowest_of_steps(steps: DataFrame) -> DataFrame:
    """``step, node, pressure``: the lowest place of each step; ties go to the smaller node."""
    return steps.groupBy("step").agg(F.min(F.struct("pressure", "node")).alias("low")).select("step", "low.node", "low.pressure")


def results_back(results: DataFrame, nodes: DataFrame, pipes: DataFrame) -> DataFrame:
    """``kind, key, value`` of results whose ids are N or P and a number, joined to what they stand for."""
    parsed = results.select(F.upper(F.substring("id", 1, 1)).alias("kind"), F.expr("try_cast(substring(id, 2) AS BIGINT)").alias("number"), "value")
    of_nodes = parsed.filter("kind = 'N'").join(nodes.select(F.col("node").alias("number")), "number", "left_semi")
    of_pipes = parsed.filter("kind = 'P'").join(pipes.select(F.col("pipe").alias("number")), "number", "left_semi")
    return of_nodes.unionByName(of_pipes).select("kind", F.col("number").alias("key"), "value")


def chainage(path: DataFrame) -> DataFrame:
    """``seq, chainage, level``: distance from the start along an ordered path (``seq, length, level``); a null length counts as none."""
    known = path.select("seq", F.coalesce("length", F.lit(0.0)).alias("length"), "level")
    return lists.running(known, ["seq"], ("length",)).select("seq", F.col("run_length").alias("chainage"), "level")
