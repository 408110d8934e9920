"""Summaries, quantities, costs, scores and ranks over feature tables.

``features`` frames have ``class, role, fid, ag, at, size, length, lifecycle, assetid``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.conditions import is_missing
from meshwright.plans.staging import staged

#: Fixed steps of the age score: share of the life that is used up, from 1 to 5.
AGE_STEPS = (0.25, 0.5, 0.75, 1.0)
#: Greatest score of each risk class.
RISK_CLASSES = ((4, "Low"), (9, "Medium"), (15, "High"), (25, "Very high"))
#: Rows of a dimension that may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it has few rows, else leave the join to Spark."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def in_stages(features: DataFrame, lifecycle: Sequence[int] | None) -> DataFrame:
    return features.filter(F.col("lifecycle").isin(*lifecycle)) if lifecycle else features


def summary(features: DataFrame, lifecycle: Sequence[int] | None = None) -> DataFrame:
    """Count and length by class, group and type, with totals of each class and of all (null keys)."""
    by = ("class", "role", "ag", "at")
    return (
        in_stages(features, lifecycle)
        .groupingSets([[F.col(c) for c in by], [F.col("class"), F.col("role")], []], *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("role") == "Line", F.col("length"))).alias("length"), F.grouping_id(*by).alias("level"))
    )


def quantities(features: DataFrame, lifecycle: Sequence[int] | None = None) -> DataFrame:
    """Lines by size as pieces and length, points as pieces."""
    of_line = F.col("role") == "Line"
    return (
        in_stages(features, lifecycle)
        .groupBy("role", "class", "ag", "at", F.when(of_line, F.col("size")).alias("size"))
        .agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.when(of_line, F.col("length"))).alias("length"))
    )


def cost_estimate(counted: DataFrame, prices: DataFrame) -> DataFrame:
    """The best price for every row of :func:`quantities`, and its amount: length for lines, pieces for points.

    A price fits if class and group agree and its type and size agree or are null; the one with more
    that agree wins, then the lower ``price_row``. No price, or one of zero, counts as missing.
    """
    keys = ("role", "class", "ag", "at", "size", "pieces", "length")
    p = prices.select(*[F.col(c).alias(f"p_{c}") for c in ("class", "ag", "at", "size", "price", "unit", "price_row")])
    fits = (counted["class"] == p["p_class"]) & (counted["ag"] == p["p_ag"]) & (p["p_at"].isNull() | (p["p_at"] == counted["at"])) & (p["p_size"].isNull() | (p["p_size"] == counted["size"]))
    rank = p["p_at"].isNotNull().cast("int") + p["p_size"].isNotNull().cast("int")
    best = counted.join(small(p), fits, "left").groupBy(*keys).agg(F.min_by("p_price", F.struct(-F.coalesce(rank, F.lit(-1)), "p_price_row")).alias("price"))
    amount = F.when(F.col("role") == "Line", F.coalesce("length", F.lit(0)).cast("double")).otherwise(F.col("pieces").cast("double"))
    return best.select(*keys, "price", F.round(amount * F.col("price"), 2).alias("cost"), F.coalesce(F.col("price") == 0, F.lit(True)).alias("missing"))


def cost_total(costs: DataFrame) -> DataFrame:
    """``total, missing``: the sum of a :func:`cost_estimate` and how many of its rows have no price."""
    return costs.agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("total"), F.sum(F.col("missing").cast("long")).alias("missing"))


def unpriced(features: DataFrame, prices: DataFrame) -> DataFrame:
    """Combinations of class, group, type and size in use that no price names exactly; nulls equal nulls."""
    used = features.select("class", "ag", "at", "size").distinct()
    p = prices.select(*[F.col(c).alias(f"p_{c}") for c in ("class", "ag", "at", "size")])
    same = used["class"].eqNullSafe(p["p_class"]) & used["ag"].eqNullSafe(p["p_ag"]) & used["at"].eqNullSafe(p["p_at"]) & used["size"].eqNullSafe(p["p_size"])
    return used.join(p, same, "left_anti")


def completeness(features: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``class, field, filled, total, percent`` with one place; an empty class is complete."""
    counted = features.groupBy("class").agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(~is_missing(F.col(f)), 1)).alias(f) for f in fields])
    long = counted.unpivot(["class", "total"], list(fields), "field", "filled")
    return long.select("class", "field", "filled", "total", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100.0 * F.col("filled") / F.col("total"), 1)).alias("percent"))


def required_empty(features: DataFrame, required: dict[str, Sequence[str]]) -> DataFrame:
    """``class, fid, missing``: features of a class with empty required fields, the fields joined by commas."""
    fields = sorted({f for names in required.values() for f in names})
    needs = F.lit(None)
    missing = F.concat_ws(", ", *[F.when(F.col("class").isin(*[c for c, names in required.items() if f in names]) & is_missing(F.col(f)), F.lit(f)).otherwise(needs) for f in fields])
    return features.filter(F.col("class").isin(*required)).withColumn("missing", missing).filter("missing <> ''").select("class", "fid", "missing")


def duplicate_ids(features: DataFrame) -> DataFrame:
    """``assetid, n``: identifiers held by two features or more, over all classes."""
    return features.filter(~is_missing(F.col("assetid"))).groupBy("assetid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def work_order_stats(orders: DataFrame, today: Column) -> DataFrame:
    """Count by status, and how many are past due and neither completed nor cancelled."""
    late = (F.col("due_date") < today) & ~F.col("status").isin("Completed", "Cancelled")
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(late, 1)).alias("overdue"))


def age_score(built: Column, life: Column, year: int) -> Column:
    """1 (new) to 5 (worn) by the used share of the life; 3 where year or life is unknown."""
    used = (F.lit(year) - built) / life
    score = F.when(used >= AGE_STEPS[3], 5)
    for k in (2, 1, 0):
        score = score.when(used >= AGE_STEPS[k], k + 2)
    return F.when(built.isNull() | life.isNull() | (life <= 0), 3).otherwise(score.otherwise(1))


def consequence(customers: Column, most: Column) -> Column:
    """1 to 5 by the share of the greatest number of customers."""
    return F.when(most > 0, F.least(F.lit(5), 1 + F.floor(4 * customers / most + F.lit(0.999)))).otherwise(1).cast("int")


def risk_class(score: Column) -> Column:
    out = F.when(score <= RISK_CLASSES[0][0], RISK_CLASSES[0][1])
    for most, name in RISK_CLASSES[1:]:
        out = out.when(score <= most, name)
    return out


def risk(lines: DataFrame, year: int, life: Column) -> DataFrame:
    """``class, fid, customers, likelihood, consequence, score, risk``; lines have ``customers, built, condition``.

    Likelihood is the greater of the age score and the condition, where that is 1 to 5.
    """
    top = lines.agg(F.max("customers").alias("most"))
    condition = F.when(F.col("condition").between(1, 5), F.col("condition")).otherwise(1)
    scored = lines.crossJoin(F.broadcast(top)).select(  # one row on the right
        "class", "fid", "customers", F.greatest(age_score(F.col("built"), life, year), condition).cast("int").alias("likelihood"), consequence(F.col("customers"), F.col("most")).alias("consequence")
    )
    scored = scored.withColumn("score", F.col("likelihood") * F.col("consequence"))
    return scored.withColumn("risk", risk_class(F.col("score")))


def ranked(scored: DataFrame, buckets: str = "score") -> DataFrame:
    """Number rows 1..n by score, then customers, both falling, then class and fid.

    Scores have few values, so ranks inside one score and the rows before it are counted apart: range
    partitions are numbered on their own and shifted by the sizes of those before, no task sorts all rows.
    """
    ordered = scored.repartitionByRange(F.desc("score"), F.desc("customers"), "class", "fid").sortWithinPartitions(F.desc("score"), F.desc("customers"), "class", "fid")
    placed = staged(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    # One row for each range partition.
    shifted = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(shifted), "part").withColumn("priority", F.col("before") + F.col("seq") - F.col("first") + 1).drop("part", "seq", "first", "before")


def next_ids(existing: DataFrame, wanted: DataFrame, digits: int = 6) -> DataFrame:
    """``prefix, key, assetid``: new identifiers for ``wanted`` (prefix, key): the prefix and a number that isn't in use.

    ``existing`` has ``assetid``; the digits that end it are its number. Numbers go on after the greatest of the prefix, and
    skip those that someone's id already spells. Rows are ranked by range partitions, so no task holds a whole prefix.
    """
    tail = F.regexp_extract("assetid", r"^(.*?)(\d+)$", 2)
    used = existing.select(F.regexp_extract("assetid", r"^(.*?)(\d+)$", 1).alias("prefix"), tail.alias("tail"), tail.try_cast("long").alias("n"))
    most = used.filter("n is not null").groupBy("prefix").agg(F.max("n").alias("most"))
    ordered = wanted.repartitionByRange("prefix", "key").sortWithinPartitions("prefix", "key")
    placed = staged(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "wanted")
    runs = placed.groupBy("part", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    # One row for each partition and prefix in it.
    runs = runs.select("part", "prefix", "first", (F.sum("n").over(Window.partitionBy("prefix").orderBy("part")) - F.col("n")).alias("before"))
    ranked_rows = placed.join(runs, ["part", "prefix"]).select("prefix", "key", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("rank"))
    # A prefix that itself ends in a digit may spell an id that was read as another prefix and number.
    # It is cut at each of its last digits that leave enough of them, and meets wanted prefixes by equality.
    cuts = F.transform(F.sequence(F.lit(1), F.length("tail") - digits), lambda j: F.struct(F.concat("prefix", F.substring(F.col("tail"), F.lit(1), j)).alias("want"), F.substring(F.col("tail"), j + 1, F.length("tail")).alias("rest")))
    whole = used.filter(F.length("tail") > digits).select(F.explode(cuts).alias("cut")).filter((F.length("cut.rest") == digits) | ~F.col("cut.rest").startswith("0"))
    whole = whole.select(F.col("cut.want").alias("prefix"), F.col("cut.rest").try_cast("long").alias("n"))
    taken = whole.filter("n is not null").join(wanted.select("prefix").distinct(), "prefix", "left_semi").distinct()
    taken = taken.join(most, "prefix", "left").filter(F.col("n") > F.coalesce("most", F.lit(0)))
    # Numbers in use beyond the greatest are few: each moves the ranks behind it by one.
    free = taken.withColumn("shift", F.row_number().over(Window.partitionBy("prefix").orderBy("n"))).select("prefix", (F.col("n") - F.coalesce("most", F.lit(0)) - F.col("shift")).alias("gap"))
    moved = free.groupBy("prefix").agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    found = ranked_rows.join(most, "prefix", "left").join(moved, "prefix", "left")
    skipped = F.coalesce(F.size(F.filter("gaps", lambda g: g < F.col("rank"))), F.lit(0))
    number = (F.coalesce("most", F.lit(0)) + F.col("rank") + F.when(F.col("gaps").isNull(), 0).otherwise(skipped)).cast("string")
    return found.select("prefix", "key", F.concat("prefix", F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))).alias("assetid"))


def latest(history: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` changes; ties by number, falling."""
    return history.orderBy(F.desc("changed_at"), F.desc("change_id")).limit(n)
