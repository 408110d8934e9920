"""Attribute rules: calculations that update fields, constraints and validations that report features.

A rule is a row of ``RULE_FIELDS``; its expression is Spark SQL over the fields of its class, with ``$length``, ``$area`` and
``$id`` for the geometry's measures and the feature's number.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.conditions import holds

CALCULATION, CONSTRAINT, VALIDATION = "calculation", "constraint", "validation"
#: What stands for the measures of a feature in expressions.
MEASURES = {"$length": "length", "$area": "area", "$id": "fid"}


@dataclass(frozen=True)
class Rule:
    name: str
    class_name: str
    kind: str
    expression: str
    field: str | None = None
    trigger: str = "insert,update"
    enabled: bool = True
    order: int = 0
    message: str = ""
    severity: str | None = None


def in_order(rules: Iterable[Rule]) -> list[Rule]:
    """Enabled rules by order and name."""
    return sorted((r for r in rules if r.enabled), key=lambda r: (r.order, r.name))


def expression(rule: Rule) -> Column:
    text = rule.expression
    for mark, column in MEASURES.items():
        text = text.replace(mark, column)
    return F.expr(text)


def calculated(features: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``features`` (``class, fid`` and fields) with the calculations of their class done one after the other."""
    for r in in_order(rules):
        if r.kind == CALCULATION:
            value = expression(r).cast(features.schema[r.field].dataType)
            features = features.withColumn(r.field, F.when(F.col("class") == r.class_name, value).otherwise(F.col(r.field)))
    return features


def updates(features: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``class, fid, field, old_value, new_value``: fields whose text the calculations change."""
    fields = sorted({r.field for r in in_order(rules) if r.kind == CALCULATION})
    # All in one pass over the rows: old values travel beside the new ones.
    kept = features.select("*", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_old"))
    done = calculated(kept, rules)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_old.{f}").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields])
    return done.select("class", "fid", F.explode(F.filter(each, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))).alias("u")).select("class", "fid", "u.*")


def issues(features: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """``class, fid, code, rule, severity, message, x, y``: features that break a constraint or a validation.

    The severity is the rule's own, else error; the message its name and its own text, else that it is broken. Features with ``x, y``
    count only where they have a place; without these columns all count, and their place is null.
    """
    tests = [r for r in in_order(rules) if r.kind != CALCULATION]
    placed = "x" in features.columns
    at = [F.col("x"), F.col("y")] if placed else [F.lit(None).cast("double").alias(k) for k in "xy"]
    broken = [
        F.when(
            (F.col("class") == r.class_name) & ~holds(expression(r)),
            F.struct(
                F.lit("AR").alias("code"), F.lit(r.name).alias("rule"), F.lit(r.severity or "error").alias("severity"),
                F.lit(f"{r.name}: {r.message or 'rule broken'}").alias("message"),
            ),
        )
        for r in tests
    ]
    rows = features.filter("x is not null and y is not null") if placed else features
    return rows.select("class", "fid", *at, F.explode(F.array_compact(F.array(*broken))).alias("i")).select("class", "fid", "i.*", "x", "y")


def changed_only(features: DataFrame, changed: DataFrame) -> DataFrame:
    """The features of a change set (``class, fid``), for rules that run on edits alone."""
    return features.join(changed, ["class", "fid"], "left_semi")


def fill_field(features: DataFrame, field: str, value: str, only_empty: bool = False) -> DataFrame:
    """A field set to an expression, or only where it is null or empty."""
    new = F.expr(value).cast(features.schema[field].dataType)
    old = F.col(field)
    return features.withColumn(field, F.when(old.isNull() | (old.cast("string") == ""), new).otherwise(old) if only_empty else new)


def renumbered(rules: DataFrame) -> DataFrame:
    """A rule table (``rule_order, name``) with orders 1 to n."""
    return rules.withColumn("rule_order", F.row_number().over(Window.orderBy("rule_order", "name")))  # a settings table of some rows


def referential(children: DataFrame, parents: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """``code, keys, n``: values of ``keys`` that no parent has, and how many rows hold each; nulls count as nothing."""
    return children.dropna(subset=list(keys)).join(parents.select(*keys).distinct(), list(keys), "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit(code))
