"""Predicates of traces and reports as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comparisons that a condition may name; "is empty" and "is not empty" take no value.
COMPARISONS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
EMPTY, NOT_EMPTY = "is empty", "is not empty"
#: Texts that count as false in the result of a rule.
FALSE_TEXTS = ("", "0", "false", "f", "no")
IN_SERVICE_EXCLUDES = (1, 2, 4, 5, 6)


def as_number(text: Column) -> Column:
    """A double, or null; NaN counts as text because it compares with nothing."""
    number = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def condition(attribute: Column, op: str, value: object = None) -> Column:
    """True where the attribute meets one condition; a null attribute meets no comparison.

    Both sides compare as numbers if both are numbers, else as lower-case text.
    """
    text = attribute.cast("string")
    if op == EMPTY:
        return text.isNull() | (text == "")
    if op == NOT_EMPTY:
        return text.isNotNull() & (text != "")
    if op not in COMPARISONS:
        raise ValueError(f"no such comparison: {op}")
    wanted = F.lit(None if value is None else str(value))
    left, right = as_number(text), as_number(wanted)
    compare = COMPARISONS[op]
    found = F.when(left.isNotNull() & right.isNotNull(), compare(left, right)).otherwise(compare(F.lower(text), F.lower(wanted)))
    return F.coalesce(found, F.lit(False))


def any_condition(attrs: Column, conditions: Iterable[tuple[str, str, object]]) -> Column:
    """True where the map of attributes meets any of the conditions."""
    return reduce(lambda a, b: a | b, [condition(attrs[name], op, value) for name, op, value in conditions], F.lit(False))


def excluded_lifecycle(lifecycle: Column, excluded: Sequence[int]) -> Column:
    """True for features out of service; an unknown stage is never excluded."""
    return F.coalesce(lifecycle.isin(*excluded), F.lit(False)) if excluded else F.lit(False)


def too_small(lifecycle: Column, size: Column, excluded: Sequence[int], min_size: float | None) -> Column:
    """True for lines with a known size below the least one, unless their stage already excludes them."""
    if min_size is None:
        return F.lit(False)
    return ~excluded_lifecycle(lifecycle, excluded) & F.coalesce(size < min_size, F.lit(False))


def holds(result: Column) -> Column:
    """Whether the result of a rule counts as true."""
    text = F.lower(F.trim(result.cast("string")))
    return F.coalesce(~text.isin(*FALSE_TEXTS), F.lit(False))


def is_missing(field: Column) -> Column:
    return field.isNull() | (field.cast("string") == "")


def output_groups(ag: Column, at: Column, groups: Sequence[tuple[int, int | None]] | None) -> Column:
    """Rows of the wanted groups; a group without a type takes all types. None: no filter; an empty list: nothing."""
    if groups is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [(ag == g) & (F.lit(True) if t is None else at == t) for g, t in groups], F.lit(False))
