"""Comparing, reconciling and posting versions of a table.

``base``, ``version`` and ``parent`` are snapshots with the same key and field columns. Keys must be
unique in a snapshot (see :func:`backfill`); a null field is a value like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def normal_id(text: Column) -> Column:
    """Global ids without braces and in upper case."""
    return F.upper(F.regexp_replace(text, "[{}]", ""))


def backfill(df: DataFrame, by: str, gid: str, fid: str) -> DataFrame:
    """Give rows without a global id, or with one that an earlier row of the class has, a new one made from class and fid.

    Ids are compared without braces and in upper case; an id of no characters counts as none.
    """
    plain = F.nullif(normal_id(F.col(gid)), F.lit(""))
    firsts = df.withColumn("_id", plain).filter("_id is not null").groupBy(by, "_id").agg(F.min(fid).alias("_first"))
    marked = df.withColumn("_id", plain).join(firsts, [by, "_id"], "left")
    again = F.col("_first").isNull() | (F.col(fid) > F.col("_first"))
    return marked.select(*[F.when(again, F.upper(F.sha1(F.concat_ws(":", by, fid)))).otherwise(F.col(gid)).alias(gid) if c == gid else F.col(c) for c in df.columns])


def state_hash(fields: Sequence[str]) -> Column:
    """A digest of the fields that aren't null."""
    return F.sha1(F.concat_ws("|", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.col(f).cast("string"))) for f in fields]))


def _side(df: DataFrame, keys: Sequence[str], fields: Sequence[str], mark: str) -> DataFrame:
    return df.select(*keys, F.struct(*fields).alias(mark))


def three_way(base: DataFrame, version: DataFrame, parent: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys and the structs ``b, v, p`` of all keys that any snapshot has."""
    joined = _side(base, keys, fields, "b").join(_side(version, keys, fields, "v"), list(keys), "full_outer")
    return joined.join(_side(parent, keys, fields, "p"), list(keys), "full_outer")


def _kind(old: str, new: str) -> Column:
    return (
        F.when(F.col(old).isNull() & F.col(new).isNotNull(), INSERT)
        .when(F.col(old).isNotNull() & F.col(new).isNull(), DELETE)
        .when(~F.col(old).eqNullSafe(F.col(new)), UPDATE)
    )


def diff(base: DataFrame, version: DataFrame, parent: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys that either side changed: ``version_kind, parent_kind, conflict, conflict_fields, merged_fields``.

    A conflict is a change on both sides with different outcomes; two updates conflict only in fields
    that both set to different values, and the fields that the parent alone set are merged.
    """
    rows = three_way(base, version, parent, keys, fields).withColumns({"version_kind": _kind("b", "v"), "parent_kind": _kind("b", "p")})
    rows = rows.filter("version_kind is not null or parent_kind is not null")
    both = (F.col("version_kind") == UPDATE) & (F.col("parent_kind") == UPDATE)

    def moved(side: str, f: str) -> Column:
        return ~F.col(f"b.{f}").eqNullSafe(F.col(f"{side}.{f}"))

    clash = F.concat_ws(",", *[F.when(both & moved("v", f) & moved("p", f) & ~F.col(f"v.{f}").eqNullSafe(F.col(f"p.{f}")), F.lit(f)) for f in sorted(fields)])
    merge = F.concat_ws(",", *[F.when(both & ~F.col("v").eqNullSafe(F.col("p")) & moved("p", f) & ~moved("v", f), F.lit(f)) for f in sorted(fields)])
    differ = F.col("version_kind").isNotNull() & F.col("parent_kind").isNotNull() & ~F.col("v").eqNullSafe(F.col("p"))
    rows = rows.withColumns({"conflict_fields": clash, "merged_fields": merge})
    return rows.withColumn("conflict", F.when(both, F.col("conflict_fields") != "").otherwise(differ)).select(
        *keys, "version_kind", "parent_kind", "conflict", "conflict_fields", "merged_fields"
    )


def reconcile(base: DataFrame, version: DataFrame, parent: DataFrame, keys: Sequence[str], fields: Sequence[str], favor: str = "version") -> DataFrame:
    """The version with the parent's changes taken in; conflicts go to the favoured side, field by field for two updates."""
    if favor not in ("version", "parent"):
        raise ValueError("favor is version or parent")
    rows = three_way(base, version, parent, keys, fields)
    first, second = ("v", "p") if favor == "version" else ("p", "v")
    changed = {side: ~F.col("b").eqNullSafe(F.col(side)) for side in ("v", "p")}
    everywhere = F.col("b").isNotNull() & F.col("v").isNotNull() & F.col("p").isNotNull()
    field = [
        F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"{first}.{f}")), F.col(f"{first}.{f}")).otherwise(F.col(f"{second}.{f}")).alias(f) for f in fields
    ]
    state = (
        F.when(everywhere, F.struct(*field))
        .when(changed[first], F.col(first))
        .otherwise(F.col(second))
    )
    return rows.withColumn("s", state).filter(F.col("s").isNotNull()).select(*keys, "s.*")


def post(parent_now: DataFrame, parent_seen: DataFrame, reconciled: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The parent after posting; refused if it moved since the version was reconciled with it."""
    moved = changes(parent_seen, parent_now, keys, fields)
    if not moved.isEmpty():
        raise ValueError("the parent has changed: reconcile again before posting")
    return reconciled.select(*keys, *fields)


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``keys, kind`` of rows that differ between two snapshots."""
    joined = _side(old, keys, fields, "b").join(_side(new, keys, fields, "v"), list(keys), "full_outer")
    return joined.withColumn("kind", _kind("b", "v")).filter("kind is not null").select(*keys, "kind")


def tallies(differences: DataFrame) -> DataFrame:
    """``side, kind, n`` of a :func:`diff`."""
    sides = differences.select(F.explode(F.array(F.struct(F.lit("version").alias("side"), F.col("version_kind").alias("kind")), F.struct(F.lit("parent").alias("side"), F.col("parent_kind").alias("kind")))).alias("s"))
    return sides.select("s.*").filter("kind is not null").groupBy("side", "kind").agg(F.count(F.lit(1)).alias("n"))


def audit(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per changed field: ``keys, action, field, old_value, new_value``; one with null field for a row that came or went."""
    joined = _side(old, keys, fields, "b").join(_side(new, keys, fields, "v"), list(keys), "full_outer").withColumn("action", _kind("b", "v")).filter("action is not null")
    none = F.lit(None).cast("string")
    per_field = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("old_value"), F.col(f"v.{f}").cast("string").alias("new_value")) for f in fields]),
        lambda x: ~x["old_value"].eqNullSafe(x["new_value"]),
    )
    whole = F.array(F.struct(none.alias("field"), none.alias("old_value"), none.alias("new_value")))
    return joined.select(*keys, "action", F.explode(F.when(F.col("action") == UPDATE, per_field).otherwise(whole)).alias("c")).select(*keys, "action", "c.*")


def apply_rows(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``(current + added) - removed`` as sets."""
    return current.unionByName(added).distinct().exceptAll(removed.distinct())


def row_changes(base: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``now`` that ``base`` lacks, and the other way round."""
    return now.subtract(base), base.subtract(now)


def dirty_areas(changed: DataFrame, gap: float, by: Sequence[str] = ()) -> DataFrame:
    """Rectangles around changed places ``x, y``, grown by ``gap``."""
    return changed.groupBy(*by).agg((F.min("x") - gap).alias("minx"), (F.min("y") - gap).alias("miny"), (F.max("x") + gap).alias("maxx"), (F.max("y") + gap).alias("maxy"), F.count(F.lit(1)).alias("features"))


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
