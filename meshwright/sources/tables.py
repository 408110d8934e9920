"""Reading and writing tables: typed CSV, imports by a mapping of fields, key sets and packages of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.identifiers import name_score

#: Texts that count as true in imported tables.
TRUE_TEXTS = ("1", "true", "t", "yes", "y")


def coerced(text: Column, kind: str) -> Column:
    """Text as a value of ``kind``; what doesn't fit, and blanks, are null."""
    trimmed = F.nullif(F.trim(text), F.lit(""))
    if kind == "boolean":
        return F.when(trimmed.isNotNull(), F.lower(trimmed).isin(*TRUE_TEXTS))
    if kind == "date":
        return F.coalesce(trimmed.try_cast("date"), F.try_to_timestamp(trimmed, F.lit("dd.MM.yyyy")).cast("date"))
    if kind in ("int", "long"):
        return trimmed.try_cast("double").try_cast(kind)
    return trimmed if kind == "string" else trimmed.try_cast(kind)


def typed(rows: DataFrame, kinds: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """The columns of ``kinds`` as their types; missing ones are null, or an error if they are ``required``; others are left out."""
    missing = [k for k in required if k not in rows.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {', '.join(missing)}")
    return rows.select(*[(coerced(F.col(c).cast("string"), k) if c in rows.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])


def read_csv(spark: SparkSession, path: str, kinds: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    return typed(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), kinds, required)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as CSV with a header, one file a partition; ``mode`` replaces or appends."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def imported(rows: DataFrame, fields: Mapping[str, str], mapping: DataFrame, value: str) -> DataFrame:
    """``rows`` under the names of ``fields`` (source: target), with ``ag, at`` of their ``value`` by ``mapping`` (value, ag, at)."""
    renamed = rows.select(*[F.col(s).alias(t) for s, t in fields.items()], F.col(value).cast("string").alias("_value"))
    known = mapping.select(F.col("value").alias("_value"), "ag", "at")
    return renamed.join(known, "_value", "left").drop("_value")


def distinct_values(rows: DataFrame, field: str, most: int = 500) -> DataFrame:
    """``value, n``: values of a field, in text order, as a list to choose from."""
    return rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value").limit(most)


def suggested_mapping(values: DataFrame, types: DataFrame, least: float = 0.35) -> DataFrame:
    """``value, ag, at, score``: the type whose names are most like each value; null where the score is below ``least``.

    ``types`` has ``ag, group_name, at, type_name``, a settings table of a few hundred rows; ``values`` are distinct values.
    """
    pairs = values.select("value").join(types)
    scored = pairs.withColumns({"g": name_score("value", "group_name"), "t": name_score("value", "type_name")})
    scored = scored.withColumn("s", F.greatest("g", "t", 0.6 * F.col("g") + 0.6 * F.col("t")))
    best = scored.groupBy("value").agg(F.max_by(F.struct("ag", "at"), F.struct("s", -F.col("ag"), -F.col("at"))).alias("b"), F.max("s").alias("score"))
    fits = F.col("score") >= least
    return best.select("value", F.when(fits, F.col("b.ag")).alias("ag"), F.when(fits, F.col("b.at")).alias("at"), "score")


def dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, position, field, type, nullable, n_rows, n_filled`` of every table; a table is read once, and filled is what isn't null."""
    out = None
    for t, df in tables.items():
        counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f.name).alias(f"f{k}") for k, f in enumerate(df.schema)])
        fields = [
            F.struct(F.lit(k).alias("position"), F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.col("n").alias("n_rows"), F.col(f"f{k}").alias("n_filled"))
            for k, f in enumerate(df.schema)
        ]
        rows = counts.select(F.lit(t).alias("table"), F.explode(F.array(*fields)).alias("f")).select("table", "f.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def attributes_of(features: DataFrame, keys: DataFrame, names: DataFrame) -> DataFrame:
    """Attributes of a set of features (``class, fid``), with the name of their group (``class, ag, name``) and rounded length."""
    found = features.join(keys, ["class", "fid"], "left_semi").join(names, ["class", "ag"], "left")
    return found.withColumn("length", F.round("length", 2))


def rekeyed(rows: DataFrame, ids: DataFrame, sides: Sequence[str]) -> DataFrame:
    """Rows whose ``<side>_class, <side>_fid`` become ``<side>_gid`` by ``ids`` (class, fid, gid); rows with an unknown key go."""
    for side in sides:
        known = ids.select(F.col("class").alias(f"{side}_class"), F.col("fid").alias(f"{side}_fid"), F.col("gid").alias(f"{side}_gid"))
        rows = rows.join(known, [f"{side}_class", f"{side}_fid"]).drop(f"{side}_fid")
    return rows


def write_package(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_package(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
