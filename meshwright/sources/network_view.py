"""A utility network laid over the star-schema tables.

==========  ==========================  =======================================
class       from                        role
==========  ==========================  =======================================
Source      region                      source device, tier Transmission
Valve       nation                      isolating device, closed on every seventh key
Station     supplier                    plain device
Meter       customer                    customer device
Joint       part                        junction
Trunk       region - nation             line, tier Transmission
Feeder      nation - supplier           line, tier Distribution
Service     nation - customer           line, service
Mesh        supplier - part             line, one for each pair in lineitem
==========  ==========================  =======================================

``node`` is a number that is unique over all classes. Coordinates lie on a lattice with an own
strip for each class; a line's ends have the coordinates of the points it joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of one class have numbers from its place here times this.
STRIDE = 10**12
POINT_CLASSES = ("Source", "Valve", "Station", "Meter", "Joint")
LINE_CLASSES = ("Trunk", "Feeder", "Service", "Mesh")
#: A line's number within class Mesh: supplier times this, plus part.
PAIR = 10**9
#: Points on one row of the lattice, and the distance of the strips.
ROW, STRIP = 1000, 10**7


def node(kind: str, key: Column) -> Column:
    return key.cast("long") + F.lit((POINT_CLASSES.index(kind) + 1) * STRIDE)


def _xy(kind: str, key: Column) -> list[Column]:
    key = key.cast("long")
    return [
        ((key % ROW) * 10).cast("double").alias("x"),
        (F.floor(key / ROW) * 10 + POINT_CLASSES.index(kind) * STRIP).cast("double").alias("y"),
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, class, fid, x, y, ag, at, closed, assetid, lifecycle, categories, attrs``."""

    def of(kind: str, source: str, key: str, ag: Column, at: Column, closed: Column, name: str, life: Column, categories: str, attrs: Column) -> DataFrame:
        t = table(spark, sf_dir, source)
        k = F.col(key)
        return t.select(
            node(kind, k).alias("node"), F.lit(kind).alias("class"), k.cast("long").alias("fid"), *_xy(kind, k),
            ag.cast("int").alias("ag"), at.cast("int").alias("at"), closed.alias("closed"), F.col(name).alias("assetid"),
            life.cast("int").alias("lifecycle"), F.array(*map(F.lit, categories.split())).cast("array<string>").alias("categories"), attrs.alias("attrs"),
        )

    no_attrs = F.create_map().cast("map<string,string>")
    no = F.lit(False)
    return (
        of("Source", "region", "r_regionkey", F.lit(1), F.lit(1), no, "r_name", F.lit(3), "source", no_attrs)
        .unionByName(of("Valve", "nation", "n_nationkey", F.lit(2), F.col("n_regionkey") + 1, F.col("n_nationkey") % 7 == 0, "n_name", F.lit(3), "isolating", no_attrs))
        .unionByName(
            of("Station", "supplier", "s_suppkey", F.lit(3), F.lit(1), no, "s_name", F.when(F.col("s_acctbal") < 0, 4).otherwise(3), "main",
               F.create_map(F.lit("balance"), F.col("s_acctbal").cast("string")))
        )
        .unionByName(
            of("Meter", "customer", "c_custkey", F.lit(4), F.lit(1), no, "c_name", F.when(F.col("c_acctbal") < 0, 4).otherwise(3), "customer",
               F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("segment"), F.col("c_mktsegment")))
        )
        .unionByName(
            of("Joint", "part", "p_partkey", F.lit(5), F.col("p_size") % 5 + 1, no, "p_name", F.lit(3), "main",
               F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
        )
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier and part that meet in lineitem."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.max("l_quantity").alias("size"), F.min("l_shipdate").alias("first_ship"), F.min("l_linestatus").alias("status")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``class, fid, a, b, ag, size, lifecycle, tier, reverse, built, length``: a line joins node a to node b."""

    def of(kind: str, rows: DataFrame, fid: Column, a: tuple, b: tuple, size: Column, life: Column, tier: Column, built: Column) -> DataFrame:
        (ka, ca), (kb, cb) = a, b
        (xa, ya), (xb, yb) = _xy(ka, ca), _xy(kb, cb)
        return rows.select(
            F.lit(kind).alias("class"), fid.cast("long").alias("fid"), node(ka, ca).alias("a"), node(kb, cb).alias("b"),
            F.lit(LINE_CLASSES.index(kind) + 1).alias("ag"), size.cast("double").alias("size"), life.cast("int").alias("lifecycle"), tier.cast("string").alias("tier"),
            (fid % 11 == 0).alias("reverse"), built.cast("int").alias("built"),
            F.sqrt(F.pow(xa - xb, 2) + F.pow(ya - yb, 2)).alias("length"),
            xa.alias("xa"), ya.alias("ya"), xb.alias("xb"), yb.alias("yb"),
            F.create_map(F.lit("built"), built.cast("string"), F.lit("bore"), size.cast("string")).alias("attrs"),
        )

    c = F.col
    none = F.lit(None)
    return (
        of("Trunk", table(spark, sf_dir, "nation"), c("n_nationkey"), ("Source", c("n_regionkey")), ("Valve", c("n_nationkey")), F.lit(600), F.lit(3), F.lit("Transmission"), F.lit(1980))
        .unionByName(of("Feeder", table(spark, sf_dir, "supplier"), c("s_suppkey"), ("Valve", c("s_nationkey")), ("Station", c("s_suppkey")), c("s_suppkey") % 7 * 50 + 100, F.lit(3), F.lit("Distribution"), c("s_suppkey") % 40 + 1980))
        .unionByName(of("Service", table(spark, sf_dir, "customer"), c("c_custkey"), ("Valve", c("c_nationkey")), ("Meter", c("c_custkey")), F.lit(25), F.when(c("c_custkey") % 13 == 0, 4).otherwise(3), none, none))
        .unionByName(
            of("Mesh", pairs(spark, sf_dir), c("l_suppkey").cast("long") * PAIR + c("l_partkey"), ("Station", c("l_suppkey")), ("Joint", c("l_partkey")), c("size"),
               F.when(c("status") == "O", 2).otherwise(3), none, F.year("first_ship"))
        )
    )


#: The same two tables in SQL, for the oracles: ``points`` and ``lines`` as common table expressions.
VIEW_SQL = f"""
points AS MATERIALIZED (
  SELECT {STRIDE} + r_regionkey AS node, 'Source' AS class, CAST(r_regionkey AS BIGINT) AS fid, 1 AS ag, 1 AS at, FALSE AS closed, r_name AS assetid, 3 AS lifecycle,
         NULL::DOUBLE AS balance, NULL::VARCHAR AS segment, NULL::DOUBLE AS psize, NULL::VARCHAR AS brand FROM region
  UNION ALL SELECT {2 * STRIDE} + n_nationkey, 'Valve', n_nationkey, 2, n_regionkey + 1, n_nationkey % 7 = 0, n_name, 3, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT {3 * STRIDE} + s_suppkey, 'Station', s_suppkey, 3, 1, FALSE, s_name, CASE WHEN s_acctbal < 0 THEN 4 ELSE 3 END, s_acctbal, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT {4 * STRIDE} + c_custkey, 'Meter', c_custkey, 4, 1, FALSE, c_name, CASE WHEN c_acctbal < 0 THEN 4 ELSE 3 END, c_acctbal, c_mktsegment, NULL, NULL FROM customer
  UNION ALL SELECT {5 * STRIDE} + p_partkey, 'Joint', p_partkey, 5, p_size % 5 + 1, FALSE, p_name, 3, NULL, NULL, p_size, p_brand FROM part
),
places AS MATERIALIZED (
  SELECT node, class, fid, CAST((fid % {ROW}) * 10 AS DOUBLE) AS x,
         CAST((fid // {ROW}) * 10 + CAST((node // {STRIDE} - 1) AS BIGINT) * {STRIP} AS DOUBLE) AS y FROM points
),
bare AS MATERIALIZED (
  SELECT 'Trunk' AS class, CAST(n_nationkey AS BIGINT) AS fid, {STRIDE} + n_regionkey AS a, {2 * STRIDE} + n_nationkey AS b, 1 AS ag, 600.0::DOUBLE AS size, 3 AS lifecycle, 'Transmission' AS tier, 1980 AS built FROM nation
  UNION ALL SELECT 'Feeder', s_suppkey, {2 * STRIDE} + s_nationkey, {3 * STRIDE} + s_suppkey, 2, s_suppkey % 7 * 50 + 100, 3, 'Distribution', s_suppkey % 40 + 1980 FROM supplier
  UNION ALL SELECT 'Service', c_custkey, {2 * STRIDE} + c_nationkey, {4 * STRIDE} + c_custkey, 3, 25, CASE WHEN c_custkey % 13 = 0 THEN 4 ELSE 3 END, NULL, NULL FROM customer
  UNION ALL SELECT 'Mesh', l_suppkey * {PAIR} + l_partkey, {3 * STRIDE} + l_suppkey, {5 * STRIDE} + l_partkey, 4, max(l_quantity), CASE WHEN min(l_linestatus) = 'O' THEN 2 ELSE 3 END, NULL, year(min(l_shipdate)) FROM lineitem GROUP BY l_suppkey, l_partkey
),
lines AS MATERIALIZED (
  SELECT bare.*, bare.fid % 11 = 0 AS reverse, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS length
  FROM bare JOIN places p ON p.node = a JOIN places q ON q.node = b
)
"""
