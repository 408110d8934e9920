"""Sweeping is heavy for its bytes, so small tables must not leave it to one task."""

from meshwright.operators import overlay
from pyspark.sql import functions as F


def test_cells_are_swept_by_all_partitions(spark):
    corner = lambda x, y: F.struct(F.lit(x).cast("double") + F.col("id") * 10, F.lit(y).cast("double"))
    ring = F.array(*[corner(x, y) for x, y in ((0, 0), (6, 0), (6, 6), (0, 6))]).cast("array<struct<x:double,y:double>>")
    boxes = spark.range(0, 40, 1, 1).select(F.lit(0).alias("layer"), F.col("id").alias("area"), ring.alias("ring"))
    swept = overlay.swept(boxes, 17.0, "pair", "bare", layers=2)
    tasks = swept.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1 and swept.groupBy("one").agg(F.sum("area")).filter("abs(`sum(area)` - 36) > 1e-6").count() == 0
