"""Edges are moved once, not in every round, and parents at no distance make no circle."""

from pyspark.sql import functions as F

from meshwright.operators import graph
from meshwright.plans.staging import dealt


def test_joins_on_dealt_rows_move_the_other_side_only(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst"))
    files = dealt(rows, "src", many=0)
    assert sorted(files.collect()) == sorted(rows.collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    front = spark.range(20).withColumnRenamed("id", "node")
    met = front.join(files, front["node"] == files["src"])
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 400
    assert plan.count("Exchange hashpartitioning") == 1


def test_parents_over_edges_without_length_make_no_circle(spark):
    edges = spark.createDataFrame([(5, 9, "a", 0.0), (9, 3, "b", 0.0), (3, 1, "c", 2.0), (9, 1, "d", 2.0)], "a long, b long, line string, weight double")
    ways = graph.both_ways(edges, "line", "weight")
    starts = spark.createDataFrame([(5,)], "node long")
    got = {r["node"]: (r["dist"], r["parent"], r["via"]) for r in graph.distances(ways, starts).collect()}
    assert got == {5: (0.0, None, None), 9: (0.0, 5, "a"), 3: (0.0, 9, "b"), 1: (2.0, 3, "c")}
    assert {r["node"]: r["dist"] for r in graph.lengths(ways, starts).collect()} == {k: v[0] for k, v in got.items()}


def test_edges_of_a_search_without_walls_take_one_join(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 3, 2), (3, 4, 5), (4, None, 1)], "eid long, a long, b long")
    starts = spark.createDataFrame([(3,)], "node long")
    reached = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    got = graph.crossed_edges(edges, reached, None, starts)
    assert sorted(r["eid"] for r in got.collect()) == [1, 2, 4]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
