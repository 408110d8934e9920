"""Risk and components over lines of every class, on a network worked out by hand."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from meshwright.operators import reports, traces
from meshwright.plans.graph_queries import component_sizes
from meshwright.plans.report_queries import with_losses

from .test_network import network


def test_every_line_is_scored(spark):
    points = [(1, "source", False), (2, "isolating", False), (3, None, False), (4, "customer", False), (7, None, False), (8, None, False), (9, None, False)]
    net = network(spark, points, [(1, 2), (2, 3), (3, 4), (7, 8)])
    lines = net.edges.withColumn("class", F.when(F.col("eid") == 3, "Mesh").otherwise("Feeder")).withColumn("built", F.lit(2000))
    lost = traces.criticality(net).drop("class").join(lines.select("fid", "class"), "fid").select("class", "fid", "customers")
    got = {(r["class"], r.fid): r.customers for r in reports.risk(with_losses(lines, lost), 2026, F.lit(50)).collect()}
    assert got == {("Feeder", 0): 1, ("Feeder", 1): 1, ("Feeder", 2): 1, ("Mesh", 3): 0}
    assert {tuple(r) for r in component_sizes(net).collect()} == {(1, 4), (7, 2), (9, 1)}
    assert {"risk_scores_all", "risk_ranking_all", "all_components"} <= set(queries())
