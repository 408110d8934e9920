"""Connected components of an undirected graph, by least labels and label shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, staged


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest label of all nodes reachable from each node.

    ``nodes`` has ``node, label`` with labels unique to their node; ``edges`` has ``a, b`` in one
    direction. Each round takes the least label of the neighbours and then the label of the node that
    owned it, so chains shorten; every round is a staged table, and only the number of
    changed labels comes to the driver.
    """
    links = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("src", "dst"), "edges")
    last, now = None, staged(nodes.select("node", "label"), "labels")
    owners = now.withColumnsRenamed({"node": "owner", "label": "near"})
    while True:
        # A node with very many edges, or a label with very many nodes, is spread over tasks.
        heard = spread_join(links, now.withColumnRenamed("node", "src"), "src", "dst").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        nearer = now.join(heard, "node", "left").select("node", "label", F.least("label", F.coalesce("heard", "label")).alias("near"))
        # The label's owner may itself have heard of a smaller one.
        of_owner = now.select(F.col("node").alias("owner"), F.col("label").alias("jump")).join(owners, "owner").select("near", "jump")
        new = spread_join(nearer, of_owner, "near", "node", "left").select(
            "node", F.least("near", F.coalesce("jump", "near")).alias("label"), (F.col("near") != F.col("label")).alias("moved"), "jump"
        )
        new = staged(new, "labels")
        moved = new.filter(F.col("moved") | (F.col("jump") > F.col("label"))).limit(1).count()
        now = new.select("node", "label")
        if last is not None:
            discard(last)
        last = new
        if not moved:
            discard(links)
            return now
