"""Queries over the versioned store: a version that is reconciled and posted, its audit, and edits captured from a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshwright.plans import version_queries as vq
from meshwright.plans.staging import shared_folder
from meshwright.sources.network_view import table
from meshwright.sources.registry import Store
from meshwright.streaming import capture as cap

c = F.col
#: Edits are never late by more than this; the feed's files may come in any order.
DELAY = "60 days"
FILES = 8


def _store(spark, fields) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", ["gid"], list(fields))


def _posted(spark, sf_dir) -> Store:
    store = _store(spark, vq.FIELDS)
    store.begin(vq.base(spark, sf_dir))
    store.create("design")
    store.write("design", vq.version(spark, sf_dir))
    store.write("default", vq.parent(spark, sf_dir))
    store.reconcile("design")
    store.post("design")
    return store


def store_post(spark, sf_dir):
    """The default after a version took its changes in and was posted."""
    return _posted(spark, sf_dir).read()


def store_history(spark, sf_dir):
    """What the post changed in the default, counted by action and field."""
    return _posted(spark, sf_dir).history().groupBy("action", "field").agg(F.count(F.lit(1)).alias("n"))


def captured_edits(spark, sf_dir):
    """Features after all edits of the event feed went through the stream; errors stand for deletions."""
    events = table(spark, sf_dir, "events").select(
        c("event_id").alias("event"), c("ts").cast("timestamp").alias("ts"), c("user_id").alias("gid"), c("event_type").alias("name"), c("value").alias("size"),
        c("user_id").cast("double").alias("x"), c("value").alias("y"), (c("event_type") == "error").alias("gone"),
    )
    top = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    events.repartitionByRange(FILES, "ts").write.parquet(f"{top}/edits")
    store = _store(spark, ("name", "size", "x", "y", cap.NEWEST, "gone"))
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{top}/edits")
    cap.capture(feed, store, f"{top}/checkpoint", DELAY).awaitTermination()
    return store.read().filter("not gone").select("gid", "name", "size", c(cap.NEWEST).alias("changed_at"))


_AFTER = vq.QUERIES["reconcile_result"][1]
_MOVED = " UNION ALL ".join(
    f"SELECT 'update' AS action, '{f}' AS field, count(*) AS n FROM after a JOIN before b USING (gid) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in vq.FIELDS
)

QUERIES = {
    "store_post": (store_post, _AFTER),
    "store_history": (
        store_history,
        f"""WITH {vq._SNAPSHOTS}, before AS (SELECT * FROM parent), after AS ({_AFTER}),
        told AS ({_MOVED} UNION ALL SELECT 'insert', NULL, count(*) FROM after ANTI JOIN before USING (gid) UNION ALL SELECT 'delete', NULL, count(*) FROM before ANTI JOIN after USING (gid))
        SELECT * FROM told WHERE n > 0""",
    ),
    "captured_edits": (
        captured_edits,
        """SELECT user_id AS gid, event_type AS name, value AS size, ts AS changed_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""",
    ),
}
