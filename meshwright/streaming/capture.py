"""Capture of edits made elsewhere, as a stream: state, dirty areas and the rules on what changed.

The feed has one row an edit: ``event`` (its number), ``ts``, the keys, the fields, ``x, y`` and ``gone`` (true for a deletion). Each micro-batch is merged
into a :class:`Store`; its number is noted in the commit, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import versions as ops
from meshwright.sources.registry import DEFAULT, Store

c = F.col
#: Dirty rectangles of one check beyond which one around all takes their place.
MOST_AREAS = 200
NEWEST = "changed_at"


def newest(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last edit of each key, by time and then number."""
    rest = [k for k in edits.columns if k not in keys]
    return edits.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "event")).alias("e")).select(*keys, "e.*")


def merged(state: DataFrame, edits: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The state (``keys, fields, changed_at, gone``) after the edits; one that is older than what is known of its key is passed over.

    Deletions stay as rows marked gone, so that a late edit can't bring a feature back.
    """
    last = newest(edits, keys).select(*keys, *fields, c("ts").alias(NEWEST), "gone")
    both = state.select(*keys, *fields, NEWEST, "gone").withColumn("_new", F.lit(0)).unionByName(last.withColumn("_new", F.lit(1)))
    kept = [*fields, NEWEST, "gone"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct(NEWEST, "_new")).alias("s")).select(*keys, "s.*")


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``keys, kind`` and both places of the features that came, changed or went."""
    live = lambda df: df.filter("not gone")
    found = ops.changes(live(before), live(after), keys, fields)
    at = lambda df, mark: live(df).select(*keys, c("x").alias(f"{mark}x"), c("y").alias(f"{mark}y"))
    return found.join(at(before, "old_"), list(keys), "left").join(at(after, "new_"), list(keys), "left")


def rectangles(changed: DataFrame, gap: float) -> DataFrame:
    """``minx, miny, maxx, maxy`` around both places of each change, grown by the gap; more than 200 become one around all."""
    places = F.array(F.struct(c("old_x").alias("x"), c("old_y").alias("y")), F.struct(c("new_x").alias("x"), c("new_y").alias("y")))
    at = changed.select(F.explode(places).alias("p")).select("p.*").filter("x is not null and y is not null")
    each = at.select((c("x") - gap).alias("minx"), (c("y") - gap).alias("miny"), (c("x") + gap).alias("maxx"), (c("y") + gap).alias("maxy"))
    many = each.limit(MOST_AREAS + 1).count() > MOST_AREAS
    if not many:
        return each
    return each.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def apply_batch(store: Store, edits: DataFrame, batch: str, gap: float, then: Callable[[DataFrame, DataFrame], None] | None = None) -> dict[str, int] | None:
    """Merge one batch of edits into the default of the store; null if this batch is in already.

    ``then`` gets the changes (with kinds and places) and the dirty rectangles. The first state of an empty store reports nothing.
    """
    keys, fields = store.keys, [f for f in store.fields if f not in (NEWEST, "gone")]
    if store.noted(batch):
        return None
    if store.empty():
        first = newest(edits, keys).select(*keys, *fields, c("ts").alias(NEWEST), "gone")
        store.begin(first)
        store.write(DEFAULT, store.read(), note=batch)
        return {ops.INSERT: 0, ops.UPDATE: 0, ops.DELETE: 0}
    before = store.read()
    store.write(DEFAULT, merged(before, edits, keys, fields), note=batch)
    changed = differences(before, store.read(), keys, fields)
    counts = {r.kind: r["count"] for r in changed.groupBy("kind").count().collect()}
    if then is not None:
        then(changed, rectangles(changed, gap))
    return {k: counts.get(k, 0) for k in (ops.INSERT, ops.UPDATE, ops.DELETE)}


def capture(feed: DataFrame, store: Store, checkpoint: str, delay: str = "1 hour", gap: float = 0.001, then: Callable[[DataFrame, DataFrame], None] | None = None, **trigger):
    """Run the feed (a stream) into the store; returns the query. Edits delivered twice within ``delay`` count once."""
    once = feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event"])

    def batch(df: DataFrame, number: int) -> None:
        apply_batch(store, df, f"{checkpoint}:{number}", gap, then)

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def relevant(edits: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Edits (``field`` and what else) that touch the network: geometry, insertions, deletions (null field) and the listed fields."""
    return edits.filter(c("field").isNull() | c("field").isin("@shape", *fields))
