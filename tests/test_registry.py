"""Versions in a store: what is refused, two writers at once, and edits captured from a stream."""

import itertools

import pytest

from meshwright.sources.registry import Conflict, Store, VersionError, slug
from meshwright.streaming import capture as cap

SCHEMA = "gid long, name string, size long"


@pytest.fixture()
def store(spark, tmp_path):
    ticks = (f"2024-01-01T00:00:{k:02d}" for k in itertools.count())
    made = Store(spark, f"file://{tmp_path}/store", ["gid"], ["name", "size"], clock=lambda: next(ticks))
    made.begin(frame(spark, (1, "a", 1), (2, "b", 2), (3, "c", 3)))
    return made


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_slugs():
    assert [slug(" Main St. - Phase 2 "), slug("A" * 50)] == ["main_st_phase_2", "a" * 40]
    for name in (None, "", " -- ", "é"):
        with pytest.raises(VersionError):
            slug(name)


def test_versions_and_their_registry(spark, store):
    assert store.create("Plan A", description="first", access="Private", owner="ana") == "plan_a"
    child = store.create("Plan B", parent="plan_a", access="Nonsense", owner="bo")
    assert store.root_of(child) == "default"
    listed = store.versions().collect()
    assert [(r.name, r.parent, r.access, r.status) for r in listed] == [("plan_a", "default", "Private", "Design"), ("plan_b", "plan_a", "Public", "Design")]
    assert [r.name for r in store.versions(user="bo").collect()] == ["plan_b"]
    for refused in (lambda: store.create("plan-a"), lambda: store.create("x", parent="nowhere"), lambda: store.delete("plan_a"), lambda: store.update("plan_a", status="Odd"), lambda: store.update("plan_a", snapshot="s"), lambda: store.branch("nowhere"), lambda: store.post("default"), lambda: store.begin(store.read())):
        with pytest.raises(VersionError):
            refused()
    store.update("plan_a", status="Review", owner="bo")
    assert store.branch("plan_a").status == "Review"
    store.delete("plan_b")
    store.delete("plan_a")
    assert store.versions().count() == 0


def test_reconcile_and_post(spark, store):
    store.create("v")
    store.write("v", frame(spark, (1, "A", 1), (3, "c", 3), (4, "d", 4)))
    store.write("default", frame(spark, (1, "a", 9), (2, "b", 2), (3, "c", 3)))
    with pytest.raises(Conflict):
        store.post("v")
    assert {r.gid: (r.version_kind, r.parent_kind, r.conflict) for r in store.diff("v").collect()} == {1: ("update", "update", False), 2: ("delete", None, False), 4: ("insert", None, False)}
    store.reconcile("v")
    assert rows(store.read("v")) == [(1, "A", 9), (3, "c", 3), (4, "d", 4)]
    assert store.post("v") == {"insert": 1, "update": 1, "delete": 1}
    assert rows(store.read()) == rows(store.read("v"))
    assert store.diff("v").count() == 0
    assert (store.branch("v").status, store.branch("v").posted_counts) == ("Posted", "1 inserted, 1 updated, 1 deleted")
    assert {(r.gid, r.action, r.field, r.old_value, r.new_value) for r in store.history().collect()} == {(1, "update", "name", "a", "A"), (2, "delete", None, None, None), (4, "insert", None, None, None)}
    assert store.prune() > 0 and rows(store.read()) == rows(store.read("v"))


def test_of_two_posts_at_once_one_is_refused(spark, store):
    for name in ("one", "two"):
        store.create(name)
        store.write(name, frame(spark, (1, name, 1), (2, "b", 2), (3, "c", 3)))
    # While one posts, two does: its commit comes between what one read and what one writes.
    plain = store._commit

    def late(number, entry):
        store._commit = plain
        store.post("two")
        return plain(number, entry)

    store._commit = late
    with pytest.raises(Conflict):
        store.post("one")
    assert rows(store.read())[0] == (1, "two", 1)
    store.reconcile("one")
    assert store.post("one")["update"] == 1 and rows(store.read())[0] == (1, "one", 1)


EDITS = "event long, ts timestamp, gid long, name string, size long, x double, y double, gone boolean"


def edit(n, gid, name, size, gone=False, minute=None):
    from datetime import datetime, timedelta

    return (n, datetime(2024, 1, 1) + timedelta(minutes=n if minute is None else minute), gid, name, size, float(gid), float(size), gone)


def live(store):
    return sorted((r.gid, r.name, r["size"]) for r in store.read().filter("not gone").collect())


def test_captured_edits(spark, tmp_path):
    feed = [
        [edit(1, 1, "a", 1), edit(2, 2, "b", 2)],
        [edit(3, 1, "a2", 5), edit(4, 3, "c", 3), edit(4, 3, "c", 3), edit(5, 2, "b", 2)],
        [edit(6, 2, "b", 2, gone=True), edit(7, 3, "late", 9, minute=2)],
    ]
    store = Store(spark, f"file://{tmp_path}/store", ["gid"], ["name", "size", "x", "y", "changed_at", "gone"])
    source = f"{tmp_path}/feed"
    for k, batch in enumerate(feed):
        spark.createDataFrame(batch, EDITS).coalesce(1).write.mode("append").parquet(f"{source}/batch={k}")
    seen = []

    def then(changed, areas):
        seen.append(({(r.gid, r.kind) for r in changed.collect()}, {tuple(r) for r in areas.collect()}))

    stream = lambda: spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    query = cap.capture(stream(), store, f"{tmp_path}/checkpoint", gap=0.5, then=then)
    query.awaitTermination(120)
    assert live(store) == [(1, "a2", 5), (3, "c", 3)]
    kinds = [s[0] for s in seen if s[0]]
    assert set().union(*kinds) >= {(1, "update"), (3, "insert"), (2, "delete")}
    assert any((0.5, 0.5, 1.5, 1.5) in s[1] and (0.5, 4.5, 1.5, 5.5) in s[1] for s in seen)
    # The same batch again changes nothing.
    before = len(store._commits())
    assert cap.apply_batch(store, spark.createDataFrame(feed[0], EDITS), f"{tmp_path}/checkpoint:0", 0.5) is None
    assert len(store._commits()) == before


def test_first_state_and_many_areas(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", ["gid"], ["name", "size", "x", "y", "changed_at", "gone"])
    first = spark.createDataFrame([edit(k, k, "n", 1) for k in range(250)], EDITS)
    assert cap.apply_batch(store, first, "0", 0.5) == {"insert": 0, "update": 0, "delete": 0}
    areas = []
    second = spark.createDataFrame([edit(300 + k, k, "m", 1) for k in range(250)], EDITS)
    assert cap.apply_batch(store, second, "1", 0.5, lambda changed, found: areas.extend(found.collect())) == {"insert": 0, "update": 250, "delete": 0}
    assert [tuple(r) for r in areas] == [(-0.5, 0.5, 249.5, 1.5)]
    fields = spark.createDataFrame([("name",), ("note",), (None,), ("@shape",)], "field string")
    assert cap.relevant(fields, ["name"]).count() == 3
