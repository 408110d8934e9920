"""Version and audit queries over customers, with edits that follow from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import reports, versions
from meshwright.sources.network_view import ROW, table

KEYS, FIELDS = ("gid",), ("segment", "nation", "cents")
#: Inserted rows have supplier keys beyond this.
BEYOND = 10**12
#: Newest changes that the history page lists.
LATEST = 5000


def base(spark, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("gid"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), cents.alias("cents"))


def version(spark, sf_dir: str) -> DataFrame:
    kept = base(spark, sf_dir).filter("nation <> 3").withColumn("segment", F.when(F.col("cents") < 0, "HOLD").otherwise(F.col("segment")))
    added = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + BEYOND).cast("long").alias("gid"), F.lit("NEW").alias("segment"), F.col("s_nationkey").alias("nation"), F.lit(0).cast("long").alias("cents"))
    return kept.unionByName(added)


def parent(spark, sf_dir: str) -> DataFrame:
    kept = base(spark, sf_dir).filter("not (nation = 5 and segment = 'AUTOMOBILE') and not (nation = 3 and cents < 0)")
    return kept.withColumns(
        {
            "cents": F.when(F.col("segment") == "BUILDING", F.col("cents") + 100).otherwise(F.col("cents")),
            "segment": F.when((F.col("cents") < 0) & (F.col("nation") < 12), "WATCH").when(F.col("nation") == 4, None).otherwise(F.col("segment")),
        }
    )


def _three(spark, sf_dir):
    return base(spark, sf_dir), version(spark, sf_dir), parent(spark, sf_dir), KEYS, FIELDS


def version_diff(spark, sf_dir):
    return versions.diff(*_three(spark, sf_dir))


def version_conflicts(spark, sf_dir):
    return versions.diff(*_three(spark, sf_dir)).filter("conflict").groupBy("version_kind", "parent_kind", "conflict_fields").agg(F.count(F.lit(1)).alias("n"))


def version_tallies(spark, sf_dir):
    return versions.tallies(versions.diff(*_three(spark, sf_dir)))


def reconcile_result(spark, sf_dir):
    return versions.reconcile(*_three(spark, sf_dir))


def reconcile_for_parent(spark, sf_dir):
    return versions.reconcile(*_three(spark, sf_dir), favor="parent")


def post_result(spark, sf_dir):
    b, v, p, keys, fields = _three(spark, sf_dir)
    return versions.post(p, p, versions.reconcile(b, v, p, keys, fields), keys, fields)


def audit_unpivot(spark, sf_dir):
    return versions.audit(base(spark, sf_dir), version(spark, sf_dir), KEYS, FIELDS)


def external_edits(spark, sf_dir):
    return versions.changes(base(spark, sf_dir), parent(spark, sf_dir), KEYS, FIELDS)


def dirty_areas(spark, sf_dir):
    changed = external_edits(spark, sf_dir).withColumns({"x": (F.col("gid") % ROW * 10).cast("double"), "y": (F.floor(F.col("gid") / ROW) * 10).cast("double")})
    return versions.dirty_areas(changed, 0.5, ["kind"])


def edit_history_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("change_id"), F.col("ts").alias("changed_at"), "user_id", F.col("event_type").alias("action"))
    return reports.latest(events, LATEST).select("change_id", "user_id", "action")


def row_set_changes(spark, sf_dir):
    """Associations between nations and segments that the version adds or removes."""
    now, was = (f(spark, sf_dir).select("nation", "segment") for f in (version, base))
    added, removed = versions.row_changes(was, now)
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


_SNAPSHOTS = f"""base AS (SELECT CAST(c_custkey AS BIGINT) AS gid, c_mktsegment AS segment, c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer),
version AS (SELECT gid, CASE WHEN cents < 0 THEN 'HOLD' ELSE segment END AS segment, nation, cents FROM base WHERE nation <> 3
  UNION ALL SELECT s_suppkey + {BEYOND}, 'NEW', s_nationkey, 0 FROM supplier),
parent AS (SELECT gid, CASE WHEN cents < 0 AND nation < 12 THEN 'WATCH' WHEN nation = 4 THEN NULL ELSE segment END AS segment, nation,
  CASE WHEN segment = 'BUILDING' THEN cents + 100 ELSE cents END AS cents FROM base WHERE NOT (nation = 5 AND segment = 'AUTOMOBILE') AND NOT (nation = 3 AND cents < 0)),
three AS (SELECT gid, b.gid IS NOT NULL AS hb, v.gid IS NOT NULL AS hv, p.gid IS NOT NULL AS hp, b.segment AS bs, v.segment AS vs, p.segment AS ps, b.nation AS bn, v.nation AS vn, p.nation AS pn,
  b.cents AS bc, v.cents AS vc, p.cents AS pc FROM base b FULL JOIN version v USING (gid) FULL JOIN parent p USING (gid)),
kinds AS (SELECT *, CASE WHEN NOT hb AND hv THEN 'insert' WHEN hb AND NOT hv THEN 'delete' WHEN hb AND (bs, bn, bc) IS DISTINCT FROM (vs, vn, vc) THEN 'update' END AS version_kind,
  CASE WHEN NOT hb AND hp THEN 'insert' WHEN hb AND NOT hp THEN 'delete' WHEN hb AND (bs, bn, bc) IS DISTINCT FROM (ps, pn, pc) THEN 'update' END AS parent_kind FROM three),
fields AS (SELECT *, version_kind = 'update' AND parent_kind = 'update' AS two, bs IS DISTINCT FROM vs AS ms, bn IS DISTINCT FROM vn AS mn, bc IS DISTINCT FROM vc AS mc,
  bs IS DISTINCT FROM ps AS qs, bn IS DISTINCT FROM pn AS qn, bc IS DISTINCT FROM pc AS qc FROM kinds WHERE version_kind IS NOT NULL OR parent_kind IS NOT NULL),
named AS (SELECT *, concat_ws(',', CASE WHEN two AND mc AND qc AND vc IS DISTINCT FROM pc THEN 'cents' END, CASE WHEN two AND mn AND qn AND vn IS DISTINCT FROM pn THEN 'nation' END,
  CASE WHEN two AND ms AND qs AND vs IS DISTINCT FROM ps THEN 'segment' END) AS conflict_fields,
  concat_ws(',', CASE WHEN two AND qc AND NOT mc THEN 'cents' END, CASE WHEN two AND qn AND NOT mn THEN 'nation' END, CASE WHEN two AND qs AND NOT ms THEN 'segment' END) AS merged_fields FROM fields),
differences AS (SELECT gid, version_kind, parent_kind, CASE WHEN coalesce(two, FALSE) THEN conflict_fields <> '' ELSE version_kind IS NOT NULL AND parent_kind IS NOT NULL
  AND (hv <> hp OR (hv AND hp AND (vs, vn, vc) IS DISTINCT FROM (ps, pn, pc))) END AS conflict, conflict_fields, merged_fields FROM named)"""


def _reconciled(first: str, second: str) -> str:
    pick = lambda f: f"CASE WHEN b{f} IS DISTINCT FROM {first}{f} THEN {first}{f} ELSE {second}{f} END"
    moved = f"(hb <> h{first} OR (hb AND h{first} AND (bs, bn, bc) IS DISTINCT FROM ({first}s, {first}n, {first}c)))"
    value = lambda f: f"CASE WHEN hb AND hv AND hp THEN {pick(f)} WHEN {moved} THEN {first}{f} ELSE {second}{f} END"
    return f"""WITH {_SNAPSHOTS} SELECT gid, {value('s')} AS segment, {value('n')} AS nation, {value('c')} AS cents FROM three
    WHERE CASE WHEN hb AND hv AND hp THEN TRUE WHEN {moved} THEN h{first} ELSE h{second} END"""


_OLD_NEW = "two_ways AS (SELECT gid, hb, hv, bs, vs, bn, vn, bc, vc, version_kind AS action FROM kinds WHERE version_kind IS NOT NULL)"

QUERIES = {
    "version_diff": (version_diff, f"WITH {_SNAPSHOTS} SELECT * FROM differences"),
    "version_conflicts": (version_conflicts, f"WITH {_SNAPSHOTS} SELECT version_kind, parent_kind, conflict_fields, count(*) AS n FROM differences WHERE conflict GROUP BY ALL"),
    "version_tallies": (
        version_tallies,
        f"""WITH {_SNAPSHOTS} SELECT 'version' AS side, version_kind AS kind, count(*) AS n FROM differences WHERE version_kind IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'parent', parent_kind, count(*) FROM differences WHERE parent_kind IS NOT NULL GROUP BY ALL""",
    ),
    "reconcile_result": (reconcile_result, _reconciled("v", "p")),
    "reconcile_for_parent": (reconcile_for_parent, _reconciled("p", "v")),
    "post_result": (post_result, _reconciled("v", "p")),
    "audit_unpivot": (
        audit_unpivot,
        f"""WITH {_SNAPSHOTS}, {_OLD_NEW} SELECT gid, action, NULL AS field, NULL AS old_value, NULL AS new_value FROM two_ways WHERE action <> 'update'
        UNION ALL SELECT gid, action, 'segment', bs, vs FROM two_ways WHERE action = 'update' AND bs IS DISTINCT FROM vs
        UNION ALL SELECT gid, action, 'nation', bn::VARCHAR, vn::VARCHAR FROM two_ways WHERE action = 'update' AND bn IS DISTINCT FROM vn
        UNION ALL SELECT gid, action, 'cents', bc::VARCHAR, vc::VARCHAR FROM two_ways WHERE action = 'update' AND bc IS DISTINCT FROM vc""",
    ),
    "external_edits": (external_edits, f"WITH {_SNAPSHOTS} SELECT gid, parent_kind AS kind FROM kinds WHERE parent_kind IS NOT NULL"),
    "dirty_areas": (
        dirty_areas,
        f"""WITH {_SNAPSHOTS}, spots AS (SELECT parent_kind AS kind, CAST(gid % {ROW} * 10 AS DOUBLE) AS x, CAST(gid // {ROW} * 10 AS DOUBLE) AS y FROM kinds WHERE parent_kind IS NOT NULL)
        SELECT kind, min(x) - 0.5 AS minx, min(y) - 0.5 AS miny, max(x) + 0.5 AS maxx, max(y) + 0.5 AS maxy, count(*) AS features FROM spots GROUP BY kind""",
    ),
    "edit_history_latest": (edit_history_latest, f"SELECT event_id AS change_id, user_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT {LATEST}"),
    "row_set_changes": (
        row_set_changes,
        f"""WITH {_SNAPSHOTS} SELECT *, 'added' AS change FROM (SELECT nation, segment FROM version EXCEPT SELECT nation, segment FROM base)
        UNION ALL SELECT *, 'removed' FROM (SELECT nation, segment FROM base EXCEPT SELECT nation, segment FROM version)""",
    ),
}
