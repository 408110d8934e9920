"""Report and validation queries over the network view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators import reports, rules
from meshwright.plans.graph_queries import criticality
from meshwright.sources import network_view as nv

#: class, group, type, size, price, unit in the order in which they are looked up; null fits everything.
PRICES = (
    ("Trunk", 1, None, None, 120.0, "m"),
    ("Feeder", 2, None, None, 60.0, "m"),
    ("Feeder", 2, 1, 150.0, 75.0, "m"),
    ("Service", 3, None, 25.0, 0.0, "m"),
    ("Mesh", 4, None, 10.0, 8.0, "m"),
    ("Mesh", 4, None, 10.0, 9.0, "m"),
    ("Meter", 4, None, None, 80.0, "pc"),
    ("Meter", 4, 1, None, 90.0, "pc"),
    ("Joint", 5, 2, None, 12.0, "pc"),
)
#: Allowed connections: two kinds of class and group in text order.
RULES = (("Source", 1, "Trunk", 1), ("Trunk", 1, "Valve", 2), ("Feeder", 2, "Valve", 2), ("Feeder", 2, "Station", 3), ("Meter", 4, "Service", 3), ("Joint", 5, "Mesh", 4))
AS_OF_YEAR, LIFE, TODAY = 2026, 50, "1998-01-01"


def features(spark, sf_dir: str) -> DataFrame:
    p = nv.points(spark, sf_dir)
    of_points = p.select(
        "class", F.when(F.col("class") == "Joint", "Junction").otherwise("Device").alias("role"), "fid", "ag", "at", F.lit(None).cast("double").alias("size"),
        F.lit(None).cast("long").alias("length"), "lifecycle", "assetid", F.col("attrs")["segment"].alias("segment"),
    )
    none = F.lit(None).cast("string")
    of_lines = nv.lines(spark, sf_dir).select(
        "class", F.lit("Line").alias("role"), "fid", "ag", F.lit(1).alias("at"), "size", F.round("length").cast("long").alias("length"), "lifecycle", none.alias("assetid"), none.alias("segment")
    )
    return of_points.unionByName(of_lines)


def prices(spark) -> DataFrame:
    rows = [(*row, k) for k, row in enumerate(PRICES)]
    return spark.createDataFrame(rows, "class string, ag int, at int, size double, price double, unit string, price_row int")


def asset_summary(spark, sf_dir):
    return reports.summary(features(spark, sf_dir)).drop("level")


def bill_of_quantities(spark, sf_dir):
    return reports.quantities(features(spark, sf_dir))


def quantities_in_service(spark, sf_dir):
    return reports.quantities(features(spark, sf_dir), lifecycle=(3,))


def cost_estimate(spark, sf_dir):
    return reports.cost_estimate(reports.quantities(features(spark, sf_dir)), prices(spark))


def unpriced_combos(spark, sf_dir):
    return reports.unpriced(features(spark, sf_dir), prices(spark))


def completeness(spark, sf_dir):
    return reports.completeness(features(spark, sf_dir), ("assetid", "size", "segment", "lifecycle"))


def required_empty(spark, sf_dir):
    return reports.required_empty(features(spark, sf_dir), {"Meter": ("assetid", "segment"), "Station": ("segment",), "Trunk": ("size", "assetid")})


def lifecycle_histogram(spark, sf_dir):
    return features(spark, sf_dir).groupBy("class", "lifecycle").agg(F.count(F.lit(1)).alias("n"))


def duplicate_ids(spark, sf_dir):
    return reports.duplicate_ids(features(spark, sf_dir))


def work_orders(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Open").otherwise("In progress")
    return nv.table(spark, sf_dir, "orders").select(status.alias("status"), F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"))


def work_order_stats(spark, sf_dir):
    return reports.work_order_stats(work_orders(spark, sf_dir), F.to_date(F.lit(TODAY)))


def missing_rules(spark, sf_dir):
    allowed = spark.createDataFrame(list(RULES), "one_class string, one_ag int, other_class string, other_ag int")
    return rules.missing(fittings(spark, sf_dir), nv.lines(spark, sf_dir), allowed)


def learned_rules(spark, sf_dir):
    allowed = spark.createDataFrame(list(RULES), "one_class string, one_ag int, other_class string, other_ag int")
    return rules.learned(fittings(spark, sf_dir), nv.lines(spark, sf_dir), allowed)


def fittings(spark, sf_dir) -> DataFrame:
    """Points of the view without every third joint: there lines meet at a bare node."""
    return nv.points(spark, sf_dir).filter("not (class = 'Joint' and fid % 3 = 0)")


def size_changes(spark, sf_dir):
    """Sizes that differ where lines meet at a bare node; services don't count."""
    return rules.size_changes(fittings(spark, sf_dir), nv.lines(spark, sf_dir), ["Service"])


def cost_total(spark, sf_dir):
    return reports.cost_total(cost_estimate(spark, sf_dir))


def fed_lines(spark, sf_dir) -> DataFrame:
    """Lines with the customers of the nation they serve."""
    served = nv.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    lines = nv.lines(spark, sf_dir).filter(F.col("class").isin("Trunk", "Feeder", "Service"))
    nation = F.when(F.col("class") == "Trunk", F.col("b")).otherwise(F.col("a")) - 2 * nv.STRIDE
    condition = F.when(F.col("lifecycle") == 4, 5)
    return lines.select("class", "fid", "built", nation.alias("nation"), condition.alias("condition")).join(served, "nation", "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


def risk_scores(spark, sf_dir):
    return reports.risk(fed_lines(spark, sf_dir), AS_OF_YEAR, F.lit(LIFE))


def risk_ranking(spark, sf_dir):
    return reports.ranked(risk_scores(spark, sf_dir)).select("priority", "class", "fid", "score", "risk")


def with_losses(lines: DataFrame, lost: DataFrame) -> DataFrame:
    """All ``lines`` with the customers that each cuts off by ``lost`` (``class, fid, customers``), zero where none."""
    condition = F.when(F.col("lifecycle") == 4, 5)
    lines = lines.select("class", "fid", "built", condition.alias("condition")).join(lost, ["class", "fid"], "left")
    return lines.withColumn("customers", F.coalesce("customers", F.lit(0)))


def risk_scores_all(spark, sf_dir):
    """Lines of every class, Mesh included, by the customers that are cut off without them."""
    return reports.risk(with_losses(nv.lines(spark, sf_dir), criticality(spark, sf_dir)), AS_OF_YEAR, F.lit(LIFE))


def risk_ranking_all(spark, sf_dir):
    return reports.ranked(risk_scores_all(spark, sf_dir)).select("priority", "class", "fid", "score", "risk")


def next_ids(spark, sf_dir):
    """Identifiers for customers by nation, going on after those that suppliers hold; some ids end in more digits than their number has."""
    key = F.col("s_suppkey")
    number = F.when(key % 10 == 0, F.concat(F.lit("7"), F.lpad((key % 1000).cast("string"), 6, "0"))).otherwise(F.lpad(key.cast("string"), 6, "0"))
    existing = nv.table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.char(65 + F.col("s_nationkey")), F.lit("-"), number).alias("assetid"))
    wanted = nv.table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.char(65 + F.col("c_nationkey")), F.when(F.col("c_custkey") % 4 == 0, "-7").otherwise("-")).alias("prefix"), F.col("c_custkey").alias("key"))
    return reports.next_ids(existing, wanted)


_FEATURES = """features AS (SELECT class, CASE class WHEN 'Joint' THEN 'Junction' ELSE 'Device' END AS role, fid, ag, "at", NULL::DOUBLE AS size, NULL::BIGINT AS length, lifecycle, assetid, segment FROM points
UNION ALL SELECT class, 'Line', fid, ag, 1, size, CAST(round(length) AS BIGINT), lifecycle, NULL, NULL FROM lines)"""
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in (*row, k)) + ")" for k, row in enumerate(PRICES))
_PRICES = f'prices(class, ag, "at", size, price, unit, price_row) AS (VALUES {_VALUES})'
_QUANTITIES = 'quantities AS (SELECT role, class, ag, "at", size, count(*) AS pieces, CAST(sum(length) AS BIGINT) AS length FROM features GROUP BY ALL)'
_ALLOWED = "allowed(one_class, one_ag, other_class, other_ag) AS (VALUES " + ", ".join(map(repr, RULES)) + ")"
_PAIRS = """fit AS (SELECT * FROM points WHERE NOT (class = 'Joint' AND fid % 3 = 0)), ends AS (SELECT class, ag, fid, a AS node FROM lines UNION ALL SELECT class, ag, fid, b FROM lines),
met AS (SELECT e.node, e.class, e.ag, e.fid, p.class AS c2, p.ag AS g2 FROM ends e JOIN fit p USING (node)
  UNION ALL SELECT e.node, e.class, e.ag, least(e.fid, o.fid), o.class, o.ag FROM ends e JOIN ends o ON e.node = o.node AND (e.class, e.fid) < (o.class, o.fid) WHERE e.node NOT IN (SELECT node FROM fit)),
pairs AS (SELECT node, least((class, ag), (c2, g2)) AS p, greatest((class, ag), (c2, g2)) AS q, min(fid) AS fid FROM met GROUP BY ALL),
named AS (SELECT node, p[1] AS one_class, p[2] AS one_ag, q[1] AS other_class, q[2] AS other_ag, fid FROM pairs),
bad AS (SELECT * FROM named ANTI JOIN allowed USING (one_class, one_ag, other_class, other_ag))"""
_FED = f"""served AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1),
fed AS (SELECT class, fid, built, CASE WHEN lifecycle = 4 THEN 5 ELSE 1 END AS condition, coalesce(customers, 0) AS customers FROM lines
  LEFT JOIN served ON nation = CASE WHEN class = 'Trunk' THEN b ELSE a END - {2 * nv.STRIDE} WHERE class IN ('Trunk', 'Feeder', 'Service')),
aged AS (SELECT *, ({AS_OF_YEAR} - built) / {LIFE}.0 AS used FROM fed),
scored AS (SELECT class, fid, customers, greatest(CASE WHEN built IS NULL THEN 3 WHEN used >= 1 THEN 5 WHEN used >= 0.75 THEN 4 WHEN used >= 0.5 THEN 3 WHEN used >= 0.25 THEN 2 ELSE 1 END, condition) AS likelihood,
  CAST(least(5, 1 + floor(4 * customers / (SELECT max(customers) FROM fed)::DOUBLE + 0.999)) AS INTEGER) AS consequence FROM aged),
risks AS (SELECT *, likelihood * consequence AS score, CASE WHEN likelihood * consequence <= 4 THEN 'Low' WHEN likelihood * consequence <= 9 THEN 'Medium' WHEN likelihood * consequence <= 15 THEN 'High' ELSE 'Very high' END AS risk FROM scored)"""
_V = f"WITH {nv.VIEW_SQL}, {_FEATURES}"


def _filled(field: str) -> str:
    return f"SELECT class, '{field}' AS field, count(CASE WHEN {field} IS NOT NULL AND CAST({field} AS VARCHAR) <> '' THEN 1 END) AS filled, count(*) AS total FROM features GROUP BY class"


QUERIES = {
    "asset_summary": (asset_summary, _V + ' SELECT class, role, ag, "at", count(*) AS n, CAST(sum(length) AS BIGINT) AS length FROM features GROUP BY GROUPING SETS ((class, role, ag, "at"), (class, role), ())'),
    "bill_of_quantities": (bill_of_quantities, f"{_V}, {_QUANTITIES} SELECT * FROM quantities"),
    "quantities_in_service": (quantities_in_service, f"{_V}, {_QUANTITIES.replace('FROM features', 'FROM features WHERE lifecycle = 3')} SELECT * FROM quantities"),
    "cost_estimate": (
        cost_estimate,
        f"""{_V}, {_QUANTITIES}, {_PRICES}, matched AS (SELECT q.*, p.price, p.unit, row_number() OVER (PARTITION BY q.role, q.class, q.ag, q."at", q.size
          ORDER BY (p."at" IS NOT NULL)::INT + (p.size IS NOT NULL)::INT DESC, p.price_row) AS k
          FROM quantities q LEFT JOIN prices p ON q.class = p.class AND q.ag = p.ag AND (p."at" IS NULL OR p."at" = q."at") AND (p.size IS NULL OR p.size = q.size))
        SELECT role, class, ag, "at", size, pieces, length, price::DOUBLE AS price, round(CASE WHEN role = 'Line' THEN coalesce(length, 0) ELSE pieces END::DOUBLE * price::DOUBLE, 2) AS cost, coalesce(price = 0, TRUE) AS missing FROM matched WHERE k = 1""",
    ),
    "cost_total": (
        cost_total,
        f"""{_V}, {_QUANTITIES}, {_PRICES}, matched AS (SELECT q.*, p.price, row_number() OVER (PARTITION BY q.role, q.class, q.ag, q."at", q.size
          ORDER BY (p."at" IS NOT NULL)::INT + (p.size IS NOT NULL)::INT DESC, p.price_row) AS k
          FROM quantities q LEFT JOIN prices p ON q.class = p.class AND q.ag = p.ag AND (p."at" IS NULL OR p."at" = q."at") AND (p.size IS NULL OR p.size = q.size))
        SELECT round(sum(CASE WHEN role = 'Line' THEN coalesce(length, 0) ELSE pieces END::DOUBLE * price::DOUBLE), 2) AS total, count(*) FILTER (coalesce(price = 0, TRUE)) AS missing FROM matched WHERE k = 1""",
    ),
    "unpriced_combos": (
        unpriced_combos,
        f"""{_V}, {_PRICES} SELECT DISTINCT class, ag, "at", size FROM features f WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.class IS NOT DISTINCT FROM f.class
        AND p.ag IS NOT DISTINCT FROM f.ag AND p."at" IS NOT DISTINCT FROM f."at" AND p.size IS NOT DISTINCT FROM f.size)""",
    ),
    "completeness": (
        completeness,
        f"{_V}, counts AS ({' UNION ALL '.join(map(_filled, ('assetid', 'size', 'segment', 'lifecycle')))}) SELECT *, round(100.0 * filled / total, 1)::DOUBLE AS percent FROM counts",
    ),
    "required_empty": (
        required_empty,
        f"""{_V}, empty AS (SELECT class, fid, concat_ws(', ', CASE WHEN class IN ('Meter', 'Trunk') AND coalesce(assetid, '') = '' THEN 'assetid' END, CASE WHEN class IN ('Meter', 'Station') AND coalesce(segment, '') = '' THEN 'segment' END,
        CASE WHEN class = 'Trunk' AND size IS NULL THEN 'size' END) AS missing FROM features WHERE class IN ('Meter', 'Station', 'Trunk')) SELECT * FROM empty WHERE missing <> ''""",
    ),
    "lifecycle_histogram": (lifecycle_histogram, f"{_V} SELECT class, lifecycle, count(*) AS n FROM features GROUP BY ALL"),
    "duplicate_ids": (duplicate_ids, f"{_V} SELECT assetid, count(*) AS n FROM features WHERE assetid <> '' GROUP BY assetid HAVING count(*) > 1"),
    "work_order_stats": (
        work_order_stats,
        f"""WITH wo AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Open' ELSE 'In progress' END AS status, CAST(o_orderdate AS DATE) + 30 AS due FROM orders)
        SELECT status, count(*) AS n, count(*) FILTER (due < DATE '{TODAY}' AND status NOT IN ('Completed', 'Cancelled')) AS overdue FROM wo GROUP BY status""",
    ),
    "missing_rules": (missing_rules, f"WITH {nv.VIEW_SQL}, {_ALLOWED}, {_PAIRS} SELECT node, one_class, one_ag, other_class, other_ag, fid FROM bad"),
    "learned_rules": (learned_rules, f"WITH {nv.VIEW_SQL}, {_ALLOWED}, {_PAIRS} SELECT DISTINCT one_class, one_ag, other_class, other_ag FROM bad"),
    "size_changes": (
        size_changes,
        f"""WITH {nv.VIEW_SQL}, ends AS (SELECT a AS node, size, fid, class FROM lines UNION ALL SELECT b, size, fid, class FROM lines)
        SELECT node, count(DISTINCT size) AS sizes, min(fid) AS fid FROM ends WHERE class <> 'Service' AND size IS NOT NULL AND node NOT IN (SELECT node FROM points WHERE NOT (class = 'Joint' AND fid % 3 = 0)) GROUP BY node HAVING count(DISTINCT size) > 1""",
    ),
    "risk_scores": (risk_scores, f"WITH {nv.VIEW_SQL}, {_FED} SELECT class, fid, customers, likelihood, consequence, score, risk FROM risks"),
    "risk_ranking": (risk_ranking, f"WITH {nv.VIEW_SQL}, {_FED} SELECT row_number() OVER (ORDER BY score DESC, customers DESC, class, fid) AS priority, class, fid, score, risk FROM risks"),
    "risk_scores_all": (risk_scores_all, None),
    "risk_ranking_all": (risk_ranking_all, None),
    "next_ids": (
        next_ids,
        """WITH RECURSIVE used AS (SELECT concat('N', chr(CAST(65 + s_nationkey AS INTEGER)), '-', CASE WHEN s_suppkey % 10 = 0 THEN concat('7', lpad((s_suppkey % 1000)::VARCHAR, 6, '0')) ELSE lpad(s_suppkey::VARCHAR, 6, '0') END) AS id FROM supplier),
        most AS (SELECT regexp_extract(id, '^(.*?)(\\d+)$', 1) AS prefix, max(CAST(regexp_extract(id, '^(.*?)(\\d+)$', 2) AS BIGINT)) AS most FROM used GROUP BY 1),
        want AS (SELECT concat('N', chr(CAST(65 + c_nationkey AS INTEGER)), CASE WHEN c_custkey % 4 = 0 THEN '-7' ELSE '-' END) AS prefix, c_custkey AS key FROM customer),
        ranked AS (SELECT prefix, key, row_number() OVER (PARTITION BY prefix ORDER BY key) AS r FROM want),
        numbers AS (SELECT prefix, coalesce(most, 0) + unnest(range(1, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + 1)) AS n FROM (SELECT DISTINCT prefix FROM want) LEFT JOIN most USING (prefix)),
        ids AS (SELECT prefix, n, concat(prefix, CASE WHEN n >= 100000 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 6, '0') END) AS id FROM numbers),
        free AS (SELECT prefix, id, row_number() OVER (PARTITION BY prefix ORDER BY n) AS r FROM ids ANTI JOIN used USING (id))
        SELECT prefix, key, id AS assetid FROM ranked JOIN free USING (prefix, r)""",
    ),
}
