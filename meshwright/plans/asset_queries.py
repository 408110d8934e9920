"""Queries over identifiers, attribute rules, imports, model tables and feature sets, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import identifiers as ids
from meshwright.operators import attribute_rules as ar
from meshwright.operators import hydraulic_tables as hyd
from meshwright.operators import lists, profiles, traces, versions
from meshwright.plans.graph_queries import LINE, TIERS, network, tiered
from meshwright.plans.topology_queries import MAP_SQL, lines
from meshwright.sources import tables as tab
from meshwright.sources import network_view as nv
from meshwright.sources.network_view import table

c = F.col
RULES = (
    ar.Rule("price of length", "Part", ar.CALCULATION, "CASE WHEN size % 4 = 0 THEN round($length * 10, 2) ELSE price END", "price", order=1),
    ar.Rule("default brand", "Part", ar.CALCULATION, "coalesce(brand, 'Brand#0')", "brand", order=2),
    ar.Rule("not too large", "Part", ar.CONSTRAINT, "size < 40", message="sizes end at 39", severity="warning"),
    ar.Rule("brand of the first ten", "Part", ar.VALIDATION, "brand ILIKE 'brand#1%'"),
    ar.Rule("switched off", "Part", ar.VALIDATION, "false", enabled=False),
)
PATTERN = "{NET}-{CLASS}-{GROUP}{TYPE}-{N}"
BANDS, LOW = (5.0, 10.0, 50.0), 5.0
TYPES = ((1, "Machines", 1, "Machinery"), (1, "Machines", 2, "Automobiles"), (2, "Home", 1, "Household goods"), (2, "Home", 2, "Furniture"), (3, "Works", 1, "Building site"))
KINDS = {"number": "int", "text": "string", "due": "date", "urgent": "boolean", "gone": "double"}


def features(spark, sf_dir: str) -> DataFrame:
    size = c("p_size").cast("int")
    return table(spark, sf_dir, "part").select(
        F.lit("Part").alias("class"), c("p_partkey").cast("long").alias("fid"), size.alias("size"), c("p_retailprice").cast("double").alias("price"),
        F.when(c("p_partkey") % 9 != 0, c("p_brand")).alias("brand"), (size * 1.5).cast("double").alias("length"), c("p_name").alias("name"), c("p_type").alias("kind"),
    )


def abbreviations(spark, sf_dir):
    return features(spark, sf_dir).select("fid", ids.abbreviation(c("name")).alias("of_name"), ids.abbreviation(c("kind")).alias("of_kind"), ids.abbreviation(c("brand")).alias("of_brand"))


def id_prefixes(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("fid", ids.id_prefix(PATTERN, F.lit("water"), F.lit("Device"), c("kind"), c("name")).alias("prefix"))


def slugs(spark, sf_dir):
    return features(spark, sf_dir).select("fid", ids.slug(F.concat_ws(" / ", "name", "brand")).alias("slug"), F.array_join(F.array_sort(ids.word_tokens(F.concat_ws(" ", "name", "kind"))), "|").alias("words"))


def keys_of_features(spark, sf_dir):
    key = ids.feature_key(F.concat(c("class"), F.lit(":"), c("kind")), c("fid"))
    return features(spark, sf_dir).select("fid", key.alias("key"), ids.split_key(key).alias("k")).select("key", c("k.name").alias("name"), c("k.fid").alias("back"))


def formulas(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(
        "fid", F.round(ids.pump_head(c("size").cast("double"), c("length"), F.lit(30.0)), 6).alias("head"), F.round(ids.friction_factor(c("price") * c("size"), F.lit(0.0005)), 6).alias("friction"),
        F.round(ids.fire_flow(c("price"), c("length"), F.lit(20.0), F.lit(10.0)), 6).alias("fire_flow"),
    )


def rule_updates(spark, sf_dir):
    return ar.updates(features(spark, sf_dir), RULES)


def placed_features(spark, sf_dir: str) -> DataFrame:
    """The features with a place, which every 17th lacks."""
    k = c("fid")
    x, y = (k % 100 * 10).cast("double"), F.floor(k / 100).cast("double")
    return features(spark, sf_dir).withColumns({"x": F.when(k % 17 != 0, x), "y": F.when(k % 17 != 0, y)})


def rule_issues(spark, sf_dir):
    return ar.issues(placed_features(spark, sf_dir), RULES)


def rule_issues_of_edits(spark, sf_dir):
    edits = table(spark, sf_dir, "lineitem").filter(c("l_quantity") >= 49).select(F.lit("Part").alias("class"), c("l_partkey").cast("long").alias("fid"))
    return ar.issues(ar.changed_only(placed_features(spark, sf_dir), edits), RULES)


def filled_fields(spark, sf_dir):
    done = ar.fill_field(ar.fill_field(features(spark, sf_dir), "brand", "upper(kind)", only_empty=True), "price", "size * 2")
    return done.select("fid", "brand", "price")


def referential_issues(spark, sf_dir):
    """Orders of customers that the first two thousand don't hold, as a check of references."""
    children = table(spark, sf_dir, "orders").select(c("o_custkey").alias("key"))
    parents = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 3").select(c("c_custkey").alias("key"))
    return ar.referential(children, parents, ["key"], "customer")


def raw_import(spark, sf_dir: str) -> DataFrame:
    """Orders as the text fields of a file."""
    key = c("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"), F.when(key % 5 == 0, "n/a").when(key % 3 == 0, F.concat(F.lit(" "), key.cast("string"), F.lit(".0 "))).otherwise(key.cast("string")).alias("number"),
        F.when(key % 7 == 0, " ").otherwise(c("o_orderpriority")).alias("text"), F.when(key % 4 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(key % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due"),
        F.when(key % 2 == 0, F.upper(F.lit("Yes"))).when(key % 13 == 0, "").otherwise("no").alias("urgent"),
    )


def typed_import(spark, sf_dir):
    return tab.typed(raw_import(spark, sf_dir), {"id": "long"} | KINDS).withColumn("due", F.date_format("due", "yyyy-MM-dd"))


def mapped_import(spark, sf_dir):
    mapping = spark.createDataFrame([("BUILDING", 3, 1), ("FURNITURE", 2, 2), ("HOUSEHOLD", 2, 1)], "value string, ag int, at int")
    return tab.imported(table(spark, sf_dir, "customer"), {"c_custkey": "fid", "c_name": "assetid"}, mapping, "c_mktsegment")


def distinct_segments(spark, sf_dir):
    return tab.distinct_values(table(spark, sf_dir, "customer"), "c_mktsegment")


def mapping_suggestions(spark, sf_dir):
    types = spark.createDataFrame(list(TYPES), "ag int, group_name string, at int, type_name string")
    return tab.suggested_mapping(distinct_segments(spark, sf_dir), types).withColumn("score", F.round("score", 9))


def data_dictionary(spark, sf_dir):
    return tab.dictionary({t: table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})


def exported_attributes(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("ag", c("size") % 5)
    keys = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.1").select(F.lit("Part").alias("class"), c("l_partkey").cast("long").alias("fid")).distinct()
    names = spark.createDataFrame([("Part", k, f"group {k}") for k in range(4)], "class string, ag int, name string").withColumnRenamed("name", "group_name")
    return tab.attributes_of(f, keys, names).select("fid", "ag", "group_name", "length")


def rekeyed_rows(spark, sf_dir):
    gids = table(spark, sf_dir, "supplier").filter("s_suppkey % 6 <> 0").select(F.lit("Station").alias("class"), c("s_suppkey").alias("fid"), c("s_name").alias("gid"))
    pairs = table(spark, sf_dir, "lineitem").select(F.lit("Station").alias("from_class"), c("l_suppkey").alias("from_fid"), F.lit("Station").alias("to_class"), (c("l_partkey") % 50).alias("to_fid")).distinct()
    return tab.rekeyed(pairs, gids, ["from", "to"]).select("from_gid", "to_gid")


def pressures(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(c("user_id").cast("long").alias("node"), F.date_trunc("day", "ts").alias("step"), c("value").cast("double").alias("pressure"), (c("event_id") % 4).cast("long").alias("customers"))


def pressure_classes(spark, sf_dir):
    return hyd.class_counts(pressures(spark, sf_dir), "pressure", BANDS, LOW)


def pressure_extremes(spark, sf_dir):
    return hyd.period_extremes(pressures(spark, sf_dir))


def lowest_pressures(spark, sf_dir):
    return hyd.lowest_of_steps(pressures(spark, sf_dir)).withColumn("step", F.date_format("step", "yyyy-MM-dd"))


def model_summary(spark, sf_dir):
    nodes = pressures(spark, sf_dir).withColumn("demand", c("customers").cast("double"))
    pipes = table(spark, sf_dir, "part").select((c("p_size") - 20).cast("double").alias("velocity"))
    return hyd.solver_summary(nodes, pipes)


def calibration_fit(spark, sf_dir):
    pairs = features(spark, sf_dir).select(c("price").alias("observed"), (900 + c("size") * 2).cast("double").alias("computed"))
    fit = hyd.fit_quality(pairs)
    return fit.select("n", *[F.round(k, 6).alias(k) for k in ("rmse", "mae", "max_error", "r_squared")])


def first_node_values(spark, sf_dir):
    role = F.when(c("event_id") % 3 == 0, "Junction").otherwise("Device")
    points = table(spark, sf_dir, "events").select(c("user_id").alias("node"), role.alias("role"), c("event_id").alias("fid"), F.when(c("event_id") % 2 == 0, c("value")).alias("elevation"))
    return hyd.first_values(points, "elevation", ("Junction", "Device"))


def node_demands(spark, sf_dir):
    return hyd.node_demands(table(spark, sf_dir, "customer").select(c("c_nationkey").alias("node"), (c("c_custkey") % 10).cast("double").alias("demand")))


def roughness_means(spark, sf_dir):
    return hyd.group_means(features(spark, sf_dir).select(c("kind").alias("label"), c("size")), "size").withColumn("mean", F.round("mean", 9))


def joined_results(spark, sf_dir):
    key = c("s_suppkey")
    results = table(spark, sf_dir, "supplier").select(F.concat(F.when(key % 3 == 0, "N").when(key % 3 == 1, "p").otherwise("X"), key.cast("string")).alias("id"), key.cast("double").alias("value"))
    nodes = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(c("p_partkey").alias("node"))
    pipes = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(c("c_custkey").alias("pipe"))
    return hyd.results_back(results, nodes, pipes)


def profile_chainage(spark, sf_dir):
    path = features(spark, sf_dir).select(c("fid").alias("seq"), "length", c("price").alias("level"))
    return hyd.chainage(path)


def profile_rows(spark, sf_dir):
    """One long sewer: each supplier is a pipe to the next one, drawn either way, with inverts and a ground level at every fourth node."""
    k = c("s_suppkey").cast("long")
    pipes = table(spark, sf_dir, "supplier")
    drawn_back = k % 3 == 0
    path = pipes.select(k.alias("eid"), F.when(drawn_back, k + 1).otherwise(k).alias("a"), F.when(drawn_back, k).otherwise(k + 1).alias("b"), (k % 7 + 0.5).cast("double").alias("length"), drawn_back.alias("reverse"))
    attributes = pipes.select(k.alias("eid"), (10000 - k * 0.5).cast("double").alias("us_invert"), (9999.75 - k * 0.5).cast("double").alias("ds_invert"), (k % 5 * 100.0).cast("double").alias("diameter"), c("s_name").alias("pipe"))
    ground = pipes.filter(k % 4 == 0).select(k.alias("node"), c("s_acctbal").alias("elevation"))
    return profiles.profile(path, attributes, ground)


def global_ids(spark, sf_dir):
    """Customers that share one id by name, and some without, after the missing and repeated ids were made anew."""
    rows = table(spark, sf_dir, "customer").select(F.lit("Meter").alias("class"), c("c_custkey").alias("fid"), F.when(c("c_custkey") % 5 != 0, F.concat(F.lit("G"), (c("c_custkey") % 400).cast("string"))).alias("gid"))
    return versions.backfill(rows, "class", "gid", "fid")


def state_hashes(spark, sf_dir):
    fields = ("brand", "size")
    hashes = ids.field_hashes(fields)
    return features(spark, sf_dir).select("fid", versions.state_hash(fields).alias("state"), hashes["brand"].alias("brand_hash"), hashes["size"].alias("size_hash"))


def applied_rows(spark, sf_dir):
    """Associations after the added ones came and the removed ones went."""
    rows = lambda when: table(spark, sf_dir, "customer").filter(when).select(c("c_nationkey").alias("nation"), c("c_mktsegment").alias("segment"))
    return versions.apply_rows(rows("c_custkey % 4 = 0"), rows("c_custkey % 50 = 1"), rows("c_custkey % 70 = 8"))


def next_work_orders(spark, sf_dir):
    """The id that follows the work orders of each year."""
    year = F.year("o_orderdate")
    of_year = table(spark, sf_dir, "orders").groupBy(year.alias("year")).agg(F.max(c("o_orderkey") % 3000).alias("most"))
    return of_year.select("year", F.format_string("WO-%d-%04d", c("year"), (c("most") + 1).cast("long")).alias("wo_id"))


def repeated_ids(spark, sf_dir):
    """One row for each feature whose id another feature has too."""
    f = features(spark, sf_dir).select("fid", F.concat_ws("-", "name", "brand").alias("assetid"))
    many = f.groupBy("assetid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return f.join(many, "assetid").select("fid", "assetid", "n")


def repeated_shapes(spark, sf_dir):
    """Lines that repeat the shape of a line with a smaller number, and that line."""
    drawn = lines(spark, sf_dir).withColumn("shape", F.transform("path", lambda p: F.struct(F.round(p["x"] / 20).alias("x"), F.round(p["y"] / 20).alias("y"))))
    firsts = drawn.groupBy("shape").agg(F.min("line").alias("first"))
    return drawn.join(firsts, "shape").filter("line > first").select("line", "first")


def controllers_of_start(spark, sf_dir):
    """Controllers that feed a picked feature (trace of controllers)."""
    net = network(spark, sf_dir, (*LINE, "tier"))
    picked = spark.createDataFrame([("Station", 1)], "class string, fid long")
    fed = traces.subnetworks(net, tiered(net)).join(traces.start_of(net, picked), "node", "left_semi").select(c("controller").alias("node")).distinct()
    return net.points.join(fed, "node").select("class", "fid")


def tier_settings(spark, sf_dir):
    """The tiers with their settings and how many lines of each the network has."""
    settings = spark.createDataFrame([(k + 1, t, s["multi"], s["require"]) for k, (t, s) in enumerate(TIERS.items())], "rank int, tier string, multi boolean, require boolean")
    used = nv.lines(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n_lines"))
    return settings.join(used, "tier", "left").select("rank", "tier", "multi", "require", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def ordered_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select((c("n_regionkey") * 10).cast("int").alias("rule_order"), c("n_name").alias("name"))
    return ar.renumbered(rows)


def recent_versions(spark, sf_dir):
    """Versions, the newest first, as the list of them shows."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), c("o_orderkey").cast("string")).alias("name"), (-F.unix_micros(c("o_orderdate").cast("timestamp"))).alias("age"))
    return lists.running(rows, ["age", "name"]).select("name", "place")


_F = "WITH f AS (SELECT p_partkey AS fid, CAST(p_size AS INTEGER) AS size, CAST(p_retailprice AS DOUBLE) AS price, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS brand, p_size * 1.5::DOUBLE AS length, p_name AS name, p_type AS kind FROM part)"


def _abbr(text: str) -> str:
    words = f"regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+')"
    return f"CASE WHEN len({words}) = 0 THEN 'XXX' WHEN len({words}) = 1 THEN upper(left({words}[1], 3)) ELSE rpad(upper(left(array_to_string(list_transform({words}, lambda w: left(w, 1)), ''), 3)), 3, 'X') END"


_PLACE = "CAST(fid % 100 * 10 AS DOUBLE) AS x, CAST(fid // 100 AS DOUBLE) AS y"
_ISSUES = f"""SELECT 'Part' AS class, fid, 'AR' AS code, 'not too large' AS rule, 'warning' AS severity, 'not too large: sizes end at 39' AS message, {_PLACE} FROM f WHERE NOT size < 40 AND fid % 17 <> 0
UNION ALL SELECT 'Part', fid, 'AR', 'brand of the first ten', 'error', 'brand of the first ten: rule broken', {_PLACE} FROM f WHERE NOT coalesce(brand ILIKE 'brand#1%', FALSE) AND fid % 17 <> 0"""
_EVENTS = "WITH e AS (SELECT CAST(user_id AS BIGINT) AS node, date_trunc('day', ts) AS step, value AS pressure, event_id % 4 AS customers FROM events)"

QUERIES = {
    "abbreviations": (abbreviations, f"{_F} SELECT fid, {_abbr('name')} AS of_name, {_abbr('kind')} AS of_kind, {_abbr('brand')} AS of_brand FROM f"),
    "id_prefixes": (id_prefixes, f"{_F} SELECT fid, concat('WAT-DEV-', {_abbr('kind')}, {_abbr('name')}, '-') AS prefix FROM f"),
    "slugs": (
        slugs,
        f"""{_F} SELECT fid, left(lower(trim(regexp_replace(concat_ws(' / ', name, brand), '[^A-Za-z0-9_]+', '_', 'g'), '_')), 40) AS slug,
        array_to_string(list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', name, kind)), '[a-z0-9]+'))), '|') AS words FROM f""",
    ),
    "keys_of_features": (keys_of_features, f"{_F} SELECT concat('Part:', kind, ':', fid) AS key, concat('Part:', kind) AS name, fid AS back FROM f"),
    "formulas": (
        formulas,
        f"""{_F} SELECT fid, round(4 / 3.0::DOUBLE * length - length / 3 * pow(size / 30.0::DOUBLE, 2), 6) AS head,
        round(CASE WHEN greatest(price * size, 1) < 2000 THEN 64 / greatest(price * size, 1) ELSE 0.25 / pow(log10(0.0005::DOUBLE / 3.7 + 5.74 / pow(price * size, 0.9)), 2) END, 6) AS friction,
        round(CASE WHEN length <= 10 THEN 0 WHEN length - 20 <= 1e-6 THEN NULL ELSE price * pow((length - 10) / (length - 20), 0.54) END, 6) AS fire_flow FROM f""",
    ),
    "rule_updates": (
        rule_updates,
        f"""{_F}, n AS (SELECT fid, size, price, brand, CASE WHEN size % 4 = 0 THEN round(length * 10, 2) ELSE price END AS new_price, coalesce(brand, 'Brand#0') AS new_brand FROM f)
        SELECT 'Part' AS class, fid, 'price' AS field, price::VARCHAR AS old_value, new_price::VARCHAR AS new_value FROM n WHERE price <> new_price
        UNION ALL SELECT 'Part', fid, 'brand', brand, new_brand FROM n WHERE brand IS DISTINCT FROM new_brand""",
    ),
    "rule_issues": (rule_issues, f"{_F} {_ISSUES}"),
    "rule_issues_of_edits": (rule_issues_of_edits, f"{_F}, i AS ({_ISSUES}) SELECT * FROM i WHERE fid IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"),
    "filled_fields": (filled_fields, f"{_F} SELECT fid, coalesce(nullif(brand, ''), upper(kind)) AS brand, CAST(size * 2 AS DOUBLE) AS price FROM f"),
    "referential_issues": (
        referential_issues,
        "SELECT o_custkey AS key, count(*) AS n, 'customer' AS code FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) GROUP BY ALL",
    ),
    "typed_import": (
        typed_import,
        """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS INTEGER) END AS number, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS text,
        CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due, CASE WHEN o_orderkey % 2 = 0 THEN TRUE WHEN o_orderkey % 13 <> 0 THEN FALSE END AS urgent, NULL::DOUBLE AS gone FROM orders""",
    ),
    "mapped_import": (
        mapped_import,
        "SELECT c_custkey AS fid, c_name AS assetid, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 2 END AS ag, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 1 END AS at FROM customer",
    ),
    "distinct_segments": (distinct_segments, "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 500"),
    "mapping_suggestions": (mapping_suggestions, None),
    "data_dictionary": (data_dictionary, None),
    "exported_attributes": (
        exported_attributes,
        f"{_F} SELECT fid, size % 5 AS ag, CASE WHEN size % 5 < 4 THEN concat('group ', size % 5) END AS group_name, round(length, 2) AS length FROM f WHERE fid IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)",
    ),
    "rekeyed_rows": (
        rekeyed_rows,
        """WITH g AS (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 6 <> 0), p AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 50 AS b FROM lineitem)
        SELECT x.s_name AS from_gid, y.s_name AS to_gid FROM p JOIN g x ON x.s_suppkey = a JOIN g y ON y.s_suppkey = b""",
    ),
    "pressure_classes": (
        pressure_classes,
        f"""{_EVENTS} SELECT (pressure >= 5)::INTEGER + (pressure >= 10)::INTEGER + (pressure >= 50)::INTEGER AS band, count(*) AS n, CAST(sum(CASE WHEN pressure < 5 THEN customers ELSE 0 END) AS BIGINT) AS customers_low FROM e WHERE pressure IS NOT NULL GROUP BY 1""",
    ),
    "pressure_extremes": (pressure_extremes, f"{_EVENTS} SELECT node, min(pressure) AS min_pressure, max(pressure) AS max_pressure FROM e GROUP BY node"),
    "lowest_pressures": (lowest_pressures, f"{_EVENTS} SELECT strftime(step, '%Y-%m-%d') AS step, arg_min(node, (pressure, node)) AS node, min(pressure) AS pressure FROM e GROUP BY ALL"),
    "model_summary": (
        model_summary,
        f"{_EVENTS} SELECT min(pressure) AS min_pressure, max(pressure) AS max_pressure, sum(customers)::DOUBLE AS demand, (SELECT max(abs(p_size - 20))::DOUBLE FROM part) AS max_velocity FROM e",
    ),
    "calibration_fit": (
        calibration_fit,
        f"""{_F}, p AS (SELECT price AS o, 900 + size * 2 - price AS d FROM f) SELECT count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(max(abs(d)), 6) AS max_error,
        round(1 - sum(d * d) / (var_pop(o) * count(*)), 6) AS r_squared FROM p""",
    ),
    "first_node_values": (
        first_node_values,
        "SELECT user_id AS node, arg_min(value, (event_id % 3 <> 0, event_id)) AS value FROM events WHERE event_id % 2 = 0 AND value IS NOT NULL GROUP BY user_id",
    ),
    "node_demands": (node_demands, "SELECT c_nationkey AS node, sum(c_custkey % 10)::DOUBLE AS demand, count(*) AS customers FROM customer GROUP BY 1"),
    "roughness_means": (roughness_means, f"{_F} SELECT kind AS label, round(avg(size), 9) AS mean FROM f GROUP BY 1"),
    "joined_results": (
        joined_results,
        """SELECT 'N' AS kind, s_suppkey AS key, s_suppkey::DOUBLE AS value FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)
        UNION ALL SELECT 'P', s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)""",
    ),
    "profile_chainage": (profile_chainage, f"{_F} SELECT fid AS seq, sum(length) OVER (ORDER BY fid) AS chainage, price AS level FROM f"),
    "profile_rows": (
        profile_rows,
        """WITH p AS (SELECT s_suppkey AS k, s_suppkey % 7 + 0.5::DOUBLE AS length, 10000 - s_suppkey * 0.5::DOUBLE AS us, 9999.75::DOUBLE - s_suppkey * 0.5::DOUBLE AS ds, s_suppkey % 5 * 100.0::DOUBLE AS diameter, s_name AS pipe FROM supplier),
        ends AS (SELECT k, k + 1 AS node, round(sum(length) OVER (ORDER BY k), 2) AS chainage, ds FROM p), nodes AS (SELECT node, chainage, ds AS invert_in FROM ends UNION ALL SELECT min(k), 0, NULL FROM p)
        SELECT row_number() OVER (ORDER BY node) - 1 AS seq, node, chainage, s_acctbal AS ground, invert_in, us AS invert_out, pipe, diameter FROM nodes LEFT JOIN p ON k = node LEFT JOIN supplier ON s_suppkey = node AND node % 4 = 0""",
    ),
    "global_ids": (
        global_ids,
        """WITH r AS (SELECT c_custkey AS fid, CASE WHEN c_custkey % 5 <> 0 THEN concat('G', c_custkey % 400) END AS gid FROM customer)
        SELECT 'Meter' AS class, fid, CASE WHEN gid IS NULL OR fid > min(fid) OVER (PARTITION BY gid) THEN upper(sha1(concat('Meter:', fid))) ELSE gid END AS gid FROM r""",
    ),
    "state_hashes": (
        state_hashes,
        f"{_F} SELECT fid, sha1(concat_ws('|', 'brand=' || brand, 'size=' || size)) AS state, left(sha1(brand), 10) AS brand_hash, left(sha1(size::VARCHAR), 10) AS size_hash FROM f",
    ),
    "applied_rows": (
        applied_rows,
        """WITH r AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment FROM customer) SELECT * FROM (SELECT nation, segment FROM r WHERE k % 4 = 0 UNION SELECT nation, segment FROM r WHERE k % 50 = 1)
        EXCEPT SELECT nation, segment FROM r WHERE k % 70 = 8""",
    ),
    "next_work_orders": (next_work_orders, "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, concat('WO-', year(o_orderdate), '-', lpad((max(o_orderkey % 3000) + 1)::VARCHAR, 4, '0')) AS wo_id FROM orders GROUP BY year(o_orderdate)"),
    "repeated_ids": (repeated_ids, f"{_F} SELECT * FROM (SELECT fid, concat_ws('-', name, brand) AS assetid, count(*) OVER (PARTITION BY concat_ws('-', name, brand)) AS n FROM f) WHERE n > 1"),
    "repeated_shapes": (
        repeated_shapes,
        f"""WITH {MAP_SQL}, s AS (SELECT line, list((round(x / 20), round(y / 20)) ORDER BY v) AS shape FROM verts GROUP BY line)
        SELECT * FROM (SELECT line, min(line) OVER (PARTITION BY shape) AS first FROM s) WHERE line > first""",
    ),
    "controllers_of_start": (
        controllers_of_start,
        None,
    ),
    "tier_settings": (tier_settings, f"WITH {nv.VIEW_SQL} SELECT rank, t.tier, multi, require, count(l.tier) AS n_lines FROM (VALUES (1, 'Transmission', FALSE, FALSE), (2, 'Distribution', TRUE, TRUE)) t(rank, tier, multi, require) LEFT JOIN lines l ON l.tier = t.tier GROUP BY ALL"),
    "ordered_rules": (ordered_rules, "SELECT CAST(row_number() OVER (ORDER BY n_regionkey, n_name) AS INTEGER) AS rule_order, n_name AS name FROM nation"),
    "recent_versions": (recent_versions, "SELECT concat('v', o_orderkey) AS name, row_number() OVER (ORDER BY o_orderdate DESC, concat('v', o_orderkey)) AS place FROM orders"),
}
