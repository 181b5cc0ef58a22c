"""Queries over board geometry: filters, spatial joins, nets, rules, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import checks, connectivity, graph, query, rules, spatial, windows
from tracewright.plans.derived import sql, table
from tracewright.plans.registry import register

PARTS = "SELECT p_partkey, p_name, p_size FROM part WHERE "


def parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size")


@register("query_filter_cmp", PARTS + "p_size >= 25")
def query_filter_cmp(spark, d):
    return query.execute(parts(spark, d), "p_size >= 25")


@register("query_filter_not_equal", "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def query_filter_not_equal(spark, d):
    return query.execute(table(spark, d, "documents").select("doc_id", "lang"), "lang != en")


@register("query_filter_contains", PARTS + "contains(lower(p_name), 'a')")
def query_filter_contains(spark, d):
    return query.execute(parts(spark, d), "p_name ~ A")


@register("query_filter_and", PARTS + "p_size < 30 AND p_partkey > 50")
def query_filter_and(spark, d):
    return query.all_of(parts(spark, d), "p_size<30", "p_partkey>50")


@register("query_filter_or", "SELECT p_partkey, p_name, p_size, CASE WHEN p_size < 5 THEN 0 ELSE 1 END AS first FROM part WHERE p_size < 5 OR contains(lower(p_name), 'e')")
def query_filter_or(spark, d):
    return query.any_of(parts(spark, d), "p_size < 5", "p_name ~ e", order="first")


@register("query_missing_field", "SELECT p_partkey FROM part WHERE false")
def query_missing_field(spark, d):
    return query.execute(parts(spark, d), "absent.path > 3").select("p_partkey")


@register("sort_nulls_top", sql("tracks", "SELECT id, net_id FROM tracks ORDER BY net_id DESC NULLS FIRST, id LIMIT 200"))
def sort_nulls_top(spark, d):
    return query.sort(table(spark, d, "tracks"), "net_id", reverse=True, ties=("id",)).limit(200).select("id", "net_id")


@register("search_preset_low_confidence", sql("claims", "SELECT subject_id, field, source, round(confidence, 6) AS confidence FROM claims WHERE confidence < 0.7"))
def search_preset_low_confidence(spark, d):
    return query.apply_preset(table(spark, d, "claims"), query.PRESETS[0]).select("subject_id", "field", "source", F.round("confidence", 6).alias("confidence"))


@register("even_sample", "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS p, count(*) OVER () AS n FROM part) WHERE p IN (SELECT CAST(floor(i * (SELECT count(*) FROM part) / 37) AS BIGINT) FROM range(37) t(i))")
def even_sample(spark, d):
    return query.even_sample(table(spark, d, "part").select("p_partkey"), 37, ["p_partkey"])


NEAR = "abs(a.x - b.x) <= (a.size_x + b.size_x) / 2 + {t} AND abs(a.y - b.y) <= (a.size_y + b.size_y) / 2 + {t}"


@register("band_pairs", sql("pads", f"SELECT a.id AS l_id, b.id AS r_id FROM pads a JOIN pads b ON a.layer = b.layer AND a.id < b.id AND {NEAR.format(t='1.05e0')}"))
def band_pairs(spark, d):
    return spatial.box_pairs(connectivity.pad_boxes(table(spark, d, "pads")), 4.0, 1.05).select("l_id", "r_id")


@register("radius_neighbours", sql("pads drills", "SELECT d.id AS l_id, p.id AS r_id, round(sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)), 6) AS distance FROM drills d JOIN pads p ON sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) <= 1.5"))
def radius_neighbours(spark, d):
    out = spatial.radius_join(table(spark, d, "drills").select("id", "x", "y"), table(spark, d, "pads").select("id", "x", "y"), 1.5)
    return out.select("l_id", "r_id", F.round("distance", 6).alias("distance"))


@register("nearest_drill", sql("pads drills", "SELECT id, drill_id, diameter FROM (SELECT p.id, d.id AS drill_id, d.diameter, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)), d.id) AS r FROM pads p JOIN drills d ON sqrt((d.x - p.x) * (d.x - p.x) + (d.y - p.y) * (d.y - p.y)) <= 0.15) WHERE r = 1"))
def nearest_drill(spark, d):
    out = connectivity.attach_drills(table(spark, d, "pads"), table(spark, d, "drills"))
    return out.where("drill_id is not null").select("id", "drill_id", F.col("drill").alias("diameter"))


@register("box_keepout", sql("pads drills", "SELECT p.id AS l_id, d.id AS r_id FROM pads p JOIN drills d ON p.x - p.size_x / 2 <= d.x + 2 AND d.x - 2 <= p.x + p.size_x / 2 AND p.y - p.size_y / 2 <= d.y + 1 AND d.y - 1 <= p.y + p.size_y / 2"))
def box_keepout(spark, d):
    keepouts = table(spark, d, "drills").select("id", (F.col("x") - 2).alias("x0"), (F.col("x") + 2).alias("x1"), (F.col("y") - 1).alias("y0"), (F.col("y") + 1).alias("y1"))
    return rules.keepout_hits(connectivity.pad_boxes(table(spark, d, "pads")), keepouts)


@register("pair_reduction_metrics", sql("pads", f"n AS (SELECT count(*) AS n FROM pads), c AS (SELECT count(*) AS candidate_pairs FROM pads a JOIN pads b ON a.layer = b.layer AND a.id < b.id AND {NEAR.format(t='0')}) SELECT CAST(n * (n - 1) / 2 AS BIGINT) AS brute_pairs, candidate_pairs, round(1 - candidate_pairs / (n * (n - 1) / 2), 6) AS reduction_ratio FROM n, c"))
def pair_reduction_metrics(spark, d):
    pads = connectivity.pad_boxes(table(spark, d, "pads"))
    return spatial.pair_metrics(pads.count(), spatial.box_pairs(pads, 2.0))


CONTACT = """
contact AS (SELECT p.id AS u, t.id AS v FROM pads p JOIN tracks t ON p.layer = t.layer
  AND sqrt(pow(greatest(p.x - p.size_x / 2 - greatest(t.x1, t.x2), 0, least(t.x1, t.x2) - (p.x + p.size_x / 2)), 2) + pow(greatest(p.y - p.size_y / 2 - t.y1, 0, t.y1 - (p.y + p.size_y / 2)), 2)) - t.width / 2 <= 0)"""
REACH = """
both_ways AS (SELECT u, v FROM contact UNION ALL SELECT v, u FROM contact),
nodes AS (SELECT id AS node FROM pads UNION SELECT id FROM tracks),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
label AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def contacts(spark, d):
    return connectivity.pad_track_contacts(table(spark, d, "pads"), table(spark, d, "tracks"))


def board_nodes(spark, d):
    return table(spark, d, "pads").select(F.col("id").alias("node")).unionByName(table(spark, d, "tracks").select(F.col("id").alias("node")))


@register("contact_edges", sql("pads tracks", CONTACT + " SELECT u, v FROM contact"))
def contact_edges(spark, d):
    return contacts(spark, d)


@register("nets_connected_components", sql("pads tracks", CONTACT + "," + REACH + " SELECT concat('net_', substr(sha1(string_agg(node, '|' ORDER BY node)), 1, 12)) AS net_id, count(*) AS member_count FROM label GROUP BY component"))
def nets_connected_components(spark, d):
    return connectivity.nets(board_nodes(spark, d), contacts(spark, d)).select("net_id", "member_count")


@register("island_sizes", sql("pads tracks", CONTACT + "," + REACH + " SELECT component, count(*) AS size FROM label GROUP BY component"))
def island_sizes(spark, d):
    return graph.islands(board_nodes(spark, d), contacts(spark, d))


@register("cluster_single_linkage", sql("pads", "contact AS (SELECT a.id AS u, b.id AS v FROM pads a JOIN pads b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.0 AND (a.size_x + b.size_x) > 1.2), tracks AS (SELECT id FROM pads WHERE false)," + REACH + " SELECT component, count(*) AS size FROM label GROUP BY component"))
def cluster_single_linkage(spark, d):
    pads = table(spark, d, "pads")
    near = spatial.radius_join(pads.select("id", "x", "y", "size_x"), pads.select("id", "x", "y", "size_x"), 1.0).where("l_id < r_id and l_size_x + r_size_x > 1.2")
    return graph.islands(pads.select(F.col("id").alias("node")), near.select(F.col("l_id").alias("u"), F.col("r_id").alias("v")))


@register("drc_track_width", sql("tracks", "SELECT id, printf('track width %.4f mm', width) AS message FROM tracks WHERE width < 0.15"))
def drc_track_width(spark, d):
    return rules.track_width(table(spark, d, "tracks"), rules.DrcLimits()).select(F.col("object_ids")[0].alias("id"), "message")


RING = "ring AS (SELECT id, least(size_x, size_y) / 2 - drill / 2 AS ring FROM pads WHERE drill IS NOT NULL)"


@register("drc_annular", sql("pads", RING + " SELECT id, CASE WHEN ring < 0 THEN 'ANNULAR_RING_BROKEN' ELSE 'ANNULAR_RING_MIN' END AS code FROM ring WHERE ring < 0.1"))
def drc_annular(spark, d):
    return rules.annular(table(spark, d, "pads"), rules.DrcLimits()).select(F.col("object_ids")[0].alias("id"), "code")


@register("drc_clearance", sql("tracks", """
pairs AS (SELECT a.id AS l_id, b.id AS r_id, greatest(0, greatest(greatest(least(a.x1, a.x2) - greatest(b.x1, b.x2), least(b.x1, b.x2) - greatest(a.x1, a.x2)), 0) - a.width / 2 - b.width / 2) AS gap,
  CASE WHEN a.net_id IS NULL OR b.net_id IS NULL THEN 'unresolved' WHEN a.net_id = b.net_id THEN 'same' ELSE 'different' END AS state
  FROM tracks a JOIN tracks b ON a.layer = b.layer AND a.y1 = b.y1 AND a.id < b.id)
SELECT l_id, r_id, round(gap, 6) AS gap, state FROM pairs WHERE gap < 0.15 AND state <> 'same'"""))
def drc_clearance(spark, d):
    out = rules.track_clearance(table(spark, d, "tracks"), rules.DrcLimits())
    return out.select("l_id", "r_id", F.round("gap", 6).alias("gap"), "state")


@register("validate_duplicate_ids", "SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def validate_duplicate_ids(spark, d):
    ids = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return rules.duplicate_ids(ids).select(F.col("object_ids")[0].alias("id"))


@register("validate_memberships", sql("pin_edges", "SELECT 'OBJECT_IN_MULTIPLE_NETS' AS code, count(*) AS n FROM (SELECT component_id FROM pin_edges GROUP BY 1 HAVING count(DISTINCT net_id) > 1) UNION ALL SELECT 'NET_MEMBER_MISSING', count(*) FROM pin_edges WHERE component_id NOT IN (SELECT concat('K', CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderkey % 2 = 0)"))
def validate_memberships(spark, d):
    members = table(spark, d, "pin_edges").select("net_id", F.col("component_id").alias("member_id"))
    objects = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("id"))
    found = rules.union(rules.shared_members(members), rules.missing_members(members, objects))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@register("unified_issue_gate", sql("pads tracks", RING + ", i AS (SELECT 'error' AS severity FROM ring WHERE ring < 0 UNION ALL SELECT 'warning' FROM ring WHERE ring >= 0 AND ring < 0.1 UNION ALL SELECT 'warning' FROM tracks WHERE width < 0.15) SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS passed, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM i"))
def unified_issue_gate(spark, d):
    limits = rules.DrcLimits()
    ring, width = rules.annular(table(spark, d, "pads"), limits), rules.track_width(table(spark, d, "tracks"), limits)
    return rules.gate(rules.unify(ring, ring, width)).select("passed", "errors", "warnings")


@register("review_queue_open", sql("claims", "SELECT DISTINCT concat(subject_id, field, source) AS id FROM claims WHERE confidence < 0.05"))
def review_queue_open(spark, d):
    items = table(spark, d, "claims").select(F.concat("subject_id", "field", "source").alias("id"), F.lit("claim").alias("kind"), F.col("subject_id").alias("object_id"), "confidence")
    return rules.review_queue(items, threshold=0.05).select("id")


RELEASE = """
WITH f AS (SELECT c_nationkey AS k, count(*) FILTER (WHERE c_acctbal < -900) AS errors, count(*) AS warnings, c_nationkey / 25e0 AS provenance, 0.8e0 AS completeness, c_nationkey % 5 > 0 AS tests, c_nationkey % 3 = 0 AS reviews FROM customer GROUP BY 1)
SELECT k, 'development' AS profile, errors <= 10 AS ready, CAST(errors > 10 AS INT) AS blockers, CAST(warnings > 500 AS INT) AS warned FROM f UNION ALL
SELECT k, 'research', errors <= 0 AND provenance >= 0.5 AND tests, CAST(errors > 0 AS INT) + CAST(provenance < 0.5 AS INT) + CAST(NOT tests AS INT), CAST(warnings > 250 AS INT) FROM f UNION ALL
SELECT k, 'review', errors <= 0 AND provenance >= 0.75 AND tests AND reviews, CAST(errors > 0 AS INT) + CAST(provenance < 0.75 AS INT) + CAST(NOT tests AS INT) + CAST(NOT reviews AS INT), CAST(warnings > 100 AS INT) FROM f UNION ALL
SELECT k, 'manufacturing-export-candidate', false, CAST(errors > 0 AS INT) + CAST(provenance < 0.95 AS INT) + 1 + CAST(NOT tests AS INT) + 1 + CAST(NOT reviews AS INT) + 1, CAST(warnings > 25 AS INT) FROM f"""


@register("release_decisions", RELEASE)
def release_decisions(spark, d):
    """Four profiles for the facts of each nation; what is not known blocks where it is asked for."""
    n, true = F.col("c_nationkey"), F.lit(True)
    facts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.when(F.col("c_acctbal") < -900, 1)).alias("errors"), F.count("*").alias("warnings"))
    facts = facts.withColumns({"provenance": n / 25, "completeness": F.lit(0.8), "tests_passed": n % 5 > 0, "deterministic": true, "no_unsupported": true, "roundtrip_passed": true, "reviews_closed": n % 3 == 0, "ground_truth_passed": F.lit(None).cast("boolean")})
    out = rules.release_decisions(facts, ("c_nationkey",))
    return out.select(F.col("c_nationkey").alias("k"), "profile", "ready", F.size("blockers").alias("blockers"), F.size("warnings").alias("warned"))


@register("channel_spacing", sql("tracks", "SELECT id, round(x1 - lag(x1) OVER (PARTITION BY layer, y1 ORDER BY x1, id), 6) AS spacing FROM tracks"))
def channel_spacing(spark, d):
    return windows.spacing(table(spark, d, "tracks"), ["layer", "y1"], "x1", ["id"]).select("id", "spacing")


@register("polyline_length", """
WITH legs AS (SELECT user_id, event_id, CAST(event_id % 97 AS DOUBLE) AS x, value AS y, lag(CAST(event_id % 97 AS DOUBLE)) OVER w AS px, lag(value) OVER w AS py FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 4) AS length FROM legs GROUP BY user_id""")
def polyline_length(spark, d):
    points = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 97).cast("double").alias("x"), F.col("value").alias("y"))
    return windows.path_length(points, ["user_id"], ["event_id"]).select("user_id", F.round("length", 4).alias("length"))


@register("margin_to_runner_up", "SELECT c_nationkey, c_custkey, round(margin, 4) AS margin FROM (SELECT c_nationkey, c_custkey, c_acctbal - lead(c_acctbal) OVER w AS margin, row_number() OVER w AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) WHERE r = 1")
def margin_to_runner_up(spark, d):
    out = windows.winner(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", ["c_custkey"])
    return out.select("c_nationkey", "c_custkey", F.round("margin", 4).alias("margin"))


@register("chunk_pages", "SELECT c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 30) + 1 AS INTEGER) AS page FROM customer")
def chunk_pages(spark, d):
    return windows.pages(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"]).select("c_custkey", "page")


@register("trend_delta", "SELECT user_id, count(*) AS count, max_by(value, event_id) AS latest, round(max_by(value, event_id) - max_by(value, event_id) FILTER (WHERE event_id <> m), 6) AS delta FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def trend_delta(spark, d):
    return windows.trend(table(spark, d, "events"), ["user_id"], ["event_id"], "value")


@register("assign_references", "WITH n AS (SELECT c_custkey, substr(c_mktsegment, 1, 1) AS k, CASE WHEN c_custkey % 4 = 0 THEN concat('R', CAST(c_custkey // 2 AS STRING)) END AS reference FROM customer), p AS (SELECT c_custkey, reference, CASE k WHEN 'A' THEN 'R' WHEN 'B' THEN 'C' ELSE 'U' END AS prefix FROM n), free AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM range(1, 400000) t(i) WHERE concat('R', CAST(i AS STRING)) NOT IN (SELECT reference FROM p WHERE reference IS NOT NULL)), r AS (SELECT c_custkey, prefix, row_number() OVER (PARTITION BY prefix ORDER BY lpad(CAST(c_custkey AS STRING), 9, '0')) AS k FROM p WHERE reference IS NULL) SELECT lpad(CAST(c_custkey AS STRING), 9, '0') AS id, reference FROM p WHERE reference IS NOT NULL UNION ALL SELECT lpad(CAST(c_custkey AS STRING), 9, '0'), concat(prefix, CAST(CASE WHEN prefix = 'R' THEN free.i ELSE r.k END AS STRING)) FROM r LEFT JOIN free ON prefix = 'R' AND free.k = r.k")
def assign_references(spark, d):
    kind = F.substring("c_mktsegment", 1, 1)
    parts = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), F.when(kind == "A", "resistor").when(kind == "B", "capacitor").otherwise("ic").alias("kind"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("R"), F.floor(F.col("c_custkey") / 2).cast("string"))).alias("reference"))
    return windows.assign_references(parts)


@register("check_geometry", sql("tracks drills", "SELECT 'TRACK_WIDTH_INVALID' AS code, count(*) AS n FROM tracks WHERE width - 0.2 <= 0 UNION ALL SELECT 'DRILL_DIAMETER_INVALID', count(*) FROM drills WHERE diameter - 0.4 <= 0"))
def check_geometry(spark, d):
    tracks, drills = table(spark, d, "tracks").withColumn("width", F.col("width") - 0.2), table(spark, d, "drills").withColumn("diameter", F.col("diameter") - 0.4)
    return checks.geometry(tracks, table(spark, d, "pads"), drills).groupBy("code").agg(F.count("*").alias("n"))


@register("check_components", sql("pads", "SELECT id, 'COMPONENT_PAD_MISSING' AS code FROM pads WHERE layer = '1' UNION ALL SELECT id, 'COMPONENT_CONFIDENCE_INVALID' FROM pads WHERE x > 40"))
def check_components(spark, d):
    pads = table(spark, d, "pads")
    parts = pads.select("id", F.array("id").alias("pad_ids"), F.when(F.col("x") > 40, 1.5).otherwise(0.5).alias("confidence"), F.create_map("id", F.lit("1")).alias("pin_map"))
    return checks.components(parts, pads.where("layer = '0'")).select(F.col("object_ids")[0].alias("id"), "code")


@register("check_electrical", sql("few_pins", "n AS (SELECT net_id, count(DISTINCT component_id) AS n FROM few_pins GROUP BY 1) SELECT 'DANGLING_NET' AS code, count(*) AS n FROM n WHERE n < 2 HAVING count(*) > 0 UNION ALL SELECT 'NET_LABEL_UNKNOWN', count(*) FROM n WHERE right(net_id, 1) = '3' HAVING count(*) > 0 UNION ALL SELECT 'COMPONENT_LOW_CONFIDENCE', count(DISTINCT component_id) FROM few_pins WHERE right(component_id, 1) = '7' HAVING count(*) > 0"))
def check_electrical(spark, d):
    pins = table(spark, d, "few_pins").withColumn("pin_id", F.lit("1"))
    nets = pins.select("net_id").distinct().withColumn("label", F.when(~F.col("net_id").endswith("3"), "x"))
    parts = pins.select(F.col("component_id").alias("id")).distinct().select("id", F.array("id").alias("pad_ids"), F.when(F.col("id").endswith("7"), 0.1).otherwise(0.9).alias("confidence"))
    return checks.electrical(parts, pins, nets).groupBy("code").agg(F.count("*").alias("n"))


@register("check_drill_copper", sql("pads drills", "SELECT d.id AS drill, p.id AS pad FROM drills d JOIN pads p ON sqrt(pow(greatest(p.x - p.size_x / 2 - d.x, 0, d.x - p.x - p.size_x / 2), 2) + pow(greatest(p.y - p.size_y / 2 - d.y, 0, d.y - p.y - p.size_y / 2), 2)) - d.diameter / 2 < 0.15"))
def check_drill_copper(spark, d):
    drills = table(spark, d, "drills").withColumn("net_id", F.lit(None).cast("string"))
    return checks.drill_copper(drills, table(spark, d, "pads")).select(F.col("object_ids")[0].alias("drill"), F.col("object_ids")[1].alias("pad"))


@register("check_edge", sql("drills", "SELECT id, CASE WHEN NOT (x > 2 AND x < 45 AND y > 1 AND y < 38) THEN 'DRILL_OUTSIDE_BOARD' ELSE 'DRILL_EDGE_CLEARANCE' END AS code FROM drills WHERE NOT (x > 2 AND x < 45 AND y > 1 AND y < 38) OR least(x - 2, 45 - x, y - 1, 38 - y) - diameter / 2 < 0.9"))
def check_edge(spark, d):
    out = checks.edge(table(spark, d, "drills"), [(2.0, 1.0), (45.0, 1.0), (45.0, 38.0), (2.0, 38.0)], 0.9, ("DRILL_OUTSIDE_BOARD", "DRILL_EDGE_CLEARANCE"))
    return out.select(F.col("object_ids")[0].alias("id"), "code")
