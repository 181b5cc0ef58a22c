"""Queries over copper of any direction and shape: contacts, clearances, design rules, validation, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import board, connectivity, copper, graph, hypotheses, rules, windows
from tracewright.plans.derived import sql, table
from tracewright.plans.registry import register


def point_segment_sql(px: str, py: str, s: str) -> str:
    """Distance of a point from the segment of the table s."""
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    t = f"coalesce(greatest(0, least(1, (({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0))), 0)"
    return f"sqrt(pow({px} - ({s}.x1 + {t} * {dx}), 2) + pow({py} - ({s}.y1 + {t} * {dy}), 2))"


def segment_segment_sql(a: str, b: str) -> str:
    side = lambda s, x, y: f"sign(({s}.x2 - {s}.x1) * ({y} - {s}.y1) - ({s}.y2 - {s}.y1) * ({x} - {s}.x1))"
    cross = f"({side(a, f'{b}.x1', f'{b}.y1')} * {side(a, f'{b}.x2', f'{b}.y2')} < 0 AND {side(b, f'{a}.x1', f'{a}.y1')} * {side(b, f'{a}.x2', f'{a}.y2')} < 0)"
    ends = ", ".join([point_segment_sql(f"{a}.x{k}", f"{a}.y{k}", b) for k in (1, 2)] + [point_segment_sql(f"{b}.x{k}", f"{b}.y{k}", a) for k in (1, 2)])
    return f"CASE WHEN {cross} THEN 0 ELSE least({ends}) END"


TOUCH = f"""
touch AS (
  SELECT p.id AS u, t.id AS v FROM round_pads p JOIN slanted t ON p.layer = t.layer AND {point_segment_sql('p.x', 'p.y', 't')} - p.size_x / 2 - t.width / 2 <= 0.03 UNION ALL
  SELECT a.id, b.id FROM slanted a JOIN slanted b ON a.layer = b.layer AND a.id < b.id AND {segment_segment_sql('a', 'b')} - a.width / 2 - b.width / 2 <= 0.03 UNION ALL
  SELECT a.id, b.id FROM round_pads a JOIN round_pads b ON a.layer = b.layer AND a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) - a.size_x / 2 - b.size_x / 2 <= 0.03)"""


def slanted_copper(spark, d):
    return copper.shapes(table(spark, d, "slanted"), table(spark, d, "round_pads"))


@register("copper_contacts", sql("round_pads slanted", TOUCH + " SELECT u, v FROM touch"))
def copper_contacts(spark, d):
    """Tracks in any direction, round pads, and each with itself: all pairs of a layer in SQL."""
    return copper.contacts(slanted_copper(spark, d))


@register("copper_islands", sql("round_pads slanted", TOUCH + """,
both_ways AS (SELECT u, v FROM touch UNION ALL SELECT v, u FROM touch), nodes AS (SELECT id AS node FROM round_pads UNION SELECT id FROM slanted),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u)
SELECT component, count(*) AS size FROM (SELECT node, min(other) AS component FROM reach GROUP BY node) GROUP BY component"""))
def copper_islands(spark, d):
    c = slanted_copper(spark, d)
    return graph.islands(c.select(F.col("id").alias("node")), copper.contacts(c))


def box_gap_sql(p: str, q: str) -> str:
    side = lambda c, s: f"greatest(abs({p}.{c} - {q}.{c}) - ({p}.{s} + {q}.{s}) / 2, 0)"
    return f"sqrt(pow({side('x', 'size_x')}, 2) + pow({side('y', 'size_y')}, 2))"


@register("region_contacts", sql("round_pads", """
tri AS (SELECT concat('R', CAST(s_suppkey AS STRING)) AS id, CAST((s_suppkey * 7) % 50 AS DOUBLE) AS x, CAST((s_suppkey * 13) % 40 AS DOUBLE) AS y FROM supplier),
e AS (SELECT id, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM tri UNION ALL SELECT id, x + 1, y, x + 1, y + 1 FROM tri UNION ALL SELECT id, x + 1, y + 1, x, y FROM tri),
far AS (SELECT p.id AS u, e.id AS v, min(""" + point_segment_sql("p.x", "p.y", "e") + """) AS d, any_value(p.size_x) AS size, any_value(p.x) AS px, any_value(p.y) AS py FROM round_pads p JOIN e ON true GROUP BY 1, 2)
SELECT u, v FROM far JOIN tri ON far.v = tri.id WHERE d - size / 2 <= 0.03 OR (px > tri.x AND px < tri.x + 1 AND py > tri.y AND py - tri.y < px - tri.x)"""))
def region_contacts(spark, d):
    """Round pads of all layers, pressed into one, that touch or lie in triangles of copper."""
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    tri = table(spark, d, "supplier").select(F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("id"), ((F.col("s_suppkey") * 7) % 50).cast("double").alias("x"), ((F.col("s_suppkey") * 13) % 40).cast("double").alias("y"))
    regions = tri.select("id", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 0)).alias("points"), F.lit("x").alias("layer"))
    pads = table(spark, d, "round_pads").withColumn("layer", F.lit("x"))
    return copper.near(copper.pad_shapes(pads), copper.region_shapes(regions), 0.03).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


@register("copper_clearance", sql("round_pads slanted", f"""
near AS (
  SELECT p.id AS l_id, t.id AS r_id, {point_segment_sql('p.x', 'p.y', 't')} - p.size_x / 2 - t.width / 2 AS gap, p.net_id AS a, t.net_id AS b FROM round_pads p JOIN slanted t ON p.layer = t.layer)
SELECT l_id, r_id, round(greatest(gap, 0), 6) AS gap, CASE WHEN a IS NULL OR b IS NULL THEN 'unresolved' ELSE 'different' END AS state FROM near WHERE gap < 0.151 AND (a IS NULL OR b IS NULL OR a <> b)"""))
def copper_clearance(spark, d):
    out = copper.clearances(copper.pad_shapes(table(spark, d, "round_pads")), copper.track_shapes(table(spark, d, "slanted")), 0.151)
    return out.select("l_id", "r_id", F.round("gap", 6).alias("gap"), "state")


CONTACT = """
flat AS (SELECT p.id AS u, t.id AS v FROM pads p JOIN tracks t ON p.layer = t.layer
  AND sqrt(pow(greatest(p.x - p.size_x / 2 - greatest(t.x1, t.x2), 0, least(t.x1, t.x2) - (p.x + p.size_x / 2)), 2) + pow(greatest(p.y - p.size_y / 2 - t.y1, 0, t.y1 - (p.y + p.size_y / 2)), 2)) - t.width / 2 <= 0.03),
hit AS (SELECT d.id AS drill_id, p.id, p.layer FROM drills d JOIN pads p ON sqrt(pow(greatest(p.x - p.size_x / 2 - d.x, 0, d.x - p.x - p.size_x / 2), 2) + pow(greatest(p.y - p.size_y / 2 - d.y, 0, d.y - p.y - p.size_y / 2), 2)) - d.diameter / 2 <= 0.53),
star AS (SELECT drill_id, min(id) AS u FROM hit GROUP BY 1 HAVING count(DISTINCT layer) > 1),
via AS (SELECT s.u, h.id AS v, h.drill_id FROM hit h JOIN star s USING (drill_id) WHERE h.id <> s.u)"""


def physical(spark, d):
    """Box pads, tracks and wide drills that are proven to join both layers, with a confidence by number."""
    pads, tracks = table(spark, d, "pads"), table(spark, d, "tracks")
    drills = table(spark, d, "drills").withColumns({"diameter": F.col("diameter") + 1, "plating": F.lit("plated"), "span_proven": F.lit(True), "confidence": F.when(F.substring("id", -1, 1) == "7", 0.5).otherwise(0.95)})
    flat = connectivity.pad_track_contacts(pads, tracks, 0.03).withColumn("confidence", F.lit(1.0))
    via = copper.via_contacts(drills, copper.pad_shapes(pads), 0.03)
    return pads, tracks, flat, via


@register("via_edges", sql("pads tracks drills", CONTACT + " SELECT u, v, drill_id FROM via"))
def via_edges(spark, d):
    return physical(spark, d)[3].select("u", "v", "drill_id")


@register("physical_nets", sql("pads tracks drills", CONTACT + """,
edge AS (SELECT u, v, 1e0 AS c FROM flat UNION ALL SELECT u, v, CASE WHEN right(drill_id, 1) = '7' THEN 0.5e0 ELSE 0.95e0 END FROM via), both_ways AS (SELECT u, v FROM edge UNION ALL SELECT v, u FROM edge),
nodes AS (SELECT id AS node FROM pads UNION SELECT id FROM tracks), reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
label AS (SELECT node, min(other) AS component FROM reach GROUP BY node), c AS (SELECT component, min(c) AS c FROM edge JOIN label ON edge.u = label.node GROUP BY 1)
SELECT concat('net_', substr(sha1(string_agg(node, '|' ORDER BY node)), 1, 12)) AS net_id, count(*) AS member_count, min(node) AS first_member, coalesce(min(least(0.99e0, c.c)), 0.99e0) AS confidence FROM label LEFT JOIN c USING (component) GROUP BY component"""))
def physical_nets(spark, d):
    """Nets over contacts and vias, with the confidence of the weakest via."""
    pads, tracks, flat, via = physical(spark, d)
    nodes = pads.select(F.col("id").alias("node")).unionByName(tracks.select(F.col("id").alias("node")))
    return connectivity.nets(nodes, flat.unionByName(via.drop("drill_id"))).drop("component")


@register("net_labels", sql("tracks", """
m AS (SELECT layer AS net_id, id AS member_id, CASE WHEN x1 < 3 THEN 'N/C' WHEN layer = '0' THEN 'GND' ELSE coalesce(net_id, '') END AS name FROM tracks),
n AS (SELECT net_id, count(DISTINCT name) FILTER (WHERE name NOT IN ('', 'N/C')) AS k, max(name) FILTER (WHERE name NOT IN ('', 'N/C')) AS label FROM m GROUP BY 1)
SELECT net_id, CASE WHEN k = 1 THEN label END AS label, CASE WHEN k > 1 THEN 'conflict' WHEN k = 1 THEN 'labelled' ELSE 'unlabelled' END AS state FROM n"""))
def net_labels(spark, d):
    t = table(spark, d, "tracks")
    name = F.when(F.col("x1") < 3, "N/C").when(F.col("layer") == "0", "GND").otherwise(F.coalesce("net_id", F.lit("")))
    return connectivity.net_labels(t.select(F.col("layer").alias("net_id"), F.col("id").alias("member_id")), t.select(F.col("id").alias("member_id"), name.alias("name")))


def rule_board(spark, d):
    """Axis-parallel tracks, round pads, drills, slots and a frame that cuts through them."""
    edges = [(0.69, 0.69, 45.31, 0.69), (45.31, 0.69, 45.31, 25.31), (45.31, 25.31, 0.69, 25.31), (0.69, 25.31, 0.69, 0.69)]
    frame = spark.createDataFrame([(f"E{i}", i, *e) for i, e in enumerate(edges)], "id string, ord long, x1 double, y1 double, x2 double, y2 double")
    s = F.col("s_suppkey")
    plating = F.when(s % 3 == 0, "non-plated").when(s % 3 == 1, "unknown").otherwise("plated")
    slots = table(spark, d, "supplier").select(F.concat(F.lit("S"), s.cast("string")).alias("id"), (s * 7 % 50 + 0.1).alias("x1"), (s * 13 % 40 + 0.1).alias("y1"), (s * 7 % 50 + 1.1).alias("x2"), (s * 13 % 40 + 0.1).alias("y2"), F.lit(0.3).alias("width"), plating.alias("plating"))
    return {"tracks": table(spark, d, "tracks"), "pads": table(spark, d, "round_pads").withColumn("drill", F.when(F.col("size_x") > 0.5, F.col("size_x") - 0.15)), "drills": table(spark, d, "drills"), "slots": slots, "outline": frame}


@register("drc_rules", sql("tracks round_pads drills", f"""
slot AS (SELECT concat('S', CAST(s_suppkey AS STRING)) AS id, (s_suppkey * 7) % 50 + 0.1e0 AS x1, (s_suppkey * 13) % 40 + 0.1e0 AS y1, (s_suppkey * 7) % 50 + 1.1e0 AS x2, (s_suppkey * 13) % 40 + 0.1e0 AS y2, CASE WHEN s_suppkey % 3 = 0 THEN 'error' ELSE 'warning' END AS severity FROM supplier WHERE s_suppkey % 3 < 2),
copper AS (SELECT x1, y1, x2, y2, width / 2 AS r FROM tracks UNION ALL SELECT x, y, x, y, size_x / 2 FROM round_pads), disc AS (SELECT x AS x1, y AS y1, x AS x2, y AS y2, diameter / 2 AS r FROM drills),
every AS (SELECT x1, y1, x2, y2, 0.15e0 AS r FROM (SELECT (s_suppkey * 7) % 50 + 0.1e0 AS x1, (s_suppkey * 13) % 40 + 0.1e0 AS y1, (s_suppkey * 7) % 50 + 1.1e0 AS x2, (s_suppkey * 13) % 40 + 0.1e0 AS y2 FROM supplier)),
shapes AS (SELECT 'COPPER' AS what, * FROM copper UNION ALL SELECT 'DRILL', * FROM disc UNION ALL SELECT 'SLOT', * FROM every),
placed AS (SELECT what, least(least(x1, x2) - 0.69, 45.31 - greatest(x1, x2), least(y1, y2) - 0.69, 25.31 - greatest(y1, y2)) - r AS far FROM shapes),
near AS (SELECT s.id, s.severity, {point_segment_sql('p.x', 'p.y', 's')} - p.size_x / 2 - 0.15 AS gap FROM slot s, round_pads p UNION ALL SELECT s.id, s.severity, {segment_segment_sql('s', 't')} - t.width / 2 - 0.15 FROM slot s, tracks t)
SELECT 'TRACK_WIDTH_MIN' AS code, 'warning' AS severity, count(*) AS n FROM tracks WHERE width < 0.15 GROUP BY ALL HAVING count(*) > 0 UNION ALL
SELECT 'DRILL_MIN', 'warning', count(*) FROM drills WHERE diameter < 0.2 GROUP BY ALL HAVING count(*) > 0 UNION ALL
SELECT 'ANNULAR_RING_MIN', 'warning', count(*) FROM round_pads WHERE size_x > 0.5 GROUP BY ALL HAVING count(*) > 0 UNION ALL
SELECT 'MECHANICAL_COPPER_CLEARANCE', severity, count(*) FROM near WHERE gap < 0.15 GROUP BY severity UNION ALL
SELECT concat(what, '_OUTSIDE_BOARD'), 'error', count(*) FROM placed WHERE far < 0 GROUP BY what UNION ALL
SELECT concat(what, '_EDGE_CLEARANCE'), 'error', count(*) FROM placed WHERE far >= 0 AND far < 0.2 GROUP BY what"""))
def drc_rules(spark, d):
    """Six of the design rules run as one, by code and severity."""
    found = board.run_drc(rule_board(spark, d), names=["track_width", "drill_size", "annular_ring", "mechanical_clearance", "edge_presence", "duplicate_ids"])
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


@register("drc_drill_copper", sql("round_pads drills", "SELECT d.id AS drill, p.id AS object, round(greatest(sqrt(pow(d.x - p.x, 2) + pow(d.y - p.y, 2)) - d.diameter / 2 - p.size_x / 2, 0), 5) AS gap FROM drills d JOIN round_pads p ON sqrt(pow(d.x - p.x, 2) + pow(d.y - p.y, 2)) - d.diameter / 2 - p.size_x / 2 < 0.151"))
def drc_drill_copper(spark, d):
    some = {"pads": table(spark, d, "round_pads"), "drills": table(spark, d, "drills")}
    found = board.drill_clearance(some, board.Limits(drill_copper=0.151))
    return found.select(F.col("object_ids")[0].alias("drill"), F.col("object_ids")[1].alias("object"), F.round(F.regexp_extract("message", r"([0-9.]+) mm below", 1).cast("double"), 5).alias("gap"))


@register("validate_board", sql("tracks", """
m AS (SELECT id, coalesce(net_id, 'none') AS net FROM tracks), k AS (SELECT count(*) AS n FROM m WHERE net = 'N3')
SELECT 'OBJECT_NET_BACKREF_MISMATCH' AS code, 'error' AS severity, n FROM k UNION ALL
SELECT 'NET_MEMBER_MISSING', 'error', count(*) FROM nation UNION ALL SELECT 'INVALID_NET_CONFIDENCE', 'error', 1 UNION ALL SELECT 'DUPLICATE_NET_ID', 'error', 1 UNION ALL
SELECT 'OBJECT_IN_MULTIPLE_NETS', 'error', count(*) FROM m WHERE net = 'N1' UNION ALL
SELECT 'SLOT_WIDTH_INVALID', 'error', count(*) FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'SLOT_ZERO_LENGTH', 'warning', count(*) FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL
SELECT 'ROUTE_WIDTH_NONPOSITIVE', 'error', count(*) FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'ROUTE_ZERO_LENGTH_SEGMENT', 'warning', count(*) FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL
SELECT 'REGION_GEOMETRY_INVALID', 'error', count(*) FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT 'REGION_NOT_CLOSED', 'error', count(*) FROM supplier WHERE s_suppkey % 6 = 1 UNION ALL
SELECT 'OUTLINE_NOT_CLOSED', 'warning', 1"""))
def validate_board(spark, d):
    """A board with a known number of every fault."""
    tracks, s = table(spark, d, "tracks"), F.col("s_suppkey")
    supplier = table(spark, d, "supplier").withColumn("name", s.cast("string"))
    listed = tracks.where("net_id is not null and net_id <> 'N3'").select("net_id", F.col("id").alias("member_id"))
    twice = tracks.where("net_id = 'N1'").select(F.lit("other").alias("net_id"), F.col("id").alias("member_id"))
    lost = table(spark, d, "nation").select(F.lit("N2").alias("net_id"), F.concat(F.lit("lost"), F.col("n_nationkey").cast("string")).alias("member_id"))
    names = tracks.select("net_id").where("net_id is not null").distinct().select("net_id", F.when(F.col("net_id") == "N4", 1.5).otherwise(0.9).alias("confidence"))
    nets = names.unionByName(names.where("net_id = 'N2'")).unionByName(names.limit(1).select(F.lit("other").alias("net_id"), F.lit(0.9).alias("confidence")))
    end = F.when(s % 5 == 0, 0.0).otherwise(1.0)
    slots = supplier.select(F.concat(F.lit("S"), "name").alias("id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), end.alias("x2"), F.lit(0.0).alias("y2"), F.when(s % 4 == 0, 0.0).otherwise(0.3).alias("width"), F.lit("plated").alias("plating"))
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    routes = supplier.select(F.concat(F.lit("O"), "name").alias("id"), F.array(at(0, 0), F.struct(end.alias("x"), F.lit(0.0).alias("y"))).alias("points"), F.when(s % 4 == 0, 0.0).otherwise(0.3).alias("width"), F.lit("unknown").alias("plating"))
    bow, box, open_ = F.array(at(0, 0), at(1, 1), at(1, 0), at(0, 1), at(0, 0)), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0)), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))
    regions = supplier.select(F.concat(F.lit("R"), "name").alias("id"), F.when(s % 6 == 0, bow).when(s % 6 == 1, open_).otherwise(box).alias("points"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"), F.lit("F.Cu").alias("layer"), F.lit(None).cast("string").alias("net_id"))
    outline = spark.createDataFrame([("E0", 0, 0.0, 0.0, 9.0, 0.0), ("E1", 1, 9.0, 0.0, 9.0, 9.0)], "id string, ord long, x1 double, y1 double, x2 double, y2 double")
    found = board.validate({"tracks": tracks, "nets": nets, "net_members": listed.unionByName(twice).unionByName(lost), "slots": slots, "routes": routes, "regions": regions, "outline": outline})
    return found.groupBy("code", "severity").agg(F.count("*").alias("n"))


@register("review_sources", sql("tracks drills round_pads slanted", f"""
near AS (SELECT 1 AS one FROM round_pads p JOIN slanted t ON p.layer = t.layer AND t.net_id IS NULL AND {point_segment_sql('p.x', 'p.y', 't')} - p.size_x / 2 - t.width / 2 < 0.151)
SELECT 'clearance' AS kind, count(*) AS n FROM near UNION ALL SELECT 'drill', count(*) FROM drills WHERE diameter > 0.45 UNION ALL SELECT 'net', count(DISTINCT net_id) FROM tracks WHERE net_id IS NOT NULL UNION ALL
SELECT 'via_span', count(*) FROM drills WHERE diameter < 0.35 UNION ALL SELECT 'component', count(*) FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 10 < 5 UNION ALL SELECT 'diagnostic', count(*) FROM nation"""))
def review_sources(spark, d):
    """Open items by source: no label, weak confidence, unknown plating and nets, unproven vias, diagnostics."""
    s, drills = F.col("s_suppkey"), table(spark, d, "drills")
    pads, tracks = table(spark, d, "round_pads"), table(spark, d, "slanted").where("net_id is null")
    parts = table(spark, d, "supplier").select(F.concat(F.lit("U"), s.cast("string")).alias("id"), F.when(s % 4 != 0, "U1").alias("reference"), ((s % 10) / 10).alias("confidence"))
    some = {
        "drills": drills.withColumn("plating", F.when(F.col("diameter") > 0.45, "unknown").otherwise("plated")), "pads": pads, "components": parts,
        "nets": table(spark, d, "tracks").select("net_id").where("net_id is not null").distinct().select("net_id", F.lit(None).cast("string").alias("label"), F.lit(0.9).alias("confidence")),
        "via_spans": drills.select(F.col("id").alias("drill_id"), F.lit("F.Cu").alias("from_layer"), F.lit("B.Cu").alias("to_layer"), (F.col("diameter") >= 0.35).alias("proven"), F.lit(0.7).alias("confidence")),
        "diagnostics": table(spark, d, "nation").select(F.lit("warning").alias("severity"), F.lit("X").alias("code"), F.col("n_name").alias("message"), F.lit("a.gtl").alias("path"), F.col("n_nationkey").cast("int").alias("line")),
    }
    some["tracks"] = tracks
    queue = board.review_queue(some, limits=board.Limits(clearance=0.151), component_confidence_below=0.45)
    # tracks without a name are near each other too; here the pairs of a pad and a track count
    mixed = board.unresolved_clearance({"pads": pads, "tracks": tracks}, board.Limits(clearance=0.151)).where("substr(object_ids[0], 1, 1) <> substr(object_ids[1], 1, 1)")
    return queue.where("kind <> 'clearance'").select("kind").unionByName(mixed.select(F.lit("clearance").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@register("outline_gaps", "WITH o AS (SELECT c_nationkey AS board, c_custkey AS id, CAST(c_custkey % 13 AS DOUBLE) AS x1, CAST(c_custkey % 7 AS DOUBLE) AS y1, CAST(c_custkey % 13 + c_custkey % 2 AS DOUBLE) AS x2, CAST(c_custkey % 7 AS DOUBLE) AS y2 FROM customer), n AS (SELECT *, coalesce(lead(id) OVER w, first(id) OVER w) AS next_id, coalesce(lead(x1) OVER w, first(x1) OVER w) AS nx, coalesce(lead(y1) OVER w, first(y1) OVER w) AS ny FROM o WINDOW w AS (PARTITION BY board ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT id, next_id, round(sqrt(pow(x2 - nx, 2) + pow(y2 - ny, 2)), 6) AS gap FROM n WHERE sqrt(pow(x2 - nx, 2) + pow(y2 - ny, 2)) > 0.05")
def outline_gaps(spark, d):
    k = F.col("c_custkey")
    o = table(spark, d, "customer").select(F.col("c_nationkey").alias("board"), k.alias("id"), k.alias("ord"), (k % 13).cast("double").alias("x1"), (k % 7).cast("double").alias("y1"), (k % 13 + k % 2).cast("double").alias("x2"), (k % 7).cast("double").alias("y2"))
    return rules.outline_gaps(o).select("id", "next_id", F.round("gap", 6).alias("gap"))


@register("rule_registry", sql("pads tracks drills", "SELECT 'DRILL_DIAMETER_INVALID' AS code, count(*) AS n FROM drills WHERE diameter - 0.4 <= 0 GROUP BY 1 HAVING count(*) > 0 UNION ALL SELECT 'wide', count(*) FROM tracks WHERE width > 0.2 GROUP BY 1 HAVING count(*) > 0"))
def rule_registry(spark, d):
    """A registry with a rule of its own beside a built-in one."""
    from tracewright.operators import checks

    own = rules.Registry()
    own.add("geometry", checks.builtin().rules["geometry"])
    own.add("wide", lambda t: rules.issues(t["tracks"].where("width > 0.2"), "own", "info", "wide", "a wide track", "id"))
    drills = table(spark, d, "drills").withColumn("diameter", F.col("diameter") - 0.4)
    return own.run({"tracks": table(spark, d, "tracks"), "pads": table(spark, d, "pads"), "drills": drills}).groupBy("code").agg(F.count("*").alias("n"))


@register("declared_spans", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 6 <= 1 THEN 'invalid span' WHEN p_partkey % 6 = 5 THEN 'span exceeds the stackup' END AS issue, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 6 <= 1 OR p_partkey % 6 = 5 THEN 0 ELSE p_partkey % 6 END AS n FROM part")
def declared_spans(spark, d):
    """X2 spans from layer 1 to layer k of a declared stackup of four layers."""
    k, no = F.col("p_partkey") % 6, F.col("p_size") % 5 == 0
    order = F.array(*map(F.lit, ("F.Cu", "In1.Cu", "In2.Cu", "B.Cu")))
    out = hypotheses.declared_span(F.when(~no, F.array(F.lit(1), k.cast("int"))), F.lit("pth"), order, F.lit(True))
    return table(spark, d, "part").select("p_partkey", out["issue"].alias("issue"), F.when(~no, F.size(out["layers"])).alias("n"))


@register("first_in_group", "SELECT c_custkey, c_mktsegment = first(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS same FROM customer")
def first_in_group(spark, d):
    return windows.against_first(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"], "c_mktsegment").select("c_custkey", "same")


@register("radial_order", sql("round_pads", "c AS (SELECT *, round(avg(x) OVER g, 9) AS mx, round(avg(y) OVER g, 9) AS my FROM round_pads WINDOW g AS (PARTITION BY layer)) SELECT id, row_number() OVER (PARTITION BY layer ORDER BY round(atan2(y - my, x - mx), 9), id) AS place FROM c"))
def radial_order(spark, d):
    """Places by angle about the centre, angles to nine decimals so that equal ones tie by id."""
    pads = table(spark, d, "round_pads")
    return windows.radial_order(pads, ["layer"], ["id"], digits=9).select("id", F.col("place").cast("bigint").alias("place"))
