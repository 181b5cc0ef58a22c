"""Queries over parsed files; their texts are made from the driver's tables or are small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.geometry import signed_area
from tracewright.operators import connectivity, graph
from tracewright.plans.derived import table
from tracewright.plans.registry import register
from tracewright.sinks import audit, footprints, kicad, reports
from tracewright.sources import excellon, formats, forms, gerber, tables
from tracewright.storage import cut, new_folder


def k():
    return F.col("p_partkey")


#: Tasks that the files of a query are dealt to.
FILE_TASKS = 64


def in_files(df, line, head, tail, file):
    """Lines of a table as texts (path, content), a few hundred files."""
    # a number of tasks that adaptive execution leaves alone: files are few rows, but each is much work
    own = df.select(file.alias("path"), line.alias("line"), "ord").repartition(FILE_TASKS, "path")
    lines = own.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return lines.select("path", F.concat(F.lit(head), "body", F.lit(tail)).alias("content"))


def fixed(v, digits=4):
    return F.format_string(f"%.{digits}f", v.cast("double"))


@register("parse_excellon", "SELECT concat(CAST(p_partkey % 20 AS STRING), '.drl') AS path, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey // 50 AS DOUBLE) AS y, CASE WHEN p_size % 2 = 0 THEN 0.8e0 ELSE 1.2e0 END AS diameter FROM part")
def parse_excellon(spark, d):
    part = table(spark, d, "part").withColumn("ord", k())
    line = F.concat(F.when(F.col("p_size") % 2 == 0, "T01").otherwise("T02"), F.lit("\nX"), fixed(k() % 50), F.lit("Y"), fixed(F.floor(k() / 50)))
    files = in_files(part, line, "M48\nMETRIC\nT01C0.800\nT02C1.200\n%\n", "\nM30\n", F.concat((k() % 20).cast("string"), F.lit(".drl")))
    return excellon.parse_frame(files).where("kind = 'drill'").select("path", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("size_x").alias("diameter"))


@register("parse_gerber", "SELECT concat(CAST(p_partkey % 20 AS STRING), '.gtl') AS path, CASE WHEN p_size % 3 = 0 THEN 'track' ELSE 'pad' END AS kind, round(p_partkey % 50 / 10, 4) AS x, round(p_partkey // 50 / 10, 4) AS y FROM part")
def parse_gerber(spark, d):
    part = table(spark, d, "part").withColumn("ord", k())
    at = lambda x, y: F.concat(F.lit("X"), F.lpad((x * 1000).cast("bigint").cast("string"), 10, "0"), F.lit("Y"), F.lpad((y * 1000).cast("bigint").cast("string"), 10, "0"))
    x, y = k() % 50, F.floor(k() / 50)
    line = F.when(F.col("p_size") % 3 == 0, F.concat(at(x, y), F.lit("D02*\n"), at(x + 1, y), F.lit("D01*"))).otherwise(F.concat(at(x, y), F.lit("D03*")))
    files = in_files(part, line, "%FSLAX64Y64*%\n%MOMM*%\n%ADD10C,0.200*%\nD10*\nG01*\n", "\nM02*\n", F.concat((k() % 20).cast("string"), F.lit(".gtl")))
    out = gerber.parse_frame(files).where("kind in ('track', 'pad')")
    return out.select("path", "kind", F.round("x1", 4).alias("x"), F.round("y1", 4).alias("y"))


@register("parse_ipc356", "SELECT concat('N', CAST(p_partkey % 40 AS STRING)) AS net_name, concat('R', CAST(p_partkey AS STRING)) AS reference, p_size * 1e0 / 1000 AS x FROM part WHERE p_partkey % 5 <> 0")
def parse_ipc356(spark, d):
    n = k().cast("string")
    line = F.when(k() % 5 == 0, F.concat(F.lit("C comment "), n)).otherwise(F.concat(F.lit("317 NET=N"), (k() % 40).cast("string"), F.lit(" REF=R"), n, F.lit(" PIN=1 X="), F.col("p_size").cast("string"), F.lit(" Y=0")))
    return tables.ipc356(table(spark, d, "part").select(line.alias("value"))).select("net_name", "reference", "x")


@register("bom_parts", "SELECT concat('R', CAST(p_partkey AS STRING)) AS reference, p_brand AS value FROM part UNION ALL SELECT concat('C', CAST(p_partkey AS STRING)), p_brand FROM part")
def bom_parts(spark, d):
    n = k().cast("string")
    rows = table(spark, d, "part").select(F.concat(F.lit("R"), n, F.lit(" , C"), n).alias("Designator"), F.col("p_brand").alias("VALUE"), F.col("p_size").cast("string").alias("Qty"))
    return tables.bom_parts(tables.bom(rows)).select("reference", "value")


@register("centroid_rows", "SELECT concat('R', CAST(p_partkey AS STRING)) AS Reference, printf('%.6f', CAST(p_size AS DOUBLE)) AS X_mm, CASE WHEN p_partkey % 2 = 0 THEN 'top' ELSE 'bottom' END AS Side FROM part WHERE p_partkey % 7 <> 0")
def centroid_rows(spark, d):
    n = k().cast("string")
    rows = table(spark, d, "part").select(F.when(k() % 7 != 0, F.concat(F.lit("R"), n)).alias("RefDes"), F.concat(F.col("p_size").cast("string"), F.lit("mm")).alias("Mid X"), F.lit("1.5").alias("Mid Y"), F.when(k() % 2 == 0, "Top").otherwise("B").alias("Layer"))
    return reports.centroid(tables.placements(rows)).select("Reference", "X_mm", "Side")


@register("detect_formats", "SELECT concat(CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.gtl' WHEN 1 THEN '.drl' WHEN 2 THEN '.csv' ELSE '.bin' END) AS path, CASE p_partkey % 4 WHEN 0 THEN 'gerber' WHEN 1 THEN 'excellon' WHEN 2 THEN 'csv' ELSE 'unknown' END AS format FROM part")
def detect_formats(spark, d):
    end = F.when(k() % 4 == 0, ".gtl").when(k() % 4 == 1, ".drl").when(k() % 4 == 2, ".csv").otherwise(".bin")
    text = F.when(k() % 4 == 0, "%FSLAX24Y24*%\n%MOMM*%").when(k() % 4 == 1, "M48\nMETRIC").when(k() % 4 == 2, "Reference,X,Y\n").otherwise("\u0001\u0002")
    files = table(spark, d, "part").select(F.concat(k().cast("string"), end).alias("path"), text.alias("content"))
    return formats.detect(files).select("path", "format")


@register("star_edges", "WITH m AS (SELECT p_brand AS net_id, concat('P', CAST(p_partkey AS STRING)) AS member_id, p_partkey AS ord FROM part), f AS (SELECT net_id, min_by(member_id, ord) AS source FROM m GROUP BY 1) SELECT source, member_id AS target FROM m JOIN f USING (net_id) WHERE member_id <> source")
def star_edges(spark, d):
    members = table(spark, d, "part").select(F.col("p_brand").alias("net_id"), F.concat(F.lit("P"), k().cast("string")).alias("member_id"), k().alias("ord"))
    return reports.star_edges(members).select("source", "target")


def reconstruct(spark, files):
    """Tables of a board from its files (path, content): pads with drills, tracks, outline, and nets with their members."""
    # a few files are many objects, which no planner can know from the files: tables of their own have sizes, so that none is broadcast by mistake
    g = cut(gerber.parse_frame(files.where("not path like '%.drl'")), "copper-objects")
    e = cut(excellon.parse_frame(files.where("path like '%.drl'")), "drill-objects")
    pads = cut(g.where("kind = 'pad'").select("id", F.col("x1").alias("x"), F.col("y1").alias("y"), "size_x", "size_y", "shape", F.lit("F.Cu").alias("layer")), "pads")
    tracks = cut(g.where("kind = 'track'").select("id", "x1", "y1", "x2", "y2", F.col("size_x").alias("width"), F.lit("F.Cu").alias("layer")), "tracks")
    drills = cut(e.where("kind = 'drill'").select("id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("size_x").alias("diameter")), "drills")
    edges = cut(connectivity.pad_track_contacts(pads, tracks, 0.03).unionByName(connectivity.track_contacts(tracks, 0.03)), "contacts")
    nodes = pads.select(F.col("id").alias("node")).unionByName(tracks.select(F.col("id").alias("node")))
    return {"pads": connectivity.attach_drills(pads, drills), "tracks": tracks, "drills": drills, "outline": g.where("kind = 'outline'"), "nets": connectivity.nets(nodes, edges), "islands": graph.islands(nodes, edges)}


@register("reconstruct_board", """
WITH p AS (SELECT p_partkey, p_size, (p_partkey // 20) % 50 AS x, (p_partkey // 1000) * 20 + p_partkey % 20 AS y FROM part),
e AS (SELECT count(*) AS n FROM p a JOIN p b ON b.x = a.x + 1 AND b.y = a.y WHERE a.p_size % 3 = 0)
SELECT count(*) AS pads, count(*) FILTER (WHERE p_size % 3 = 0) AS tracks, count(*) FILTER (WHERE p_partkey % 4 = 0) AS drilled, count(*) - (SELECT n FROM e) AS nets FROM p""")
def reconstruct_board(spark, d):
    """One board in twenty copper files and a drill file: round pads, tracks to the right, drills."""
    part = table(spark, d, "part").withColumns({"ord": k(), "x": F.floor(k() / 20) % 50, "y": F.floor(k() / 1000) * 20 + k() % 20})
    at = lambda x: F.concat(F.lit("X"), (x * 10_000).cast("bigint").cast("string"), F.lit("Y"), (F.col("y") * 10_000).cast("bigint").cast("string"))
    line = F.concat(F.lit("D10*\n"), at(F.col("x")), F.lit("D03*"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("\nD11*\n"), at(F.col("x")), F.lit("D02*\n"), at(F.col("x") + 1), F.lit("D01*"))).otherwise(""))
    files = in_files(part, line, "%FSLAX64Y64*%\n%MOMM*%\n%ADD10C,0.400*%\n%ADD11C,0.200*%\nG01*\n", "\nM02*\n", F.concat((k() % 20).cast("string"), F.lit(".gtl")))
    holes = part.where(k() % 4 == 0)
    drilled = in_files(holes, F.concat(F.lit("X"), fixed(F.col("x")), F.lit("Y"), fixed(F.col("y"))), "M48\nMETRIC\nT01C0.200\n%\nT01\n", "\nM30\n", F.lit("board.drl"))
    board = reconstruct(spark, files.unionByName(drilled))
    pads = board["pads"].agg(F.count("*").alias("pads"), F.count("drill").alias("drilled"))
    return pads.crossJoin(board["tracks"].agg(F.count("*").alias("tracks"))).crossJoin(board["nets"].agg(F.count("*").alias("nets"))).select("pads", "tracks", "drilled", "nets")


def board_of(spark, d):
    """Tracks, pads, drills, slots, regions, nets and an outline, of whole tables."""
    pads = table(spark, d, "round_pads").withColumn("drill", F.when(F.col("size_x") > 0.7, 0.3))
    tracks = table(spark, d, "slanted")
    layer = lambda df: df.withColumn("layer", F.when(F.col("layer") == "0", "F.Cu").when(F.col("layer") == "39", "B.Cu").when(F.col("layer") == "38", "In31.Cu").otherwise(F.concat(F.lit("In"), (F.col("layer").cast("int") % 30 + 1).cast("string"), F.lit(".Cu"))))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 7 % 50).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 40).cast("double").alias("y"))
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    regions = s.select(F.concat(F.lit("R"), "k").alias("id"), F.array(corner(0, 0), corner(0.5, 0), corner(0.5, 0.25), corner(0, 0)).alias("points"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"), F.lit("F.Cu").alias("layer"), F.concat(F.lit("N"), (F.col("k") % 11).cast("string")).alias("net_id"))
    plating = F.element_at(F.array(*map(F.lit, ("plated", "non-plated", "unknown"))), (F.col("k") % 3 + 1).cast("int"))
    slots = s.select(F.concat(F.lit("S"), "k").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1).alias("x2"), F.col("y").alias("y2"), F.lit(0.3).alias("width"), plating.alias("plating"))
    drills = table(spark, d, "drills").join(s.select(F.concat(F.lit("D"), "k").alias("id"), plating.alias("plating")), "id")
    outline = spark.createDataFrame([(f"E{i}", i, *p) for i, p in enumerate([(0.0, 0.0, 60.0, 0.0), (60.0, 0.0, 60.0, 50.0), (60.0, 50.0, 0.0, 50.0), (0.0, 50.0, 0.0, 0.0)])], "id string, ord long, x1 double, y1 double, x2 double, y2 double")
    nets = tracks.select("net_id").unionByName(pads.select("net_id")).where("net_id is not null").distinct().withColumn("label", F.lit(None).cast("string"))
    return {"tracks": layer(tracks), "pads": layer(pads), "drills": drills, "slots": slots, "regions": regions, "outline": outline, "nets": nets}


def file_lines(spark, board, planned=None):
    """The lines of the board's own file, written in parts and read again."""
    path = new_folder(spark, "board")
    kicad.write_board(board, path, planned)
    return forms.read_lines(spark, path, folders=True)


def read_back(spark, board):
    """The rows of the board's own file, form by form."""
    parts = forms.form_texts(file_lines(spark, board)).where("level = 1 and startswith(text, '(')")
    return tables.kicad(parts.select(F.col("board").alias("path"), F.concat(F.lit("(kicad_pcb "), "text", F.lit(")")).alias("content")))


BOARD_STATUS = """
WITH t AS (SELECT o_orderkey % 40 AS l, o_orderkey % 3 AS dx, o_orderkey % 4 AS dy FROM orders),
p AS (SELECT p_partkey % 40 AS l, 2e-1 + 1e-1 * (p_size % 7) AS size FROM part), s AS (SELECT s_suppkey AS k FROM supplier),
a AS (
  SELECT 'tracks' AS family, CASE WHEN dx = 0 AND dy = 0 THEN 'skip-zero-length' WHEN l = 38 THEN 'skip-layer' ELSE 'export' END AS status FROM t UNION ALL
  SELECT 'pads', CASE WHEN l = 38 THEN 'skip-layer' WHEN size > 0.7 THEN 'skip-drill-padstack' ELSE 'export' END FROM p UNION ALL
  SELECT 'drills', CASE k % 3 WHEN 0 THEN 'skip-plated-padstack' WHEN 1 THEN 'export-npth' ELSE 'skip-unknown-plating' END FROM s UNION ALL
  SELECT 'slots', CASE k % 3 WHEN 0 THEN 'infer-plated-padstack' WHEN 1 THEN 'export-npth' ELSE 'skip-unknown-plating' END FROM s UNION ALL
  SELECT 'regions', 'export' FROM s UNION ALL SELECT 'outline', 'export' FROM range(4))
"""


@register("kicad_export_status", BOARD_STATUS + "SELECT family, status, count(*) AS n FROM a GROUP BY ALL")
def kicad_export_status(spark, d):
    return kicad.statuses(kicad.plan(board_of(spark, d)))


@register("roundtrip_board", BOARD_STATUS + """, f AS (SELECT CASE family WHEN 'drills' THEN 'hole' WHEN 'outline' THEN 'outline' ELSE rtrim(family, 's') END AS family, status FROM a),
n AS (SELECT count(DISTINCT net_id) AS n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 11 END::VARCHAR AS net_id FROM orders UNION ALL SELECT p_brand FROM part))
SELECT family, CAST(count(*) FILTER (WHERE status LIKE 'export%') AS BIGINT) AS expected, CAST(count(*) FILTER (WHERE status LIKE 'export%') AS BIGINT) AS observed, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected, CAST(count(*) FILTER (WHERE NOT status LIKE 'export%') AS BIGINT) AS skipped FROM f GROUP BY 1
UNION ALL SELECT 'net', n, n, 0, 0, 0 FROM n""")
def roundtrip_board(spark, d):
    """The whole board written as a file, read back and compared, family by family."""
    board = board_of(spark, d)
    return kicad.audit(board, read_back(spark, board)).select("family", "expected", "observed", "missing", "unexpected", "skipped")


# -- footprints of several pads ------------------------------------------------------------------------------
def packaged_board(spark, d):
    """board_of() with routes, and pads of components of four; some components contradict themselves in one way or another."""
    n = k()
    side = F.when((F.floor(n / 4) % 17 == 0) & (n % 4 == 3), "In1.Cu").when(F.floor(n / 4) % 3 == 0, "B.Cu").otherwise("F.Cu")
    component = F.concat(F.lit("C"), F.floor(n / 4).cast("string"))
    text = lambda c: c.cast("string")
    pads = table(spark, d, "part").select(
        F.concat(F.lit("P"), text(n)).alias("id"), (n % 50 + 0.3).alias("x"), (F.floor(n / 50) + 0.2).alias("y"), (0.2 + 0.1 * (F.col("p_size") % 7)).alias("size_x"), F.lit(0.4).alias("size_y"), F.lit("R").alias("shape"), side.alias("layer"),
        (15.0 * (n % 4)).alias("rotation"), F.when(n % 41 == 0, 0.3).alias("drill"), F.col("p_brand").alias("net_id"), component.alias("component"), n.alias("n"),
    )
    own = lambda test, value: F.map_from_entries(F.filter("m", lambda x: test(x["n"]))) if value is None else F.map_from_entries(F.transform(F.filter("m", lambda x: test(x["n"])), lambda x: F.struct(x["id"], value(x["n"]))))
    parts = pads.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("m")).select(
        F.col("component").alias("id"), F.transform("m", lambda x: x["id"]).alias("pad_ids"), F.lit(footprints.COMPONENT).alias("kind"), F.lit(1.0).alias("confidence"), F.concat(F.lit("U"), "component").alias("reference"),
        own(lambda i: F.lit(True), lambda i: text(i % 4 + 1)).alias("pin_map"), own(lambda i: i % 5 == 0, lambda i: F.concat(F.lit("F"), text(i % 3))).alias("pin_functions"),
    )
    kinds = footprints.EVIDENCE
    tell = lambda kind, value, test: pads.where(test).select(F.concat("id", F.lit(kind)).alias("id"), F.col("id").alias("object_id"), F.lit(kinds[kind]).alias("kind"), F.lit(1.0).alias("confidence"), value.alias("detail"))
    m = F.col("n")
    evidence = tell("reference", F.concat(F.lit("U"), F.when(m % 37 == 0, "X").otherwise(F.col("component"))), m >= 0).unionByName(tell("number", text(m % 4 + 1), m % 29 != 0))
    evidence = evidence.unionByName(tell("function", F.concat(F.lit("F"), text(m % 3)), m % 5 == 0)).unionByName(tell("function", F.lit("X"), m % 43 == 0))
    board = board_of(spark, d)
    s = board["slots"]
    end = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    bent = F.substring("id", 2, 20).cast("bigint") % 5 == 0
    routes = s.select(F.concat(F.lit("R"), "id").alias("id"), F.when(bent, F.array(end("x1", "y1"), end("x2", "y2"), end("x1", "x2"))).otherwise(F.array(end("x1", "y1"), end("x2", "y2"))).alias("points"), "width", "plating")
    # the expressions of a component are used many times over
    return board | {"pads": pads.drop("component", "n"), "components": cut(parts, "components", free=False), "evidence": evidence, "routes": routes, "nets": board["tracks"].select("net_id").unionByName(pads.select("net_id")).where("net_id is not null").distinct().withColumn("label", F.lit(None).cast("string"))}


PACKAGED = """
WITH p AS (SELECT p_partkey AS n, p_partkey // 4 AS c, p_partkey % 41 = 0 AS drilled, (p_partkey // 4) % 17 = 0 AND p_partkey % 4 = 3 AS buried FROM part),
r AS (
  SELECT c, 'pad-not-exportable' AS reason FROM p WHERE drilled UNION SELECT c, 'reference-not-proven' FROM p WHERE NOT drilled AND n % 37 = 0 UNION
  SELECT c, 'pin-number-not-proven' FROM p WHERE NOT drilled AND n % 29 = 0 UNION SELECT c, 'function-conflict' FROM p WHERE NOT drilled AND n % 43 = 0 AND n % 5 = 0 UNION
  SELECT c, 'function-not-proven' FROM p WHERE NOT drilled AND n % 43 = 0 UNION
  SELECT c, 'pads-on-several-sides' FROM p WHERE NOT drilled GROUP BY c HAVING count(DISTINCT buried) > 1 UNION
  SELECT c, 'not-on-a-surface' FROM p WHERE NOT drilled GROUP BY c HAVING bool_and(buried)),
e AS (SELECT n, c, drilled, c NOT IN (SELECT c FROM r) AS good FROM p)
"""


@register("component_footprints", PACKAGED + """
SELECT 'reason' AS kind, reason AS name, count(*) AS n FROM r GROUP BY reason UNION ALL
SELECT 'component', CASE WHEN good THEN 'export' ELSE 'refused' END, count(DISTINCT c) FROM e GROUP BY 2 UNION ALL
SELECT 'pad', CASE WHEN good THEN 'export-grouped' WHEN drilled THEN 'skip-drill-padstack' ELSE 'export' END, count(*) FROM e GROUP BY 2""")
def component_footprints(spark, d):
    """Which components are footprints of several pads, which are refused and why, and what becomes of their pads."""
    board = packaged_board(spark, d)
    planned = kicad.plan(board)
    _, refused = footprints.component_plan(board["components"], kicad.plan({n: board[n] for n in ("pads", "tracks", "nets")})["pads"], board["evidence"])
    reasons = refused.select(F.explode("reasons").alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("reason").alias("kind"), "name", "n")
    count = lambda kind, table_: table_.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col("status").alias("name"), "n")
    return reasons.unionByName(count("component", planned["components"])).unionByName(count("pad", planned["pads"]))


@register("roundtrip_sections", PACKAGED.rstrip() + """,
t AS (SELECT count(*) AS n FROM orders WHERE (o_orderkey % 3 > 0 OR o_orderkey % 4 > 0) AND o_orderkey % 40 <> 38),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS open, count(*) FILTER (WHERE s_suppkey % 3 = 1 AND s_suppkey % 5 <> 0) AS straight FROM supplier),
nets AS (SELECT count(DISTINCT net_id) + 1 AS n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 11 END::VARCHAR AS net_id FROM orders UNION ALL SELECT p_brand FROM part)),
f AS (
  SELECT 'file_header' AS section, 1 AS n UNION ALL SELECT 'file_structure', 1 UNION ALL SELECT 'board_settings', 2 UNION ALL
  SELECT 'layer_table', 5 + max(CASE WHEN o_orderkey % 40 IN (0, 38, 39) THEN 0 ELSE o_orderkey % 40 % 30 + 1 END) FROM orders UNION ALL SELECT 'net_table', n FROM nets UNION ALL SELECT 'tracks', n FROM t UNION ALL SELECT 'board_outline', 4 UNION ALL
  SELECT 'recovered_drills', open FROM s UNION ALL SELECT 'recovered_pads', count(*) FROM e WHERE good OR NOT drilled UNION ALL
  SELECT unnest(['copper_regions', 'region_geometry', 'region_fill_state', 'region_rules']), n FROM s UNION ALL SELECT unnest(['recovered_slots', 'slot_geometry']), open FROM s UNION ALL SELECT 'recovered_routes', straight FROM s UNION ALL
  SELECT unnest(['vias', 'track_arcs', 'unexpected_edge_graphics', 'unexpected_copper_graphics', 'unexpected_footprint_copper_graphics', 'unexpected_fabrication_graphics', 'unexpected_copper_overrides', 'unexpected_fabrication_overrides', 'unexpected_pad_properties', 'unexpected_net_tie_groups', 'foreign_footprints']), 0)
SELECT section, CAST(n AS BIGINT) AS expected, CAST(n AS BIGINT) AS observed, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unexpected FROM f""")
def roundtrip_sections(spark, d):
    """The whole board with footprints and routes written in parts, read back form by form, and compared in all sections."""
    board = packaged_board(spark, d)
    planned = kicad.plan(board)
    return audit.audit(board, forms.forms(file_lines(spark, board, planned)), planned).drop("equal")


@register("board_forms", PACKAGED.rstrip() + """,
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS open, count(*) FILTER (WHERE s_suppkey % 3 = 1 AND s_suppkey % 5 <> 0) AS straight FROM supplier),
g AS (SELECT count(DISTINCT c) AS groups, count(*) AS pads FROM e WHERE good), a AS (SELECT count(*) AS n FROM e WHERE NOT good AND NOT drilled)
SELECT 'footprint' AS head, 2 * open + straight + groups + a.n AS n, 2 * open + straight + pads + a.n AS pads FROM s, g, a UNION ALL
SELECT 'zone', n, 0 FROM s UNION ALL SELECT 'gr_line', 4, 0 UNION ALL SELECT 'segment', count(*), 0 FROM orders WHERE (o_orderkey % 3 > 0 OR o_orderkey % 4 > 0) AND o_orderkey % 40 <> 38""")
def board_forms(spark, d):
    """How many forms of each kind the file has, and pads inside them, by its table of nodes."""
    made = forms.forms(file_lines(spark, packaged_board(spark, d)))
    n = forms.nodes(made.where("head in ('footprint', 'zone', 'gr_line', 'segment')"))
    heads = n.where("parent = -1").select("board", "form", F.col("head").alias("top"))
    pads = n.where("parent = 0 and head = 'pad'").groupBy("board", "form").agg(F.count("*").alias("pads"))
    return heads.join(pads, ["board", "form"], "left").groupBy(F.col("top").alias("head")).agg(F.count("*").alias("n"), F.coalesce(F.sum("pads"), F.lit(0)).alias("pads"))


A_HOLE, ANOTHER = [(0, 3), (2, 3), (2, 4), (4, 4), (4, 2), (2, 2), (2, 3), (0, 3)], [(0, 7), (2, 7), (2, 8), (4, 8), (4, 6), (2, 6), (2, 7), (0, 7)]
#: Closed contours: one simple, one with a hole, one with two; the others are no region for one reason each.
CONTOURS = [
    [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)],
    [(0, 0), (10, 0), (10, 10), (0, 10), *A_HOLE, (0, 0)],
    [(0, 0), (10, 0), (10, 10), (0, 10), *ANOTHER, *A_HOLE, (0, 0)],
    [(0, 0), (10, 0), (10, 10), (0, 10), (0, 3), (2, 3), *A_HOLE[-3:1:-1], (2, 3), (0, 3), (0, 0)],
    [(0, 0), (7, 0), (7, 2), (6, 2), (6, 4), (8, 4), (8, 2), (7, 2), (7, 0), (10, 0), (10, 10), (0, 10), *ANOTHER, (0, 0)],
    [(0, 0), (10, 0), (10, 10), (0, 10), (0, 5), (3, 7), (7, 7), (7, 3), (3, 3), (3, 7), (0, 5), (0, 0)],
    [(0, 0), (10, 10), (10, 0), (0, 8), (0, 0)],
    [(0, 0), (4, 0), (4, 5), (6, 5), (6, 0), (10, 0), (10, 10), (6, 10), (6, 5), (4, 5), (4, 10), (0, 10), (0, 0)],
]


@register("strict_regions", """
SELECT p_partkey % 8 AS contour, CASE p_partkey % 8 WHEN 3 THEN 'GERBER_REGION_CUTIN_WINDING_INVALID' WHEN 4 THEN 'GERBER_REGION_CUTIN_DIRECTION_MISMATCH' WHEN 5 THEN 'GERBER_REGION_CUTIN_INVALID' WHEN 6 THEN 'GERBER_REGION_INVALID' WHEN 7 THEN 'GERBER_REGION_CUTIN_DISJOINT_UNSUPPORTED' ELSE 'region' END AS outcome,
  count(*) AS n, CAST(sum(CASE p_partkey % 8 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END) AS BIGINT) AS holes, round(sum(CASE p_partkey % 8 WHEN 0 THEN 100e0 WHEN 1 THEN 96e0 WHEN 2 THEN 92e0 ELSE 0 END), 4) AS area
FROM part GROUP BY ALL""")
def strict_regions(spark, d):
    """A contour of one of eight kinds for each part, at a place of its own: which are regions, and why the others are none."""
    kind, x, y = (k() % 8).cast("int"), (F.floor(k() / 8) % 100) * 20, F.floor(k() / 800) * 20
    number = lambda v: (v * 10_000).cast("bigint").cast("string")
    draw = lambda ring: F.concat(F.lit("G36*\n"), *[F.concat(F.lit("X"), number(x + a), F.lit("Y"), number(y + b), F.lit("D02*\n" if i == 0 else "D01*\n")) for i, (a, b) in enumerate(ring)], F.lit("G37*"))
    text = F.element_at(F.array(*map(draw, CONTOURS)), kind + 1)
    part = table(spark, d, "part").withColumn("ord", k())
    files = in_files(part, text, "%FSLAX64Y64*%\n%MOMM*%\n", "\nM02*\n", F.concat_ws("-", kind.cast("string"), F.floor(k() / 1600).cast("string"), F.lit("x.gtl")))
    out = gerber.parse_frame(files, strict=False).where("kind in ('region', 'diagnostic')")
    inner = F.aggregate(F.coalesce("holes", F.array().cast(out.schema["holes"].dataType)), F.lit(0.0), lambda s, h: s + F.abs(signed_area(h)))
    area = F.when(F.col("kind") == "region", F.abs(signed_area(F.col("points"))) - inner).otherwise(0.0)
    return out.groupBy(F.substring_index("path", "-", 1).cast("bigint").alias("contour"), F.coalesce("code", "kind").alias("outcome")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "region", F.size("holes"))), F.lit(0)).cast("bigint").alias("holes"), F.round(F.sum(area), 4).alias("area"))


@register("parse_gerber_clear", """
WITH p AS (SELECT concat(CAST(p_partkey % 20 AS STRING), '.gtl') AS path, (p_partkey // 20) // 50 AS y, p_size FROM part),
r AS (SELECT path, y, (count(*) + 0.2e0) * 0.5e0 - 0.08e0 * count(*) FILTER (WHERE p_size % 2 = 0) + 0.01e0 * count(*) FILTER (WHERE p_size % 4 = 0) AS area, 1 + count(*) FILTER (WHERE p_size % 4 = 0) AS n, count(*) FILTER (WHERE p_size % 2 = 0) AS holes FROM p GROUP BY ALL)
SELECT path, CAST(sum(n) AS BIGINT) AS components, CAST(sum(holes) AS BIGINT) AS holes, round(sum(area), 4) AS area FROM r GROUP BY path""")
def parse_gerber_clear(spark, d):
    """Rows of dark boxes that overlap, clear boxes inside them, and dark ones inside these."""
    part = table(spark, d, "part")
    n = F.floor(k() / 20)
    at = F.concat(F.lit("X"), ((n % 50) * 10_000).cast("string"), F.lit("Y"), (F.floor(n / 50) * 10_000).cast("string"), F.lit("D03*"))
    step = lambda rows, place, polarity, tool: rows.select(k(), F.concat(F.lit(f"%LP{polarity}*%\nD{tool}*\n"), at).alias("draw"), F.struct(F.lit(place).alias("a"), k().alias("b")).alias("ord"))
    rows = step(part, 0, "D", 10).unionByName(step(part.where("p_size % 2 = 0"), 1, "C", 11)).unionByName(step(part.where("p_size % 4 = 0"), 2, "D", 12))
    files = in_files(rows, F.col("draw"), "%FSLAX64Y64*%\n%MOMM*%\n%ADD10R,1.2X0.5*%\n%ADD11R,0.4X0.2*%\n%ADD12R,0.1X0.1*%\n", "\nM02*\n", F.concat((k() % 20).cast("string"), F.lit(".gtl")))
    out = gerber.parse_frame(files).where("kind = 'region'")
    inner = F.aggregate("holes", F.lit(0.0), lambda s, h: s + F.abs(signed_area(h)))
    return out.groupBy("path").agg(F.count("*").alias("components"), F.sum(F.size("holes")).alias("holes"), F.round(F.sum(F.abs(signed_area(F.col("points"))) - inner), 4).alias("area"))
