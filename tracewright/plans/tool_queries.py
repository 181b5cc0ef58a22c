"""Queries over selection, import, readers, merges, statistics, formats of values, fits and wires."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import geometry, text
from tracewright.operators import board, evidence, graph, query
from tracewright.plans.derived import sql, table
from tracewright.plans.registry import register
from tracewright.plans.source_queries import FILE_TASKS
from tracewright.storage import new_folder
from tracewright.sinks import reports
from tracewright.sources import adapters, archives, excellon, formats, gerber, tables
from tracewright.streaming import event_log


def k():
    return F.col("p_partkey")


# -- selection ----------------------------------------------------------------------------------------
@register("keyed_filter", "SELECT user_id, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND user_id = 7")
def keyed_filter(spark, d):
    events = table(spark, d, "events")
    kind = events.agg(F.min("event_type")).first()[0]
    return query.keyed(events, event_type=kind, user_id=7, props=None).select("user_id", "event_id")


@register("text_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '77') OR contains(lower(c_mktsegment), '77') OR contains(lower(c_name), 'mach')")
def text_search(spark, d):
    c = table(spark, d, "customer")
    return query.text_search(c, "77", ["c_name", "c_mktsegment"]).select("c_custkey").unionByName(query.text_search(c, "MACH", ["c_name"]).select("c_custkey")).distinct()


SELECTED = """
o AS (SELECT 'tracks' AS class, id, layer, net_id FROM tracks UNION ALL SELECT 'pads', id, layer, net_id FROM pads UNION ALL SELECT 'drills', id, NULL, NULL FROM drills)"""


def selectable(spark, d):
    return {n: table(spark, d, n) for n in ("tracks", "pads", "drills")}


@register("board_selectors", sql("tracks pads drills", SELECTED + " SELECT 'layer' AS by, class, count(*) AS n FROM o WHERE layer = '1' GROUP BY ALL UNION ALL SELECT 'net', class, count(*) FROM o WHERE net_id = 'N3' GROUP BY ALL UNION ALL SELECT 'class', class, count(*) FROM o WHERE class = 'drills' GROUP BY ALL UNION ALL SELECT 'text', class, count(*) FROM o WHERE contains(lower(id), 'p1') OR contains(lower(coalesce(net_id, '')), 'p1') OR contains(layer, 'p1') GROUP BY ALL"))
def board_selectors(spark, d):
    """Objects of all tables by layer, by net, by class, by text."""
    b = selectable(spark, d)
    parts = {"layer": board.by_layer(b, "1"), "net": board.by_net(b, "N3"), "class": board.by_class(b, "drills"), "text": board.search(b, " P1 ")}
    out = None
    for name, df in parts.items():
        one = df.groupBy("class").agg(F.count("*").alias("n")).select(F.lit(name).alias("by"), "class", "n")
        out = one if out is None else out.unionByName(one)
    return out


@register("board_counts", sql("tracks pads drills", "SELECT 'tracks' AS name, count(*) AS n FROM tracks UNION ALL SELECT 'pads', count(*) FROM pads UNION ALL SELECT 'drills', count(*) FROM drills"))
def board_counts(spark, d):
    return board.counts(selectable(spark, d))


@register("search_presets", sql("claims", "SELECT 'Low confidence' AS preset, count(*) AS n FROM claims WHERE confidence < 0.7 UNION ALL SELECT 'Unresolved', count(*) FROM claims WHERE value = 'O' UNION ALL SELECT 'Power nets', count(*) FROM claims WHERE field = 'R' UNION ALL SELECT 'Critical findings', count(*) FROM claims WHERE source = '3'"))
def search_presets(spark, d):
    """All four presets over rows that have their fields."""
    c = table(spark, d, "claims").select("confidence", F.when(F.col("value") == "O", "unresolved").otherwise("resolved").alias("status"), F.when(F.col("field") == "R", "POWER_5V").otherwise("signal").alias("class_name"), F.when(F.col("source") == "3", "critical").otherwise("info").alias("severity"))
    out = None
    for p in query.PRESETS:
        one = query.apply_preset(c, p).agg(F.count("*").alias("n")).select(F.lit(p.name).alias("preset"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# -- sources ------------------------------------------------------------------------------------------
NAMES = ("board.gtl", "x/board.GBL", "mask.gts", "b.g2", "in3_cu.gbr", "top.gbr", "copper_bot.ger", "profile.art", "notes.txt", "silk_top.pho", "gm1.gm1", "paste_bot.gbr")
LAYERS = ("F.Cu", "B.Cu", "F.Mask", "In2.Cu", "In3.Cu", "F.Cu", "B.Cu", "Edge.Cuts", None, "F.SilkS", "Edge.Cuts", "B.Paste")
FUNCTIONS = (None, "Copper,L3,Inr", "Soldermask,Bot", "Profile,NP", "Copper,L1,Top,Signal")
SAID = (None, "In2.Cu", "B.Mask", "Edge.Cuts", "F.Cu")


def sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@register("inferred_layers", f"SELECT p_partkey, coalesce(({sql_list(SAID)})[p_size % 5 + 1], ({sql_list(LAYERS)})[p_partkey % 12 + 1]) AS layer FROM part")
def inferred_layers(spark, d):
    """The layer by X2 file function, ending and name."""
    path, function = F.element_at(F.array(*map(F.lit, NAMES)), (k() % 12 + 1).cast("int")), F.element_at(F.array(*map(F.lit, FUNCTIONS)), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", formats.layer(path, function).alias("layer"))


@register("discovered_files", "SELECT concat(CAST(p_partkey AS STRING), '/a.gbr') AS path, CASE p_size % 4 WHEN 0 THEN 'In1.Cu' WHEN 1 THEN NULL WHEN 2 THEN 'F.Mask' ELSE NULL END AS layer, CASE WHEN p_size % 4 = 3 THEN 'non-plated' ELSE 'unknown' END AS plating, p_size % 4 = 1 AS conflict FROM part")
def discovered_files(spark, d):
    """File functions that tell the layer, contradict each other, or tell the plating."""
    said = ("%TF.FileFunction,Copper,L2,Inr*%", "%TF.FileFunction,Copper,L2,Inr*%\n%TF.FileFunction,Profile,NP*%", "%TF.FileFunction,Soldermask,Top*%", "%TF.FileFunction,NonPlated,1,2,NPTH*%")
    content = F.concat(F.lit("%FSLAX24Y24*%\n%MOMM*%\n"), F.element_at(F.array(*map(F.lit, said)), (F.col("p_size") % 4 + 1).cast("int")))
    files = table(spark, d, "part").select(F.concat(k().cast("string"), F.lit("/a.gbr")).alias("path"), content.alias("content"))
    return formats.discover(files).select("path", "layer", "plating", "conflict")


@register("import_report", "WITH f AS (SELECT p_partkey % 6 AS f, p_size % 5 = 0 AS asked FROM part), g AS (SELECT CASE f WHEN 0 THEN 'gerber' WHEN 1 THEN 'excellon' WHEN 2 THEN 'csv' WHEN 3 THEN 'kicad_schematic' WHEN 4 THEN 'unknown' ELSE 'ipc356' END AS format, CASE WHEN asked AND f <> 0 THEN 'mismatch' WHEN f = 4 THEN 'NO_ADAPTER' END AS diagnostic FROM f) SELECT format, CASE format WHEN 'gerber' THEN 20 WHEN 'excellon' THEN 30 WHEN 'csv' THEN 60 WHEN 'kicad_schematic' THEN 50 WHEN 'unknown' THEN 99 ELSE 10 END AS priority, diagnostic, count(*) AS n FROM g GROUP BY ALL")
def import_report(spark, d):
    """Mixed files, some of which are expected to be another format, or have no reader."""
    f = k() % 6
    end, body = F.lit(".bin"), F.lit("\u0001")
    for i, (e, t) in enumerate(((".gtl", "%FSLAX24Y24*%\n%MOMM*%\nM02*\n"), (".drl", "M48\nMETRIC\n%\nM30\n"), (".csv", "Reference,X\nR1,2\n"), (".kicad_sch", "(kicad_sch (version 1))"))):
        end, body = F.when(f == i, e).otherwise(end), F.when(f == i, t).otherwise(body)
    end, body = F.when(f == 5, ".ipc").otherwise(end), F.when(f == 5, "P  JOB x\n317 NET=A REF=R1 PIN=1 X=1 Y=2\n").otherwise(body)
    files = table(spark, d, "part").select(F.concat(k().cast("string"), end).alias("path"), body.alias("content"), F.when(F.col("p_size") % 5 == 0, "gerber").alias("expected"))
    report, _ = adapters.import_files(files)
    told = F.when(F.col("diagnostic").startswith("FORMAT_MISMATCH"), "mismatch").otherwise(F.col("diagnostic"))
    return report.groupBy("format", "priority", told.alias("diagnostic")).agg(F.count("*").alias("n"))


@register("schematic_symbols", "SELECT concat('R', CAST(p_partkey AS STRING)) AS reference, p_brand AS value, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey // 50 AS DOUBLE) AS y, CASE WHEN p_size % 2 = 0 THEN 90e0 ELSE 0e0 END AS rotation FROM part")
def schematic_symbols(spark, d):
    """Symbols of schematic files that are written from the parts."""
    n = k().cast("string")
    line = F.concat(F.lit('(symbol (lib_id "Device:R") (at '), (k() % 50).cast("string"), F.lit(" "), F.floor(k() / 50).cast("string"), F.when(F.col("p_size") % 2 == 0, " 90").otherwise(""), F.lit(') (uuid "u'), n, F.lit('") (property "Reference" "R'), n, F.lit('") (property "Value" "'), F.col("p_brand"), F.lit('")) (wire (pts (xy 0 0) (xy 1 0))) (label "L" (at 1 1))'))
    body = table(spark, d, "part").select(F.concat((k() % 20).cast("string"), F.lit(".kicad_sch")).alias("path"), line.alias("line")).repartition(FILE_TASKS, "path").groupBy("path").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    files = body.select("path", F.concat(F.lit('(kicad_sch (version 20230121) (generator "g") (uuid "f")\n'), "body", F.lit(")")).alias("content"))
    return tables.schematics(files).where("kind = 'symbol'").select("reference", "value", "x", "y", "rotation")


@register("ipc_pads", sql("pads", "r AS (SELECT s_suppkey AS record, (s_suppkey * 7) % 50 + 0.3e0 AS x, (s_suppkey * 13) % 40 - 0.2e0 AS y FROM supplier), n AS (SELECT record, id, row_number() OVER (PARTITION BY record ORDER BY sqrt(pow(r.x - p.x, 2) + pow(r.y - p.y, 2)), CAST(substr(id, 2) AS BIGINT)) AS k FROM r JOIN pads p ON sqrt(pow(r.x - p.x, 2) + pow(r.y - p.y, 2)) <= 1.15) SELECT record, id AS pad_id FROM n WHERE k = 1"))
def ipc_pads(spark, d):
    """The nearest pad of each test record; equal distances go to the pad that comes first."""
    s = F.col("s_suppkey")
    records = table(spark, d, "supplier").select(s.alias("record"), (s * 7 % 50 + 0.3).alias("x"), (s * 13 % 40 - 0.2).alias("y"))
    pads = table(spark, d, "pads").withColumn("ord", F.substring("id", 2, 20).cast("bigint"))
    return tables.match_ipc_pads(records, pads, 1.15).select("record", "pad_id")


@register("silkscreen_references", "WITH c AS (SELECT s_suppkey AS id, (s_suppkey * 7) % 50 + 0.5e0 AS x, (s_suppkey * 13) % 40 * 1e0 AS y FROM supplier), t AS (SELECT concat('R', CAST(p_partkey AS STRING)) AS text, p_partkey AS ord, p_partkey % 50 * 1e0 AS x, p_partkey // 50 * 1e0 AS y FROM part), n AS (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(c.x - t.x, 2) + pow(c.y - t.y, 2)), ord) AS k FROM c JOIN t ON sqrt(pow(c.x - t.x, 2) + pow(c.y - t.y, 2)) <= 5) SELECT CAST(id AS STRING) AS id, text FROM n WHERE k = 1")
def silkscreen_references(spark, d):
    """The nearest text of each footprint: two are always equally near, and the first counts."""
    s = F.col("s_suppkey")
    centres = table(spark, d, "supplier").select(s.cast("string").alias("id"), (s * 7 % 50 + 0.5).alias("x"), (s * 13 % 40).cast("double").alias("y"))
    tokens = table(spark, d, "part").select(F.concat(F.lit("R"), k().cast("string")).alias("text"), k().alias("ord"), (k() % 50).cast("double").alias("x"), F.floor(k() / 50).cast("double").alias("y"))
    return tables.match_silkscreen(centres, tokens).select("id", "text")


@register("unpacked_archives", "SELECT concat('lot', CAST(p_partkey % 16 AS STRING), '.zip!/', CAST(p_partkey AS STRING), '.txt') AS path, p_brand AS content FROM part")
def unpacked_archives(spark, d):
    """Parts as members of ZIP files, unpacked in the tasks; a lot is as many files of its name as hold 10,000 part numbers each."""

    def pack(part):
        import io
        import zipfile

        import pandas as pd

        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for key, brand in sorted(zip(part["p_partkey"], part["p_brand"], strict=True)):
                z.writestr(f"{key}.txt", brand)
        return pd.DataFrame([(f"lot{part['lot'].iloc[0]}.zip", data.getvalue())], columns=["path", "content"])

    zips = table(spark, d, "part").select((k() % 16).alias("lot"), F.floor(k() / (16 * 10_000)).alias("volume"), "p_partkey", "p_brand").groupBy("lot", "volume").applyInPandas(pack, "path string, content binary")
    return archives.unpack(zips).select("path", "content")


@register("ndjson_roundtrip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def ndjson_roundtrip(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return reports.ndjson_rows(reports.canonical_lines(s, ["s_suppkey"]), s.schema.simpleString()[7:-1].replace(":", " "))


def dealt(part):
    """The keys of parts in as many tasks as files go to: a small file of parts is one split, and each part a text to parse."""
    return part.select("p_partkey").repartition(FILE_TASKS, "p_partkey")


GERBER_CASES = (
    ("%ADD10C,0.5*%\nD10*\nX0Y0D03*\n", "pad", 1), ("%ADD10R,0.6X0.3*%\n%LR45*%\nD10*\nX0Y0D03*\n", "region", 1), ("%ADD10O,0.6X0.3X0.1*%\nD10*\nX0Y0D03*\n", "region", 1), ("%ADD10P,1.0X5X30*%\nD10*\nX0Y0D03*\n", "region", 1),
    ("%AMBX*21,1,$1,$1x2,0,0,0*%\n%ADD10BX,0.25*%\nD10*\nX0Y0D03*\n", "pad", 1), ("%AMT*4,1,3,0,0,1,0,0,1,0,0,0*%\n%ADD10T*%\nD10*\nX0Y0D03*\n", "region", 1), ("%ADD10C,0*%\nD10*\nX0Y0D03*\n", "diagnostic", 1),
    ("%ADD10C,0.1*%\nD10*\nG75*\nX010000Y0D02*\nG03X-010000Y0I-010000J0D01*\n", "track", 16), ("%ADD10C,0.1*%\nD10*\nG74*\nX010000Y0D02*\nG03X0Y010000I010000J0D01*\n", "track", 8),
    ("%ADD10C,0.5*%\n%SRX2Y3I2J2*%\nD10*\nX0Y0D03*\n%SR*%\n", "pad", 6), ("%ADD10R,1X1*%\nD10*\nX0Y0D02*\nX020000Y010000D01*\n", "region", 1), ("%ADD10C,0.5*%\n%TO.N,GND*%\nD10*\nX0Y0D03*\n", "net GND", 1),
    ("G36*\nX0Y0D02*\nX010000Y0D01*\nX010000Y010000D01*\nX0Y0D01*\nX020000Y0D02*\nX030000Y0D01*\nX030000Y010000D01*\nX020000Y0D01*\nG37*\n", "region", 2), ("%ABD12*%\n", "diagnostic", 1), ("G99*\n", "diagnostic", 1),
)


@register("gerber_constructs", "SELECT p_partkey % 15 AS c, kind, CAST(sum(n) AS BIGINT) AS n FROM part JOIN (VALUES " + ", ".join(f"({i}, '{kind}', {n})" for i, (_, kind, n) in enumerate(GERBER_CASES)) + ") v(c, kind, n) ON p_partkey % 15 = v.c GROUP BY ALL")
def gerber_constructs(spark, d):
    """Apertures, macros, arcs, repeats, sweeps, attributes, regions and failures: how many objects of what kind each leaves."""
    body = F.element_at(F.array(*[F.lit(b) for b, *_ in GERBER_CASES]), (k() % len(GERBER_CASES) + 1).cast("int"))
    files = dealt(table(spark, d, "part")).select(F.concat((k() % len(GERBER_CASES)).cast("string"), F.lit("/"), k().cast("string"), F.lit(".gtl")).alias("path"), F.concat(F.lit("%FSLAX24Y24*%\n%MOMM*%\n"), body, F.lit("M02*\n")).alias("content"))
    rows = gerber.parse_frame(files, strict=False)
    kind = F.when(F.col("net").isNotNull(), F.concat(F.lit("net "), "net")).otherwise(F.col("kind"))
    return rows.groupBy(F.split("path", "/")[0].cast("bigint").alias("c"), kind.alias("kind")).agg(F.count("*").alias("n"))


@register("gerber_tokens", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 4 AS statements, 2 AS extended, CAST(2 + p_size % 3 AS BIGINT) AS last_line FROM part")
def gerber_tokens(spark, d):
    """Statements of a file, how many are extended commands, and the line of the last."""
    content = F.concat(F.lit("%MOMM*FSLAX24Y24*%\nG01*"), F.repeat(F.lit("\n"), (F.col("p_size") % 3).cast("int")), F.lit("M02*\n"))

    def run(parts):
        import pandas as pd

        for part in parts:
            rows = [(int(key), gerber.tokens(t)) for key, t in zip(part["p_partkey"], part["content"], strict=True)]
            yield pd.DataFrame([(key, len(w), sum(e for *_, e in w), w[-1][0]) for key, w in rows], columns=["p_partkey", "statements", "extended", "last_line"])

    out = table(spark, d, "part").select("p_partkey", content.alias("content")).mapInPandas(run, "p_partkey bigint, statements int, extended int, last_line bigint")
    return out.withColumn("last_line", F.col("last_line"))


@register("permissive_failures", "SELECT p_partkey % 4 AS c, CAST(count(*) * CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0 END AS BIGINT) AS pads, count(*) AS diagnostics FROM part GROUP BY 1")
def permissive_failures(spark, d):
    """What is left where an object, a region, a file, or a drill file fails."""
    bodies = ("%ADD10C,0.5*%\nD10*\nX0Y0D03*\nD11*\nX0Y0D03*\nD10*\nX010000Y0D03*\nM02*\n", "%ADD10C,0.5*%\nD10*\nX0Y0D03*\nG36*\nX0Y0D02*\nX010000Y0D01*\nX010000Y010000D01*\nX0Y010000D01*\nG37*\nM02*\n", "%ADD10C,0.5*%\nD10*\nX0Y0D03*\n%LPX*%\nX010000Y0D03*\nM02*\n")
    content = F.concat(F.lit("%FSLAX24Y24*%\n%MOMM*%\n"), F.element_at(F.array(*map(F.lit, bodies)), (F.least(k() % 4, F.lit(2)) + 1).cast("int")))
    drl = F.lit("M48\nMETRIC\nT01C0.800\n%\nT01\nX1.0Y1.0\nT02\nX2.0Y2.0\nM30\n")
    files = dealt(table(spark, d, "part")).select((k() % 4).alias("c"), F.concat((k() % 4).cast("string"), F.lit("/"), k().cast("string")).alias("path"), F.when(k() % 4 == 3, drl).otherwise(content).alias("content"))
    rows = gerber.parse_frame(files.where("c < 3"), strict=False).unionByName(excellon.parse_frame(files.where("c = 3"), strict=False))
    return rows.groupBy(F.split("path", "/")[0].cast("bigint").alias("c")).agg(F.count(F.when(F.col("kind") == "pad", 1)).alias("pads"), F.count(F.when(F.col("kind") == "diagnostic", 1)).alias("diagnostics"))


# -- merges and statistics ----------------------------------------------------------------------------
@register("duration_statistics", "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS pstdev FROM events GROUP BY 1")
def duration_statistics(spark, d):
    s = evidence.statistics(table(spark, d, "events"), "value", ("event_type",))
    return s.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "median")], "min", "max", F.round("pstdev", 6).alias("pstdev"))


@register("merged_records", sql("claims", "m AS (SELECT *, row_number() OVER (PARTITION BY subject_id, field ORDER BY round(confidence, 9) DESC, source, value) AS r FROM claims) SELECT 'best' AS how, count(*) AS n, round(sum(confidence), 4) AS total FROM m WHERE r = 1 UNION ALL SELECT 'distinct', count(*), NULL FROM (SELECT DISTINCT subject_id, field FROM claims) UNION ALL SELECT 'strict', count(*), round(sum(s_acctbal), 4) FROM supplier UNION ALL SELECT 'last', count(*), round(sum(o_totalprice), 4) FROM (SELECT o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1"))
def merged_records(spark, d):
    """The best row of a key, each key once, rows that agree, and the last row of a key."""
    c, s = table(spark, d, "claims").withColumn("score", F.round("confidence", 9)), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    best = evidence.merge_best(c.where("source < '4'"), c.where("source >= '4'"), key=["subject_id", "field"], score="score", ties=["source", "value"])
    once = evidence.merge_distinct(c, c, key=["subject_id", "field"])
    strict = evidence.merge_strict(s, s.where("s_suppkey % 2 = 0"), key="s_suppkey")
    last = evidence.merge_last(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"])
    row = lambda name, df, v: df.agg(F.count("*").alias("n"), F.round(F.sum(v), 4).cast("double").alias("total") if v else F.lit(None).cast("double").alias("total")).select(F.lit(name).alias("how"), "n", "total")
    return row("best", best, "confidence").unionByName(row("distinct", once, None)).unionByName(row("strict", strict, "s_acctbal")).unionByName(row("last", last, "o_totalprice"))


REPLAY = "WITH e AS (SELECT user_id, event_id, event_type, min(event_type) OVER () AS opens, max(event_type) OVER () AS closes FROM events), s AS (SELECT *, sum(CASE WHEN event_type = closes THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM e), last AS (SELECT user_id, max(part) AS part, any_value(opens) AS opens, any_value(closes) AS closes FROM s GROUP BY 1) SELECT CAST(s.user_id AS STRING) AS object_id, CAST(count(*) FILTER (WHERE event_type = last.opens AND s.part = last.part) AS BIGINT) AS open, CAST(max(s.part) AS BIGINT) AS closed FROM s JOIN last USING (user_id) GROUP BY 1"


def opens_and_closes(events):
    """A fold whose result depends on the order: what one kind of event opens, another closes."""
    opens, closes = events.agg(F.min("event_type"), F.max("event_type")).first()

    def opened(state, event):
        state["open"] += 1

    def closed(state, event):
        state["open"], state["closed"] = 0, state["closed"] + 1

    return {opens: opened, closes: closed}, lambda: {"open": 0, "closed": 0}, "object_id string, open long, closed long"


@register("event_replay", REPLAY)
def event_replay(spark, d):
    events = table(spark, d, "events")
    return event_log.replay(event_log.from_events(events).select("seq", "kind", "object_id"), *opens_and_closes(events))


@register("event_replay_stream", REPLAY)
def event_replay_stream(spark, d):
    """The same fold on a stream whose files hold the events in no order: each waits for those of its object that come before."""
    events = table(spark, d, "events")
    folder = new_folder(spark, "replay")
    log = event_log.versions(event_log.from_events(events).select("seq", "kind", "object_id"))
    log.repartition(4, F.xxhash64("seq")).write.parquet(f"{folder}/log")
    stream = event_log.read_stream(spark, f"{folder}/log", log.schema, 1)
    return event_log.final_states(event_log.ordered_replay(stream, *opens_and_closes(events)), folder).select("object_id", "open", "closed")


# -- values -------------------------------------------------------------------------------------------
@register("formatted_values", "WITH v AS (SELECT p_partkey, CAST(p_partkey * pow(10, p_size % 6) AS DOUBLE) AS ohms, (p_partkey % 900 + 1) / pow(10e0, 12 - p_size % 5) AS farads FROM part) SELECT p_partkey, CASE WHEN ohms >= 1e6 THEN concat(printf('%g', ohms / 1e6), 'MΩ') WHEN ohms >= 1e3 THEN concat(printf('%g', ohms / 1e3), 'kΩ') ELSE concat(printf('%g', ohms), 'Ω') END AS ohms, CASE WHEN farads >= 1e-6 THEN concat(printf('%g', farads / 1e-6), 'µF') WHEN farads >= 1e-9 THEN concat(printf('%g', farads / 1e-9), 'nF') ELSE concat(printf('%g', farads / 1e-12), 'pF') END AS farads FROM v")
def formatted_values(spark, d):
    ohms, farads = k() * F.pow(F.lit(10.0), F.col("p_size") % 6), (k() % 900 + 1) / F.pow(F.lit(10.0), 12 - F.col("p_size") % 5)
    return table(spark, d, "part").select("p_partkey", text.format_resistance(ohms).alias("ohms"), text.format_capacitance(farads).alias("farads"))


@register("short_names", "SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN p_name ELSE concat(substr(p_name, 1, 8), '…') END AS short, regexp_replace(trim(concat(p_name, ' #', p_brand)), '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe FROM part")
def short_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.truncate(F.col("p_name"), 9).alias("short"), text.safe_class_name(F.concat("p_name", F.lit(" #"), "p_brand")).alias("safe"))


DDR = ("DQ3", "DDR_DQS_P", "DQSP1", "A12", "BA0", "RAS_N", "DDR_CS", "ODTN", "CKP", "DDR_CK1", "clk", "DQ")
DDR_SAID = ("data", None, "strobe", "address", "bank", "command", "command", "command", "clock", "clock", None, None)


@register("memory_roles", f"SELECT p_partkey, ({sql_list(DDR_SAID)})[p_partkey % 12 + 1] AS role FROM part")
def memory_roles(spark, d):
    return table(spark, d, "part").select("p_partkey", text.ddr_role(F.element_at(F.array(*map(F.lit, DDR)), (k() % 12 + 1).cast("int"))).alias("role"))


# -- geometry -----------------------------------------------------------------------------------------
@register("affine_fits", "SELECT c_nationkey, round(2.0e0, 6) AS a, round(-0.5e0 - c_nationkey % 3, 6) AS b, round(0.25e0, 6) AS c, round(3.0e0, 6) AS d, round(1e0 * c_nationkey, 5) AS e, round(-7.0e0, 5) AS f FROM customer GROUP BY 1 HAVING count(*) > 8")
def affine_fits(spark, d):
    """Maps that are found again from points; groups of nine points and more are on no line."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    x, y = (key % 17).cast("double"), (F.floor(key / 17) % 23 + key % 5).cast("double")
    points = table(spark, d, "customer").select("c_nationkey", x.alias("x"), y.alias("y"), (2 * x - (0.5 + nation % 3) * y + nation).alias("to_x"), (0.25 * x + 3 * y - 7).alias("to_y"))
    fit = geometry.fit_affine_columns(points, ["c_nationkey"]).where("n > 8")
    return fit.select("c_nationkey", *[F.round(v, 6).alias(v) for v in "abcd"], *[F.round(v, 5).alias(v) for v in "ef"])


@register("wire_crossings", "WITH w AS (SELECT p_partkey AS n, CAST(p_partkey * 7 % 40 AS DOUBLE) AS x0, CAST(p_partkey * 3 % 30 AS DOUBLE) + 0.5 AS y0, CAST(p_partkey * 11 % 40 AS DOUBLE) + 0.25 AS x1, CAST(p_partkey * 5 % 30 AS DOUBLE) + 0.75 AS y1 FROM part), h AS (SELECT n, y0 AS y, least(x0, x1) AS l, greatest(x0, x1) AS r FROM w), v AS (SELECT n, x1 AS x, least(y0, y1) AS l, greatest(y0, y1) AS r FROM w) SELECT count(*) AS n, round(sum(v.x), 2) AS xs, round(sum(h.y), 2) AS ys FROM h JOIN v ON h.n <> v.n AND v.l < h.y AND h.y < v.r AND h.l < v.x AND v.x < h.r")
def wire_crossings(spark, d):
    """Manhattan wires with a bend each, and where they cross."""
    wires = table(spark, d, "part").select(k().alias("net_id"), (k() * 7 % 40).cast("double").alias("x0"), ((k() * 3 % 30) + 0.5).alias("y0"), ((k() * 11 % 40) + 0.25).alias("x1"), ((k() * 5 % 30) + 0.75).alias("y1"))
    at = graph.crossing_places(graph.manhattan_routes(wires))
    total = lambda c: F.round(F.sum(F.col(c) * F.col("n")), 2)
    return at.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), total("x").alias("xs"), total("y").alias("ys"))


@register("report_lines", "SELECT 0 AS place, CAST(1 AS BIGINT) AS n UNION ALL SELECT 1, count(DISTINCT p_partkey) FROM part UNION ALL SELECT 2, count(*) - count(DISTINCT p_brand) FROM part UNION ALL SELECT 3, 1")
def report_lines(spark, d):
    """A GraphML document of all nets as lines: head, nodes, edges, end."""
    members = table(spark, d, "part").select(F.col("p_brand").alias("net_id"), F.concat(F.lit("P"), k().cast("string")).alias("member_id"), k().alias("ord"))
    return reports.graphml_lines(members).groupBy("place").agg(F.count("*").alias("n"))
