"""Parsers, sinks, archives and event logs."""

import io
import json
import math
import tarfile
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tracewright.plans import source_queries
from tracewright.plans.source_queries import reconstruct
from tracewright.sinks import kicad, reports
from tracewright.sources import archives, excellon, formats, gerber, tables
from tracewright.sources.common import ParseError, UnsupportedFeatureError
from tracewright.streaming import event_log

# A small LED board of six pads, four tracks, six drills and an outline.
LED = (
    ("copper.gtl", "%FSLAX24Y24*%\n%MOMM*%\n%ADD10C,1.800*%\n%ADD11C,0.500*%\nD10*\nX080000Y150000D03*\nX080000Y175400D03*\nX250000Y150000D03*\nX280000Y150000D03*\nX420000Y150000D03*\nX445400Y150000D03*\nD11*\nX080000Y150000D02*\nX250000Y150000D01*\nX280000Y150000D02*\nX420000Y150000D01*\nX445400Y150000D02*\nX445400Y175400D01*\nX445400Y175400D02*\nX080000Y175400D01*\nM02*\n"),
    ("outline.gbr", "%FSLAX24Y24*%\n%MOMM*%\n%ADD10C,0.100*%\nD10*\nX050000Y050000D02*\nX550000Y050000D01*\nX550000Y350000D01*\nX050000Y350000D01*\nX050000Y050000D01*\nM02*\n"),
    ("drill.drl", "M48\nMETRIC,LZ\nT01C0.800\n%\nT01\nX8.0Y15.0\nX8.0Y17.54\nX25.0Y15.0\nX28.0Y15.0\nX42.0Y15.0\nX44.54Y15.0\nM30\n"),
)

HEAD = "%FSLAX24Y24*%\n%MOMM*%\n"
PEN = "%ADD10C,0.200*%\nD10*\n"


def count(image):
    out = {}
    for r in image.rows:
        out[r["kind"]] = out.get(r["kind"], 0) + 1
    return out


@pytest.mark.parametrize(
    "body,want",
    [
        (PEN + "X000000Y000000D02*\nX010000Y000000D01*\n", {"track": 1}),
        ("%IR90*%\n" + PEN + "X010000Y020000D02*\nX030000Y020000D01*\n", {"track": 1}),
        ("%OFA1B-2*%\n" + PEN + "X010000Y020000D03*\n", {"pad": 1}),
        (PEN + "M01*\nX010000Y020000D03*\n", {"pad": 1, "diagnostic": 1}),
        ("%ASAYBX*%\n" + PEN + "X010000Y020000D03*\n", {"pad": 1, "diagnostic": 1}),
        ("%SFA2B2*%\n" + PEN + "G75*\nX010000Y000000D02*\nG03X000000Y010000I-010000J000000D01*\n", {"track": 12}),
        (PEN + "G75*\nX010000Y000000D02*\nG03X000000Y010000I-010000J000000D01*\n", {"track": 8}),
        (PEN + "G74*\nX110000Y060000D02*\nG03X070000Y100000I040000J000000D01*\n", {"track": 16}),
        ("%AMBOX*21,1,$1,$2,0,0,0*%\n%ADD10BOX,1.0X2.0*%\nD10*\nX010000Y020000D03*\n", {"pad": 1}),
        ("%AMLL*22,1,2.0,1.0,-1.0,-0.5,90*%\n%ADD10LL*%\nD10*\nX010000Y020000D03*\n", {"pad": 1}),
        ("%ADD10R,0.600X0.300*%\nD10*\n%LMX*%\n%LR90*%\n%LS2*%\nX010000Y020000D03*\n", {"pad": 1}),
        ("G36*\nX000000Y000000D02*\nX010000Y000000D01*\nX010000Y010000D01*\nX000000Y010000D01*\nX000000Y000000D01*\nG37*\n", {"region": 1}),
        ("G75*\nG36*\nX000000Y000000D02*\nX020000Y000000D01*\nG03*\nX000000Y000000I-010000J000000D01*\nG37*\n", {"region": 1}),
        ("%SRX3Y2I1J1*%\n" + PEN + "X0Y0D03*\n%SR*%\nX050000Y0D03*\n", {"pad": 7}),
        ("%ADD10R,1.0X2.0*%\nD10*\nX0Y0D02*\nX010000Y010000D01*\n", {"region": 1}),
        ("%ADD10P,1.0X6*%\nD10*\nX0Y0D03*\n", {"region": 1}),
    ],
)
def test_gerber_images(body, want):
    assert count(gerber.parse(HEAD + body + "M02*\n", "x.gtl")) == want


def test_gerber_incremental_and_transformations():
    image = gerber.parse("%FSLIX24Y24*%\n%MOMM*%\n" + PEN + "X010000Y000000D02*\nX010000Y000000D01*\nM02*\n")
    assert (image.rows[0]["x1"], image.rows[0]["x2"]) == (1.0, 2.0)
    r = gerber.parse(HEAD + "%IR90*%\n" + PEN + "X010000Y020000D03*\nM02*\n").rows[0]
    assert (r["x1"], r["y1"]) == (-2.0, 1.0)
    r = gerber.parse(HEAD + "%MIA1*%\n%OFA1B-2*%\n" + PEN + "X010000Y020000D03*\nM02*\n").rows[0]
    assert (r["x1"], r["y1"]) == (0.0, 0.0)
    r = gerber.parse(HEAD + "%ADD10R,0.6X0.3*%\nD10*\n%LR90*%\n%LS2*%\nX0Y0D03*\nM02*\n").rows[0]
    assert (round(r["size_x"], 9), round(r["size_y"], 9)) == (0.6, 1.2)


def test_gerber_cut_in_region_has_a_hole():
    ring = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 5), (3, 5), (3, 7), (7, 7), (7, 3), (3, 3), (3, 5), (0, 5), (0, 0)]
    body = "G36*\n" + "".join(f"X{x * 10000:06}Y{y * 10000:06}D0{2 if i == 0 else 1}*\n" for i, (x, y) in enumerate(ring)) + "G37*\nM02*\n"
    (r,) = gerber.parse(HEAD + body).rows
    area = lambda ps: abs(gerber.area([(p["x"], p["y"]) for p in ps]))
    assert area(r["points"]) == 100 and [area(h) for h in r["holes"]] == [16]


def test_gerber_failures():
    block = HEAD + "%ABD10*%\n%AB*%\nM02*\n"
    with pytest.raises(UnsupportedFeatureError):
        gerber.parse(block)
    rows = gerber.parse(HEAD + PEN + "X0Y0D03*\n%ABD11*%\nX0Y0D03*\nM02*\n", strict=False).rows
    assert [r["code"] for r in rows] == ["UNSUPPORTED_GERBER_CONSTRUCT"]  # the pads before and after are gone
    for strict in (True, False):
        with pytest.raises(ParseError):
            gerber.parse(HEAD + "X0Y0D03*\nM02*\n", strict=strict)
    with pytest.raises(ParseError):
        gerber.parse(HEAD + "D10")
    assert count(gerber.parse(HEAD + PEN + "G99*\nX0Y0D03*\nM02*\n", strict=False)) == {"diagnostic": 1, "pad": 1}


def test_gerber_attributes_and_outline():
    rows = gerber.parse(HEAD + PEN + "%TO.N,GND*%\n%TO.P,U1,7*%\nX0Y0D03*\n%TD*%\nX010000Y0D03*\nM02*\n").rows
    assert [(r["net"], r["reference"], r["pin"]) for r in rows] == [("GND", "U1", "7"), (None, None, None)]
    assert count(gerber.parse(HEAD + PEN + "X0Y0D02*\nX010000Y0D01*\nM02*\n", "board-outline.gbr")) == {"outline": 1}


@pytest.mark.parametrize(
    "body,want",
    [
        ("T01\nX1.000Y1.000\nX2.000Y2.000\nM30\n", {"drill": 2}),
        ("T01\nX1.000Y2.000G85X3.000Y2.000\nM30\n", {"slot": 1}),
        ("T01\nG00X1.000Y1.000\nM15\nG01X2.000Y1.000\nM16\nM30\n", {"route": 1}),
        ("T01\nG00X10.000Y0.000\nM15\nG03X0.000Y10.000I-10.000J0.000\nM16\nM30\n", {"route": 1}),
        ("T01\nG00X10.000Y0.000\nM15\nG03X0.000Y10.000A10.000\nM16\nM30\n", {"route": 1}),
    ],
)
def test_excellon(body, want):
    assert count(excellon.parse("M48\nMETRIC\nT01C0.800\n%\n" + body)) == want


def test_excellon_arcs_agree_and_units():
    by = [excellon.parse("M48\nMETRIC\nT01C0.8\n%\nT01\nG00X10.0Y0.0\nM15\nG03X0.0Y10.0" + c + "\nM16\nM30\n").rows[0]["points"] for c in ("I-10.0J0.0", "A10.0")]
    assert all(math.hypot(p["x"], p["y"]) == pytest.approx(10) for ps in by for p in ps) and len(by[0]) == len(by[1])
    r = excellon.parse("M48\nINCH,TZ\nT01C0.0400\n%\nT01\nX010000Y020000\nM30\n").rows[0]
    assert (r["x1"], r["y1"], round(r["size_x"], 6)) == (25.4, 50.8, 1.016)
    r = excellon.parse("M48\n; #@! TF.FileFunction,NonPlated,1,2,NPTH\nMETRIC\nT1C1\n%\nT1\nX1.0Y1.0\nM30\n").rows[0]
    assert r["plating"] == "non-plated"


@pytest.mark.parametrize("text,code", [("T01\nX1.0Y1.0\nM30\nX2.0Y2.0\n", "INVALID_EXCELLON_DATA_AFTER_M30"), ("T02\nM30\n", "INVALID_EXCELLON_TOOL_SELECTION"), ("T1C1\n%\n", None)])
def test_excellon_permissive(text, code):
    full = "M48\nMETRIC\nT01C0.800\n%\n" + text
    rows = excellon.parse(full, strict=False).rows
    assert [r["code"] for r in rows] == ([code] if code else [])
    if code:
        with pytest.raises(ParseError):
            excellon.parse(full)
    with pytest.raises(ParseError):
        excellon.parse("M48\nMETRIC\n%\nX1.0Y1.0\nM30\n", strict=False)


def test_board_from_files(spark):
    board = reconstruct(spark, spark.createDataFrame(LED, "path string, content string"))
    assert {k: board[k].count() for k in ("pads", "tracks", "drills", "outline", "nets")} == {"pads": 6, "tracks": 4, "drills": 6, "outline": 4, "nets": 3}
    assert sorted(r["member_count"] for r in board["nets"].collect()) == [3, 3, 4] and {r["drill"] for r in board["pads"].collect()} == {0.8}
    doc = reports.svg(board["tracks"], board["pads"])
    assert len(ElementTree.fromstring(doc)) == 10


def test_tables(spark):
    rows = spark.createDataFrame([("317 NET=GND REF=U1 PIN=3 X=1500 Y=-250",), ("C comment",), ("",), ("P JOB",)], "value string")
    got = tables.ipc356(rows).collect()
    assert [(r["record_type"], r["net_name"], r["x"], r["y"]) for r in got] == [("317", "GND", 1.5, -0.25), ("UNKNOWN", None, None, None)]
    p = tables.placements(spark.createDataFrame([("R1", "1.5mm", "2", "90", "F.Cu"), ("", "1", "1", "0", "B"), ("R2", "x", "1", "0", "B")], "`Ref Des` string, `Mid X` string, `Mid Y` string, Rot string, Layer string").withColumnRenamed("Ref Des", "Designator")).collect()
    assert [(r["reference"], r["x"], r["rotation"], r["side"]) for r in p] == [("R1", 1.5, 90.0, "top")]
    b = tables.bom(spark.createDataFrame([("R1, R2;R3  R4", "10k", "2")], "Designators string, Value string, Qty string")).first()
    assert b["references"] == ["R1", "R2", "R3", "R4"] and b["quantity"] == 2 and b["mpn"] == ""
    assert tables.s_expression('(a (b "c \\"d\\"") e)') == [["a", ["b", 'c "d"'], "e"]]
    with pytest.raises(ValueError):
        tables.s_expression("(a")
    with pytest.raises(ValueError):
        tables.kicad_rows("(x)")


def test_formats(spark):
    files = [("a.gbr", "%FSLAX24Y24*%\n%TF.FileFunction,Copper,L3,Inr*%"), ("b-npth.drl", "M48\nMETRIC"), ("c.kicad_pcb", "(kicad_pcb (version 1))"), ("d.xyz", "nothing")]
    got = {r["path"]: (r["format"], r["layer"], r["plating"]) for r in formats.discover(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got["a.gbr"][:2] == ("gerber", "In2.Cu") and got["b-npth.drl"][::2] == ("excellon", "non-plated") and got["c.kicad_pcb"][0] == "kicad_board" and got["d.xyz"][0] == "unknown"
    assert [formats.layer_of(n) for n in ("x.gtl", "x.g3", "board-F_Cu.gbr", "board.Edge.Cuts.gbr", "q.gbr")] == ["F.Cu", "In3.Cu", "F.Cu", "Edge.Cuts", None]


def zipped(items):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in items:
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    assert archives.members(zipped([("b/x.drl", b"1"), ("a.gbr", b"2")])) == [("a.gbr", b"2"), ("b/x.drl", b"1")]
    for bad in ([("../x", b"")], [("/etc/x", b"")], [("c:/x", b"")]):
        with pytest.raises(archives.PackageError):
            archives.members(zipped(bad))
    with pytest.raises(archives.PackageError):
        archives.members(zipped([("a", b"123"), ("b", b"456")]), most_bytes=5)
    with pytest.raises(archives.PackageError):
        archives.members(b"not an archive")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    with pytest.raises(archives.PackageError):
        archives.members(out.getvalue())
    (tmp_path / "p.zip").write_bytes(zipped([("copper.gtl", LED[0][1])]))
    (tmp_path / "drill.drl").write_text(LED[2][1])
    files = archives.read(spark, f"file://{tmp_path}")
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in files.collect()) == ["copper.gtl", "drill.drl"]


def test_sinks(spark, tmp_path):
    members = spark.createDataFrame([("n", "b", 0), ("n", "a", 1), ("m", "c", 0)], "net_id string, member_id string, ord int")
    g = ElementTree.fromstring(reports.graphml(members))
    assert [(e.get("source"), e.get("target")) for e in g.iter("{http://graphml.graphdrawing.org/xmlns}edge")] == [("b", "a")]
    found = spark.createDataFrame([("drc", "error", "X", "bad", ["a"]), ("drc", "warning", "W", "so", ["b"])], "source string, severity string, code string, message string, object_ids array<string>")
    assert "**ERROR X**: bad" in reports.markdown(found, {"pads": 2}) and ElementTree.fromstring(reports.junit(found)).get("failures") == "1"
    assert json.loads(reports.canonical_json(members, ["net_id", "ord"]))[0] == {"net_id": "m", "member_id": "c", "ord": 0}
    reports.write_bundle({"members": members}, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/members")).count() == 3
    reports.write_ndjson(members, str(tmp_path / "j"))
    assert tables.ndjson(spark, str(tmp_path / "j"), members.schema).count() == 3
    with pytest.raises(ValueError):
        reports.graphml(members, most=1)


def test_replay_and_issues(spark):
    log = spark.createDataFrame([(3, "set", "m", "s", "a"), (1, "set", "m", "s", "a"), (2, "skip", "m", "s", "a"), (4, "set", "", "s", "b")], "seq long, kind string, message string, source string, object_id string")

    def note(state, event):
        state["n"] = state.get("n", 0) * 10 + event["seq"]

    got = {r["object_id"]: r["n"] for r in event_log.replay(log, {"set": note}, dict, "object_id string, n long").collect()}
    assert got == {"a": 13, "b": 4}
    assert [(r["seq"], r["code"]) for r in event_log.issues(log).collect()] == [(4, "EVENT_EMPTY_MESSAGE")]
    assert [r["seq"] for r in event_log.query(event_log.since(log, 1), kind="set", object_id="a").collect()] == [3]


def test_streams(spark, small_dir, tmp_path):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    for k in range(3):
        events.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = event_log.read_stream(spark, str(tmp_path / "in"), events.schema)
    q = event_log.tumbling(stream, "1 hour", late="400 days").writeStream.outputMode("update").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event_type"], r["start"]): r["n"] for r in spark.sql("select event_type, start, max(n) n from w group by 1, 2").collect()}
    assert got == {(r["event_type"], r["start"]): r["n"] for r in event_log.tumbling(events, "1 hour").collect()}
    q = event_log.replay_stream(event_log.from_events(event_log.read_stream(spark, str(tmp_path / "in"), events.schema)).select("object_id", "seq", "kind")).writeStream.outputMode("update").format("memory").queryName("s").start()
    q.processAllAvailable()
    q.stop()
    last = {r["object_id"]: (r["events"], r["kind"], r["seq"]) for r in spark.sql("select object_id, max_by(struct(events, kind, seq), events) x from s group by 1").select("object_id", "x.*").collect()}
    assert last == {r["object_id"]: (r["events"], r["kind"], r["seq"]) for r in event_log.latest(event_log.from_events(events)).collect()}
    assert event_log.sessions(events, "1 hour").count() > 0


def test_roundtrip_sees_every_track(spark, small_dir):
    """A reader that loses the last track in order of id is found out, and so is one that moves a pad."""
    board = source_queries.board_of(spark, small_dir)
    read = source_queries.read_back(spark, board).cache()
    whole = kicad.audit(board, read)
    assert whole.where("not equal").count() == 0 and kicad.verdict(whole).first() == (True, False)
    tracks = read.where("kind = 'track'").orderBy("x1", "y1", "x2", "y2", "width", "layer", "net").collect()
    last, pad = tracks[-1], read.where("kind = 'pad' and pad_type = 'smd'").first()
    lost = read.where(~((F.col("kind") == "track") & (F.struct("x1", "y1", "x2", "y2", "width", "layer", "net") == F.struct(*[F.lit(last[c]) for c in ("x1", "y1", "x2", "y2", "width", "layer", "net")]))))
    moved = lost.withColumn("x1", F.when((F.col("kind") == "pad") & (F.col("x1") == pad["x1"]) & (F.col("y1") == pad["y1"]), F.col("x1") + 1).otherwise(F.col("x1")))
    diff = {r["family"]: (r["missing"], r["unexpected"]) for r in kicad.audit(board, moved).collect() if not r["equal"]}
    assert set(diff) == {"track", "pad"} and diff["track"][0] >= 1 and diff["track"][1] == 0 and diff["pad"][0] == diff["pad"][1] >= 1
