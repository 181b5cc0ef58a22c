"""Shapes, boards, board files, composition and extensions, against plain geometry."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import plugins
from tracewright.functions import geometry, text
from tracewright.operators import board, connectivity, copper, evidence, graph, spatial
from tracewright.sinks import kicad, reports
from tracewright.sources import adapters, composition, gerber, tables


def plain_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def outline_points(kind, x, y, sx, sy, turn, n=720):
    """Points on the border of a pad, close together."""
    w, out = min(sx, sy), []
    if kind == "R":
        for (ax, ay), (bx, by) in itertools.pairwise([(-sx, -sy), (sx, -sy), (sx, sy), (-sx, sy), (-sx, -sy)]):
            out += [((ax + (bx - ax) * k / n) / 2, (ay + (by - ay) * k / n) / 2) for k in range(n)]
    elif kind == "C":
        out = [(sx / 2 * math.cos(2 * math.pi * k / n), sy / 2 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    else:
        dx, dy = (sx - w) / 2, (sy - w) / 2
        for k in range(n):
            c, s = w / 2 * math.cos(2 * math.pi * k / n), w / 2 * math.sin(2 * math.pi * k / n)
            out += [(math.copysign(dx, c) + c, math.copysign(dy, s) + s)]
        out += [(dx * (2 * k / n - 1), e * w / 2) for k in range(n) for e in (1, -1)] if dx else [(e * w / 2, dy * (2 * k / n - 1)) for k in range(n) for e in (1, -1)]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    return [(x + px * c - py * s, y + px * s + py * c) for px, py in out]


def test_gaps_of_pads_and_tracks(spark):
    """Every shape at every angle against points close together on its border."""
    rnd, pads, tracks = random.Random(3), [], []
    for k, (kind, turn) in enumerate(itertools.product("CRO", (0, 30, 90, 135, 180))):
        sx, sy = rnd.choice([(1.0, 1.0), (1.2, 0.5), (0.4, 1.5)])
        pads.append((f"p{k:02}", rnd.uniform(-1, 1), rnd.uniform(-1, 1), sx, sy, kind, float(turn), "a"))
    for k in range(12):
        x, y = rnd.uniform(-4, 4), rnd.uniform(-4, 4)
        tracks.append((f"t{k:02}", x, y, x + rnd.uniform(-3, 3), y + rnd.choice([0.0, rnd.uniform(-3, 3)]), 0.2, "a"))
    p = copper.pad_shapes(spark.createDataFrame(pads, "id string, x double, y double, size_x double, size_y double, shape string, rotation double, layer string"))
    t = copper.track_shapes(spark.createDataFrame(tracks, "id string, x1 double, y1 double, x2 double, y2 double, width double, layer string"))
    got = {(r["l_id"], r["r_id"]): r["gap"] for r in copper.near(p, t, 20.0).collect()}
    assert len(got) == len(pads) * len(tracks)
    for pid, x, y, sx, sy, kind, turn, _ in pads:
        border = outline_points(kind, x, y, sx, sy, turn)
        for tid, x1, y1, x2, y2, w, _ in tracks:
            far = min(plain_segment(q, (x1, y1), (x2, y2)) for q in border) - w / 2
            inside = abs(got[pid, tid]) < 1e-9
            assert inside and far < 0.02 + min(sx, sy) / 2 or abs(got[pid, tid] - far) < 0.01, (pid, tid, got[pid, tid], far)


def test_regions_with_holes_and_brute_force(spark):
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    plane = ("plane", ring((0, 0), (300, 0), (300, 300), (0, 300), (0, 0)), [ring((10, 10), (20, 10), (20, 20), (10, 20), (10, 10))], "a")
    regions = spark.createDataFrame([plane, ("else", plane[1], [], "b")], "id string, points array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>, layer string")
    tracks = spark.createDataFrame([("in", 1.0, 1.0, 2.0, 2.0, 0.1, "a"), ("hole", 12.0, 12.0, 18.0, 18.0, 0.1, "a"), ("rim", 12.0, 12.0, 19.99, 18.0, 0.1, "a"), ("out", 400.0, 1.0, 401.0, 1.0, 0.1, "a")], "id string, x1 double, y1 double, x2 double, y2 double, width double, layer string")
    c = copper.shapes(tracks=tracks, regions=regions)
    pairs = sorted(map(tuple, copper.contacts(c, 0.03).collect()))
    assert pairs == [("in", "plane"), ("hole", "rim"), ("plane", "rim")] or sorted(pairs) == sorted([("in", "plane"), ("hole", "rim"), ("plane", "rim")])
    assert sorted(map(tuple, copper.brute_contacts(c, 0.03).collect())) == sorted(pairs)


def test_diagonal_track_is_no_contact_of_its_box(spark):
    pads = spark.createDataFrame([("p", 9.0, 1.0, 1.0, 1.0, "0"), ("q", 5.0, 5.5, 1.0, 1.0, "0")], "id string, x double, y double, size_x double, size_y double, layer string")
    tracks = spark.createDataFrame([("t", 0.0, 0.0, 10.0, 10.0, 0.2, "0")], "id string, x1 double, y1 double, x2 double, y2 double, width double, layer string")
    assert [tuple(r) for r in connectivity.pad_track_contacts(pads, tracks, 0.0).collect()] == [("q", "t")]


def test_wide_boxes_meet_on_coarse_grids(spark):
    rnd = random.Random(9)
    rows = [(f"b{k:03}", "x", x, x + w, y, y + h) for k in range(150) for x, y, w, h in [(rnd.uniform(0, 3000), rnd.uniform(0, 3000), rnd.choice([0.5, 3, 30, 900]), rnd.choice([0.5, 3, 30, 2500]))]]
    df = spark.createDataFrame(rows, "id string, layer string, x0 double, x1 double, y0 double, y1 double")
    got = sorted((r["l_id"], r["r_id"]) for r in spatial.box_join(df, df, 1.0, 0.5, wide=True).where("l_id < r_id").collect())
    near = lambda a, b: a[2] - 0.5 <= b[3] and b[2] <= a[3] + 0.5 and a[4] - 0.5 <= b[5] and b[4] <= a[5] + 0.5
    assert got == [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if near(a, b)] and len(got) > 300


def test_vias_follow_their_span(spark):
    pads = spark.createDataFrame([(n, 1.0, 1.0, 0.5, 0.5, "C", n) for n in ("F.Cu", "In1.Cu", "B.Cu")], "id string, x double, y double, size_x double, size_y double, shape string, layer string")
    drills = spark.createDataFrame([("d", 1.0, 1.0, 0.3, "plated", True, ["F.Cu", "In1.Cu"], 0.8), ("e", 1.0, 1.0, 0.3, "non-plated", True, None, 0.8)], "id string, x double, y double, diameter double, plating string, span_proven boolean, layers array<string>, confidence double")
    edges = copper.physical_graph(copper.pad_shapes(pads), drills)
    assert [tuple(r) for r in edges.collect()] == [("F.Cu", "In1.Cu", "via", "d", 0.8)]
    nodes = pads.select(F.col("id").alias("node"))
    assert sorted((r["member_count"], r["first_member"], r["confidence"]) for r in connectivity.nets(nodes, edges).collect()) == [(1, "B.Cu", 0.99), (2, "F.Cu", 0.8)]
    for bad in ([("a", "a", 0.5)], [("a", "b", 1.5)], [("a", "b", None)]):
        with pytest.raises(ValueError):
            connectivity.solve(nodes, spark.createDataFrame(bad, "u string, v string, confidence double"))


def test_ids_of_long_nets(spark, monkeypatch):
    """Beyond LEAF members an id is made of digests of ranges, however the members are dealt; up to LEAF it is as ever."""
    from hashlib import sha1

    monkeypatch.setattr(connectivity, "LEAF", 4)
    names = {"a": 4, "b": 5, "c": 11}
    nodes = spark.createDataFrame([(f"{c}{k:02}",) for c, n in names.items() for k in range(n)], "node string")
    edges = spark.createDataFrame([(f"{c}{k:02}", f"{c}{k + 1:02}") for c, n in names.items() for k in range(n - 1)], "u string, v string")

    def wanted(c, n):
        members = [f"{c}{k:02}" for k in range(n)]
        parts = members if n <= 4 else [sha1("|".join(members[k : k + 4]).encode()).hexdigest() for k in range(0, n, 4)]
        return "net_" + sha1("|".join(parts).encode()).hexdigest()[:12]

    for dealt in (nodes, nodes.repartition(7)):
        assert {r["first_member"][0]: r["net_id"] for r in connectivity.nets(dealt, edges).collect()} == {c: wanted(c, n) for c, n in names.items()}


def via_board(spark, **change):
    pad = {"size": 0.6, "shape": "C", "x": 2.0, "net": "N1"} | change
    pads = [("a", 2.0, 3.0, 0.6, 0.6, "C", "F.Cu", None, "N1"), ("b", pad["x"], 3.0, pad["size"], pad["size"], pad["shape"], "B.Cu", None, pad["net"])]
    return {
        "pads": spark.createDataFrame(pads, "id string, x double, y double, size_x double, size_y double, shape string, layer string, drill double, net_id string"),
        "tracks": spark.createDataFrame([("t", 0.0, 0.0, 1.0, 0.0, 0.2, change.get("inner", "F.Cu"), "N1"), ("u", 0.0, 0.0, 0.0, 0.0, 0.2, "F.Cu", "N1"), ("v", 0.0, 0.0, 1.0, 0.0, -1.0, "F.Cu", "N1"), ("w", 0.0, 1.0, 1.0, 1.0, 0.1, "Paper", "N1")], "id string, x1 double, y1 double, x2 double, y2 double, width double, layer string, net_id string"),
        "drills": spark.createDataFrame([("d", 2.0, 3.0, 0.3, change.get("plating", "plated"))], "id string, x double, y double, diameter double, plating string"),
        "nets": spark.createDataFrame([("N1", None), ("N2", "VCC"), ("N3", "x"), ("N3", "y")], "net_id string, label string"),
        "via_spans": spark.createDataFrame([("d", "F.Cu", "B.Cu", ["a", "b"], True, change.get("kind"))], "drill_id string, from_layer string, to_layer string, pad_ids array<string>, proven boolean, span_kind string"),
    }


@pytest.mark.parametrize("change,status", [
    ({}, "export"), ({"size": 0.5}, "KICAD_PROVEN_VIA_ANNULUS_UNREPRESENTABLE"), ({"shape": "R"}, "KICAD_PROVEN_VIA_ANNULUS_UNREPRESENTABLE"), ({"x": 2.1}, "KICAD_PROVEN_VIA_ANNULUS_UNREPRESENTABLE"),
    ({"net": "N2"}, "KICAD_PROVEN_VIA_NET_CONFLICT"), ({"net": None}, "KICAD_PROVEN_VIA_NET_CONFLICT"), ({"plating": "unknown"}, "invalid-drill"), ({"kind": "blind"}, "KICAD_PROVEN_VIA_X2_KIND_MISMATCH"), ({"inner": "In1.Cu"}, "KICAD_PROVEN_VIA_LAYER_SUPPORT_INCOMPLETE"),
])
def test_via_export(spark, change, status):
    b = via_board(spark, **change)
    assert [r["status"] for r in kicad.via_plan(b, kicad.copper_layers(b)).collect()] == [status]


def test_board_file_round_trip(spark):
    b = via_board(spark)
    planned = {(r["family"], r["status"]): r["n"] for r in kicad.statuses(kicad.plan(b)).collect()}
    assert planned == {("tracks", "export"): 1, ("tracks", "skip-zero-length"): 1, ("tracks", "skip-invalid-width"): 1, ("tracks", "skip-layer"): 1, ("pads", "export"): 2, ("vias", "export"): 1, ("drills", "export-via"): 1}
    assert [tuple(r) for r in kicad.net_rows(b["nets"]).orderBy("code").collect()] == [("N1", 1, "N1"), ("N2", 2, "VCC")]
    read = tables.kicad(kicad.board_text(b).withColumn("path", F.lit("x")))
    audited = {r["family"]: (r["expected"], r["observed"], r["missing"], r["unexpected"]) for r in kicad.audit(b, read).collect()}
    assert audited["via"] == (1, 1, 0, 0) and audited["pad"] == (2, 2, 0, 0) and audited["track"] == (1, 1, 0, 0) and audited["net"] == (2, 2, 0, 0)
    other = read.unionByName(read.where("kind = 'via'").withColumns({"kind": F.lit("arc")}))
    assert [r["family"] for r in kicad.audit(b, other).collect() if not r["equal"]] == ["unexpected"]


def test_missing_parts_of_a_board(spark):
    b = via_board(spark)
    assert board.run_drc({"tracks": b["tracks"]}).where("code = 'TRACK_WIDTH_MIN'").count() == 2
    codes = {r["code"] for r in board.validate({"pads": b["pads"], "outline": spark.createDataFrame([], "id string, ord long, x1 double, y1 double, x2 double, y2 double")}).collect()}
    assert codes == {"NO_BOARD_OUTLINE"}
    none = b["nets"].limit(0).withColumn("confidence", F.lit(1.0))
    assert {r["code"] for r in board.validate({"pads": b["pads"], "nets": none, "net_members": spark.createDataFrame([], "net_id string, member_id string")}).collect()} == {"NO_CONNECTIVITY", "OBJECT_NET_BACKREF_MISMATCH"}
    with pytest.raises(ValueError):
        board.review_queue({"nets": none}, net_confidence_below=1.5)
    with pytest.raises(ValueError):
        board.Limits(mechanical=-1.0)


def area_of(components):
    return sum(composition.area(c.shell) + sum(composition.area(h) for h in c.holes) for c in components)


def test_composition_against_cells():
    """Boxes on a lattice, dark and clear in turn, against every cell of the lattice."""
    for seed in range(8):
        rnd = random.Random(seed)
        ops = [composition.Operation(rnd.random() < 0.6, [composition.box(rnd.randrange(8, 40) / 4, rnd.randrange(8, 40) / 4, rnd.randrange(2, 16, 2) / 4, rnd.randrange(2, 16, 2) / 4)], k) for k in range(40)]
        cells = 0
        for i, j in itertools.product(range(100), range(100)):
            x, y, dark = i / 8 + 1 / 16, j / 8 + 1 / 16, False
            for op in ops:
                (x0, y0), _, (x1, y1), _ = op.rings[0]
                if x0 < x < x1 and y0 < y < y1:
                    dark = op.dark
            cells += dark
        out = composition.compose(ops)
        assert abs(area_of(out) - cells / 64) < 1e-9
        assert all(composition.area(c.shell) > 0 and c.shell[0] == min(c.shell) and all(composition.area(h) < 0 for h in c.holes) for c in out) and out == sorted(out, key=lambda c: c.shell)


def test_composition_of_round_things():
    """Discs and strokes against many points."""
    rnd = random.Random(4)
    ops = [composition.Operation(rnd.random() < 0.6, [composition.disc(x, y, 0.3 + rnd.random()) if k % 2 else composition.stroke((x, y), (x + rnd.random() * 3, y + rnd.random() * 3), 0.4)], k) for k in range(60) for x, y in [(rnd.random() * 6, rnd.random() * 6)]]
    out = composition.compose(ops)
    p = np.random.default_rng(0).random((60_000, 2)) * 13 - 2
    dark = np.zeros(len(p), dtype=bool)
    for op in ops:
        a = np.array(op.rings[0])
        b = np.roll(a, -1, axis=0)
        with np.errstate(all="ignore"):
            x = (b[None, :, 0] - a[None, :, 0]) * (p[:, 1, None] - a[None, :, 1]) / (b[None, :, 1] - a[None, :, 1]) + a[None, :, 0]
        dark[(((a[None, :, 1] > p[:, 1, None]) != (b[None, :, 1] > p[:, 1, None])) & (p[:, 0, None] < x)).sum(axis=1) % 2 == 1] = op.dark
    share = dark.mean()
    assert abs(area_of(out) - share * 169) < 4 * 169 * math.sqrt(share * (1 - share) / len(p))
    assert composition.compose([]) == [] and composition.compose([composition.Operation(False, [composition.box(0, 0, 1, 1)])]) == []
    corner = composition.compose([composition.Operation(True, [composition.box(0, 0, 2, 2)], 1), composition.Operation(True, [composition.box(2, 2, 2, 2)], 2)])
    assert len(corner) == 2 and [c.sources for c in corner] == [[1], [2]]


def test_clear_polarity_replaces_pads_and_tracks():
    head = "%FSLAX24Y24*%\n%MOMM*%\n%ADD10R,4X4*%\n%ADD11C,1*%\n"
    rows = gerber.parse(head + "D10*\nX0Y0D03*\n%LPC*%\nD11*\nX0Y0D03*\n%LPD*%\nX010000Y050000D02*\nX020000Y050000D01*\nM02*\n", "x.gtl").rows
    assert [r["kind"] for r in rows] == ["region", "region"] and sorted(len(r["holes"]) for r in rows) == [0, 1]
    hole = next(r for r in rows if r["holes"])
    assert hole["message"] == "lines 6, 9" and abs(abs(composition.area([(p["x"], p["y"]) for p in hole["points"][:-1]])) - 16) < 1e-9
    assert [r["kind"] for r in gerber.parse(head + "D10*\nX0Y0D03*\nM02*\n", "x.gtl").rows] == ["pad"]
    assert [r["kind"] for r in gerber.parse(head + "%LPC*%\nD11*\nX0Y0D03*\nM02*\n", "board-outline.gbr", strict=False).rows] == ["diagnostic"]


def test_import_of_mixed_files(spark):
    files = spark.createDataFrame([("a.gtl", "%FSLAX24Y24*%\n%MOMM*%\n%ADD10C,1*%\nD10*\nX0Y0D03*\nM02*\n", None), ("b.json", "[1, 2]", None), ("c.csv", "Reference,X\n", "gerber"), ("d.bin", "\u0001", None), (None, "x", None), ("e.gtl", None, None)], "path string, content string, expected string")
    report, read = adapters.import_files(files)
    got = {r["path"]: (r["format"], r["success"], r["diagnostic"]) for r in report.collect()}
    assert got["a.gtl"] == ("gerber", True, None) and got["c.csv"] == ("csv", False, "FORMAT_MISMATCH:gerber:csv") and got["d.bin"][2] == "NO_ADAPTER" and got[None][2] == "IMPORT_PATH_EMPTY" and got["e.gtl"][2] == "IMPORT_TEXT_NONE"
    assert read["gerber"].where("kind = 'pad'").count() == 1 and read["json"].count() == 1 and read["kicad_board"].count() == 0
    assert [r["path"] for r in report.collect()][:1] == ["a.gtl"] or report.first()["priority"] <= 20
    assert {r["format"]: (r["total"], r["passed"]) for r in adapters.summary(report).collect()}["csv"] == (1, 0)
    with pytest.raises(ValueError):
        adapters.default_adapters().add("csv", tables.kicad)


def test_plugins():
    class Own(plugins.Plugin):
        def __init__(self, name, *capabilities):
            self.metadata, self.seen = plugins.Metadata(name, "1", capabilities=capabilities), []

        def activate(self, context):
            self.seen.append(context.permissions["network"])

    registry, a, b = plugins.Registry(), Own("a", "parser"), Own("b", "exporter", "odd")
    registry.add(b)
    registry.add(a)
    context = plugins.Context(permissions=plugins.permissions({"network": 1}))
    assert registry.activate(context) == ["a", "b"] and registry.deactivate(context) == ["b", "a"] and a.seen == [True] and registry.able_to("parser") == [a]
    assert plugins.problems(b) == ["PLUGIN_UNKNOWN_CAPABILITY"] and plugins.problems(object()) == ["PLUGIN_METADATA_MISSING"] and plugins.problems(a) == []
    assert not any(plugins.permissions().values())
    with pytest.raises(ValueError):
        registry.add(Own("a"))
    with pytest.raises(ValueError):
        registry.add(plugins.Plugin())
    hooks, calls = plugins.Hooks(), []
    hooks.subscribe("saved", lambda x: calls.append(x) or 1)
    hooks.subscribe("saved", lambda x: 2)
    assert hooks.emit("saved", "p") == [1, 2] and hooks.emit("other") == [] and calls == ["p"]


def test_schematic_reader():
    rows = tables.schematic_rows('(kicad_sch (version 2) (generator "g") (uuid "s") (symbol (lib_id "D:R") (at 1 2 90) (uuid "a") (property "Reference" "R1") (property "Value" "10k")) (wire (pts (xy 0 0) (xy 3 4)) (uuid "w")) (global_label "GND" (at 5 6) (uuid "l")))')
    assert [r["kind"] for r in rows] == ["file", "symbol", "wire", "global_label"]
    assert (rows[1]["reference"], rows[1]["value"], rows[1]["x"], rows[1]["rotation"]) == ("R1", "10k", 1.0, 90.0) and rows[2]["points"][1] == {"x": 3.0, "y": 4.0} and rows[3]["text"] == "GND"
    with pytest.raises(ValueError):
        tables.schematic_rows("(kicad_pcb)")


def test_affine_fits(spark):
    m = geometry.fit_affine([(0, 0, 5, 7), (1, 0, 7, 6), (0, 1, 4, 10)])
    assert m == (2.0, -1.0, -1.0, 3.0, 5.0, 7.0)
    for bad in ([(0, 0, 1, 1)], [(0, 0, 1, 1), (1, 1, 2, 2), (2, 2, 3, 3)]):
        with pytest.raises(ValueError):
            geometry.fit_affine(bad)
    df = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 7.0), (1, 1.0, 0.0, 7.0, 6.0), (1, 0.0, 1.0, 4.0, 10.0), (2, 1.0, 1.0, 1.0, 1.0), (2, 2.0, 2.0, 1.0, 1.0)], "k int, x double, y double, to_x double, to_y double")
    got = {r["k"]: [r[c] for c in "abcdef"] for r in geometry.fit_affine_columns(df, ["k"]).collect()}
    assert got[1] == pytest.approx(list(m)) and got[2] == [None] * 6


def test_short_numbers(spark):
    numbers = [0.0, 1.0, 4.7, 100.0, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234567, 2.5e-7, 33.3333333, -4.75, 1e10, 0.5]
    got = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", text.general(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == {v: f"{v:g}" for v in numbers}


def test_merges(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "y"), (3, None)], "id int, v string")
    assert sorted(r["id"] for r in evidence.merge_strict(a, b).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="conflicting record"):
        evidence.merge_strict(a, b.withColumn("v", F.lit("z"))).collect()
    assert evidence.statistics(a.limit(0).withColumn("n", F.lit(1.0)), "n").first()["count"] == 0


def test_cycles_of_any_length_and_levels(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 12) for k in range(12)] + [(50, 3), (5, 60), (60, 61)], "u long, v long")
    assert [r["nodes"] for r in graph.cycles(ring).collect()] == [list(range(12))] and graph.cycles(ring, longest=8).count() == 0 and graph.has_cycle(ring)
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(ring)
    assert {r["node"]: r["level"] for r in graph.levels(ring, strict=False).collect()} == {50: 0}
    tree = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "u long, v long")
    assert graph.cycles(tree).count() == 0 and not graph.has_cycle(tree) and {r["node"]: r["level"] for r in graph.levels(tree).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_report_lines_are_the_documents(spark, tmp_path):
    from xml.etree import ElementTree

    issues = spark.createDataFrame([("drc", "error", "A<B", "x & y", ["p"]), ("drc", "warning", "C", "z", [])], "source string, severity string, code string, message string, object_ids array<string>")
    suite = ElementTree.fromstring(reports.document(reports.junit_lines(issues)))
    assert (suite.get("tests"), suite.get("failures")) == ("2", "1") and suite[0].get("name") == "A<B" and suite[0][0].get("message") == "x & y"
    assert reports.document(reports.markdown_lines(issues, {"pads": 3})) == reports.markdown(issues, {"pads": 3})
    assert reports.document(reports.markdown_lines(issues.limit(0), {})).endswith("- none\n") and ElementTree.fromstring(reports.document(reports.junit_lines(issues.limit(0))))[0].get("name") == "all"
    tracks, pads = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.2)], "x1 double, y1 double, x2 double, y2 double, width double"), spark.createDataFrame([(2.0, 2.0, 1.0, 1.0)], "x double, y double, size_x double, size_y double")
    svg = ElementTree.fromstring(reports.document(reports.svg_lines(tracks, pads)))
    assert len(svg) == 2 and svg.get("viewBox") == "-2.0 -2.0 6.5 6.5"
    members = spark.createDataFrame([("n", "a&", 1), ("n", "b", 2), ("m", "c", 3)], "net_id string, member_id string, ord long")
    whole = ElementTree.fromstring(reports.document(reports.graphml_lines(members)))
    assert [len(whole[0].findall(f"{{http://graphml.graphdrawing.org/xmlns}}{t}")) for t in ("node", "edge")] == [3, 1]
    reports.write_lines(reports.graphml_lines(members), str(tmp_path / "g"))
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    assert len(ElementTree.fromstring(text_)[0]) == 4
    reports.write_bundle({"pads": pads}, str(tmp_path / "b"), issues)
    assert spark.read.json(str(tmp_path / "b/validation")).count() == 2 and spark.read.parquet(str(tmp_path / "b/pads")).count() == 1


def test_inside_of_a_long_outline(spark):
    """A jagged ring with a hole, against the parity of all edges for each point."""
    rng = random.Random(9)
    ring = lambda n, r: [(r * (0.7 + 0.3 * rng.random()) * math.cos(2 * math.pi * k / n), r * (0.7 + 0.3 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    edges = [(*a, *b) for points in (ring(400, 50), ring(60, 20)) for a, b in zip(points, points[1:] + points[:1], strict=True)]
    spots = [(f"s{k}", rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(500)] + [("corner", *edges[0][:2]), ("none", None, 1.0), ("twice", 0.0, 30.0), ("twice", 0.0, 30.0)]
    odd = lambda x, y: sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in edges) % 2 == 1
    df = spark.createDataFrame(spots, "id string, px double, py double")
    got = sorted((r["id"], r["inside"]) for r in spatial.inside_rings(df, spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")).collect())
    assert got == sorted((i, x is not None and odd(x, y)) for i, x, y in spots) and 100 < sum(v for _, v in got) < 400
    assert not any(r["inside"] for r in spatial.inside_rings(df, spark.createDataFrame([], "x1 double, y1 double, x2 double, y2 double")).collect())
