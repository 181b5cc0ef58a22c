"""Operators and functions on small tables, against plain Python."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import engineering, geometry, text
from tracewright.operators import architecture, checks, connectivity, evidence, graph, hypotheses, inference, quality, query, reconcile, rules, spatial, windows
from tracewright.plans import derived, graph_queries, quality_queries
from tracewright.plans.dag import Cache, Dag, Node


def values(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row)


def test_query_parsing():
    q = query.parse
    assert q("a >= 3") == query.Query("a", ">=", 3) and q("a.b==true") == query.Query("a.b", "==", True)
    assert q("x~'Power'") == query.Query("x", "~", "Power") and q("y<0.5") == query.Query("y", "<", 0.5)
    for bad in ("nothing", "==3"):
        with pytest.raises(ValueError):
            q(bad)
    assert query.issues(query.Query(" ", "?", 1)) == ["QUERY_EMPTY_FIELD", "QUERY_BAD_OPERATOR"]


def test_query_null_rules(spark):
    df = spark.createDataFrame([(1, "GND", None, (3.0,)), (2, None, 5.0, (None,)), (3, "vcc 3", 1.0, None)], "id int, label string, v double, s struct<x:double>")
    ids = lambda q: [r["id"] for r in query.execute(df, q).orderBy("id").collect()]
    assert ids("label != GND") == [2, 3] and ids("label == GND") == [1] and ids("label ~ none") == [2]
    assert ids("v > 2") == [2] and ids("s.x >= 3") == [1] and ids("missing == 1") == [] and ids("missing != 1") == [1, 2, 3] and ids("label > 3") == []
    assert [r["id"] for r in query.sort(df, "v").collect()] == [3, 2, 1] and [r["id"] for r in query.sort(df, "v", True).collect()] == [1, 2, 3]
    assert [r["id"] for r in query.any_of(df, "v > 2", "label == GND", order="k").orderBy("k").collect()] == [2, 1]
    assert [p["v"] for p in query.even_sample(spark.range(10).withColumnRenamed("id", "v"), 4, ["v"]).orderBy("v").collect()] == [0, 2, 5, 7]


def boxes(n, seed):
    rnd = random.Random(seed)
    return [(f"b{i:03}", str(rnd.randrange(2)), x, x + rnd.random() * 3, y, y + rnd.random() * 3) for i in range(n) for x, y in [(rnd.uniform(-9, 9), rnd.uniform(-9, 9))]]


@pytest.mark.parametrize("cell,within", [(1.0, 0.0), (2.5, 0.7), (20.0, 0.3)])
def test_box_pairs_match_brute_force(spark, cell, within):
    rows = boxes(60, 4)
    df = spark.createDataFrame(rows, "id string, layer string, x0 double, x1 double, y0 double, y1 double")
    got = sorted((r["l_id"], r["r_id"]) for r in spatial.box_pairs(df, cell, within).collect())
    near = lambda a, b: a[1] == b[1] and a[2] - within <= b[3] and b[2] <= a[3] + within and a[4] - within <= b[5] and b[4] <= a[5] + within
    assert got == [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if near(a, b)]
    assert "NestedLoop" not in spatial.box_pairs(df, cell, within)._jdf.queryExecution().toString()


def test_radius_and_nearest(spark):
    rnd = random.Random(2)
    pts = [(f"p{i:02}", rnd.uniform(0, 4), rnd.uniform(0, 4)) for i in range(40)]
    df = spark.createDataFrame(pts, "id string, x double, y double")
    d = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    got = {(r["l_id"], r["r_id"]) for r in spatial.radius_join(df, df, 0.8).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if d(a, b) <= 0.8}
    others = df.where("id > 'p20'")
    near = {r["l_id"]: r["r_id"] for r in spatial.nearest(df, others, 1.0).collect()}
    want = {a[0]: min((d(a, b), b[0]) for b in pts if b[0] > "p20" and d(a, b) <= 1.0)[1] for a in pts if any(b[0] > "p20" and d(a, b) <= 1.0 for b in pts)}
    assert near == want


def plain_components(nodes, edges):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    nodes = spark.range(60).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in graph.label_components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == plain_components(range(60), edges)


def test_graph_algorithms(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)], "u long, v long")
    assert {r["node"]: r["hops"] for r in graph.hops(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert sorted(r["node"] for r in graph.closure(edges, spark.createDataFrame([(4,)], "node long")).collect()) == [4, 5]
    assert [r["nodes"] for r in graph.cycles(edges).collect()] == [[1, 2, 3]] and graph.has_cycle(edges)
    assert {r["node"]: r["level"] for r in graph.levels(edges, strict=False).collect()} == {6: 0, 7: 1}
    assert sorted(r["node"] for r in graph.articulation_nodes(edges).collect()) == [3, 4]
    assert sorted((r["u"], r["v"]) for r in graph.bridges(edges).collect()) == [(3, 4), (4, 5), (6, 7)]
    b = {r["node"]: r["betweenness"] for r in graph.betweenness(edges, 7).collect()}
    assert b[3] == round(4 / 15, 8) and b[4] == round(3 / 15, 8) and b[1] == 0.0
    paths = [r["nodes"] for r in graph.simple_paths(edges, 1, 5).collect()]
    assert paths == [[1, 3, 4, 5], [1, 2, 3, 4, 5]]
    m = graph.metrics(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))), edges).first()
    assert (m["nodes"], m["edges"], m["components"]) == (7, 6, 2)
    h = {r["node"]: r["hash"] for r in graph.neighbourhood_hash(spark.createDataFrame([(i, "c") for i in range(1, 8)], "node long, label string"), edges).collect()}
    assert h[6] == h[7] and h[1] == h[2] != h[3]


def test_betweenness_of_the_whole_flow(spark, small_dir):
    """Against all pairs: v is between s and t as often as d(s, v) + d(v, t) = d(s, t)."""
    near = {}
    for r in graph_queries.flow(spark, small_dir).collect():
        near.setdefault(r["u"], set()).add(r["v"])
        near.setdefault(r["v"], set()).add(r["u"])
    far, ways = {}, {}
    for s in near:
        far[s], ways[s], ring = {s: 0}, {s: 1}, [s]
        while ring:
            after = []
            for a in ring:
                for b in near[a]:
                    if b not in far[s]:
                        far[s][b], ways[s][b] = far[s][a] + 1, 0
                        after.append(b)
                    if far[s][b] == far[s][a] + 1:
                        ways[s][b] += ways[s][a]
            ring = after
    n, want = len(near), dict.fromkeys(near, 0.0)
    for s in near:
        for t in far[s]:
            for v in far[s]:
                if s < t and v not in (s, t) and far[s][v] + far[v][t] == far[s][t]:
                    want[v] += ways[s][v] * ways[v][t] / ways[s][t]
    got = {r["node"]: r["betweenness"] for r in graph_queries.betweenness(spark, small_dir).collect()}
    assert n > 25 and got == pytest.approx({v: x * 2 / ((n - 1) * (n - 2)) for v, x in want.items()}, abs=1e-8)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=6))
def test_noisy_or_bounds(cs):
    miss = math.prod(1 - c for c in cs)
    assert 0 <= 1 - miss <= 1 and 1 - miss >= max(cs) - 1e-12


def test_evidence(spark):
    rows = [("s", "v", "A", "x", 0.6, None, 1), ("s", "v", "A", "x", 0.5, None, 2), ("s", "v", "A", "y", 0.5, "g", 3), ("s", "v", "B", "z", 0.75, None, 4), ("t", "v", "C", "x", 0.2, None, 5), ("u", "v", "D", "x", 1.0, None, 6)]
    df = spark.createDataFrame(rows, "subject string, field string, value string, source string, confidence double, independent_group string, ord long")
    fused = {(r["subject"], r["value"]): round(r["confidence"], 9) for r in evidence.noisy_or(df, ["subject", "value"], F.coalesce("independent_group", "source")).collect()}
    assert fused == {("s", "A"): 0.8, ("s", "B"): 0.75, ("t", "C"): 0.2, ("u", "D"): 1.0}
    found = {(r["subject"], r["code"], r["severity"]) for r in evidence.consistency_findings(df, ["subject", "field"]).collect()}
    assert found == {("s", "EVIDENCE_CONFLICT", "error"), ("t", "EVIDENCE_WEAK_CONSENSUS", "warning")}
    r = evidence.resolve(df, ["subject"]).where("subject = 's'").first()
    assert (r["value"], r["confidence"], r["conflicts"], r["sources"]) == ("B", 0.75, ["A"], ["z"])
    f = evidence.fuse(df.withColumnRenamed("value", "claim"), ["subject"]).where("subject = 's'").first()
    assert (f["claim"], f["confidence"], f["sources"], f["groups"]) == ("A", 0.8, ["x", "y"], ["g", "x"])
    assert evidence.coverage(df.limit(0), df.limit(0), "value").first()["coverage"] == 1.0
    pr = evidence.precision_recall(df.where("subject = 's'"), df, "value").first()
    assert pr["precision"] == 1.0 and pr["recall"] == 0.5


def test_reconciliation(spark):
    parts = "reference string, value string, footprint string"
    bill, placed = spark.createDataFrame([("r 1", "10K", "0603"), ("C1", "", "0402"), ("U9", "x", "y")], parts), spark.createDataFrame([("R1", "22k", "0603"), ("C1", "1u", "0805"), ("D1", None, None), ("", "q", "q")], parts)
    assert sorted((r["reference"], r["code"]) for r in reconcile.bom(bill, placed).collect()) == [("C1", "FOOTPRINT_MISMATCH"), ("D1", "MISSING_FROM_BOM"), ("R1", "VALUE_MISMATCH"), ("U9", "NOT_PLACED")]
    at = "reference string, x double, y double, rotation double, side string"
    a, b = spark.createDataFrame([("R1", 0.0, 0.0, 359.0, "Top"), ("R2", 0.0, 0.0, 0.0, "Top")], at), spark.createDataFrame([("R1", 0.2, 0.0, 2.0, "top"), ("R3", 0.0, 0.0, 0.0, "top")], at)
    assert {r["reference"]: (r["code"], r["rotation_delta_deg"]) for r in reconcile.placements(a, b).collect()} == {"R1": ("OK", 3.0), "R2": ("ONLY_SOURCE", 0.0), "R3": ("ONLY_RECONSTRUCTED", 0.0)}
    d = reconcile.changes(spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "id int, v string"), spark.createDataFrame([(1, None), (2, "x"), (4, "d")], "id int, v string"), ["id"])
    assert sorted((r["id"], r["kind"]) for r in d.collect()) == [(2, "changed"), (3, "removed"), (4, "added")]
    assert reconcile.change_counts(d).first().asDict() == {"total": 3, "added": 1, "removed": 1, "changed": 1}


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 90.0), ("a", 3, 180.0), ("b", 1, 5.0)], "k string, i int, v double")
    assert [r["gap"] for r in windows.angular_gaps(df, ["k"], "v", ["i"]).orderBy("k", "i").collect()] == [90.0, 90.0, 180.0, None]
    assert {r["k"]: r["regular"] for r in windows.regular(df, ["k"], "v", ["i"]).collect()} == {"a": True}
    t = windows.trend(df, ["k"], ["i"], "v").orderBy("k").collect()
    assert [(r["count"], r["latest"], r["delta"]) for r in t] == [(3, 180.0, 90.0), (1, 5.0, None)]
    parts = spark.createDataFrame([("a", "resistor", "R2"), ("b", "resistor", None), ("c", "resistor", ""), ("d", "led", None)], "id string, kind string, reference string")
    assert {r["id"]: r["reference"] for r in windows.assign_references(parts).collect()} == {"a": "R2", "b": "R1", "c": "R3", "d": "D1"}


def test_rules(spark):
    pads = spark.createDataFrame([("p1", 1.0, 1.0, 0.9), ("p2", 1.0, 2.0, 1.2), ("p3", 1.0, 1.0, None), ("p4", 2.0, 2.0, 0.8)], "id string, size_x double, size_y double, drill double")
    assert sorted((r["object_ids"][0], r["code"]) for r in rules.annular(pads, rules.DrcLimits()).collect()) == [("p1", "ANNULAR_RING_MIN"), ("p2", "ANNULAR_RING_BROKEN")]
    with pytest.raises(ValueError):
        rules.DrcLimits(track_width=-1)
    g = rules.gate(rules.annular(pads, rules.DrcLimits()), regressions=1).first()
    assert (g["passed"], g["failed"]) == (False, ["GATE_ERROR_COUNT", "GATE_REGRESSION_FAILURES"])
    ring = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 0.0), ("b", 1, 1.0, 0.0, 1.0, 1.0), ("c", 2, 1.0, 1.3, 0.0, 0.0)], "id string, ord long, x1 double, y1 double, x2 double, y2 double")
    assert [(r["id"], r["next_id"]) for r in rules.outline_gaps(ring).collect()] == [("b", "c")] and rules.outline_ends(ring).count() == 2
    slots = spark.createDataFrame([("s", 0.0, 0.0, 0.0, 0.0, 0.0, "odd")], "id string, x1 double, y1 double, x2 double, y2 double, width double, plating string")
    assert {r["code"] for r in rules.slots(slots).collect()} == {"SLOT_WIDTH_INVALID", "SLOT_ZERO_LENGTH", "SLOT_PLATING_UNKNOWN_ENUM"}
    registry = rules.Registry()
    registry.add("slots", lambda t: rules.slots(t["slots"]))
    assert registry.run({"slots": slots}).count() == 3


def test_net_labels(spark):
    members = spark.createDataFrame([("n1", "a"), ("n1", "b"), ("n2", "c"), ("n3", "d"), ("n4", "e"), ("n5", "f"), ("n6", "g")], "net_id string, member_id string")
    names = spark.createDataFrame([("a", "GND"), ("b", "GND"), ("c", "X"), ("d", "X"), ("e", "N/C"), ("f", "P"), ("f", "Q")], "member_id string, name string")
    got = {r["net_id"]: (r["label"], r["state"]) for r in connectivity.net_labels(members, names).collect()}
    assert got == {"n1": ("GND", "labelled"), "n2": (None, "shared"), "n3": (None, "shared"), "n4": (None, "unlabelled"), "n5": (None, "conflict"), "n6": (None, "unlabelled")}


def test_via_edges(spark):
    drills = spark.createDataFrame([("d1", 0.0, 0.0, "plated", True), ("d2", 5.0, 5.0, "unknown", True)], "id string, x double, y double, plating string, span_proven boolean")
    pads = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0, "F.Cu"), ("b", 0.1, 0.0, 1.0, 1.0, "B.Cu"), ("c", 5.0, 5.0, 1.0, 1.0, "F.Cu"), ("e", 5.0, 5.0, 1.0, 1.0, "B.Cu")], "id string, x double, y double, size_x double, size_y double, layer string")
    assert [(r["u"], r["v"]) for r in connectivity.via_edges(drills, pads).collect()] == [("a", "b")]


def test_inference(spark):
    pins = spark.createDataFrame([("R1", "VCC"), ("R1", "MID"), ("R2", "MID"), ("R2", "GND"), ("C1", "MID"), ("C1", "GND"), ("R3", "SIG"), ("R3", "VCC")], "component_id string, net_id string")
    parts = spark.createDataFrame([("R1", "resistor", "10k"), ("R2", "resistor", "1k"), ("R3", "resistor", "4k"), ("C1", "capacitor", "100nF")], "id string, kind string, value string")
    net = lambda n: spark.createDataFrame([(n,)], "net_id string")
    d = [(r["first"], r["second"], r["midpoint"], r["confidence"]) for r in inference.voltage_dividers(pins, parts, net("VCC"), net("GND")).collect()]
    assert ("R1", "R2", "MID", 0.9) in d
    p = {r["id"]: (r["kind"], r["signal"]) for r in inference.pull_networks(pins, parts, net("VCC"), net("GND")).collect()}
    assert p == {"R1": ("pull_up", "MID"), "R2": ("pull_down", "MID"), "R3": ("pull_up", "SIG")}
    f = {(r["resistor"], r["junction"]): r for r in inference.rc_filters(pins, parts, net("GND")).collect()}
    assert f["R1", "MID"]["confidence"] == 0.82 and abs(f["R1", "MID"]["cutoff_hz"] - 159.154943) < 1e-3
    pairs = inference.differential_pairs(spark.createDataFrame([("D_P", 10.0), ("D_N", 10.5), ("U+", 1.0), ("U-", 3.0), ("Q_DP", 1.0)], "name string, length double")).collect()
    assert sorted((r["first"], r["second"], r["confidence"]) for r in pairs) == [("D_N", "D_P", 0.9), ("U+", "U-", 0.65)]
    b = inference.buses(spark.createDataFrame([("1", "D0"), ("2", "D1"), ("3", "A[0]"), ("4", "A[2]"), ("5", "X")], "net_id string, label string")).orderBy("name").collect()
    assert [(r["name"], r["width"], r["confidence"], r["nets"]) for r in b] == [("A", 2, 0.65, ["3", "4"]), ("D", 2, 0.85, ["1", "2"])]


def test_text_functions(spark):
    s = F.lit
    assert values(spark, text.voltage(s("+3V3")), text.voltage(s("-12V")), text.voltage(s("1V05")), text.voltage(s("x"))) == [3.3, -12.0, 1.05, None]
    assert values(spark, text.resistance(s("4.7 kΩ")), text.resistance(s("4R7")), text.resistance_r(s("4R7")), text.resistance_r(s("33R")), text.resistance_r(s("2k"))) == [4700.0, None, 4.7, 33.0, 2000.0]
    assert values(spark, text.frequency(s("32.768 kHz")), text.frequency(s("bad")), text.resistor_marking(s("4702")), text.resistor_marking(s("0R0"))) == [32768.0, None, 47000.0, 0.0]
    assert [round(v * 1e9, 6) for v in values(spark, text.capacitance(s("100nF")), text.capacitance(s("1uF")), text.capacitor_marking(s("104")))] == [100.0, 1000.0, 100.0]
    assert values(spark, text.strict_reference(s(" r12 ")), text.strict_reference(s("12R")), text.net_name(s(" A  B ")), text.normal_text(s(" a   b "))) == ["R12", "", "A_B", "A B"]
    assert values(spark, text.silk_token(s("ic7")), text.silk_token(s("3V3")), text.serial_role(s("I2C SDA"))["protocol"], text.debug_role(s("SWDIO"))["signal"], text.pin_function(s("D+"))) == ["reference_ic", "net_label_candidate", "I2C", "SWDIO", "usb_dp"]
    assert values(spark, text.indexed_label(s("DATA[12]"))["index"], text.indexed_label(s("A_3"))["base"], text.complementary(s("X_P"), s("X_N")), text.complementary(s("X_P"), s("Y_N"))) == [12, "A", True, False]


def test_geometry(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    got = values(spark, geometry.segment_distance(lit(0, 0, 2, 0), lit(1, -1, 1, 1)), geometry.segment_distance(lit(0, 0, 2, 0), lit(0, 3, 2, 3)), geometry.capsule_gap(lit(0, 0, 1, 0), F.lit(1.0), lit(0, 3, 1, 3), F.lit(2.0)), geometry.angle_gap(F.lit(350.0), F.lit(20.0)), geometry.quantise(F.lit(2.5), 1.0))
    assert got == [0.0, 3.0, 1.5, 30.0, 2.0]
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(pt(0, 0), pt(4, 0), pt(4, 3), pt(0, 3))
    assert values(spark, geometry.signed_area(ring), geometry.in_ring(F.lit(1.0), F.lit(1.0), ring), geometry.in_ring(F.lit(5.0), F.lit(1.0), ring), geometry.polyline_length(ring), geometry.excess_length(ring)) == [12.0, True, False, 11.0, 8.0]
    assert values(spark, geometry.chords(F.lit(1.0), F.lit(math.pi / 2)), engineering.health_grade(F.lit(0.85)), engineering.margin(F.lit(0.0), F.lit(1.0))) == [8, "B", -1.0]


def test_dag(spark, tmp_path):
    runs = []

    def step(name, out):
        def run(inputs):
            runs.append(name)
            return {out: spark.range(len(inputs) + 1)}

        return run

    g = Dag([Node("b", ("x",), ("y",), step("b", "y")), Node("a", (), ("x",), step("a", "x")), Node("c", ("y", "gone"), ("z",), step("c", "z"))])
    assert g.order() == ["a", "b", "c"] and g.impacted(["a"]) == ["a", "b", "c"]
    cache = Cache(spark, f"file://{tmp_path}")
    first, second = g.execute(cache=cache), g.execute(cache=cache)
    assert first.executed == ["a", "b"] and first.skipped == ["c"] and second.executed == [] and runs == ["a", "b"]
    assert second.artifacts["y"].count() == 2
    with pytest.raises(ValueError):
        g.add(Node("d", (), ("x",)))
    with pytest.raises(ValueError):
        Dag([Node("p", ("q",), ("r",)), Node("s", ("r",), ("q",))]).order()


def test_holes_are_matched_in_order(spark):
    holes = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 1, 0.1, 0.0), ("c", 2, 9.0, 9.0)], "id string, ord int, x double, y double")
    targets = spark.createDataFrame([("x", 0, 0.12, 0.0), ("y", 1, 0.2, 0.0)], "id string, ord int, x double, y double")
    assert {(r["hole"], r["target"]) for r in quality.match_holes(holes, targets, 0.25).collect()} == {("a", "x"), ("b", "y")}


def test_release_profiles(spark):
    facts = spark.range(1).select(F.lit(0).alias("errors"), F.lit(30).alias("warnings"), F.lit(1.0).alias("provenance"), F.lit(1.0).alias("completeness"), *[F.lit(True).alias(n) for n in rules.FACT_CODES])
    got = {r["profile"]: (r["ready"], r["warnings"]) for r in rules.release_decisions(facts).collect()}
    assert got["manufacturing-export-candidate"] == (True, ["GATE_WARNING_COUNT"]) and got["research"] == (True, [])


def test_architecture(spark):
    parts = spark.createDataFrame([("U1", "ic", "buck converter"), ("R1", "resistor", "1k")], "id string, kind string, value string")
    pins = spark.createDataFrame([("U1", "VIN", "A"), ("U1", "SW_OUT", "B"), ("U1", "FB", "C")], "component_id string, pin_name string, net_id string")
    (r,) = architecture.regulators(parts, pins).collect()
    assert (r["kind"], r["input_nets"], r["output_nets"], r["feedback_nets"], r["confidence"]) == ("buck", ["A"], ["B"], ["C"], 0.86)
    roles = spark.createDataFrame([("n", "power"), ("n", "ground"), ("m", "clock")], "net_id string, role string")
    got = {r["net_id"]: (r["confidence"], r["conflicts"]) for r in architecture.signal_roles(roles).collect()}
    assert got == {"n": (0.64, ["POWER_GROUND_CONFLICT"]), "m": (0.52, [])}
    assert architecture.traceability(spark.createDataFrame([], "claim_id int, kind string, target string")).first()["source_coverage"] == 1.0


def test_component_pairs_match_brute_force(spark):
    rnd = random.Random(8)
    pads = [(f"p{i:02}", rnd.uniform(0, 12), rnd.uniform(0, 12), "F.Cu", 0.5 if i % 3 else None) for i in range(30)]
    got = sorted((tuple(r["pad_ids"]), r["kind"]) for r in hypotheses.paired_components(spark.createDataFrame(pads, "id string, x double, y double, layer string, drill double"), 2.0).collect())
    free, want = dict((p[0], p) for p in pads), []
    while free:
        a = free.pop(min(free))
        near = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in free.values() if math.hypot(a[1] - b[1], a[2] - b[2]) <= 2.0)
        if not near:
            want.append(((a[0],), "unresolved_pad"))
            continue
        b = free.pop(near[0][1])
        want.append((tuple(sorted((a[0], b[0]))), "two_pin_through_hole_candidate" if a[4] and b[4] else "two_pad_component_candidate"))
    assert got == sorted(want)


def test_component_pairs_take_every_pad(spark, small_dir):
    got = quality_queries.component_pairs(spark, small_dir).collect()
    assert sum(1 if r["kind"] == "unresolved_pad" else 2 for r in got) == derived.table(spark, small_dir, "pads").count()


def test_declared_spans(spark):
    drills = spark.createDataFrame([("a", 0.0, 0.0, "plated", [1, 3], None), ("b", 0.0, 0.0, "plated", [2, 9], None), ("c", 0.0, 0.0, "non-plated", None, None), ("d", 5.0, 5.0, "plated", None, None)], "id string, x double, y double, plating string, span array<int>, span_kind string")
    pads = spark.createDataFrame([("p", 0.0, 0.0, 1.0, 1.0, "F.Cu"), ("q", 0.0, 0.0, 1.0, 1.0, "In1.Cu")], "id string, x double, y double, size_x double, size_y double, layer string")
    got = {r["drill_id"]: (r["from_layer"], r["to_layer"], r["proven"], r["confidence"], r["pad_ids"]) for r in hypotheses.via_spans(drills, pads, ["F.Cu", "In1.Cu", "B.Cu"], told=True).collect()}
    assert got == {"a": ("F.Cu", "B.Cu", True, 0.99, ["p", "q"]), "b": (None, None, False, 0.1, []), "c": ("F.Cu", "In1.Cu", False, 0.7, ["p", "q"]), "d": (None, None, False, 0.1, [])}


def test_board_checks(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    as_points = lambda r: [{"x": x, "y": y} for x, y in r]
    good = as_points([*ring, ring[0]])
    df = spark.createDataFrame([("ok", good, [good]), ("open", as_points(ring), []), ("few", as_points([ring[0], ring[1], ring[0]]), [as_points(ring)]), ("wild", as_points([(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0), (0.0, 0.0)]), None)], "id string, points array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    got = sorted((r["object_ids"][0], r["code"]) for r in checks.regions(df).collect())
    assert got == [("few", "REGION_HOLE_NOT_CLOSED"), ("few", "REGION_VERTEX_COUNT_INVALID"), ("open", "REGION_NOT_CLOSED"), ("wild", "REGION_COORDINATE_INVALID")]
    parts = spark.createDataFrame([("c", ["a", "a", "z"], 0.5, {"q": "1", "a": " "}), ("e", [], 0.1, {})], "id string, pad_ids array<string>, confidence double, pin_map map<string,string>")
    pads = spark.createDataFrame([("a", 1.0)], "id string, x double")
    codes = {r["code"] for r in checks.components(parts, pads).collect()}
    assert codes == {"COMPONENT_PAD_DUPLICATE", "COMPONENT_PAD_MISSING", "COMPONENT_NO_PADS", "COMPONENT_PIN_MAP_PAD_NOT_MEMBER", "COMPONENT_PIN_NUMBER_INVALID"}
    points = spark.createDataFrame([("in", 2.0, 2.0, 1.0), ("near", 0.6, 2.0, 1.0), ("out", 5.0, 2.0, 1.0)], "id string, x double, y double, diameter double")
    assert sorted((r["object_ids"][0], r["code"]) for r in checks.edge(points, ring).collect()) == [("near", "COPPER_EDGE_CLEARANCE"), ("out", "COPPER_OUTSIDE_BOARD")]
    outline = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 0.0), ("b", 1, 1.2, 0.0, 0.0, 0.0)], "id string, ord long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["code"] for r in checks.outline(outline).collect()) == ["OUTLINE_GAP", "OUTLINE_NOT_CLOSED"]
    assert set(checks.builtin().rules) == {"geometry", "components", "drills", "slots", "outline", "regions"}


def test_runs_beside_each_other_keep_their_tables(spark):
    """Each run deletes its own tables, also when runs in other threads cut and delete between."""
    from concurrent.futures import ThreadPoolExecutor

    from tracewright import storage

    def run(n):
        with storage.tables_of_run() as own:
            df = spark.range(n)
            for _ in range(3):
                df = storage.cut(df.withColumn("id", F.col("id") + 1), "run", free=False)
                with storage.tables_of_run():  # an inner run's tables are the outer one's too
                    storage.cut(spark.range(2), "inner", free=False)
                storage.drop_run(spark, own, df)
            return df.agg(F.sum("id")).first()[0], len(own)

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, [10, 20, 30, 40])) == [(sum(range(3, n + 3)), 1) for n in (10, 20, 30, 40)]


def test_fingerprint_is_the_same_for_any_partitioning(spark):
    from hashlib import sha256

    level = [f"r{k:04}" for k in range(1000)]
    while True:
        level = [sha256("\n".join(level[k : k + 7]).encode()).hexdigest() for k in range(0, len(level), 7)]
        if len(level) == 1:
            break
    df = spark.range(1000).select(F.format_string("r%04d", "id").alias("x"))
    for dealt in (df, df.repartition(9), df.orderBy(F.desc("x"))):
        assert reconcile.table_fingerprint(dealt, F.col("x"), ["x"], leaf=7).first()[0] == level[0]
    assert reconcile.table_fingerprint(df.where("false"), F.col("x"), ["x"]).first()[0] is None


def test_percentiles_by_selection(spark):
    rng = random.Random(8)
    groups = {"many": [rng.gauss(0, 1) ** 3 for _ in range(3000)], "same": [2.5] * 50, "two": [1.0, 4.0], "one": [7.0], "near": [1 + k * 1e-15 for k in range(40)] + [1e300, -1e300], "small": [0.0, 5e-324, 1e-323], None: [float(rng.randrange(5)) for _ in range(99)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("many", None), ("many", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.0, 0.05, 0.5, 0.999, 1.0)
    got = {r["g"]: tuple(r)[1:] for r in evidence.percentiles(df, "v", shares, ("g",)).collect()}
    assert got.pop("none") == (None,) * 5 and got.keys() == groups.keys()
    for g, vs in groups.items():
        vs = sorted(vs)
        for p, value in zip(shares, got[g], strict=True):
            place = p * (len(vs) - 1)
            lo, hi = vs[math.floor(place)], vs[math.ceil(place)]
            assert value == pytest.approx(lo + (hi - lo) * (place % 1) if hi > lo else lo, rel=1e-12, abs=1e-320), (g, p)
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("inf"),)], "v double")
    assert tuple(evidence.percentiles(ends, "v", (0.0, 0.25, 0.375, 1.0)).first()) == (float("-inf"), 1.0, 1.5, float("inf"))
    assert evidence.percentiles(ends.where("v is null"), "v", (0.5,), ("v",)).count() == 0
