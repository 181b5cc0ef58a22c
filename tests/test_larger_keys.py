"""Queries and their SQL on tables that reach further than the small ones: larger keys, more rows."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright import storage
from tracewright.operators import architecture, graph, inference, packages, reconcile, rules, spatial, windows
from tracewright.plans import registry, source_queries
from tracewright.sources import archives, common, composition, tables

from test_queries import rows

QUERIES, SQL = registry.load()


@pytest.fixture
def compare(spark, tmp_path):
    """Runs a query and its SQL on the given tables."""

    def run(name, **made):
        con = duckdb.connect()
        for t, df in made.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        rel = con.sql(SQL[name])
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        assert got == rows(rel.columns, rel.fetchall())
        return got[1]

    return run


def parts(spark, keys):
    return keys.selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size", "concat('Brand#', id % 25) as p_brand")


def test_formatted_values_round_as_c_does(spark, compare):
    """1,234,565 ohms lie below or above the half of six digits in binary, whatever the shortest decimal says."""
    compare("formatted_values", part=parts(spark, spark.range(1_000_000, 1_020_000)))


def test_parse_gerber_far_out(spark, compare):
    """Places beyond 99.9999 mm need more than two digits before the point."""
    compare("parse_gerber", part=parts(spark, spark.range(49_900, 50_900)))


def test_archives_of_many_members(spark, compare):
    """A lot of more members than one archive may hold is several archives; the limit itself stays."""
    assert len(compare("unpacked_archives", part=parts(spark, spark.range(16 * 20_100).where("id % 16 < 2")))) == 40_200
    assert archives.MEMBERS == 20_000


def test_fingerprint_of_three_levels(spark):
    """Cut at two levels, a tree ends in the greatest digest of the second, as the SQL does beyond 4096 * 4096 rows."""
    df = spark.range(0, 9).select(F.col("id").cast("string").alias("r"), "id")
    got = [reconcile.table_fingerprint(df, F.col("r"), ["id"], 2, levels).first()[0] for levels in (2, None)]
    digests = lambda texts: [hashlib.sha256("\n".join(texts[k : k + 2]).encode()).hexdigest() for k in range(0, len(texts), 2)]
    second = digests(digests([str(k) for k in range(9)]))
    assert got == [max(second), digests(digests(second))[0]]


def test_copies_of_wires_are_not_paired(spark):
    """2,000 copies of two crossing wires make four million crossings, counted without as many rows; a route's own crossing is left out."""
    wire = lambda n, *legs: [(n, float(a), float(b), float(c), float(d)) for a, b, c, d in legs]
    few = [*wire(1, (0, 1, 9, 1), (5, 0, 5, 4)), *wire(2, (5, 3, 5, 0)), *wire(3, (8, 2, 1, 2)), *wire(3, (1, 1, 9, 1))]
    df = spark.createDataFrame(few, "net_id long, x1 double, y1 double, x2 double, y2 double")
    want = {(r["x"], r["y"]): r["count"] for r in graph.wire_crossings(df).groupBy("x", "y").count().collect()}
    assert {(r["x"], r["y"]): r["n"] for r in graph.crossing_places(df).collect()} == want and len(want) == 2
    many = spark.range(2_000).selectExpr("id net_id", "explode(array(struct(0d x1, 1d y1, 9d x2, 1d y2), struct(5d x1, 0d y1, 5d x2, 4d y2))) s").select("net_id", "s.*")
    assert [tuple(r) for r in graph.crossing_places(many).collect()] == [(5.0, 1.0, 2_000 * 1_999)]


def test_references_are_numbered_without_a_range_join(spark):
    """Used numbers are passed over by counting them in order, not by pairing each with every component behind it."""
    parts = spark.range(3_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.when(F.col("id") % 2 == 0, "resistor").otherwise("capacitor").alias("kind"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("R"), (F.col("id") % 500 + 1).cast("string"))).alias("reference"))
    out = windows.assign_references(parts)
    assert "free_before" not in out._jdf.queryExecution().toString()
    got = {r["id"]: r["reference"] for r in out.collect()}
    used = {k % 500 + 1 for k in range(0, 3_000, 3)}
    free = {"R": (n for n in range(1, 10_000) if n not in used), "C": iter(range(1, 10_000))}
    assert got == {f"{k:05}": f"R{k % 500 + 1}" if k % 3 == 0 else "RC"[k % 2] + str(next(free["RC"[k % 2]])) for k in range(3_000)}


def test_filters_pair_rows_that_are_complete(spark):
    """Values and marks are joined to parts before they are paired: nothing is joined to the pairs."""
    pins = spark.createDataFrame([(c, n) for c, a, b in [("r1", "A", "M"), ("r2", "M", "G"), ("c1", "M", "G"), ("l1", "A", "M")] for n in (a, b)], "component_id string, net_id string")
    parts = spark.createDataFrame([("r1", "resistor", "10K"), ("r2", "resistor", "1K"), ("c1", "capacitor", "1N"), ("l1", "inductor", "1U")], "id string, kind string, value string")
    net = lambda n: spark.createDataFrame([(n,)], "net_id string")
    for out, rows in ((inference.rc_filters(pins, parts, net("G")), 1), (inference.lc_filters(pins, parts, net("G")), 1), (inference.voltage_dividers(pins, parts, net("A"), net("G")), 1)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        assert out.count() == rows


def test_package_hints_broadcast_nothing(spark):
    """Components may be very many: pads are counted where they are grouped, by one shuffle, and no table goes through the driver."""
    pads = spark.range(300).selectExpr("id div 100 as component_id", "cast(id as double) x", "0d y", "cast(null as double) drill").where("component_id < 2 or x < 202")
    out = packages.package_hints(pads)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["component_id"]: r["state"] for r in out.collect()} == {0: "weak", 1: "weak", 2: "accepted" if packages.match([200, 201], [0, 0], [False, False])[0] else "weak"}


def test_neighbours_are_counted_without_pairs(spark):
    """By sets of nets, by pairs, and by both, as listing all pairs gives; null ids as before."""
    rnd = random.Random(5)
    edges = {(f"K{c}", f"N{rnd.randrange(30)}") for c in range(200) for _ in range(1 + c % 11)} | {(None, "N1"), ("K1", None), ("alone", "X")}
    df = spark.createDataFrame(sorted(edges, key=str), "component_id string, net_id string")
    on = defaultdict(set)
    for c, n in edges:
        if c and n:
            on[n].add(c)
    want = {c: (sum(x == c for x, _ in edges), len(set().union(*[on[n] for x, n in edges if x == c and n]) - {c}) if c else 0) for c, _ in edges}
    for most in (16, 4, 0):
        assert {r["component_id"]: (r["nets"], r["neighbours"]) for r in architecture.neighbourhoods(df, most).collect()} == want
    assert "component_id <> " not in architecture.neighbourhoods(df.where("net_id = 'N1'"))._jdf.queryExecution().toString()


def test_far_apart_operations_are_composed_apart():
    """Rows of boxes with a clear and a dark one inside: the same image as all at once, in groups of one row each."""
    box, op = composition.box, composition.Operation
    ops = [op(True, [box(x, y, 1.2, 0.5)], ("d", x, y)) for x in range(6) for y in range(5)] + [op(False, [box(x, y, 0.4, 0.2)], ("c", x, y)) for x in range(0, 6, 2) for y in range(5)] + [op(True, [box(x, y, 0.1, 0.1)], ("e", x, y)) for x in range(0, 6, 2) for y in range(5)]
    groups = composition._apart(ops)
    assert sorted(map(len, groups)) == [12] * 5 and composition.compose(ops) == composition._compose(ops)
    ring = [op(True, [composition.box(0, 0, 9, 9)]), op(False, [composition.box(0, 0, 8, 8)]), op(True, [composition.box(0, 0, 1, 1)])]
    assert len(composition._apart(ring)) == 1 and composition.compose([]) == [] and composition.compose([op(True, [])]) == []


def test_parsed_files_are_handed_on_one_at_a_time(spark, monkeypatch):
    """A task makes a table of at most so many objects at once, however many files a batch has."""
    monkeypatch.setattr(common, "ROWS", 7)
    sizes = []
    frame = lambda rows, columns: sizes.append(len(rows)) or (rows, columns)
    monkeypatch.setattr(common.pd, "DataFrame", frame)

    class Files:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            part = {"path": ["a", "b"], "content": ["x" * 10, "y" * 3]}
            return [r for rows, _ in run(iter([part])) for r in rows]

    parser = lambda text, path, strict: type("Image", (), {"rows": [path] * len(text)})
    assert common.parse_texts(Files(), parser) == ["a"] * 10 + ["b"] * 3 and sizes == [7, 3, 3]


def test_few_files_are_not_one_task(spark):
    """Twenty small files are parsed by several tasks: adaptive execution would join them, as it sees their bytes only."""
    df = spark.range(200).withColumn("ord", F.col("id"))
    files = source_queries.in_files(df, F.lit("x"), "", "", (F.col("id") % 20).cast("string"))
    assert files.select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_schematics_are_handed_on_one_at_a_time(monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 2)
    monkeypatch.setattr(tables, "schematic_rows", lambda text: [{"kind": c} for c in text])

    class Files:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return [len(f) for f in run(iter([{"path": ["a", "b"], "content": ["xyz", "z"]}]))]

    assert tables.schematics(Files()) == [2, 1, 1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_boxes_of_small_estimate_are_not_broadcast(spark):
    """A planner takes a table unfolded from one row for one row; the driver must not be sent all of it."""
    many = spark.range(1).selectExpr("explode(sequence(0, 29999)) as k").selectExpr("cast(k as string) as id", "'a' as layer", "k % 200 as x0", "k % 200 + 0.5 as x1", "k div 200 as y0", "k div 200 + 0.5 as y1")
    assert "BroadcastHashJoin" not in plan(spatial.box_join(many, many, 1.0))
    assert "BroadcastHashJoin" in plan(spatial.box_join(many, many.where("x0 < 10 and y0 < 10"), 1.0))


def test_boxes_round_whole_numbers_fill_one_cell(spark):
    boxes = spark.range(100).selectExpr("cast(id as string) as id", "'a' as layer", "id - 0.4 as x0", "id + 0.4 as x1", "-0.4 as y0", "0.4 as y1")
    assert spatial.with_cells(boxes, 1.0).count() == 100
    assert "meet" not in plan(spatial.box_join(boxes, boxes, 1.0, wide=True))


def test_leaves_leave_the_graph_before_it_is_solved(spark):
    """A chain of 50 pads with 20 tracks between each two: only links of pads are left, and the names are those of plain search."""
    edges = [(f"P{k + 100 + d}", f"T{k}-{j}") for k in range(49) for j in range(20) for d in (0, 1)] + [("Q1", "Q2")]
    df = spark.createDataFrame(edges, "u string, v string")
    cut_ = graph.cut(df.distinct(), "edges", "lz4", free=False)
    left, leads = graph._contracted(cut_, 0, 1000)
    assert left.count() <= 49 and len(leads) >= 1
    got = {r["node"]: r["component"] for r in graph.components(df, at_once=0).collect()}
    assert got == {n: "Q1" if n[0] == "Q" else "P100" for e in edges for n in e}
    assert graph.components(df, at_once=10_000).count() == len(got)


def test_exact_gap_is_worked_out_once(spark):
    """A planner that copies the gap of two tracks into filters makes a method too long for Java to compile; four ends are four distances."""
    row = lambda k: (f"T{k}", 0.0, float(k), 5.0, float(k), 0.9, "0", None)
    tracks = spark.createDataFrame([row(k) for k in range(4)], "id string, x1 double, y1 double, x2 double, y2 double, width double, layer string, net_id string")
    out = rules.track_clearance(tracks, rules.DrcLimits())
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("hypot") == 4
    assert sorted((r.l_id, r.r_id, round(r.gap, 6), r.state) for r in out.collect()) == [(f"T{k}", f"T{k + 1}", 0.1, "unresolved") for k in range(3)]


def test_long_methods_are_split(spark):
    """Where the session says nothing else, Spark generates no method that Java only interprets."""
    storage.reach_workers(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_degrees_bring_an_edge_together_once(spark):
    """Edges in both directions are two rows of each; the pair in order is one, and its ends are counted."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("a", "c"), ("c", "c"), ("d", None), (None, "a")], "u string, v string")
    out = graph.degrees(edges)
    assert {tuple(r) for r in out.collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_neighbourhood_hashes_of_alike_neighbours(spark, monkeypatch):
    """Neighbours of one label reach a node as one row with their number, so that a hub's list is short; hashes are as of the whole list."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    label = {"hub": "net"} | {f"p{k}": "odd" if k % 2 else "even" for k in range(9)}
    edges = [("hub", f"p{k}") for k in range(9)]
    hashes = {n: digest(x) for n, x in label.items()}
    near = {n: {v for u, v in edges if u == n} | {u for u, v in edges if v == n} for n in label}
    for _ in range(2):
        hashes = {n: digest(h + "|" + ",".join(sorted(hashes[o] for o in near[n]))) for n, h in hashes.items()}
    nodes = spark.createDataFrame([*label.items(), ("alone", "net")], "node string, label string")
    plans, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name, *a, **k: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name, *a, **k))
    out = graph.neighbourhood_hash(nodes, spark.createDataFrame(edges, "u string, v string"), 2)
    assert all("count(1)" in plan for name, plan in [p for p in plans if p[0] == "labels"][-2:])
    assert dict(map(tuple, out.collect())) == hashes | {"alone": digest(digest(digest("net") + "|") + "|")}


def test_fingerprint_tree_covers_every_row(spark, tmp_path, monkeypatch):
    """In ranges of two, nine rows make four levels; query and SQL go on to one digest of all."""
    spark.range(9).selectExpr("id + 1 as l_orderkey", "cast(1 as int) as l_linenumber", "'A' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    real = reconcile.table_fingerprint
    monkeypatch.setattr(reconcile, "table_fingerprint", lambda df, row, order, **other: real(df, row, order, leaf=2, **other))
    level = [f"{k + 1}|1|A" for k in range(9)]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[k : k + 2]).encode()).hexdigest() for k in range(0, len(level), 2)]
    assert QUERIES["fingerprint_tree"](spark, str(tmp_path)).first()[0] == level[0]
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert con.sql(SQL["fingerprint_tree"].replace("4096", "2").replace("4095", "1")).fetchall() == [(level[0],)]


def test_small_files_share_tables_and_are_dealt_out(spark, tmp_path):
    """Objects of many small files are made tables together, and files that come in one split go to many tasks."""
    one = dict.fromkeys(common.COLUMNS)
    assert [len(t) for t in common.in_tables((one for _ in range(common.ROWS + 5)), common.COLUMNS)] == [common.ROWS, 5]
    parts(spark, spark.range(40)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("gerber_constructs", "permissive_failures"):
        assert "RepartitionByExpression [p_partkey" in QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_functional_blocks_have_kinds_roles_and_several_nets(spark, compare):
    """Blocks of one net and of several, with and without roles, of every kind."""
    orders = spark.range(1, 3_000).selectExpr("id as o_orderkey", "id * 7919 % 700 as o_custkey")
    got = compare("functional_blocks", orders=orders)  # columns in order of names: components, confidence, kind, n, nets
    assert {r[2] for r in got} == {"interface", "power", "memory", "sensor", "clocking", "compute", "unknown"}
    assert {r[1] for r in got} == {"0.55", "0.65", "0.7", "0.8"} and len({r[4] for r in got}) == 3
