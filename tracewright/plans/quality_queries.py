"""Queries over quality scores, fit, supplies, access, blocks, roles and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import geometry
from tracewright.operators import architecture, hypotheses, packages, quality
from tracewright.plans.derived import sql, table
from tracewright.plans.registry import register


def part(spark, d):
    return table(spark, d, "part")


def col(name="p_partkey"):
    return F.col(name)


@register("pair_quality", "SELECT p_partkey, round(0.45e0 * greatest(0, 1 - (p_size % 10) / 10e0 / 0.5) + 0.35e0 * greatest(0, 1 - (p_partkey % 4) / 20e0 / 0.15) + 0.2e0 * greatest(0, 1 - least(p_partkey % 6, 4) / 4e0), 4) AS score, CAST(CASE WHEN p_size % 10 > 5 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 4 > 3 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 6 > 0 THEN 1 ELSE 0 END AS INTEGER) AS notes FROM part")
def pair_quality(spark, d):
    args = ((col("p_size") % 10) / 10, (col() % 4) / 20, col() % 6)
    return part(spark, d).select("p_partkey", F.round(quality.pair_quality(*args), 4).alias("score"), F.size(quality.pair_notes(*args)).alias("notes"))


@register("return_path_risk", "SELECT p_partkey, round(least(1, (1 - (p_size % 5) / 4e0) * 0.5e0 + CASE WHEN p_partkey % 4 > 0 THEN 1 - least(p_partkey % 4, p_size % 3) / CAST(p_partkey % 4 AS DOUBLE) ELSE 0 END * 0.25e0 + least(1, (p_partkey % 3) * 0.25e0)), 5) AS risk FROM part")
def return_path_risk(spark, d):
    penalty = quality.return_via_penalty(col() % 4, col("p_size") % 3)
    return part(spark, d).select("p_partkey", F.round(quality.return_path_risk((col("p_size") % 5) / 4, penalty, col() % 3), 5).alias("risk"))


@register("via_quality", "SELECT p_partkey, round(0.45e0 * least(1, greatest(0, (p_size % 8 - p_size % 6) / 20e0) / 0.1) + 0.35e0 * least(1, (p_partkey % 4) / 2e0) + 0.2e0 * (1 - (p_partkey % 3) / 4e0), 5) AS score FROM part")
def via_quality(spark, d):
    out = quality.via_quality((col("p_size") % 8) / 10, (col("p_size") % 6) / 10, col() % 4, col() % 3, F.lit(4))
    return part(spark, d).select("p_partkey", F.round(out, 5).alias("score"))


@register("decoupling_quality", "SELECT p_partkey, round(0.4e0 + CASE WHEN p_partkey % 3 > 0 THEN 0.35e0 * (1 - least(p_size / 10e0, 1)) ELSE 0 END + 0.25e0 * least(1, (p_partkey % 5) / 4e0), 6) AS score, CASE WHEN p_partkey % 3 > 0 THEN 0.9e0 ELSE 0.65e0 END AS confidence FROM part")
def decoupling_quality(spark, d):
    out = quality.decoupling_score(F.when(col() % 3 > 0, col("p_size").cast("double")), (col() % 5) / 4 * 1e-6)
    return part(spark, d).select("p_partkey", out.alias("q")).select("p_partkey", "q.score", "q.confidence")


@register("impedance_checks", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN abs(p_size - 25) <= 10 THEN 'low' WHEN abs(p_size - 25) > 30 THEN 'high' ELSE 'medium' END AS level FROM part")
def impedance_checks(spark, d):
    out = quality.impedance_check(F.when(col() % 7 != 0, col("p_size") + 25), F.lit(50.0), F.lit(10.0))
    return part(spark, d).select("p_partkey", out["level"].alias("level"))


@register("fabrication_findings", "SELECT p_partkey, CAST(CASE WHEN p_size < 15 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 30 < 20 THEN 1 ELSE 0 END AS INTEGER) AS n FROM part")
def fabrication_findings(spark, d):
    metrics = part(spark, d).select("p_partkey", (col("p_size") / 100).alias("min_track_mm"), ((col() % 30) / 100).alias("min_drill_mm"))
    return quality.fabrication_findings(metrics).select("p_partkey", F.size("codes").alias("n"))


@register("resolved_rules", sql("tracks", "SELECT DISTINCT net_id, CASE WHEN net_id IN ('N1', 'N2') THEN 0.4e0 ELSE 0.15e0 END AS min_track_mm, 0.2e0 AS min_drill_mm FROM tracks WHERE net_id IS NOT NULL"))
def resolved_rules(spark, d):
    overrides = spark.createDataFrame([("N1", "min_track_mm", 0.4), ("N2", "min_track_mm", 0.3), ("N2", "min_track_mm", 0.4)], "net_id string, name string, value double")
    return quality.resolved_rules(table(spark, d, "tracks").where("net_id is not null"), overrides).select("net_id", "min_track_mm", "min_drill_mm")


@register("assembly_findings", sql("pads", "SELECT id AS reference, 'COMPONENT_EDGE_CLEARANCE' AS code FROM pads WHERE least(x - 0, 49 - x, y - 0, 60 - y) < 0.5 UNION ALL SELECT id, 'POLARITY_MARK_MISSING' FROM pads WHERE layer = '1' AND net_id <> 'Brand#12'"))
def assembly_findings(spark, d):
    pads = table(spark, d, "pads")
    parts = pads.select(F.col("id").alias("reference"), F.when(F.col("layer") == "1", "LED").otherwise("resistor").alias("kind"), "x", "y")
    return quality.assembly_findings(parts, pads.where("net_id = 'Brand#12'").select(F.col("id").alias("reference")), (0.0, 0.0, 49.0, 60.0))


@register("manufacturing_risk", "WITH s AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM lineitem) SELECT round(avg(CASE severity WHEN 'error' THEN 0.7e0 WHEN 'warning' THEN 0.35e0 ELSE 0.1e0 END), 6) AS score, CASE WHEN avg(CASE severity WHEN 'error' THEN 0.7e0 WHEN 'warning' THEN 0.35e0 ELSE 0.1e0 END) >= 0.35 THEN 'medium' ELSE 'low' END AS level FROM s")
def manufacturing_risk(spark, d):
    n = F.col("l_linenumber") % 3
    return quality.manufacturing_risk(table(spark, d, "lineitem").select(F.when(n == 0, "error").when(n == 1, "warning").otherwise("info").alias("severity")))


@register("mounting_holes")
def mounting_holes(spark, d):
    pads = table(spark, d, "pads").withColumn("ord", F.col("id"))
    drills = table(spark, d, "drills").withColumn("ord", F.col("id"))
    return quality.match_holes(drills.select("id", "ord", "x", "y"), pads.select("id", "ord", "x", "y"))


@register("regulators", "SELECT concat('U', CAST(s_suppkey AS STRING)) AS component_id, CASE s_suppkey % 3 WHEN 0 THEN 'ldo' ELSE 'buck' END AS kind, round(0.55e0 + 0.08 + 0.12 + 0.04, 6) AS confidence FROM supplier WHERE s_suppkey % 3 < 2")
def regulators(spark, d):
    k = F.col("s_suppkey")
    base = table(spark, d, "supplier").withColumn("c", F.concat(F.lit("U"), k.cast("string")))
    components = base.select(F.col("c").alias("id"), F.when(k % 3 == 2, "resistor").otherwise("ic").alias("kind"), F.when(k % 3 == 0, "LDO 3V3").when(k % 3 == 1, "buck conv").otherwise("10k").alias("value"))
    pins = base.select(F.col("c").alias("component_id"), F.explode(F.array(F.lit("vin"), F.lit("V OUT"), F.lit("NC"))).alias("pin_name"), F.lit("N").alias("net_id"))
    return architecture.regulators(components, pins).select("component_id", "kind", "confidence")


@register("supply_domains", sql("pin_edges power", "SELECT p.net_id, count(DISTINCT component_id) AS components, CAST(substr(p.net_id, 2) AS DOUBLE) AS voltage FROM power p LEFT JOIN pin_edges e ON e.net_id = p.net_id GROUP BY p.net_id"))
def supply_domains(spark, d):
    return architecture.supply_domains(table(spark, d, "power"), table(spark, d, "pin_edges")).select("net_id", "components", "voltage")


@register("shared_supplies", sql("pin_edges power", "SELECT component_id, count(DISTINCT net_id) AS domains FROM pin_edges WHERE net_id IN (SELECT net_id FROM power) GROUP BY 1 HAVING count(DISTINCT net_id) > 1"))
def shared_supplies(spark, d):
    return architecture.shared_components(table(spark, d, "power"), table(spark, d, "pin_edges"))


@register("reset_nets", sql("labels_of_nets", "SELECT net_id, true AS active_low, round(CASE WHEN fanout >= 5 THEN 0.95e0 WHEN fanout >= 2 THEN 0.88e0 ELSE 0.8e0 END, 6) AS confidence FROM labels_of_nets WHERE contains(label, 'NRST')"))
def reset_nets(spark, d):
    return architecture.reset_nets(table(spark, d, "labels_of_nets")).select("net_id", "active_low", F.round("confidence", 6).alias("confidence"))


@register("test_access", sql("pads", "SELECT id, round(0.75e0 + CASE WHEN net_id IS NOT NULL THEN 0.15 ELSE 0 END, 6) AS score FROM pads WHERE layer = '0' AND size_x >= 0.6 AND size_x < 1.0"))
def test_access(spark, d):
    objects = table(spark, d, "pads").select("id", "net_id", F.col("size_x").alias("diameter"), (F.col("layer") == "0").alias("exposed")).where("diameter < 1.0")
    return architecture.test_points(objects).select("id", F.round("score", 6).alias("score"))


@register("untested_nets", sql("pin_edges power", "SELECT DISTINCT net_id FROM pin_edges WHERE net_id NOT IN (SELECT net_id FROM power)"))
def untested_nets(spark, d):
    return architecture.untested_nets(table(spark, d, "pin_edges"), table(spark, d, "power"))


@register("priority_nets", sql("labels_of_nets", "SELECT net_id FROM labels_of_nets WHERE regexp_matches(label, 'GND|VCC|VDD|RESET|CLK|SCL|SDA|TX|RX')"))
def priority_nets(spark, d):
    return architecture.priority_nets(table(spark, d, "labels_of_nets"))


BLOCK_KINDS = (("connector", 97), ("regulator", 89), ("memory", 83), ("sensor", 79), ("clock", 73), ("mcu", 71))


@register("functional_blocks", f"""
WITH o AS (SELECT DISTINCT o_orderkey AS k, o_custkey AS c, CASE {' '.join(f"WHEN o_orderkey % {m} = 0 THEN '{kind}'" for kind, m in BLOCK_KINDS)} ELSE 'resistor' END AS kind FROM orders),
n AS (SELECT c, count(*) AS components, bool_or(k % 8 = 0) AS linked, list(DISTINCT kind) AS kinds FROM o GROUP BY 1),
b AS (SELECT sum(components) AS components, count(*) + CASE WHEN bool_or(linked) THEN 1 ELSE 0 END AS nets, flatten(list(kinds)) AS kinds, bool_or(c % 7 < 2) AS power, bool_or(c % 7 < 3) AS told FROM n GROUP BY CASE WHEN linked THEN c // 5 END, CASE WHEN NOT linked THEN c END),
t AS (SELECT *, CASE WHEN list_contains(kinds, 'connector') THEN 'interface' WHEN power AND list_contains(kinds, 'regulator') THEN 'power' WHEN list_contains(kinds, 'memory') THEN 'memory' WHEN list_contains(kinds, 'sensor') THEN 'sensor' WHEN list_contains(kinds, 'clock') THEN 'clocking' WHEN list_contains(kinds, 'mcu') THEN 'compute' ELSE 'unknown' END AS kind FROM b)
SELECT CAST(components AS BIGINT) AS components, nets, kind, round(0.55e0 + CASE WHEN kind <> 'unknown' THEN 0.15e0 ELSE 0 END + CASE WHEN told THEN 0.1e0 ELSE 0 END, 6) AS confidence, count(*) AS n FROM t GROUP BY ALL""")
def functional_blocks(spark, d):
    """Orders on the nets of their customers, some also on a net that five customers share; three nets in seven have a role."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda letter, v: F.concat(F.lit(letter), v.cast("string"))
    kind = F.coalesce(*[F.when(k % m == 0, word) for word, m in BLOCK_KINDS], F.lit("resistor"))
    o = table(spark, d, "orders").select(k, c).distinct()
    pins = o.select(name("K", k).alias("component_id"), F.explode(F.array_compact(F.array(name("N", c), F.when(k % 8 == 0, name("G", F.floor(c / 5)))))).alias("net_id"))
    parts = o.select(name("K", k).alias("id"), kind.alias("kind")).distinct()
    roles = o.where(c % 7 < 3).select(name("N", c).alias("net_id"), F.element_at(F.array(*map(F.lit, ("power", "ground", "clock"))), (c % 7 + 1).cast("int")).alias("role")).distinct()
    return architecture.functional_blocks(pins, parts, roles).groupBy("components", "nets", "kind", "confidence").agg(F.count("*").alias("n"))


@register("neighbourhoods", sql("pin_edges", "e AS (SELECT * FROM pin_edges), m AS (SELECT a.component_id, count(DISTINCT b.component_id) AS neighbours FROM e a JOIN e b ON a.net_id = b.net_id AND a.component_id <> b.component_id GROUP BY 1) SELECT e.component_id, count(*) AS nets, coalesce(any_value(m.neighbours), 0) AS neighbours FROM e LEFT JOIN m ON m.component_id = e.component_id GROUP BY 1"))
def neighbourhoods(spark, d):
    return architecture.neighbourhoods(table(spark, d, "pin_edges"))


ROLES = "r AS (SELECT concat('N', CAST(l_partkey * 7 + l_linenumber AS STRING)) AS net_id, CASE l_suppkey % 4 WHEN 0 THEN 'power' WHEN 1 THEN 'ground' WHEN 2 THEN 'clock' ELSE 'protocol:i2c' END AS role FROM lineitem)"


def roles(spark, d):
    p = F.col("l_suppkey") % 4
    return table(spark, d, "lineitem").select(F.concat(F.lit("N"), (F.col("l_partkey") * 7 + F.col("l_linenumber")).cast("string")).alias("net_id"), F.when(p == 0, "power").when(p == 1, "ground").when(p == 2, "clock").otherwise("protocol:i2c").alias("role"))


@register("signal_roles", "WITH " + ROLES + " SELECT net_id, count(DISTINCT role) AS roles, round(least(1, 0.4e0 + 0.12 * count(DISTINCT role)), 6) AS confidence, bool_or(role = 'power') AND bool_or(role = 'ground') AS conflict FROM r GROUP BY net_id")
def signal_roles(spark, d):
    out = architecture.signal_roles(roles(spark, d))
    return out.select("net_id", F.size("roles").cast("bigint").alias("roles"), "confidence", (F.size("conflicts") > 0).alias("conflict"))


@register("constraint_synthesis", "WITH " + ROLES + ", p AS (SELECT net_id, CASE WHEN bool_or(role = 'ground') THEN 'ground' WHEN bool_or(role = 'power') THEN 'power' WHEN bool_or(role = 'clock') THEN 'clock' ELSE 'high_speed' END AS role FROM r GROUP BY 1) SELECT net_id, role, CASE role WHEN 'ground' THEN 0.25e0 WHEN 'power' THEN 0.3e0 ELSE 0.25e0 END AS min_width_mm FROM p")
def constraint_synthesis(spark, d):
    told = architecture.signal_roles(roles(spark, d)).select("net_id", "roles")
    return architecture.constraints(told, told.select("net_id", F.lit(0.25).alias("width"))).select("net_id", "role", "min_width_mm")


@register("traceability", "WITH l AS (SELECT l_orderkey AS claim_id, CASE l_linenumber % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'artifact' ELSE 'review' END AS kind FROM lineitem), c AS (SELECT claim_id, max(CAST(kind = 'source' AS INT)) AS s, max(CAST(kind = 'artifact' AS INT)) AS a, max(CAST(kind = 'review' AS INT)) AS r FROM l GROUP BY 1) SELECT count(*) AS claims, round(avg(s), 6) AS source_coverage, round(avg(a), 6) AS artifact_coverage, round(avg(r), 6) AS review_coverage FROM c")
def traceability(spark, d):
    n = F.col("l_linenumber") % 3
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.when(n == 0, "source").when(n == 1, "artifact").otherwise("review").alias("kind"))
    return architecture.traceability(links)


@register("netlist", sql("few_pins", "SELECT net_id, string_agg(component_id, ',' ORDER BY component_id) AS parts FROM few_pins GROUP BY 1"))
def netlist(spark, d):
    pins = table(spark, d, "few_pins").withColumn("pin_id", F.lit("1"))
    return architecture.netlist(pins).select("net_id", F.array_join(F.transform("connections", lambda c: c["component_id"]), ",").alias("parts"))


@register("stackup_order", "SELECT layer, CAST(place AS INTEGER) AS place, source FROM (VALUES ('F.Cu', 0, 'reconstructed_geometry'), ('In1.Cu', 1, 'reconstructed_geometry'), ('In2.Cu', 2, 'x2_file_function'), ('In10.Cu', 3, 'reconstructed_geometry'), ('B.Cu', 4, 'reconstructed_geometry'), ('Edge.Cuts', 5, 'reconstructed_geometry')) t(layer, place, source)")
def stackup_order(spark, d):
    names = F.array(*[F.lit(n) for n in ("B.Cu", "In10.Cu", "F.Cu", "Edge.Cuts", "In1.Cu")])
    seen = part(spark, d).select(F.lit("b").alias("board"), F.element_at(names, (col() % 5 + 1).cast("int")).alias("layer"))
    told = seen.limit(1).select("board", F.lit("In2.Cu").alias("layer"))
    return hypotheses.stackup(seen, told).select("layer", "place", "source")


@register("via_spans", sql("pads drills", "h AS (SELECT d.id, bool_or(p.layer = '0') AS f, bool_or(p.layer = '1') AS b FROM drills d JOIN pads p ON sqrt(pow(greatest(p.x - p.size_x / 2 - d.x, 0, d.x - p.x - p.size_x / 2), 2) + pow(greatest(p.y - p.size_y / 2 - d.y, 0, d.y - p.y - p.size_y / 2), 2)) <= 0.6 GROUP BY 1) SELECT d.id AS drill_id, CASE WHEN f THEN '0' WHEN b THEN '1' END AS from_layer, CASE WHEN b THEN '1' WHEN f THEN '0' END AS to_layer, CASE WHEN f AND b THEN 0.95e0 WHEN f OR b THEN 0.35e0 ELSE 0.1e0 END AS confidence FROM drills d LEFT JOIN h ON h.id = d.id"))
def via_spans(spark, d):
    drills = table(spark, d, "drills").select("id", "x", "y", F.lit("plated").alias("plating"), F.lit(None).cast("array<int>").alias("span"), F.lit(None).cast("string").alias("span_kind"))
    return hypotheses.via_spans(drills, table(spark, d, "pads"), ["0", "1"], 0.6).select("drill_id", "from_layer", "to_layer", "confidence")


@register("component_pairs")
def component_pairs(spark, d):
    return hypotheses.paired_components(table(spark, d, "pads"), 1.0).select("id", "kind", "confidence", "distance")


@register("named_components", sql("pads", "SELECT net_id AS reference, count(*) AS n FROM pads GROUP BY 1"))
def named_components(spark, d):
    pads = table(spark, d, "pads").select("id", F.array("net_id").alias("references"), F.array(F.lit("1")).alias("pins"))
    return hypotheses.named_components(pads).select("reference", F.size("pad_ids").cast("bigint").alias("n"))


@register("package_hints", "SELECT c_custkey AS component_id, CASE c_custkey % 6 WHEN 0 THEN 'TWO_PIN_THT' WHEN 1 THEN 'SOIC8_LIKE' WHEN 2 THEN 'SINGLE_ROW_THT' WHEN 3 THEN 'DUAL_ROW_SMD' END AS package_hint, CASE WHEN c_custkey % 6 IN (4, 5) THEN 'weak' ELSE 'accepted' END AS state FROM customer")
def package_hints(spark, d):
    """Two pins, two rows of four, a single row, two rows of six, pads here and there, and very many."""
    k = F.col("c_custkey")
    pin = lambda count, x, y, drill: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(x(i).cast("double").alias("x"), y(i).cast("double").alias("y"), F.lit(drill).cast("double").alias("drill")))
    zero = lambda i: i * 0
    shapes = [
        pin(2, lambda i: i * 5, zero, 0.8), pin(8, lambda i: i % 4 * 1.27, lambda i: F.floor(i / 4) * 6, None), pin(5, lambda i: i * 2.54, zero, 1.0),
        pin(12, lambda i: i % 6 * 0.8, lambda i: F.floor(i / 6) * 7, None), pin(7, lambda i: i * i * 1.3, lambda i: i % 3 * 2.7, None), pin(50, lambda i: i * 1.0, zero, 1.0),
    ]
    pads = table(spark, d, "customer").select(k.alias("component_id"), F.explode(F.when(k % 6 == 0, shapes[0]).when(k % 6 == 1, shapes[1]).when(k % 6 == 2, shapes[2]).when(k % 6 == 3, shapes[3]).when(k % 6 == 4, shapes[4]).otherwise(shapes[5])).alias("p"))
    turned = geometry.rotate(F.col("p.x"), F.col("p.y"), (F.col("component_id") % 360).cast("double"))
    out = packages.package_hints(pads.select("component_id", turned[0].alias("x"), turned[1].alias("y"), F.col("p.drill").alias("drill")))
    return out.select("component_id", "package_hint", "state")
