"""Queries over scalar functions: labels, values, engineering, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import engineering, geometry, text
from tracewright.plans.derived import sql, table
from tracewright.plans.registry import register


@register("label_roles", sql("labels_of_nets", "SELECT net_id, CASE WHEN contains(label, 'GND') THEN 'ground' WHEN contains(label, '+5V') THEN 'power' WHEN regexp_matches(label, 'TX|MOSI|SDA|D\\+|CANH') THEN 'signal_out_or_bidir' WHEN regexp_matches(label, 'RX|MISO|SCL|D-|CANL') THEN 'signal_in_or_bidir' ELSE 'signal' END AS role, contains(label, 'NRST') AS reset, CASE WHEN regexp_matches(label, '^DQ[0-9]+$') THEN 'data' END AS ddr FROM labels_of_nets"))
def label_roles(spark, d):
    label = F.col("label")
    return table(spark, d, "labels_of_nets").select("net_id", text.pin_role(label)["role"].alias("role"), F.coalesce(text.reset_label(label)["active_low"], F.lit(False)).alias("reset"), text.ddr_role(label).alias("ddr"))


@register("silkscreen_tokens", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'reference_resistor' WHEN p_partkey % 5 = 1 THEN 'reference_capacitor' WHEN p_partkey % 5 = 2 THEN 'reference_ic' WHEN p_partkey % 5 = 3 THEN 'net_label_candidate' ELSE 'unknown' END AS token FROM part")
def silkscreen_tokens(spark, d):
    k = F.col("p_partkey")
    n = k.cast("string")
    token = F.when(k % 5 == 0, F.concat(F.lit(" r"), n)).when(k % 5 == 1, F.concat(F.lit("C"), n)).when(k % 5 == 2, F.concat(F.lit("ic"), n)).when(k % 5 == 3, "3v3 ").otherwise(F.concat(F.lit("X"), n))
    return table(spark, d, "part").select("p_partkey", text.silk_token(token).alias("token"))


@register("voltage_parse", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING)) WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN concat('-', CAST(p_size AS STRING)) END AS DOUBLE) AS volts FROM part")
def voltage_parse(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    label = F.when(k % 4 == 0, F.concat(F.lit("RAIL "), n, F.lit("v"), (k % 10).cast("string"))).when(k % 4 == 1, F.concat(F.lit("+"), n, F.lit("V"))).when(k % 4 == 2, F.concat(F.lit("-"), n, F.lit("V"))).otherwise("none")
    return table(spark, d, "part").select("p_partkey", text.voltage(label).alias("volts"))


@register("value_codecs", "SELECT p_partkey, p_size * 1e3 AS ohms, p_size + 0.5e0 AS r_ohms, round((10 + p_size) * pow(10, p_partkey % 4), 3) AS marking, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1e6 END AS hertz FROM part")
def value_codecs(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        "p_partkey", text.resistance(F.concat(n, F.lit(" kΩ"))).alias("ohms"), text.resistance_r(F.concat(n, F.lit("R5"))).alias("r_ohms"),
        F.round(text.resistor_marking(F.concat((F.col("p_size") + 10).cast("string"), (k % 4).cast("string"))), 3).alias("marking"), text.frequency(F.when(k % 2 == 0, F.concat(n, F.lit(" MHz")))).alias("hertz"),
    )


@register("reference_parts", "SELECT p_partkey, 'R' AS prefix, CAST(p_partkey AS BIGINT) AS number, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE '' END AS suffix FROM part WHERE p_partkey % 3 <> 0")
def reference_parts(spark, d):
    k = F.col("p_partkey")
    ref = F.concat(F.when(k % 3 == 0, "?").otherwise(" r "), k.cast("string"), F.when(F.col("p_size") % 2 == 0, "a").otherwise(""))
    out = table(spark, d, "part").select("p_partkey", text.reference_parts(ref).alias("p")).where("p is not null")
    return out.select("p_partkey", "p.prefix", "p.number", "p.suffix")


@register("stable_ids", "SELECT n_nationkey, concat('net_', substr(sha1(concat(n_name, '|', CAST(n_regionkey AS STRING))), 1, 12)) AS id FROM nation")
def stable_ids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.stable_id("net", F.col("n_name"), F.col("n_regionkey").cast("string")).alias("id"))


@register("microstrip", "WITH t AS (SELECT p_partkey, 1e-1 * (1 + p_size % 20) + 0.035 AS w, 2e-1 * (1 + p_partkey % 8) AS h, 4.2e0 AS e FROM part), u AS (SELECT p_partkey, w / h AS r, (e + 1) / 2 + (e - 1) / 2 / sqrt(1 + 12 / (w / h)) AS ee FROM t) SELECT p_partkey, round(CASE WHEN r <= 1 THEN 60 / sqrt(ee) * ln(8 / r + 0.25 * r) ELSE 120 * pi() / (sqrt(ee) * (r + 1.393 + 0.667 * ln(r + 1.444))) END, 6) AS ohms FROM u")
def microstrip(spark, d):
    out = engineering.microstrip(1e-1 * (1 + F.col("p_size") % 20), 2e-1 * (1 + F.col("p_partkey") % 8), F.lit(4.2))
    return table(spark, d, "part").select("p_partkey", F.round(out, 6).alias("ohms"))


@register("trace_limits", "SELECT p_partkey, round((CASE WHEN p_partkey % 2 = 0 THEN 0.048 ELSE 0.024 END) * pow(10, 0.44) * pow(1e-1 * p_size * 35 * 1e-3 * 1550.0031, 0.725), 6) AS amperes, round(1.724e-8 * (p_retailprice * 1e-3) / ((1e-1 * p_size * 1e-3) * 35e-6), 6) AS ohms, round(2 / (1e-1 * p_size * 0.035), 6) AS density FROM part")
def trace_limits(spark, d):
    w = 1e-1 * F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", engineering.trace_current(w, F.lit(35.0), F.lit(10.0), F.col("p_partkey") % 2 == 0).alias("amperes"),
        F.round(engineering.copper_resistance(F.col("p_retailprice"), w), 6).alias("ohms"), F.round(engineering.current_density(F.lit(2.0), w), 6).alias("density"),
    )


@register("si_risk", "WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(0.3 * least(1, l_discount * 9) + 0.15 * least(1, l_linenumber / 8) + 0.2 * least(1, l_tax * 10) + 0.25 * (l_quantity / 50), 6) AS score FROM lineitem) SELECT CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level, count(*) AS n, round(sum(score), 1) AS total FROM s GROUP BY 1")
def si_risk(spark, d):
    factors = {"return_path": F.col("l_discount") * 9, "via": F.col("l_linenumber") / 8, "skew": F.col("l_tax") * 10, "impedance": F.col("l_quantity") / 50}
    out = table(spark, d, "lineitem").select(engineering.si_score(factors).alias("score"))
    return out.groupBy(engineering.si_level(F.col("score")).alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 1).alias("total"))


@register("thermal_risk", "SELECT p_partkey, round(least(1e0, CASE WHEN p IS NULL THEN 0 ELSE least(0.55, p / 5 * 0.55) END + 0.25 * (1 - least(p_size / 100, 1)) + 0.15 * (1 - least(p_partkey % 8 / 6, 1))), 6) AS risk, CASE WHEN p IS NULL THEN 0.4e0 ELSE 0.75e0 END AS confidence FROM (SELECT *, CASE WHEN p_partkey % 4 > 0 THEN p_size / 10 END AS p FROM part)")
def thermal_risk(spark, d):
    r = engineering.thermal(F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") / 10), F.col("p_size").cast("double"), F.col("p_partkey") % 8, F.lit(None).cast("double"))
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.risk", "r.confidence")


@register("fabrication_yield", "SELECT p_partkey, round(least(1e0, CASE WHEN 1e-2 * p_size < 0.15 THEN 0.25 ELSE 0 END + CASE WHEN 1e-2 * (p_partkey % 30) < 0.15 THEN 0.3 ELSE 0 END + CASE WHEN p_size % 9 > 0 THEN least(0.15, p_size % 9 * 0.02) ELSE 0 END), 6) AS score FROM part")
def fabrication_yield(spark, d):
    s = engineering.yield_score(1e-2 * F.col("p_size"), 1e-2 * (F.col("p_partkey") % 30), F.lit(None).cast("double"), F.col("p_size") % 9, F.lit(None).cast("double"))
    return table(spark, d, "part").select("p_partkey", s.alias("score"))


@register("segment_distances", sql("tracks drills", "SELECT t.id AS track, d.id AS drill, round(sqrt(pow(greatest(t.x1 - d.x, 0, d.x - t.x2), 2) + pow(d.y - t.y1, 2)), 6) AS distance FROM tracks t JOIN drills d ON abs(d.y - t.y1) <= 1 AND d.x BETWEEN t.x1 - 1 AND t.x2 + 1"))
def segment_distances(spark, d):
    from tracewright.operators import spatial

    boxes = table(spark, d, "tracks").withColumns({"x0": F.col("x1"), "y0": F.col("y1"), "bx1": F.col("x2"), "by1": F.col("y2"), "sx": F.col("x1")})
    boxes = boxes.select("id", "sx", "x0", "y0", F.col("bx1").alias("x1"), F.col("by1").alias("y1"))
    pairs = spatial.box_join(boxes, spatial.point_boxes(table(spark, d, "drills")), 2.0, 1.0, keys=())
    gap = geometry.point_segment(F.col("r_x"), F.col("r_y"), F.col("l_x0"), F.col("l_y0"), F.col("l_x1"), F.col("l_y1"))
    return pairs.select(F.col("l_id").alias("track"), F.col("r_id").alias("drill"), F.round(gap, 6).alias("distance"))


@register("polygon_measures", "SELECT n_nationkey, CAST((n_nationkey + 1) * 2 AS DOUBLE) AS area, n_nationkey + 1 > 5 AS holds FROM nation")
def polygon_measures(spark, d):
    w = (F.col("n_nationkey") + 1).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), point(w, F.lit(0.0)), point(w, F.lit(2.0)), point(F.lit(0.0), F.lit(2.0)))
    return table(spark, d, "nation").select("n_nationkey", geometry.signed_area(ring).alias("area"), geometry.in_ring(F.lit(5.0), F.lit(1.0), ring).alias("holds"))


@register("angles_and_arcs", "SELECT n_nationkey, CAST(least((n_nationkey * 50) % 360, 360 - (n_nationkey * 50) % 360) AS DOUBLE) AS gap FROM nation")
def angles_and_arcs(spark, d):
    return table(spark, d, "nation").select("n_nationkey", geometry.angle_gap((F.col("n_nationkey") * 50).cast("double"), F.lit(0.0)).alias("gap"))
