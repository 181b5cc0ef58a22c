"""Quality and risk of pairs, return paths, vias, decoupling, assembly and fit: scores, findings and levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import graph, spatial

# Kinds that need a polarity mark; what findings cost; how findings weigh as risks; design-rule profiles.
POLAR_KINDS = ("diode", "led", "electrolytic_capacitor", "tantalum_capacitor", "ic")
PENALTY = {"info": 0.01, "warning": 0.05, "error": 0.15, "critical": 0.3}
SEVERITY_RISK = {"info": 0.1, "warning": 0.35, "error": 0.7, "critical": 1.0}
RULE_PROFILES = {
    "generic": {"min_track_mm": 0.15, "min_clearance_mm": 0.15, "min_drill_mm": 0.2, "min_annular_mm": 0.1, "min_mask_sliver_mm": 0.1},
    "conservative": {"min_track_mm": 0.2, "min_clearance_mm": 0.2, "min_drill_mm": 0.25, "min_annular_mm": 0.125, "min_mask_sliver_mm": 0.125},
}
FABRICATION_CODES = {"min_track_mm": "FAB_TRACK_TOO_SMALL", "min_clearance_mm": "FAB_CLEARANCE_TOO_SMALL", "min_drill_mm": "FAB_DRILL_TOO_SMALL", "min_annular_mm": "FAB_ANNULAR_TOO_SMALL"}


def falling(value: Column, limit: float) -> Column:
    """1 at 0, 0 from the limit on."""
    return F.round(F.greatest(F.lit(0.0), 1 - F.abs(value) / max(limit, 1e-9)), 6)


def looked_up(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, v in values.items():
        out = F.when(key == name, v).otherwise(out)
    return out


def pair_quality(skew: Column, spacing: Column, vias: Column) -> Column:
    symmetry = F.round(F.greatest(F.lit(0.0), 1 - F.least(F.abs(vias), F.lit(4)) / 4.0), 6)
    return F.round(0.45 * falling(skew, 0.5) + 0.35 * falling(spacing, 0.15) + 0.2 * symmetry, 6)


def pair_notes(skew: Column, spacing: Column, vias: Column) -> Column:
    return F.array_compact(F.array(F.when(F.abs(skew) > 0.5, "high_skew"), F.when(F.abs(spacing) > 0.15, "spacing_variation"), F.when(vias != 0, "via_mismatch")))


def return_via_penalty(signal: Column, returns: Column) -> Column:
    return F.when(signal > 0, F.round(1 - F.least(signal, returns) / signal, 6)).otherwise(0.0)


def return_path_risk(continuity: Column, penalty: Column, crossings: Column) -> Column:
    risk = (1 - continuity) * 0.5 + penalty * 0.25 + F.least(F.lit(1.0), crossings * 0.25)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk)), 6)


def via_quality(pad: Column, drill: Column, return_vias: Column, stubs: Column, layers: Column, least_ring: float = 0.1) -> Column:
    ring = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (pad - drill) / 2) / max(least_ring, 1e-9))
    support = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0), return_vias) / 2.0), 6)
    stub = F.when(layers > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0), stubs) / layers), 6)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.45 * ring + 0.35 * support + 0.2 * (1 - stub))), 6)


def decoupling_score(distance: Column, capacitance: Column) -> Column:
    """(score, confidence): nearer and larger is better; what is unknown adds nothing to either."""
    zero = F.lit(0.0)
    near = F.when(distance.isNotNull(), 0.35 * F.greatest(zero, 1 - F.least(F.greatest(zero, distance) / 10, F.lit(1.0)))).otherwise(0.0)
    large = F.when(capacitance.isNotNull(), 0.25 * F.least(F.lit(1.0), F.greatest(zero, capacitance) / 1e-6)).otherwise(0.0)
    known = lambda c: F.when(c.isNotNull(), 0.25).otherwise(0.0)
    return F.struct(F.round(F.least(0.4 + near + large, F.lit(1.0)), 6).alias("score"), F.round(F.least(0.4 + known(distance) + known(capacitance), F.lit(1.0)), 6).alias("confidence"))


def impedance_check(estimate: Column, target: Column, tolerance: Column) -> Column:
    """(error_ohms, passed, level); all unknown without an estimate."""
    error = F.abs(estimate - target)
    passed = error <= tolerance
    level = F.when(passed.isNull(), "unknown").when(passed, "low").when(error > 30, "high").otherwise("medium")
    return F.struct(error.alias("error_ohms"), passed.alias("passed"), level.alias("level"))


def fabrication_findings(metrics: DataFrame, profile: str = "generic") -> DataFrame:
    """metrics with codes of the limits of the profile that they break; an unknown metric breaks none."""
    rules = RULE_PROFILES[profile]
    tests = [F.when(F.col(m) < rules[m], code) for m, code in FABRICATION_CODES.items() if m in metrics.columns]
    return metrics.withColumn("codes", F.array_compact(F.array(*tests)))


def resolved_rules(nets: DataFrame, overrides: DataFrame, profile: str = "generic") -> DataFrame:
    """(net_id, rules...) of a profile, with the overrides (net_id, name, value) of single nets; of repeated overrides the largest."""
    names = list(RULE_PROFILES[profile])
    own = overrides.groupBy("net_id").pivot("name", names).agg(F.max("value"))
    out = nets.select("net_id").distinct().join(own, "net_id", "left")
    return out.select("net_id", *[F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in RULE_PROFILES[profile].items()])


def assembly_findings(parts: DataFrame, marked: DataFrame, bounds: tuple[float, float, float, float], least_edge: float = 0.5) -> DataFrame:
    """(reference, code): parts (reference, kind, x, y) too near the edge, or polar without a mark (column reference)."""
    x0, y0, x1, y1 = bounds
    edge = F.least(F.col("x") - x0, F.lit(x1) - F.col("x"), F.col("y") - y0, F.lit(y1) - F.col("y"))
    polar = parts.where(F.lower("kind").isin(*POLAR_KINDS)).join(marked.select("reference").distinct(), "reference", "left_anti")
    return parts.where(edge < least_edge).select("reference", F.lit("COMPONENT_EDGE_CLEARANCE").alias("code")).unionByName(polar.select("reference", F.lit("POLARITY_MARK_MISSING").alias("code")))


def penalty_score(findings: DataFrame) -> DataFrame:
    """One row: 1 less what the findings (severity) cost, at least 0."""
    return findings.agg(F.coalesce(F.sum(looked_up(F.col("severity"), PENALTY, 0.05)), F.lit(0.0)).alias("p")).select(F.round(F.greatest(F.lit(0.0), 1 - F.col("p")), 6).alias("score"))


def manufacturing_risk(findings: DataFrame) -> DataFrame:
    """One row (score, level): the mean risk of findings (severity)."""
    risk = findings.agg(F.avg(looked_up(F.col("severity"), SEVERITY_RISK, 0.35)).alias("r")).select(F.round(F.coalesce("r", F.lit(0.0)), 6).alias("score"))
    s = F.col("score")
    return risk.withColumn("level", F.when(s >= 0.7, "high").when(s >= 0.35, "medium").when(s > 0, "low").otherwise("none"))


def edge_margins(board: tuple[Column, ...], around: tuple[Column, ...]) -> Column:
    """(fits, least, notes) of a box inside another."""
    least = F.least(board[0] - around[0], board[1] - around[1], around[2] - board[2], around[3] - board[3])
    notes = F.array_compact(F.array(F.when(least < 0, "board_exceeds_enclosure"), F.when((least >= 0) & (least < 0.5), "tight_clearance")))
    return F.struct((least >= 0).alias("fits"), F.round(least, 6).alias("least"), notes.alias("notes"))


def match_holes(holes: DataFrame, targets: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """(hole, target, distance): each hole (id, ord, x, y), in order, takes the nearest free target (id, ord, x, y).

    Only holes that share candidates depend on each other, so each connected group is matched in a task of
    its own.
    """
    pairs = spatial.radius_join(holes.select("id", "ord", "x", "y"), targets.select("id", "ord", "x", "y"), tolerance)
    pairs = pairs.select("l_id", "l_ord", "r_id", "r_ord", "distance")
    edges = pairs.select(F.concat(F.lit("h"), F.col("l_id").cast("string")).alias("u"), F.concat(F.lit("t"), F.col("r_id").cast("string")).alias("v"))
    label = graph.components(edges)
    grouped = pairs.join(label, F.concat(F.lit("h"), F.col("l_id").cast("string")) == label["node"])
    kind, other = dict(holes.dtypes)["id"], dict(targets.dtypes)["id"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for hole, own in part.sort_values(["l_ord", "distance", "r_ord"]).groupby("l_id", sort=False):
            free = own[~own["r_id"].isin(taken)]
            if len(free):
                best = free.iloc[0]
                taken.add(best["r_id"])
                out.append((hole, best["r_id"], round(float(best["distance"]), 6)))
        return pd.DataFrame(out, columns=["hole", "target", "distance"])

    return grouped.groupBy("component").applyInPandas(run, f"hole {kind}, target {other}, distance double")
