"""Rules that turn tables into issues; unification, gates, review queues, release decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry
from tracewright.operators import spatial
from tracewright.operators.connectivity import cell_size, track_boxes

COLUMNS = ["source", "severity", "code", "message", "object_ids"]


def issues(df: DataFrame, source: str, severity: str | Column, code: str, message: Column | str, *ids: str) -> DataFrame:
    word = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(F.lit(source).alias("source"), word(severity).alias("severity"), F.lit(code).alias("code"), word(message).alias("message"), F.array(*[F.col(i).cast("string") for i in ids]).alias("object_ids"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Registry:
    """Named rules over a dict of tables; a rule returns issues."""

    rules: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)

    def add(self, name: str, rule: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        if name in self.rules:
            raise ValueError(f"duplicate rule {name}")
        self.rules[name] = rule

    def run(self, tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
        return union(*[self.rules[n](tables) for n in (names or list(self.rules))])


def duplicate_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return issues(df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1"), "validation", "error", "DUPLICATE_OBJECT_ID", "object IDs must be globally unique", id_col)


def missing_members(members: DataFrame, objects: DataFrame) -> DataFrame:
    lost = members.join(objects.select(F.col("id").alias("member_id")), "member_id", "left_anti")
    return issues(lost, "validation", "error", "NET_MEMBER_MISSING", F.concat_ws(" ", "net_id", F.lit("references missing object"), "member_id"), "net_id", "member_id")


def shared_members(members: DataFrame) -> DataFrame:
    many = members.groupBy("member_id").agg(F.countDistinct("net_id").alias("n")).where("n > 1")
    return issues(many, "validation", "error", "OBJECT_IN_MULTIPLE_NETS", F.concat_ws(" ", "member_id", F.lit("appears in more than one physical net")), "member_id")


def back_references(objects: DataFrame, members: DataFrame) -> DataFrame:
    lost = objects.where("net_id is not null").join(members.select(F.col("member_id").alias("id"), "net_id"), ["id", "net_id"], "left_anti")
    return issues(lost, "validation", "error", "OBJECT_NET_BACKREF_MISMATCH", F.concat_ws(" ", "id", F.lit("has net_id but is not listed in that net")), "id")


def confidence_range(df: DataFrame, code: str, id_col: str = "id") -> DataFrame:
    return issues(df.where("not (confidence between 0 and 1)"), "validation", "error", code, F.concat(F.lit("invalid confidence for "), F.col(id_col).cast("string")), id_col)


def slots(df: DataFrame) -> DataFrame:
    flat = df.where("x1 = x2 and y1 = y2")
    odd = df.where("plating not in ('unknown', 'plated', 'non-plated', 'non_plated')")
    return union(
        issues(df.where("width <= 0"), "validation", "error", "SLOT_WIDTH_INVALID", "slot width must be positive", "id"),
        issues(flat, "validation", "warning", "SLOT_ZERO_LENGTH", "slot start and end are identical", "id"),
        issues(odd, "validation", "warning", "SLOT_PLATING_UNKNOWN_ENUM", F.concat(F.lit("unexpected slot plating value "), "plating"), "id"),
    )


def outline_ends(outline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Snapped end points that other than two segments meet."""
    snap = lambda c: F.bround(F.col(c) / tolerance) * tolerance
    ends = outline.select(snap("x1").alias("x"), snap("y1").alias("y")).unionByName(outline.select(snap("x2").alias("x"), snap("y2").alias("y")))
    return ends.groupBy("x", "y").agg(F.count("*").alias("degree")).where("degree <> 2")


def outline_gaps(outline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Neighbouring segments in order, the last meeting the first, whose ends are apart: ids and gap."""
    from pyspark.sql import Window

    # an outline is one ring of a few hundred segments; rows of one board are ordered together
    key = ["board"] if "board" in outline.columns else []
    w = Window.partitionBy(*key).orderBy("ord") if key else Window.partitionBy(F.lit(0)).orderBy("ord")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(every))
    out = outline.withColumns({"nx": nxt("x1"), "ny": nxt("y1"), "next_id": nxt("id")})
    return out.withColumn("gap", F.hypot(F.col("x2") - F.col("nx"), F.col("y2") - F.col("ny"))).where(F.col("gap") > tolerance).select("id", "next_id", "gap")


@dataclass(frozen=True)
class DrcLimits:
    track_width: float = 0.15
    clearance: float = 0.15
    annular_ring: float = 0.1
    drill: float = 0.2
    edge: float = 0.25

    def __post_init__(self):
        if any(not (v >= 0 and v < float("inf")) for v in self.__dict__.values()):
            raise ValueError("limits must be finite and not negative")


def track_width(tracks: DataFrame, limits: DrcLimits) -> DataFrame:
    return issues(tracks.where(F.col("width") < limits.track_width), "drc", "warning", "TRACK_WIDTH_MIN", F.format_string("track width %.4f mm", "width"), "id")


def drill_size(drills: DataFrame, limits: DrcLimits) -> DataFrame:
    return issues(drills.where(F.col("diameter") < limits.drill), "drc", "warning", "DRILL_MIN", F.format_string("drill %.4f mm", "diameter"), "id")


def annular(pads: DataFrame, limits: DrcLimits) -> DataFrame:
    ring = pads.withColumn("ring", geometry.annular_ring(F.col("size_x"), F.col("size_y"), F.col("drill")))
    return union(
        issues(ring.where("ring < 0"), "drc", "error", "ANNULAR_RING_BROKEN", "drill exceeds reconstructed pad copper", "id"),
        issues(ring.where((F.col("ring") >= 0) & (F.col("ring") < limits.annular_ring)), "drc", "warning", "ANNULAR_RING_MIN", F.format_string("annular ring %.4f mm", "ring"), "id"),
    )


def net_state(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "unresolved").when(a == b, "same").otherwise("different")


def track_clearance(tracks: DataFrame, limits: DrcLimits) -> DataFrame:
    """Pairs of tracks of different or unknown nets nearer than the clearance: l_id, r_id, gap, state."""
    t = tracks.withColumns({"sx1": F.col("x1"), "sy1": F.col("y1"), "sx2": F.col("x2"), "sy2": F.col("y2")})
    line = lambda p: tuple(F.col(f"{p}_{c}") for c in ("sx1", "sy1", "sx2", "sy2"))
    gap = geometry.capsule_gap(line("l"), F.col("l_width"), line("r"), F.col("r_width"))
    state = net_state(F.col("l_net_id"), F.col("r_net_id"))
    pairs = spatial.box_pairs(track_boxes(t), max(cell_size(0.0), limits.clearance), limits.clearance, condition=state != "same")
    return spatial.measured(pairs, "gap", gap, lambda g: g < limits.clearance).select("l_id", "r_id", "gap", state.alias("state"))


def keepout_hits(objects: DataFrame, keepouts: DataFrame, cell: float = 5.0) -> DataFrame:
    """(l_id, r_id) of object boxes that touch a keepout box."""
    return spatial.box_join(objects, keepouts, cell, 0.0, keys=(), wide=True).select("l_id", "r_id")


def dangling_nets(pin_edges: DataFrame) -> DataFrame:
    one = pin_edges.groupBy("net_id").agg(F.countDistinct("component_id").alias("n")).where("n < 2")
    return issues(one, "erc", "warning", "DANGLING_NET", "net reaches one component only", "net_id")


def unused_components(components: DataFrame, pin_edges: DataFrame) -> DataFrame:
    lost = components.join(pin_edges.select(F.col("component_id").alias("id")), "id", "left_anti")
    return issues(lost, "erc", "warning", "COMPONENT_UNCONNECTED", "component has no net", "id")


def high_fanout(pin_edges: DataFrame, most: int = 50) -> DataFrame:
    return issues(pin_edges.groupBy("net_id").agg(F.countDistinct("component_id").alias("n")).where(F.col("n") > most), "erc", "warning", "NET_HIGH_FANOUT", F.format_string("net reaches %d components", "n"), "net_id")


def unify(*parts: DataFrame) -> DataFrame:
    """All issues once: equal source, code and objects are one, of the first message in order."""
    return union(*parts).groupBy("source", "severity", "code", "object_ids").agg(F.min("message").alias("message")).select(*COLUMNS)


def severity_counts(found: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s + "s")
    return found.agg(count("critical"), count("error"), count("warning"), count("info"))


@dataclass(frozen=True)
class GateLimits:
    errors: int = 0
    warnings: int = 100
    provenance: float = 0.5
    completeness: float = 0.5
    regressions: int = 0


def gate(found: DataFrame, limits: GateLimits = GateLimits(), provenance: float | None = None, completeness: float | None = None, regressions: int = 0) -> DataFrame:
    """One row: passed, and the codes of what failed; too many warnings alone do not fail the gate."""
    n = severity_counts(found)
    tests = [(F.col("errors") > limits.errors, "GATE_ERROR_COUNT"), (F.col("warnings") > limits.warnings, "GATE_WARNING_COUNT"), (F.lit(regressions > limits.regressions), "GATE_REGRESSION_FAILURES")]
    if provenance is not None:
        tests.append((F.lit(provenance < limits.provenance), "GATE_PROVENANCE_LOW"))
    if completeness is not None:
        tests.append((F.lit(completeness < limits.completeness), "GATE_COMPLETENESS_LOW"))
    failed = F.array_compact(F.array(*[F.when(t, c) for t, c in tests]))
    hard = F.filter(failed, lambda c: c != "GATE_WARNING_COUNT")
    return n.select((F.size(hard) == 0).alias("passed"), failed.alias("failed"), "errors", "warnings")


def review_queue(*parts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Open items of (id, kind, object_id, confidence) below the threshold, least certain first by their place."""
    return union(*parts).where(F.col("confidence") < threshold).dropDuplicates(["id"]).withColumn("status", F.lit("open")).orderBy("confidence", "id")


def next_item(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'open'").orderBy(F.desc("priority"), "id").limit(1)


# Limits of each release profile (errors, warnings, provenance, completeness, regressions) and the facts that it asks for.
RELEASE_PROFILES = {
    "development": (GateLimits(10, 500, 0.0, 0.0, 10), ()),
    "research": (GateLimits(0, 250, 0.5, 0.5, 0), ("tests_passed", "deterministic")),
    "review": (GateLimits(0, 100, 0.75, 0.7, 0), ("tests_passed", "deterministic", "no_unsupported", "reviews_closed", "roundtrip_passed")),
    "manufacturing-export-candidate": (GateLimits(0, 25, 0.95, 0.9, 0), ("tests_passed", "deterministic", "no_unsupported", "provenance_complete", "reviews_closed", "roundtrip_passed", "ground_truth_passed")),
}
FACT_CODES = {
    "tests_passed": "TESTS_NOT_PASSED", "deterministic": "NONDETERMINISTIC_OUTPUT", "no_unsupported": "UNSUPPORTED_CRITICAL_SYNTAX", "provenance_complete": "PROVENANCE_INCOMPLETE",
    "reviews_closed": "MANDATORY_REVIEWS_OPEN", "roundtrip_passed": "ROUNDTRIP_FAILED", "ground_truth_passed": "GROUND_TRUTH_FAILED",
}


def release_decisions(facts: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(key, profile, ready, blockers, warnings) from a row, or one for each key, of counts (errors, warnings, regressions), shares (provenance, completeness)
    and the booleans of FACT_CODES; an unknown fact blocks where it is asked for, an unknown count or share does not."""
    has = lambda c, kind: F.col(c).cast(kind) if c in facts.columns else F.lit(None).cast(kind)
    rows = []
    for name, (limits, needs) in RELEASE_PROFILES.items():
        tests = [(has("errors", "bigint") > limits.errors, "GATE_ERROR_COUNT"), (has("regressions", "bigint") > limits.regressions, "GATE_REGRESSION_FAILURES"), (has("provenance", "double") < limits.provenance, "GATE_PROVENANCE_LOW"), (has("completeness", "double") < limits.completeness, "GATE_COMPLETENESS_LOW")]
        tests += [(~F.coalesce(has(n, "boolean"), F.lit(False)), FACT_CODES[n]) for n in needs]
        warned = F.when(has("warnings", "bigint") > limits.warnings, "GATE_WARNING_COUNT")
        rows.append(F.struct(F.lit(name).alias("profile"), F.array_compact(F.array(*[F.when(t, c) for t, c in tests])).alias("blockers"), F.array_compact(F.array(warned)).alias("warnings")))
    return facts.select(*key, F.explode(F.array(*rows)).alias("r")).select(*key, "r.profile", (F.size("r.blockers") == 0).alias("ready"), "r.blockers", "r.warnings")
