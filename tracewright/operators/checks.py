"""Checks of whole boards: validity of objects, references between tables, electrical rules, distances from the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.geometry import in_ring, point_segment
from tracewright.operators import spatial
from tracewright.operators.connectivity import cell_size, pad_boxes
from tracewright.operators.rules import Registry, issues, outline_ends, outline_gaps, slots, union

PLATINGS = ("unknown", "plated", "non_plated", "non-plated")


def bad_size(c: Column) -> Column:
    return F.coalesce(~((c > 0) & (c < float("inf"))), F.lit(True))


def bad_coordinate(*cs: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = F.lit(False)
    for c in cs:
        out = out | ~finite(c)
    return out


def geometry(tracks: DataFrame, pads: DataFrame, drills: DataFrame) -> DataFrame:
    return union(
        issues(tracks.where(bad_size(F.col("width"))), "checks", "error", "TRACK_WIDTH_INVALID", "track width must be positive", "id"),
        issues(pads.where((F.col("size_x") <= 0) | (F.col("size_y") <= 0)), "checks", "error", "PAD_SIZE_INVALID", "pad size must be positive", "id"),
        issues(drills.where(F.col("diameter") <= 0), "checks", "error", "DRILL_DIAMETER_INVALID", "drill diameter must be positive", "id"),
    )


def slot_coordinates(df: DataFrame) -> DataFrame:
    return issues(df.where(bad_coordinate(*map(F.col, ("x1", "y1", "x2", "y2")))), "checks", "error", "SLOT_COORDINATE_INVALID", "slot coordinates must be finite", "id")


def regions(df: DataFrame) -> DataFrame:
    """Rings (points, holes) that are open, too short, without area, or not finite."""
    ring = lambda r: F.size(r) > 0
    closed = lambda r: ring(r) & (F.element_at(r, 1)["x"] == F.element_at(r, -1)["x"]) & (F.element_at(r, 1)["y"] == F.element_at(r, -1)["y"])
    few = lambda r: F.size(F.array_distinct(r)) < 3
    wild = lambda r: F.exists(r, lambda p: bad_coordinate(p["x"], p["y"]))
    holes = F.coalesce(F.col("holes"), F.array().cast(df.schema["holes"].dataType))
    tests = [
        (~closed(F.col("points")), "REGION_NOT_CLOSED"), (few(F.col("points")), "REGION_VERTEX_COUNT_INVALID"), (F.exists(holes, lambda h: ~closed(h)), "REGION_HOLE_NOT_CLOSED"),
        (F.exists(holes, few), "REGION_HOLE_VERTEX_COUNT_INVALID"), (wild(F.col("points")) | F.exists(holes, wild), "REGION_COORDINATE_INVALID"),
    ]
    out = df.select("id", F.explode(F.array_compact(F.array(*[F.when(t, c) for t, c in tests]))).alias("code"))
    return out.select(F.lit("checks").alias("source"), F.lit("error").alias("severity"), "code", F.lower(F.replace("code", F.lit("_"), F.lit(" "))).alias("message"), F.array("id").alias("object_ids"))


def components(parts: DataFrame, pads: DataFrame) -> DataFrame:
    """Repeated ids, pads and pins that don't exist, confidences out of range, over components (id, pad_ids, confidence, pin_map)."""
    each = parts.select("id", F.explode("pad_ids").alias("pad"))
    lost = each.join(pads.select(F.col("id").alias("pad")), "pad", "left_anti")
    twice = each.groupBy("id", "pad").agg(F.count("*").alias("n")).where("n > 1").select("id").distinct()
    stray = parts.where(F.exists(F.map_keys("pin_map"), lambda k: ~F.array_contains("pad_ids", k)))
    blank = parts.where(F.exists(F.map_values("pin_map"), lambda v: F.trim(F.coalesce(v, F.lit(""))) == ""))
    return union(
        issues(parts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "checks", "error", "DUPLICATE_COMPONENT_ID", "component id occurs twice", "id"),
        issues(twice, "checks", "error", "COMPONENT_PAD_DUPLICATE", "component repeats a pad", "id"),
        issues(parts.where("not (confidence between 0 and 1)"), "checks", "error", "COMPONENT_CONFIDENCE_INVALID", "component confidence outside [0,1]", "id"),
        issues(lost, "checks", "error", "COMPONENT_PAD_MISSING", F.concat(F.lit("unknown pad "), "pad"), "id", "pad"),
        issues(parts.where(F.size("pad_ids") == 0), "checks", "warning", "COMPONENT_NO_PADS", "component hypothesis has no pads", "id"),
        issues(stray, "checks", "error", "COMPONENT_PIN_MAP_PAD_NOT_MEMBER", "pin map names a pad of another component", "id"),
        issues(blank, "checks", "error", "COMPONENT_PIN_NUMBER_INVALID", "pin number is blank", "id"),
    )


def platings(drills: DataFrame) -> DataFrame:
    odd = drills.where(~F.col("plating").isin(*PLATINGS))
    return issues(odd, "checks", "warning", "DRILL_PLATING_UNKNOWN_ENUM", F.concat(F.lit("unexpected plating value "), "plating"), "id")


def provenance(objects: DataFrame) -> DataFrame:
    """Objects (id, sources) without a source."""
    return issues(objects.where(F.coalesce(F.size("sources"), F.lit(0)) <= 0), "checks", "info", "PROVENANCE_SOURCE_MISSING", "object has no source reference", "id")


def outline(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Gaps between neighbours in order, and ends that other than two segments meet."""
    gaps = issues(outline_gaps(df, tolerance), "checks", "warning", "OUTLINE_GAP", F.format_string("gap of %.4f mm", "gap"), "id", "next_id")
    open_ = outline_ends(df, tolerance).agg(F.count("*").alias("n")).where("n > 0")
    return union(gaps, open_.select(F.lit("checks").alias("source"), F.lit("warning").alias("severity"), F.lit("OUTLINE_NOT_CLOSED").alias("code"), F.format_string("outline has %d ends that are not joined by two segments", "n").alias("message"), F.array().cast("array<string>").alias("object_ids")))


def electrical(parts: DataFrame, pin_edges: DataFrame, nets: DataFrame) -> DataFrame:
    """The electrical rules over components (id, pad_ids, confidence), pin_edges (component_id, pin_id, net_id) and nets (net_id, label)."""
    used = pin_edges.where("net_id is not null")
    dangling = nets.select("net_id").join(used.groupBy("net_id").agg(F.countDistinct("component_id").alias("n")).where("n > 1"), "net_id", "left_anti")
    open_ = pin_edges.where("net_id is null").select("component_id").distinct()
    return union(
        issues(dangling, "erc", "warning", "DANGLING_NET", F.concat_ws(" ", F.lit("net"), "net_id", F.lit("reaches one or zero components")), "net_id"),
        issues(parts.where(F.size("pad_ids") == 0), "erc", "error", "COMPONENT_NO_PINS", "component hypothesis has no pads", "id"),
        issues(parts.where("confidence < 0.3"), "erc", "info", "COMPONENT_LOW_CONFIDENCE", "component identity is highly uncertain", "id"),
        issues(nets.where("label is null"), "erc", "info", "NET_LABEL_UNKNOWN", "physical net has no semantic label", "net_id"),
        issues(open_, "erc", "warning", "PIN_NET_UNKNOWN", "component has pins without a net", "component_id"),
    )


def drill_copper(drills: DataFrame, pads: DataFrame, clearance: float = 0.15) -> DataFrame:
    """Drills (id, x, y, diameter, net_id) nearer to a pad of another or unknown net than the clearance, edge to edge."""
    boxes = drills.select("id", "x", "y", "diameter", "net_id").withColumns({"x0": F.col("x") - F.col("diameter") / 2, "x1": F.col("x") + F.col("diameter") / 2, "y0": F.col("y") - F.col("diameter") / 2, "y1": F.col("y") + F.col("diameter") / 2})
    near = spatial.box_join(boxes, pad_boxes(pads.select("id", "x", "y", "size_x", "size_y", "net_id")), max(cell_size(0.0), clearance), clearance, keys=())
    zero = F.lit(0.0)
    gap = F.hypot(F.greatest(F.col("r_x0") - F.col("l_x"), zero, F.col("l_x") - F.col("r_x1")), F.greatest(F.col("r_y0") - F.col("l_y"), zero, F.col("l_y") - F.col("r_y1"))) - F.col("l_diameter") / 2
    own = F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")) < 1e-6  # the drill's own pad
    out = near.where((gap < clearance) & ~own & ~F.coalesce(F.col("l_net_id") == F.col("r_net_id"), F.lit(False)))
    return issues(out, "drc", "error", "DRILL_COPPER_CLEARANCE", F.format_string("clearance below %.3f mm", F.lit(clearance)), "l_id", "r_id")


def edge(points: DataFrame, ring: list[tuple[float, float]], least: float = 0.25, names: tuple[str, str] = ("COPPER_OUTSIDE_BOARD", "COPPER_EDGE_CLEARANCE")) -> DataFrame:
    """Round objects (id, x, y, diameter) whose centre is outside the board's ring, or whose edge is nearer to it than least.

    The ring is the outline of one board: a list of corners, part of the plan.
    """
    closed = [*ring, ring[0]] if ring[0] != ring[-1] else list(ring)
    x, y = F.col("x"), F.col("y")
    far = F.least(*[point_segment(x, y, *map(F.lit, (*a, *b))) for a, b in zip(closed, closed[1:], strict=False)]) - F.col("diameter") / 2
    corners = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in closed[:-1]])
    inside = in_ring(x, y, corners)
    out = points.withColumns({"inside": inside, "far": far})
    return union(
        issues(out.where("not inside"), "drc", "error", names[0], "outside the board", "id"),
        issues(out.where(F.col("inside") & (F.col("far") < least)), "drc", "warning", names[1], F.format_string("edge distance %.4f mm", "far"), "id"),
    )


def builtin() -> Registry:
    """The checks that need no parameters, over a dict of tables."""
    out = Registry()
    out.add("geometry", lambda t: geometry(t["tracks"], t["pads"], t["drills"]))
    out.add("components", lambda t: components(t["components"], t["pads"]))
    out.add("drills", lambda t: platings(t["drills"]))
    out.add("slots", lambda t: union(slots(t["slots"]), slot_coordinates(t["slots"])))
    out.add("outline", lambda t: outline(t["outline"]))
    out.add("regions", lambda t: regions(t["regions"]))
    return out
