"""Copper objects as shapes: what touches what, and how far apart things are.

A shape is a core widened by a radius r. Three kinds of core have closed forms: a segment (tracks), a box along
the axes (pads turned by quarter turns: a point for a round pad, a line for a stadium), and a polygon with
holes (all other pads, and regions), given by its edges. Polygons and boxes are filled. Discs that are no
circles are 64-gons.

A pair of shapes is tried where their boxes come near each other, by a grid of three cell sizes, so that a
plane of copper does not fill a million cells of the size that suits pads.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.geometry import capsule_gap, in_edges, segment_box_distance, segment_distance
from tracewright.operators import spatial

COLUMNS = ["id", "layer", "net_id", "core", "r", "cx0", "cy0", "cx1", "cy1", "edges", "x0", "y0", "x1", "y1"]
EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
#: Vertices of a disc that is no circle.
ROUND = 64


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _edge(a: Column, b: Column) -> Column:
    return F.struct(a["x"].cast("double").alias("x1"), a["y"].cast("double").alias("y1"), b["x"].cast("double").alias("x2"), b["y"].cast("double").alias("y2"))


def ring_edges(ring: Column) -> Column:
    """The edges of a ring of structs x, y, closed or not."""
    n = F.size(ring)
    return F.filter(F.transform(ring, lambda p, i: _edge(p, F.get(ring, (i + 1) % n))), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def _boxed(df: DataFrame) -> DataFrame:
    """df with the box of its shapes."""
    far = lambda c, which: which(F.transform("edges", lambda e: F.least(e[c + "1"], e[c + "2"]) if which is F.array_min else F.greatest(e[c + "1"], e[c + "2"])))
    poly = F.col("core") == "poly"
    low = lambda c: F.when(poly, far(c, F.array_min)).otherwise(F.least(f"c{c}0", f"c{c}1")) - F.col("r")
    high = lambda c: F.when(poly, far(c, F.array_max)).otherwise(F.greatest(f"c{c}0", f"c{c}1")) + F.col("r")
    return df.withColumns({"x0": low("x"), "y0": low("y"), "x1": high("x"), "y1": high("y")}).select(*COLUMNS)


def track_shapes(tracks: DataFrame) -> DataFrame:
    """Of tracks (id, x1, y1, x2, y2, width, layer, net_id)."""
    out = tracks.select(
        F.col("id").cast("string").alias("id"), F.col("layer"), _column(tracks, "net_id", "string").alias("net_id"), F.lit("segment").alias("core"), (F.col("width") / 2).alias("r"),
        F.col("x1").alias("cx0"), F.col("y1").alias("cy0"), F.col("x2").alias("cx1"), F.col("y2").alias("cy1"), F.lit(None).cast(EDGES).alias("edges"),
    )
    return _boxed(out)


def pad_shapes(pads: DataFrame) -> DataFrame:
    """Of pads (id, x, y, size_x, size_y, layer, net_id), with shape (C, O, else a box) and rotation in degrees, if there."""
    shape, turn = F.coalesce(_column(pads, "shape", "string"), F.lit("R")), F.pmod(F.coalesce(_column(pads, "rotation", "double"), F.lit(0.0)), F.lit(180.0))
    circle = shape.isin("C", "O") & (F.col("size_x") == F.col("size_y"))
    quarter, straight = F.abs(turn - 90) < 1e-9, (turn < 1e-9) | (turn > 180 - 1e-9)
    sx, sy = F.when(quarter, F.col("size_y")).otherwise(F.col("size_x")), F.when(quarter, F.col("size_x")).otherwise(F.col("size_y"))
    plain = circle | (straight | quarter) & (shape != "C")
    wide = F.when(shape.isin("C", "O"), F.least("size_x", "size_y") / 2).otherwise(0.0)
    hx, hy = F.when(circle, 0.0).otherwise(sx / 2 - wide), F.when(circle, 0.0).otherwise(sy / 2 - wide)
    # corners of what is turned, before turning; a turned stadium is its middle line
    ux, uy = F.col("size_x") / 2, F.col("size_y") / 2
    corners = F.when(shape == "C", F.array(*[F.struct((ux * math.cos(2 * math.pi * k / ROUND)).alias("x"), (uy * math.sin(2 * math.pi * k / ROUND)).alias("y")) for k in range(ROUND)]))
    corners = corners.when(shape == "O", F.array(F.struct((ux - wide).alias("x"), (uy - wide).alias("y")), F.struct((wide - ux).alias("x"), (wide - uy).alias("y"))))
    corners = corners.otherwise(F.array(*[F.struct((ux * a).alias("x"), (uy * b).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]))
    c, s = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    turned = F.transform(corners, lambda p: F.struct((F.col("x") + p["x"] * c - p["y"] * s).alias("x"), (F.col("y") + p["x"] * s + p["y"] * c).alias("y")))
    out = pads.select(
        F.col("id").cast("string").alias("id"), F.col("layer"), _column(pads, "net_id", "string").alias("net_id"), F.when(plain, "box").otherwise("poly").alias("core"),
        F.when(plain | (shape == "O"), wide).otherwise(0.0).alias("r"),
        *[F.when(plain, v).alias(n) for n, v in (("cx0", F.col("x") - hx), ("cy0", F.col("y") - hy), ("cx1", F.col("x") + hx), ("cy1", F.col("y") + hy))],
        F.when(~plain, ring_edges(turned)).alias("edges"),
    )
    return _boxed(out)


def region_shapes(regions: DataFrame) -> DataFrame:
    """Of regions (id, points, holes, layer, net_id)."""
    holes = F.coalesce(F.col("holes"), F.array().cast(regions.schema["holes"].dataType)) if "holes" in regions.columns else F.array().cast("array<array<struct<x:double,y:double>>>")
    edges = F.concat(ring_edges(F.col("points")), F.flatten(F.transform(holes, ring_edges)))
    none = F.lit(None).cast("double")
    out = regions.where(F.size("points") > 0).select(F.col("id").cast("string").alias("id"), "layer", _column(regions, "net_id", "string").alias("net_id"), F.lit("poly").alias("core"), F.lit(0.0).alias("r"), *[none.alias(c) for c in COLUMNS[5:9]], edges.alias("edges"))
    return _boxed(out)


def disc_shapes(discs: DataFrame) -> DataFrame:
    """Of round things (id, x, y, diameter) on no layer: drills, holes."""
    out = discs.select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("layer"), _column(discs, "net_id", "string").alias("net_id"), F.lit("box").alias("core"), (F.coalesce(_column(discs, "diameter", "double"), F.lit(0.0)) / 2).alias("r"), F.col("x").alias("cx0"), F.col("y").alias("cy0"), F.col("x").alias("cx1"), F.col("y").alias("cy1"), F.lit(None).cast(EDGES).alias("edges"))
    return _boxed(out)


def slot_shapes(slots: DataFrame) -> DataFrame:
    """Of slots (id, x1, y1, x2, y2, width) on no layer."""
    return track_shapes(slots.withColumn("layer", F.lit(None).cast("string")))


def shapes(tracks: DataFrame | None = None, pads: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """All copper of a board in one table."""
    parts = [make(df) for make, df in ((track_shapes, tracks), (pad_shapes, pads), (region_shapes, regions)) if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges_of(p: str) -> Column:
    x0, y0, x1, y1 = (F.col(f"{p}_{c}") for c in ("cx0", "cy0", "cx1", "cy1"))
    edge = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    box = F.array(edge(x0, y0, x1, y0), edge(x1, y0, x1, y1), edge(x1, y1, x0, y1), edge(x0, y1, x0, y0))
    return F.when(F.col(f"{p}_core") == "poly", F.col(f"{p}_edges")).when(F.col(f"{p}_core") == "segment", F.array(edge(x0, y0, x1, y1))).otherwise(box)


def gap(l: str = "l", r: str = "r", raw: bool = False) -> Column:  # noqa: E741
    """Distance between the edges of two shapes, 0 where they touch; columns are prefixed l_ and r_.

    raw gives a negative number where a widened core reaches over the other shape.
    """
    core = lambda p: tuple(F.col(f"{p}_{c}") for c in ("cx0", "cy0", "cx1", "cy1"))
    kind = lambda p: F.col(f"{p}_core")
    line = lambda e: (e["x1"], e["y1"], e["x2"], e["y2"])
    zero = F.lit(0.0)
    a, b = core(l), core(r)
    boxes = F.hypot(F.greatest(a[0] - b[2], zero, b[0] - a[2]), F.greatest(a[1] - b[3], zero, b[1] - a[3]))
    ea, eb = _edges_of(l), _edges_of(r)
    inside = in_edges(ea[0]["x1"], ea[0]["y1"], eb) & (kind(r) != "segment") | in_edges(eb[0]["x1"], eb[0]["y1"], ea) & (kind(l) != "segment")
    apart = F.array_min(F.transform(ea, lambda e: F.array_min(F.transform(eb, lambda f: segment_distance(line(e), line(f))))))
    far = (
        F.when((kind(l) == "segment") & (kind(r) == "segment"), capsule_gap(a, zero, b, zero))
        .when((kind(l) == "box") & (kind(r) == "box"), boxes)
        .when((kind(l) == "segment") & (kind(r) == "box"), segment_box_distance(a, b))
        .when((kind(l) == "box") & (kind(r) == "segment"), segment_box_distance(b, a))
        .when(inside, 0.0)
        .otherwise(apart)
    )
    bare = far - F.col(f"{l}_r") - F.col(f"{r}_r")
    return bare if raw else F.greatest(zero, bare)


def once() -> Column:
    """Of the two orders of a pair of one table, one."""
    return F.col("l_id") < F.col("r_id")


def near(left: DataFrame, right: DataFrame, within: float, keys: tuple[str, ...] = ("layer",), condition: Column | None = None, strict: bool = False) -> DataFrame:
    """Pairs of shapes at most within apart, strict: nearer, with their gap; columns get l_ and r_. condition spares pairs the exact gap."""
    pairs = spatial.box_join(left, right, max(2.0, 8 * within), within, keys, condition, wide=True)
    return spatial.measured(pairs, "gap", gap(), lambda g: g < within if strict else g <= within)


def contacts(copper: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(u, v) with u < v: shapes of one layer whose gap is within the tolerance."""
    return near(copper, copper, tolerance, condition=once()).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


def via_contacts(drills: DataFrame, copper: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(u, v, drill_id, confidence): what the wall of a plated drill with a proven span joins on different layers.

    drills (id, x, y, diameter, plating, span_proven), with layers, the span, and confidence if they are known. The edges
    are a star around the least object, so a drill through n objects gives n - 1 of them.
    """
    through = drills.where("plating = 'plated' and span_proven")
    kept = through.select(F.col("id").cast("string").alias("drill_id"), _column(drills, "layers", "array<string>").alias("layers"), F.coalesce(_column(drills, "confidence", "double"), F.lit(1.0)).alias("confidence"))
    hit = near(disc_shapes(through), copper, tolerance, ()).select(F.col("l_id").alias("drill_id"), F.col("r_id").alias("id"), F.col("r_layer").alias("layer"))
    hit = hit.join(kept, "drill_id").where(F.col("layers").isNull() | F.array_contains("layers", F.col("layer")))
    star = hit.groupBy("drill_id").agg(F.min("id").alias("u"), F.countDistinct("layer").alias("n")).where("n > 1").drop("n")
    return hit.join(star, "drill_id").where("id <> u").select("u", F.col("id").alias("v"), "drill_id", "confidence")


def physical_graph(copper: DataFrame, drills: DataFrame | None = None, tolerance: float = 0.03) -> DataFrame:
    """(u, v, kind, drill_id, confidence): contacts on a layer, and what proven vias join."""
    flat = contacts(copper, tolerance).select("u", "v", F.lit("contact").alias("kind"), F.lit(None).cast("string").alias("drill_id"), F.lit(1.0).alias("confidence"))
    if drills is None:
        return flat
    return flat.unionByName(via_contacts(drills, copper, tolerance).select("u", "v", F.lit("via").alias("kind"), "drill_id", "confidence"))


def brute_contacts(copper: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """contacts() by trying all pairs of a layer: for tests of small boards only."""
    side = lambda p: copper.select(*[F.col(c).alias(f"{p}_{c}") for c in COLUMNS])
    a, b = side("l"), side("r")
    pairs = a.join(b, (a["l_layer"] == b["r_layer"]) & (a["l_id"] < b["r_id"]))
    return pairs.where(gap() <= tolerance).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


def clearances(left: DataFrame, right: DataFrame, least: float, keys: tuple[str, ...] = ("layer",), condition: Column | None = None) -> DataFrame:
    """(l_id, r_id, gap, state) of pairs nearer than least whose nets differ or aren't both known, and of which condition holds."""
    state = F.when(F.col("l_net_id").isNull() | F.col("r_net_id").isNull(), "unresolved").when(F.col("l_net_id") == F.col("r_net_id"), "same").otherwise("different")
    asked = state != "same" if condition is None else condition & (state != "same")
    return near(left, right, least, keys, asked, strict=True).select("l_id", "r_id", "gap", state.alias("state"))


def covers(points: DataFrame, copper: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(point_id, id, layer, distance): shapes that hold a point (id, x, y), or are within the tolerance of it."""
    hit = near(disc_shapes(points.withColumn("diameter", F.lit(0.0))), copper, tolerance, ())
    return hit.select(F.col("l_id").alias("point_id"), F.col("r_id").alias("id"), F.col("r_layer").alias("layer"), F.col("gap").alias("distance"))


def edge_distance(copper: DataFrame, outline: DataFrame, within: float) -> DataFrame:
    """(id, gap): shapes at most within from a segment of the outline (id, x1, y1, x2, y2), by the nearest one."""
    border = track_shapes(outline.select("id", "x1", "y1", "x2", "y2", F.lit(0.0).alias("width"), F.lit(None).cast("string").alias("layer")))
    return near(copper, border, within, ()).groupBy(F.col("l_id").alias("id")).agg(F.min("gap").alias("gap"))


__all__ = ["brute_contacts", "clearances", "contacts", "covers", "disc_shapes", "edge_distance", "gap", "near", "pad_shapes", "physical_graph", "region_shapes", "ring_edges", "shapes", "slot_shapes", "track_shapes", "via_contacts"]
