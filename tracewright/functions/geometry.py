"""Plane geometry as Column expressions, in millimetres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment, which may be a point itself."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two segments (x1, y1, x2, y2) properly cross."""
    return (_side(*a, b[0], b[1]) * _side(*a, b[2], b[3]) < 0) & (_side(*b, a[0], a[1]) * _side(*b, a[2], a[3]) < 0)


def segment_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    ends = F.least(point_segment(a[0], a[1], *b), point_segment(a[2], a[3], *b), point_segment(b[0], b[1], *a), point_segment(b[2], b[3], *a))
    return F.when(segments_cross(a, b), 0.0).otherwise(ends)


def capsule_gap(a: tuple[Column, ...], wa: Column, b: tuple[Column, ...], wb: Column) -> Column:
    """Distance between the edges of two round-ended tracks; 0 where they touch."""
    return F.greatest(F.lit(0.0), segment_distance(a, b) - wa / 2 - wb / 2)


def disc_gap(ax: Column, ay: Column, da: Column, bx: Column, by: Column, db: Column) -> Column:
    return F.greatest(F.lit(0.0), F.hypot(ax - bx, ay - by) - da / 2 - db / 2)


def box_point_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - px, zero, px - x1), F.greatest(y0 - py, zero, py - y1))


def segment_box_distance(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of a segment (x1, y1, x2, y2) from a filled box (x0, y0, x1, y1); 0 where they meet.

    A segment that runs through a box without ending in it parts its corners, and so crosses a diagonal.
    """
    x0, y0, x1, y1 = b
    through = segments_cross(a, (x0, y0, x1, y1)) | segments_cross(a, (x0, y1, x1, y0))
    ends = F.least(box_point_distance(a[0], a[1], *b), box_point_distance(a[2], a[3], *b))
    corners = F.least(*[point_segment(x, y, *a) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    return F.when(through, 0.0).otherwise(F.least(ends, corners))


def in_edges(px: Column, py: Column, edges: Column) -> Column:
    """Whether a point lies inside closed rings given by their edges (x1, y1, x2, y2), holes left out."""
    spans = lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(edges, lambda e: F.when((e["y1"] > py) != (e["y2"] > py), spans(e)).otherwise(False))) % 2 == 1


def polyline_length(points: Column) -> Column:
    """Of an array of structs x, y."""
    legs = F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def excess_length(points: Column) -> Column:
    """How much longer a polyline is than the straight line between its ends."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(F.size(points) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), polyline_length(points) - F.hypot(last["x"] - first["x"], last["y"] - first["y"])))


def signed_area(points: Column) -> Column:
    """Of a ring of structs x, y, closed or not; positive when it turns left."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2


def in_ring(px: Column, py: Column, points: Column) -> Column:
    """Whether a point lies inside a ring: a ray to the right crosses its edges an odd number of times."""
    n = F.size(points)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(points, (i + 1) % n)
        spans = (p["y"] > py) != (q["y"] > py)
        return F.when(spans & (px < (q["x"] - p["x"]) * (py - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(points, crosses), F.lit(0), lambda s, x: s + x) % 2 == 1


def rotate(x: Column, y: Column, degrees: Column | float, ox: Column | float = 0.0, oy: Column | float = 0.0) -> tuple[Column, Column]:
    a = F.radians(F.lit(degrees) if isinstance(degrees, (int, float)) else degrees)
    dx, dy = x - ox, y - oy
    return ox + dx * F.cos(a) - dy * F.sin(a), oy + dx * F.sin(a) + dy * F.cos(a)


def angle_gap(a: Column, b: Column) -> Column:
    """The smaller angle between two directions in degrees, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def arc_sweep(start: Column, end: Column, clockwise: Column) -> Column:
    """Radians swept from start to end, in (0, 2 pi]; equal angles are a full turn."""
    turn = F.lit(2.0) * F.pi()
    sweep = F.pmod(F.when(clockwise, start - end).otherwise(end - start), turn)
    return F.when(sweep <= 1e-12, turn).otherwise(sweep)


def chords(radius: Column, sweep: Column, error: float = 0.005) -> Column:
    """The least number of chords whose distance from the arc stays within the error."""
    step = 2 * F.acos(F.greatest(F.lit(-1.0), 1 - F.lit(error) / radius))
    return F.when(radius <= error, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(sweep / step))).cast("int")


def quantise(v: Column, step: float) -> Column:
    """The nearest multiple of step; halves go to the even one."""
    return (F.bround(v.cast("decimal(38,12)") / F.lit(step).cast("decimal(38,12)"), 0) * F.lit(step).cast("decimal(38,12)")).cast("double")


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """(a x + b y + e, c x + d y + f) for m = (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return a * x + b * y + e, c * x + d * y + f


def annular_ring(sx: Column, sy: Column, drill: Column) -> Column:
    """Copper left around a centred drill; -1 where it breaks out, null without a drill."""
    ring = F.least(sx, sy) / 2 - drill / 2
    return F.when(drill.isNull(), None).when(ring < 0, -1.0).otherwise(ring)


def fit_affine(points: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float, float, float]:
    """(a, b, c, d, e, f) of affine() that takes three points (x, y) to (to_x, to_y) exactly; refused for points on a line."""
    if len(points) != 3:
        raise ValueError("exactly three control points are required")
    (x1, y1, *_), (x2, y2, *_), (x3, y3, *_) = points
    whole = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
    if abs(whole) < 1e-12:
        raise ValueError("the control points lie on a line")

    def row(v1: float, v2: float, v3: float) -> tuple[float, float, float]:
        a = ((v2 - v1) * (y3 - y1) - (v3 - v1) * (y2 - y1)) / whole
        b = ((x2 - x1) * (v3 - v1) - (x3 - x1) * (v2 - v1)) / whole
        return a, b, v1 - a * x1 - b * y1

    (a, b, e), (c, d, f) = (row(*(p[k] for p in points)) for k in (2, 3))
    return a, b, c, d, e, f


def fit_affine_columns(df, key: list[str], x: str = "x", y: str = "y", to_x: str = "to_x", to_y: str = "to_y"):
    """(key, n, a, b, c, d, e, f): the affine map of least squares for each group, exact for three points; nulls on a line.

    From sums alone, with coordinates about the means, so that a group of any size is one aggregate.
    """
    cov = lambda p, q: F.covar_pop(p, q)
    agg = df.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (x, y, to_x, to_y)], cov(x, x).alias("xx"), cov(x, y).alias("xy"), cov(y, y).alias("yy"), *[cov(p, q).alias(f"{p}_{q}") for p in (x, y) for q in (to_x, to_y)])
    whole = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    safe = F.when(F.abs(whole) > 1e-18, whole)
    a, b = ((F.col(f"{x}_{to_x}") * F.col("yy") - F.col(f"{y}_{to_x}") * F.col("xy")) / safe, (F.col(f"{y}_{to_x}") * F.col("xx") - F.col(f"{x}_{to_x}") * F.col("xy")) / safe)
    c, d = ((F.col(f"{x}_{to_y}") * F.col("yy") - F.col(f"{y}_{to_y}") * F.col("xy")) / safe, (F.col(f"{y}_{to_y}") * F.col("xx") - F.col(f"{x}_{to_y}") * F.col("xy")) / safe)
    at = lambda p, q, to: F.col(f"m_{to}") - p * F.col(f"m_{x}") - q * F.col(f"m_{y}")
    return agg.select(*key, "n", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), at(a, b, to_x).alias("e"), at(c, d, to_y).alias("f"))
