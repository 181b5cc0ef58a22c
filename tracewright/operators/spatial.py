"""Grid-cell spatial joins: range predicates become equi-joins on cells, then exact predicates.

Pairs are kept in the one cell that holds the lower corner of the overlap of both boxes, so that no
distinct is needed and no pair crosses the shuffle twice. Lines between cells lie half a cell off the
multiples of the cell size, as that is where boards have their objects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A side of a join that fills no more cells than this is sent to every task.
FEW_CELLS = 20_000


def cell_at(v: Column, size: float | Column) -> Column:
    """The number of the cell that holds a coordinate."""
    return F.floor(v / size + 0.5)


def with_cells(df: DataFrame, cell: float, grow: float = 0.0, prefix: str = "") -> DataFrame:
    """One row for each grid cell that the box x0, y0, x1, y1 touches once grown on all sides."""
    at = lambda c, g: cell_at(F.col(prefix + c) + g, cell)
    return df.withColumn("cx", F.explode(F.sequence(at("x0", -grow), at("x1", grow)))).withColumn("cy", F.explode(F.sequence(at("y0", -grow), at("y1", grow))))


def _facts(df: DataFrame, cell: float, grow: float) -> tuple[int, float]:
    """How many cells the boxes of df fill, and the extent of the largest, both once grown."""
    across = lambda c: cell_at(F.col(c + "1") + grow, cell) - cell_at(F.col(c + "0") - grow, cell) + 1
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * grow
    cells, widest = df.agg(F.sum((across("x") * across("y")).cast("double")), F.max(extent)).first()
    return cells or 0, widest or 0.0


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def box_join(left: DataFrame, right: DataFrame, cell: float, within: float = 0.0, keys: tuple[str, ...] = ("layer",), condition: Column | None = None, wide: bool = False, exact: Column | None = None) -> DataFrame:
    """All pairs of boxes at most within apart on each axis and equal in keys; columns get l_ and r_.

    condition, a cheap one, and exact, a dear one, are asked of such pairs besides; exact is evaluated only where all else
    holds, not for all that meet in a cell.

    wide is for tables that may hold boxes of many cells (planes, keepouts): a box of more than eight cells
    lives on a grid 64 times as coarse, one of more than 512 on one of 4,096 times, and a pair meets on the
    coarser grid of the two, so that no box fills more than 10 by 10 cells but for those beyond 32,768. Where no
    box is that large, there is one grid.

    A planner counts a row once, however many cells it fills, so the cells are counted first: only a side
    of few is broadcast.
    """
    facts = [_facts(left, cell, within), _facts(right, cell, 0.0)]
    wide = wide and max(widest for _, widest in facts) > 8 * cell
    a, b = _renamed(left, "l_"), _renamed(right, "r_")
    if wide:
        a, b = _on_grids(a, cell, within, "l_", ("at home", "right up")), _on_grids(b, cell, 0.0, "r_", ("at home", "left up"))
        size, on = F.lit(cell) * F.pow(F.lit(64.0), a["grid"]), [a["grid"] == b["grid"], a["meet"] == b["meet"]]
    else:
        a, b, size, on = with_cells(a, cell, within, "l_"), with_cells(b, cell, 0.0, "r_"), F.lit(cell), []
    on += [a["cx"] == b["cx"], a["cy"] == b["cy"], *[a[f"l_{k}"] == b[f"r_{k}"] for k in keys]]
    near = (F.col("l_x0") - within <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1") + within) & (F.col("l_y0") - within <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1") + within)
    if wide:
        near = near & (a["grid"] == F.greatest("l__grid", "r__grid"))
    first = (a["cx"] == cell_at(F.greatest(F.col("l_x0") - within, F.col("r_x0")), size)) & (a["cy"] == cell_at(F.greatest(F.col("l_y0") - within, F.col("r_y0")), size))
    cheap = near & first if condition is None else near & first & F.coalesce(condition, F.lit(False))
    few = [cells <= FEW_CELLS for cells, _ in facts]
    joined = F.broadcast(a).join(b, on) if few[0] and facts[0] <= facts[1] else a.join(F.broadcast(b) if few[1] else b.hint("merge"), on)
    out = joined.where(cheap)
    if exact is not None:
        out = measured(out, "_exact", exact, lambda holds: holds)
    return out.select(*[F.col(c) for c in a.columns + b.columns if c not in ("cx", "cy", "grid", "meet", "l__grid", "r__grid")])


def measured(pairs: DataFrame, name: str, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    """The pairs for whose value, a dear one, the test holds, with the value as a column.

    It goes through explode() once, as a planner would copy it into each filter and join condition in front.
    """
    return pairs.withColumn("_value", value).withColumn(name, F.explode(F.array("_value"))).drop("_value").where(test(F.col(name)))


def _on_grids(df: DataFrame, cell: float, grow: float, prefix: str, home: tuple[str, str]) -> DataFrame:
    """with_cells() on the grid that suits each box, and on the coarser ones.

    meet keeps boxes apart that are both on a coarser grid than their own: only there would small ones be many in a cell.
    """
    extent = F.greatest(F.col(prefix + "x1") - F.col(prefix + "x0"), F.col(prefix + "y1") - F.col(prefix + "y0")) + 2 * grow
    own = F.when(extent <= 8 * cell, 0).when(extent <= 512 * cell, 1).otherwise(2)
    out = df.withColumn(prefix + "_grid", own).withColumn("grid", F.explode(F.sequence(F.col(prefix + "_grid"), F.lit(2))))
    up = "left up" if "left up" not in home else "right up"
    out = out.withColumn("meet", F.explode(F.when(F.col("grid") == F.col(prefix + "_grid"), F.array(*map(F.lit, home))).otherwise(F.array(F.lit(up)))))
    size = F.lit(cell) * F.pow(F.lit(64.0), F.col("grid"))
    at = lambda c, g: cell_at(F.col(prefix + c) + g, size)
    return out.withColumn("cx", F.explode(F.sequence(at("x0", -grow), at("x1", grow)))).withColumn("cy", F.explode(F.sequence(at("y0", -grow), at("y1", grow))))


def box_pairs(df: DataFrame, cell: float, within: float = 0.0, keys: tuple[str, ...] = ("layer",), id_col: str = "id", wide: bool = False, condition: Column | None = None, exact: Column | None = None) -> DataFrame:
    """Unordered pairs (l_id < r_id) of box_join of a table with itself. A box's own growth is on one side only, as distances are symmetric."""
    once = F.col(f"l_{id_col}") < F.col(f"r_{id_col}")
    return box_join(df, df, cell, within, keys, once if condition is None else once & condition, wide, exact)


def point_boxes(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"x0": F.col(x), "x1": F.col(x), "y0": F.col(y), "y1": F.col(y)})


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def radius_join(queries: DataFrame, points: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points (x, y) at most radius apart, with their distance; columns get l_ and r_."""
    out = box_join(point_boxes(queries), point_boxes(points), max(radius, 1e-9), radius, keys)
    d = distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y"))
    out = out.withColumn("distance", d).where(F.col("distance") <= radius)
    return out.drop(*[f"{s}_{c}" for s in "lr" for c in ("x0", "x1", "y0", "y1")])


def nearest(queries: DataFrame, points: DataFrame, radius: float, id_col: str = "id", ties: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The nearest point within the radius of each query that has one; ties go to the lower value of the column ties, else of the id."""
    pairs = radius_join(queries, points, radius, keys)
    order = Window.partitionBy(f"l_{id_col}").orderBy("distance", f"r_{ties or id_col}")
    return pairs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def pair_metrics(n: int, pairs: DataFrame) -> DataFrame:
    """brute_pairs n (n - 1) / 2, candidate_pairs, and what share the grid spared."""
    brute = n * (n - 1) // 2
    return pairs.agg(F.count("*").alias("candidate_pairs")).select(F.lit(brute).cast("bigint").alias("brute_pairs"), "candidate_pairs", F.round(F.lit(1.0) if brute == 0 else 1 - F.col("candidate_pairs") / brute, 6).alias("reduction_ratio"))


def overlap(a: str = "l_", b: str = "r_") -> Column:
    """Boxes that share area or an edge."""
    c = lambda p, k: F.col(p + k)
    return (c(a, "x0") <= c(b, "x1")) & (c(b, "x0") <= c(a, "x1")) & (c(a, "y0") <= c(b, "y1")) & (c(b, "y0") <= c(a, "y1"))


def inside_rings(points: DataFrame, edges: DataFrame, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """points (key, px, py) with inside: whether an odd number of the closed rings made by edges (x1, y1, x2, y2) surrounds each.

    A point meets the edges of its horizontal slab only; there are as many slabs as edges, so that a long outline has few in each.
    Points without coordinates are not inside.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    frame = F.broadcast(edges.agg(F.count("*").alias("__n"), F.min(low).alias("__low"), F.max(high).alias("__high")))  # one row
    height = F.greatest((F.col("__high") - F.col("__low")) / F.greatest("__n", F.lit(1)), F.lit(1e-9))
    slab = lambda y: F.floor((y - F.col("__low")) / height)
    own = ["__n", "__low", "__high"]
    cut_up = edges.select("x1", "y1", "x2", "y2").crossJoin(frame).withColumn("slab", F.explode(F.sequence(slab(low), slab(high)))).drop(*own)
    names = [*key, "px", "py"]
    asked = points.select(*names).distinct().crossJoin(frame).where(F.col("py").between(F.col("__low"), F.col("__high"))).withColumn("slab", slab(F.col("py"))).drop(*own)
    spans = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    right = F.when(spans, F.col("px") < (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = asked.join(cut_up, "slab").where(right).groupBy(*names).agg((F.count("*") % 2 == 1).alias("inside"))
    return points.join(odd, names, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
