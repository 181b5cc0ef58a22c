"""What the copper suggests: layer order, via spans, components."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import stable_id
from tracewright.operators import graph, spatial
from tracewright.operators.copper import covers, pad_shapes


def layer_order(layer: Column) -> Column:
    """A sort key: front copper, inner copper by number, back copper, all else by name."""
    inner = F.regexp_extract(layer, r"^In(\d+)\.Cu$", 1)
    rank = F.when(layer == "F.Cu", 0).when(inner != "", 1).when(layer == "B.Cu", 2).otherwise(3)
    return F.struct(rank.alias("rank"), F.coalesce(inner.try_cast("int"), F.lit(0)).alias("number"), layer.alias("name"))


def is_copper(layer: Column) -> Column:
    return layer.endswith(".Cu")


def stackup(observed: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(board, layer, place, copper, source, confidence) over layers seen (board, layer), and those that file attributes declare.

    A board has few layers, so places are made inside one array for each board.
    """
    seen = observed.select("board", "layer").where("layer is not null").distinct().withColumn("told", F.lit(False))
    if declared is not None:
        seen = seen.unionByName(declared.select("board", "layer").where("layer is not null").distinct().withColumn("told", F.lit(True)))
    one = seen.groupBy("board", "layer").agg(F.bool_or("told").alias("told"))
    per = one.groupBy("board").agg(F.array_sort(F.collect_list(F.struct(layer_order(F.col("layer")).alias("k"), "layer", "told"))).alias("all"), F.bool_or("told").alias("any_told"))
    has = lambda name: F.exists("all", lambda x: x["layer"] == name)
    copper = F.exists("all", lambda x: is_copper(x["layer"]))
    confidence = F.when(F.col("any_told"), 0.97).when(has("F.Cu") & has("B.Cu"), 0.9).when(copper, 0.65).otherwise(0.2)
    out = per.select("board", confidence.alias("confidence"), F.posexplode("all").alias("place", "x"))
    return out.select("board", F.col("x.layer").alias("layer"), "place", is_copper(F.col("x.layer")).alias("copper"), F.when(F.col("x.told"), "x2_file_function").otherwise("reconstructed_geometry").alias("source"), "confidence")


def declared_span(span: Column, kind: Column, copper: Column, told: Column) -> Column:
    """(layers, issue) of a declared pair of copper ordinals: null without one, no layers where it can't be mapped.

    copper is the order of copper layers, told whether file attributes declare that order.
    """
    lo, hi = F.least(span[0], span[1]), F.greatest(span[0], span[1])
    row = lambda layers, issue: F.struct(layers.alias("layers"), issue.alias("issue"))
    none, ok = F.array().cast("array<string>"), F.lit(None).cast("string")
    drilled = (lo == 1) & (hi == 2) & F.lower(kind).isin("pth", "npth") & (F.array_join(copper, ",") == "F.Cu,B.Cu")
    return (
        F.when(span.isNull(), None)
        .when((F.size(span) != 2) | lo.isNull() | hi.isNull() | (lo < 1) | (hi <= lo), row(none, F.lit("invalid span")))
        .when(told & (hi <= F.size(copper)), row(F.slice(copper, lo, hi - lo + 1), ok))
        .when(told, row(none, F.lit("span exceeds the stackup")))
        .when(F.coalesce(drilled, F.lit(False)), row(copper, ok))
        .otherwise(row(none, F.lit("no declared order of copper layers")))
    )


def via_spans(drills: DataFrame, pads: DataFrame, copper: list[str], tolerance: float = 0.15, told: bool = False) -> DataFrame:
    """(drill_id, from_layer, to_layer, layers, pad_ids, proven, confidence) for drills (id, x, y, plating, span, span_kind).

    Without a declared span a drill joins the outermost layers of the pads over it.
    """
    order = F.array(*[F.lit(c) for c in copper])
    hit = covers(drills.select("id", "x", "y"), pad_shapes(pads), tolerance)
    near = hit.where(F.col("layer").isin(copper)).groupBy(F.col("point_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "layer"))).alias("pads"))
    span = declared_span(F.col("span"), F.col("span_kind"), order, F.lit(told))
    out = drills.join(near, "id", "left").withColumn("d", span).withColumn("pads", F.coalesce("pads", F.array().cast("array<struct<id:string,layer:string>>")))
    places = F.transform("pads", lambda p: F.array_position(order, p["layer"]))
    lo, hi = F.array_min(places), F.array_max(places)
    seen = F.when(F.size("pads") > 0, F.slice(order, lo, hi - lo + 1)).otherwise(F.array().cast("array<string>"))
    layers = F.when(F.col("d").isNull(), seen).otherwise(F.col("d.layers"))
    plated, issue = F.col("plating") == "plated", F.coalesce(F.col("d.issue").isNotNull(), F.lit(False))
    out = out.withColumn("layers", layers)
    proven = F.coalesce(plated & (F.size("layers") >= 2) & ~issue, F.lit(False))
    told_confidence = F.when(issue, 0.1).when(proven, 0.99).when(F.col("plating") == "non-plated", 0.97).otherwise(0.8)
    seen_confidence = F.when(F.size("layers") >= 2, F.when(proven, 0.95).otherwise(0.7)).when(F.size("layers") == 1, 0.35).otherwise(0.1)
    inside = F.filter("pads", lambda p: F.array_contains("layers", p["layer"]))
    return out.select(
        F.col("id").alias("drill_id"), F.get("layers", F.lit(0)).alias("from_layer"), F.when(F.size("layers") > 0, F.element_at("layers", -1)).alias("to_layer"), "layers",
        F.transform(inside, lambda p: p["id"]).alias("pad_ids"), proven.alias("proven"), F.when(F.col("d").isNull(), seen_confidence).otherwise(told_confidence).alias("confidence"),
    )


def named_components(pads: DataFrame) -> DataFrame:
    """(id, pad_ids, kind, confidence, reference, pin_map) of pads (id, references, pins) whose file names their component.

    Pads with one reference form the component of that name, one for each copy where the file steps and repeats
    (column repeats, the copy's description); a pad with several references is a conflict of its own.
    """
    none_told = F.array().cast("array<string>")
    repeats = F.coalesce(F.array_sort("repeats"), none_told) if "repeats" in pads.columns else none_told
    one = pads.where(F.size("references") == 1).select("id", F.col("references")[0].alias("reference"), repeats.alias("repeats"), F.when(F.size("pins") == 1, F.col("pins")[0]).alias("pin"))
    pins = F.filter(F.col("m"), lambda x: x["pin"].isNotNull())
    groups = one.groupBy("reference", "repeats").agg(F.array_sort(F.collect_list(F.struct("id", "pin"))).alias("m"))
    ids = F.transform("m", lambda x: x["id"])
    key = F.array_join(F.concat(F.array("reference"), F.col("repeats"), ids), "|")
    named = groups.select(stable_id("cmp", F.lit("gerber_x2_refdes"), key).alias("id"), ids.alias("pad_ids"), F.lit("gerber_x2_component").alias("kind"), F.lit(1.0).alias("confidence"), "reference", F.map_from_entries(F.transform(pins, lambda x: F.struct(x["id"], x["pin"]))).alias("pin_map"))
    clash = pads.where(F.size("references") > 1)
    none = F.create_map().cast("map<string,string>")
    told = F.array_join(F.concat(F.array("id"), F.array_sort("references")), "|")
    clashes = clash.select(stable_id("cmp", F.lit("gerber_x2_refdes_conflict"), told).alias("id"), F.array("id").alias("pad_ids"), F.lit("gerber_x2_component_conflict").alias("kind"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("reference"), none.alias("pin_map"))
    return named.unionByName(clashes)


def paired_components(pads: DataFrame, most: float = 4.0, board: str | None = None) -> DataFrame:
    """(id, pad_ids, kind, confidence, distance): in order of id each free pad takes the nearest free one within most mm.

    A choice can only touch pads that a chain of such distances links, so each linked group is a task of its
    own, in which a pad looks only at the free pads of the grid cells around it. Pads: id, x, y, layer, drill (null for none); board keeps boards apart.
    """
    keys = (board,) if board else ()
    near = spatial.radius_join(pads.select("id", "x", "y", "layer", "drill", *keys), pads.select("id", "x", "y", "layer", "drill", *keys), most, keys).where("l_id <> r_id")
    label = graph.label_components(pads.select(F.col("id").alias("node")), near.select(F.col("l_id").alias("u"), F.col("r_id").alias("v")))
    rows = label.join(pads.select(F.col("id").alias("node"), "x", "y", "layer", "drill"), "node")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        ids, layers, drilled = part["node"].tolist(), part["layer"].tolist(), part["drill"].notna().tolist()
        xs, ys = part["x"].to_numpy(), part["y"].to_numpy()
        side = max(most, 1e-9) * (1 + 1e-6)
        placed = np.isfinite(xs) & np.isfinite(ys)
        cells = [(math.floor(x / side), math.floor(y / side)) if p else None for x, y, p in zip(xs, ys, placed, strict=True)]
        free, out, waiting = [True] * len(ids), [], defaultdict(set)
        for a, cell in enumerate(cells):
            if cell is not None:
                waiting[cell].add(a)
        for a in range(len(ids)):
            if not free[a]:
                continue
            free[a] = False
            best = None
            if cells[a] is not None:
                waiting[cells[a]].discard(a)
                cx, cy = cells[a]
                around = [b for i in (cx - 1, cx, cx + 1) for j in (cy - 1, cy, cy + 1) for b in waiting.get((i, j), ())]
                d = ((xs[around] - xs[a]) ** 2 + (ys[around] - ys[a]) ** 2) ** 0.5
                best = min(((float(v), b) for b, v in zip(around, d, strict=True) if v <= most), default=None)
            if best is None:
                out.append(([ids[a]], "unresolved_pad", 0.15, None))
                continue
            gap, b = best
            free[b] = False
            waiting[cells[b]].discard(b)
            both = drilled[a] and drilled[b]
            out.append((sorted([ids[a], ids[b]]), "two_pin_through_hole_candidate" if both else "two_pad_component_candidate", round(0.35 + 0.15 * both + 0.1 * (layers[a] == layers[b]), 12), gap))
        return pd.DataFrame(out, columns=["pad_ids", "kind", "confidence", "distance"])

    made = rows.groupBy("component").applyInPandas(run, "pad_ids array<string>, kind string, confidence double, distance double")
    return made.select(stable_id("cmp", F.array_join("pad_ids", "|")).alias("id"), "pad_ids", "kind", "confidence", "distance")
