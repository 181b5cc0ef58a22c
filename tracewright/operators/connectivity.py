"""From copper objects to electrical nets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.geometry import capsule_gap, segment_box_distance
from tracewright.functions.text import stable_id
from tracewright.operators import copper, graph, spatial, windows
from tracewright.storage import cut


def pad_boxes(pads: DataFrame) -> DataFrame:
    return pads.withColumns({"x0": F.col("x") - F.col("size_x") / 2, "x1": F.col("x") + F.col("size_x") / 2, "y0": F.col("y") - F.col("size_y") / 2, "y1": F.col("y") + F.col("size_y") / 2})


def track_boxes(tracks: DataFrame) -> DataFrame:
    h = F.col("width") / 2
    return tracks.withColumns({"x0": F.least("x1", "x2") - h, "x1": F.greatest("x1", "x2") + h, "y0": F.least("y1", "y2") - h, "y1": F.greatest("y1", "y2") + h})


def cell_size(tolerance: float) -> float:
    return max(1.0, 8 * tolerance)


def pad_track_contacts(pads: DataFrame, tracks: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(u, v) of pads, of any shape and rotation, and round-ended tracks in any direction of one layer whose gap is within the tolerance."""
    if {"shape", "rotation"} & set(pads.columns):
        return copper.near(copper.pad_shapes(pads), copper.track_shapes(tracks), tolerance).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))
    # pads that are all plain boxes need no other shapes
    t = tracks.withColumns({"sx1": F.col("x1"), "sy1": F.col("y1"), "sx2": F.col("x2"), "sy2": F.col("y2")})
    line, box = (tuple(F.col(c) for c in cs) for cs in (("r_sx1", "r_sy1", "r_sx2", "r_sy2"), ("l_x0", "l_y0", "l_x1", "l_y1")))
    touch = segment_box_distance(line, box) - F.col("r_width") / 2 <= tolerance
    return spatial.box_join(pad_boxes(pads), track_boxes(t), cell_size(tolerance), tolerance, exact=touch).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


def track_contacts(tracks: DataFrame, tolerance: float = 0.0) -> DataFrame:
    t = tracks.withColumns({"sx1": F.col("x1"), "sy1": F.col("y1"), "sx2": F.col("x2"), "sy2": F.col("y2")})
    line = lambda p: tuple(F.col(f"{p}_{c}") for c in ("sx1", "sy1", "sx2", "sy2"))
    touch = capsule_gap(line("l"), F.col("l_width"), line("r"), F.col("r_width")) <= tolerance
    return spatial.box_pairs(track_boxes(t), cell_size(tolerance), tolerance, exact=touch).select(F.col("l_id").alias("u"), F.col("r_id").alias("v"))


def attach_drills(pads: DataFrame, drills: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """pads with drill_id and drill (diameter) of the nearest drill within the tolerance, ties by drill id; null without one."""
    near = spatial.nearest(pads.select("id", "x", "y"), drills.select("id", "x", "y", "diameter"), tolerance)
    near = near.select(F.col("l_id").alias("id"), F.col("r_id").alias("drill_id"), F.col("r_diameter").alias("drill"))
    return pads.drop("drill", "drill_id").join(near, "id", "left")


def via_edges(drills: DataFrame, pads: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(u, v, drill_id): pads of different layers that one plated drill with a proven span joins; see copper.via_contacts for all copper."""
    return copper.via_contacts(drills, copper.pad_shapes(pads), tolerance).drop("confidence")


#: So many members of a net are hashed together.
LEAF = 1_000_000


def net_ids(label: DataFrame, sizes: DataFrame) -> DataFrame:
    """(component, net_id), by the sorted members of each group (component, node), of which sizes has member_count.

    The id is made of the members joined by bars; beyond LEAF of them, of the digests of ranges of so many, so that no row holds more.
    """
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "|")
    large = sizes.where(F.col("member_count") > LEAF).select("component")
    named = lambda df: df.groupBy("component").agg(stable_id("net", joined("node")).alias("net_id"))
    if large.isEmpty():
        return named(label)
    out = named(label.join(large, "component", "left_anti"))
    n = windows.numbered(label.join(large, "component").select("component", "node"), ["component", "node"])
    first = n.groupBy("component").agg(F.min("number").alias("first"))
    ranges = n.join(F.broadcast(first), "component").groupBy("component", F.floor((F.col("number") - F.col("first")) / LEAF).alias("at")).agg(F.sha1(joined("node").cast("binary")).alias("digest"))  # a large net is at least LEAF rows, so they are few
    tops = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
    return out.unionByName(ranges.groupBy("component").agg(stable_id("net", F.array_join(tops, "|")).alias("net_id")))


def nets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, net_id, member_count, first_member, confidence) of each connected group; net_id is stable for equal members.

    confidence is that of the weakest via of the group (column confidence of edges), 0.99 at most.
    """
    label = cut(graph.label_components(nodes, edges), "labels", "lz4")
    facts = cut(label.groupBy("component").agg(F.count("*").alias("member_count"), F.min("node").alias("first_member")), "nets", "lz4")
    out = facts.join(net_ids(label, facts), "component")
    if "confidence" in edges.columns:
        weak = edges.join(label.withColumnRenamed("node", "u"), "u").groupBy("component").agg(F.min("confidence").alias("confidence"))
        out = out.join(weak, "component", "left")
    else:
        out = out.withColumn("confidence", F.lit(None).cast("double"))
    return out.select("component", "net_id", "member_count", "first_member", F.least(F.lit(0.99), F.coalesce("confidence", F.lit(0.99))).alias("confidence"))


def solve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components over edges (u, v, confidence); an edge from a node to itself, or of a confidence outside 0 to 1, is refused."""
    bad = edges.where("u = v or not coalesce(confidence between 0 and 1, false)").limit(1).collect()
    if bad:
        raise ValueError(f"invalid edge {bad[0]['u']} - {bad[0]['v']}")
    return graph.label_components(nodes, edges)


def net_labels(members: DataFrame, names: DataFrame) -> DataFrame:
    """(net_id, label, state) from (net_id, member_id) and (member_id, name).

    A net whose members bear one name gets it, several are a conflict; empty and N/C name nothing; a
    name claimed by several nets is withdrawn from all.
    """
    told = members.join(names, "member_id").groupBy("net_id").agg(F.array_sort(F.collect_set(F.trim("name"))).alias("n"))
    told = told.withColumn("n", F.filter("n", lambda x: ~x.isin("", "N/C")))
    one = told.withColumn("label", F.when(F.size("n") == 1, F.col("n")[0]))
    shared = one.where("label is not null").groupBy("label").agg(F.count("*").alias("k")).where("k > 1").select("label", F.lit(True).alias("shared"))
    out = members.select("net_id").distinct().join(one, "net_id", "left").join(shared, "label", "left")
    state = F.when(F.col("shared"), "shared").when(F.size("n") > 1, "conflict").when(F.col("label").isNotNull(), "labelled").otherwise("unlabelled")
    return out.select("net_id", F.when(state == "labelled", F.col("label")).alias("label"), state.alias("state"))
