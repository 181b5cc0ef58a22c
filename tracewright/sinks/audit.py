"""A board against what its file says when it is read back, section by section.

Every section is a bag of rows on both sides: what the board must give, by the export plan, and what stands in the file, by expressions over the
nodes of its forms. So a value that changed, an object that is lost, and anything that somebody put in are seen alike. A section that nothing of the
board may fill expects no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.board import Board
from tracewright.operators.rules import union
from tracewright.sinks import kicad
from tracewright.sources.forms import child, inner, number, word, words
from tracewright.storage import cut

SECTIONS = [
    "file_header", "file_structure", "board_settings", "layer_table", "net_table", "tracks", "vias", "track_arcs", "board_outline",
    "unexpected_edge_graphics", "unexpected_copper_graphics", "unexpected_footprint_copper_graphics", "unexpected_fabrication_graphics", "unexpected_copper_overrides", "unexpected_fabrication_overrides",
    "unexpected_pad_properties", "unexpected_net_tie_groups", "foreign_footprints", "recovered_drills", "recovered_pads", "copper_regions", "region_geometry", "region_fill_state", "region_rules",
    "recovered_slots", "slot_geometry", "recovered_routes",
]

#: Footprints that a recovered board has are named by one of these and an id.
OWN = ["recovered", "component", "hole", "slot", "route"]
# Words of the file format.
STRUCTURE = ["general", "paper", "layers", "setup"]
COPPER_OVERRIDES = ["clearance", "zone_connect", "thermal_width", "thermal_gap", "thermal_bridge_width", "thermal_bridge_angle", "remove_unused_layers", "keep_end_layers", "zone_layer_connections"]
FABRICATION_OVERRIDES = ["solder_mask_margin", "solder_paste_margin", "solder_paste_margin_ratio", "solder_paste_ratio", "tenting", "covering", "plugging", "filling", "capping"]
ROUTED = ["start", "end", "mid", "width", "layer", "net", "uuid", "tstamp"]
VIA = ["at", "size", "drill", "layers", "net", "uuid", "tstamp"]
ZONE = ["net", "net_name", "layer", "layers", "uuid", "tstamp", "polygon", "fill", "filled_polygon"]
PAD = ["at", "size", "drill", "layers", "net", "pinfunction", "uuid", "tstamp"]


def six(v: Column) -> Column:
    return F.coalesce(F.format_string("%.6f", F.round(v.cast("double"), 6) + F.lit(0.0)), F.lit(""))


def said(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit(""))


def rows(df: DataFrame, section: str, *values: Column) -> DataFrame:
    return df.select(*[c for c in ("board",) if c in df.columns], F.lit(section).alias("section"), F.concat_ws("|", *values).alias("row"))


def flow(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """A segment without direction, to six decimals."""
    swap = (x2 < x1) | (x2 == x1) & (y2 < y1)
    return [six(F.when(swap, b).otherwise(a)) for a, b in ((x1, x2), (y1, y2), (x2, x1), (y2, y1))]


def told(node: Column) -> Column:
    """A list as text: its head and atoms."""
    return F.concat_ws(" ", node["head"], F.array_join(words(node), " "))


def others(known: list[str], within: str | Column = "nodes", parent: Column | int = 0) -> Column:
    """Lists, in a list, of heads that are not among the known ones, as one text."""
    return F.array_join(F.array_sort(F.transform(F.filter(within, lambda x: (x["parent"] == parent) & ~F.coalesce(x["head"].isin(known), F.lit(False))), told)), ";")


def _each(df: DataFrame, section: str, found: Column, *before: Column) -> DataFrame:
    """One row for each text of an array."""
    return df.select("board", *[c.alias(f"b{k}") for k, c in enumerate(before)], F.explode(found).alias("v")).select("board", F.lit(section).alias("section"), F.concat_ws("|", *[F.col(f"b{k}") for k in range(len(before))], "v").alias("row"))


def observed(formed: DataFrame) -> DataFrame:
    """(board, section, row) of the forms of board files; the forms are written once, as every section reads them."""
    formed = cut(formed, "forms", free=False)
    top = formed.where("level = 1")
    form = lambda *heads: top.where(F.col("head").isin(*heads))
    own = F.get("nodes", F.lit(0))
    nets = form("net").select("board", word(own, 0).alias("code"), word(own, 1).alias("net_name"))
    known = nets.groupBy("board", "code").agg(F.min("net_name").alias("net_name"))
    netted = lambda df, code: df.withColumn("code", code).join(known, ["board", "code"], "left").withColumn("net", F.when(F.col("code") == "0", "").otherwise(F.coalesce("net_name", F.concat(F.lit("?"), "code"), F.lit("?"))))
    count = lambda head: F.count(F.when((F.col("level") == 1) & (F.col("head") == head), 1))
    at = lambda head, k=0: word(child(head), k)
    spot = lambda head: [number(child(head), k) for k in (0, 1)]
    only = lambda head, value: F.array_join(F.array_sort(F.collect_list(F.when((F.col("level") == 1) & (F.col("head") == head), value))), ",")
    structure = formed.groupBy("board").agg(
        only("version", word(own)).alias("version"), only("generator", word(own)).alias("generator"), *[count(h).alias(h) for h in STRUCTURE], only("paper", word(own)).alias("paper_name"),
        F.count(F.when((F.col("level") == 0) & (F.col("head") == "("), 1)).alias("opened"), F.count(F.when((F.col("level") == 0) & ~F.col("head").isin("(", ")"), 1)).alias("outside"), only("kicad_pcb", F.col("head")).alias("root"),
    )
    segments = netted(form("segment"), at("net"))
    vias = netted(form("via"), at("net"))
    arcs = netted(form("arc"), at("net"))
    zones = netted(form("zone"), at("net"))
    graphics = top.where(F.col("head").startswith("gr_")).withColumn("layer", at("layer"))
    edge = graphics.where("layer = 'Edge.Cuts'")
    drawn = lambda node: F.concat_ws("|", node["head"], said(word(child("layer", "nodes", node["node"]))), F.array_join(words(node), " "))
    is_copper, is_fabrication = (lambda layer, suffixes=suffixes: F.coalesce(F.exists(F.array(*map(F.lit, suffixes)), lambda s: layer.endswith(s)), F.lit(False)) for suffixes in ([".Cu"], [".Mask", ".Paste"]))

    footprints = form("footprint", "module").withColumns({"name": word(own), "family": F.substring_index(word(own), ":", 1), "side": at("layer")})
    mine = footprints.where(F.col("family").isin(OWN))
    inside = lambda test: F.transform(F.filter("nodes", lambda x: (x["parent"] == 0) & (x["head"].startswith("fp_") | (x["head"] == "zone")) & test(word(child("layer", "nodes", x["node"])))), drawn)
    ox, oy = spot("at")
    turn = F.radians(F.coalesce(number(child("at"), 2), F.lit(0.0)))
    reference = F.get(F.filter("nodes", lambda x: (x["parent"] == 0) & (x["head"] == "property") & (word(x) == "Reference")), F.lit(0))
    pads = mine.select("board", "name", "family", "side", ox.alias("ox"), oy.alias("oy"), turn.alias("turn"), F.coalesce(word(reference, 1), F.lit("")).alias("reference"), F.explode(inner("pad")).alias("p")).select("*", F.col("p.own").alias("own"), F.col("p.nodes").alias("nodes")).drop("p")
    here = F.col("own")["node"]
    of = lambda head, k=0: word(child(head, "nodes", here), k)
    size = lambda head, k=0: number(child(head, "nodes", here), k)
    px = F.coalesce(size("at", 0), F.lit(0.0))
    py = F.when(F.col("side") == "B.Cu", -1.0).otherwise(1.0) * F.coalesce(size("at", 1), F.lit(0.0))
    pads = pads.withColumns({
        "x": F.col("ox") + px * F.cos("turn") + py * F.sin("turn"), "y": F.col("oy") - px * F.sin("turn") + py * F.cos("turn"), "angle": F.coalesce(size("at", 2), F.lit(0.0)),
        "pad_net": F.coalesce(of("net", 1), F.lit("")), "kind": word(F.col("own"), 1), "shape": word(F.col("own"), 2), "number": word(F.col("own"), 0), "uuid": said(of("uuid")), "on": F.array_join(words(child("layers", "nodes", here)), " "),
    })
    pads = netted(pads, F.coalesce(of("net", 0), F.lit("0"))).withColumn("net", F.when(F.col("net") == F.col("pad_net"), F.col("net")).otherwise(F.concat("net", F.lit("!"), "pad_net")))
    listed = lambda heads: F.transform(F.filter("nodes", lambda x: (x["parent"] == 0) & x["head"].isin(heads)), told)
    listed_in_pad = lambda heads: F.transform(F.filter("nodes", lambda x: (x["parent"] == here) & x["head"].isin(heads)), told)
    properties = F.transform(F.filter("nodes", lambda x: (x["parent"] == here) & ~x["head"].isin(PAD + COPPER_OVERRIDES + FABRICATION_OVERRIDES)), told)
    rings = F.transform(F.filter("nodes", lambda x: x["head"] == "pts"), lambda p: F.array_join(F.transform(F.filter("nodes", lambda x: (x["parent"] == p["node"]) & (x["head"] == "xy")), lambda q: F.concat(six(number(q, 0)), F.lit(","), six(number(q, 1)))), " "))
    drawn_rings = F.array_join(F.slice(rings, F.lit(1), F.size(F.filter("nodes", lambda x: (x["parent"] == 0) & (x["head"] == "polygon")))), ";")
    hole, slot, route = (pads.where(F.col("family") == f) for f in ("hole", "slot", "route"))
    shape_of = lambda: [six(F.col("x")), six(F.col("y")), said(F.col("kind")), said(F.col("shape")), six(F.col("angle")), six(size("size", 0)), six(size("size", 1)), said(F.array_join(words(child("drill", "nodes", here)), " ")), said(F.col("on")), F.col("net")]
    return union(
        rows(structure, "file_header", F.col("version"), F.col("generator")),
        rows(structure, "file_structure", *[F.col(h).cast("string") for h in STRUCTURE], F.col("paper_name"), F.col("root"), F.col("opened").cast("string"), F.col("outside").cast("string")),
        _each(form("general", "setup"), "board_settings", F.transform(F.filter("nodes", lambda x: x["node"] > 0), lambda x: F.concat_ws(" ", x["head"], F.array_join(F.transform(words(x), lambda w: F.coalesce(six(w.try_cast("double")), w)), " "))), F.col("head")),
        _each(form("layers"), "layer_table", F.transform(F.filter("nodes", lambda x: x["parent"] == 0), told)),
        rows(nets, "net_table", said(F.col("code")), said(F.col("net_name"))),
        rows(segments, "tracks", *flow(*spot("start"), *spot("end")), six(number(child("width"))), said(at("layer")), F.col("net"), said(at("uuid")), F.array_join(words(own), " "), others(ROUTED)),
        rows(vias, "vias", *map(six, spot("at")), six(number(child("size"))), six(number(child("drill"))), said(F.array_join(words(child("layers")), " ")), F.array_join(words(own), " "), F.col("net"), said(at("uuid")), others(VIA)),
        rows(arcs, "track_arcs", *map(six, [*spot("start"), *spot("mid"), *spot("end")]), said(at("layer")), F.col("net"), said(at("uuid"))),
        rows(edge.where("head = 'gr_line'"), "board_outline", *flow(*spot("start"), *spot("end")), six(number(child("width"))), said(at("uuid")), others(ROUTED)),
        rows(edge.where("head <> 'gr_line'"), "unexpected_edge_graphics", drawn(own)),
        rows(graphics.where(is_copper(F.col("layer"))), "unexpected_copper_graphics", drawn(own)),
        _each(footprints, "unexpected_footprint_copper_graphics", inside(is_copper), F.col("name")),
        union(rows(graphics.where(is_fabrication(F.col("layer"))), "unexpected_fabrication_graphics", drawn(own)), _each(footprints, "unexpected_fabrication_graphics", inside(is_fabrication), F.col("name"))),
        union(_each(mine, "unexpected_copper_overrides", listed(COPPER_OVERRIDES), F.col("name")), _each(pads, "unexpected_copper_overrides", listed_in_pad(COPPER_OVERRIDES), F.col("name"), F.col("number"))),
        union(_each(mine, "unexpected_fabrication_overrides", listed(FABRICATION_OVERRIDES), F.col("name")), _each(pads, "unexpected_fabrication_overrides", listed_in_pad(FABRICATION_OVERRIDES), F.col("name"), F.col("number"))),
        _each(pads, "unexpected_pad_properties", properties, F.col("name"), F.col("number")),
        _each(mine, "unexpected_net_tie_groups", listed(["net_tie_pad_groups"]), F.col("name")),
        rows(footprints.where(~F.coalesce(F.col("family").isin(OWN), F.lit(False))), "foreign_footprints", said(F.col("name")), said(F.col("side"))),
        rows(hole, "recovered_drills", F.col("name"), *shape_of()),
        rows(pads.where("family in ('recovered', 'component')"), "recovered_pads", F.col("name"), F.col("reference"), said(F.col("side")), F.col("number"), F.coalesce(of("pinfunction"), F.lit("")), *shape_of(), F.col("uuid")),
        rows(zones, "copper_regions", said(at("uuid")), said(at("layer")), F.col("net")),
        rows(zones, "region_geometry", said(at("uuid")), said(drawn_rings)),
        rows(zones, "region_fill_state", said(at("uuid")), F.when(child("fill").isNull(), "").otherwise(told(child("fill"))), F.size(F.filter("nodes", lambda x: (x["parent"] == 0) & (x["head"] == "filled_polygon"))).cast("string")),
        rows(zones, "region_rules", said(at("uuid")), others(ZONE)),
        rows(slot, "recovered_slots", F.col("name"), said(F.col("kind")), said(F.col("on")), F.col("net")),
        rows(slot, "slot_geometry", F.col("name"), *shape_of()[:2], *shape_of()[3:8]),
        rows(route, "recovered_routes", F.col("name"), *shape_of()),
    )


def expected(board: Board, planned: dict[str, DataFrame]) -> DataFrame:
    """(section, row) of what the file of the board must hold."""
    layers = kicad.copper_layers(board)
    nets = kicad.net_rows(board["nets"])
    names = nets.select("net_id", F.col("name").alias("net"))
    net = lambda df: df.join(names, "net_id", "left").withColumn("net", F.coalesce("net", F.lit("")))
    one = board["nets"].sparkSession.range(1)
    head = [("file_header", "20240108|tracewright"), ("file_structure", "1|1|1|1|A4|kicad_pcb|1|0"), ("board_settings", "general|thickness 1.600000"), ("board_settings", "setup|pad_to_mask_clearance 0.000000"), ("net_table", "0|")]
    table = [("layer_table", text.strip(" ()").replace('"', "")) for text in kicad.head(layers) if text.startswith("    (")]
    found = [one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(r).alias("row")) for s, r in head + table]))), rows(nets, "net_table", F.col("code").cast("string"), F.col("name"))]
    out = lambda name, status: planned[name].where(F.col("status") == status)
    own = lambda kind, key="id": kicad.uuid(kind, F.col(key))
    c, nil = F.col, F.lit("")
    if "tracks" in planned:
        found.append(rows(net(out("tracks", "export")), "tracks", *flow(c("x1"), c("y1"), c("x2"), c("y2")), six(c("width")), c("layer"), c("net"), own("track"), nil, nil))
    if "vias" in planned:
        found.append(rows(net(out("vias", "export")), "vias", six(c("x")), six(c("y")), six(c("size")), six(c("drill")), F.concat_ws(" ", "from_layer", "to_layer"), F.when(c("via_type") == "through", "").otherwise("blind"), c("net"), own("via", "drill_id"), nil))
    if "outline" in planned:
        found.append(rows(out("outline", "export"), "board_outline", *flow(c("x1"), c("y1"), c("x2"), c("y2")), six(F.lit(0.05)), own("outline"), nil))
    npth = lambda df, family, sizes, angle, shape, drill: rows(df, f"recovered_{family}s", F.concat(F.lit(f"{family}:"), "id"), six(c("x")), six(c("y")), F.lit("np_thru_hole"), F.lit(shape), angle, *sizes, drill, F.lit("*.Cu *.Mask"), nil)
    if "drills" in planned:
        d = six(c("diameter"))
        found.append(npth(out("drills", "export-npth"), "hole", [d, d], six(F.lit(0.0)), "circle", d).withColumn("section", F.lit("recovered_drills")))
    long, wide = six(c("long")), six(c("width"))
    if "slots" in planned:
        slots = kicad.laid(out("slots", "export-npth"))
        found.append(rows(slots, "recovered_slots", F.concat(F.lit("slot:"), "id"), F.lit("np_thru_hole"), F.lit("*.Cu *.Mask"), nil))
        found.append(rows(slots, "slot_geometry", F.concat(F.lit("slot:"), "id"), six(c("x")), six(c("y")), F.lit("oval"), six(c("turn")), long, wide, F.concat_ws(" ", F.lit("oval"), long, wide)))
    if "routes" in planned:
        found.append(npth(kicad.laid(kicad.straight(out("routes", "export-npth"))), "route", [long, wide], six(c("turn")), "oval", F.concat_ws(" ", F.lit("oval"), long, wide)))
    pad = lambda df, name, reference, side, number, function, angle, key: rows(df, "recovered_pads", name, reference, side, number, function, six(c("x")), six(c("y")), F.lit("smd"), kicad.pad_shape(), angle, six(c("size_x")), six(c("size_y")), nil, c("layer"), c("net"), own("pad", key))
    if "pads" in planned:
        single = net(out("pads", "export"))
        angle = six(F.coalesce("rotation", F.lit(0.0)) if "rotation" in single.columns else F.lit(0.0))
        found.append(pad(single, F.concat(F.lit("recovered:"), "id"), nil, c("layer"), F.lit("1"), nil, angle, "id"))
    if "components" in planned:
        named = planned["components"].where("status = 'export'").select("component_id", "reference")
        grouped = net(kicad.grouped_pads(board, planned)).join(named, "component_id")
        found.append(pad(grouped, F.concat(F.lit("component:"), "component_id"), c("reference"), c("side"), c("number"), F.coalesce("function", nil), six(c("local_rotation")), "pad_id"))
    if "regions" in planned:
        regions = net(out("regions", "export"))
        ring = F.array_join(F.transform(F.slice("points", F.lit(1), F.size("points") - 1), lambda p: F.concat(six(p["x"]), F.lit(","), six(p["y"]))), " ")
        found += [rows(regions, "copper_regions", own("region"), c("layer"), c("net")), rows(regions, "region_geometry", own("region"), ring), rows(regions, "region_fill_state", own("region"), nil, F.lit("0")), rows(regions, "region_rules", own("region"), nil)]
    return union(*found)


def compare(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """(section, expected, observed, missing, unexpected, equal) of all sections; rows count as often as they stand there.

    Where both sides name boards, each board has its own sections.
    """
    key = ["board"] if "board" in wanted.columns and "board" in seen.columns else []
    bags = union(wanted.select(*key, "section", "row", F.lit(1).alias("a"), F.lit(0).alias("b")), seen.select(*key, "section", "row", F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(*key, "section", "row").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    per = bags.groupBy(*key, "section").agg(F.sum("a").alias("expected"), F.sum("b").alias("observed"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("unexpected"))
    boards = per.select(*key).distinct() if key else wanted.sparkSession.range(1)
    every = boards.select(*key, F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    return every.join(per, [*key, "section"], "left").na.fill(0).withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def audit(board: Board, formed: DataFrame, planned: dict[str, DataFrame] | None = None) -> DataFrame:
    """compare() of a board with the forms of its file."""
    return compare(expected(board, planned or kicad.plan(board)), observed(formed))


def verdict(compared: DataFrame, planned: dict[str, DataFrame]) -> DataFrame:
    """(roundtrip_equal, source_equivalent): every section equal; and nothing of the source left out besides."""
    lost = union(*[df.where("status not like 'export%'").select(F.lit(1).alias("lost")) for name, df in planned.items() if name != "components"])
    return compared.agg(F.bool_and("equal").alias("roundtrip_equal")).crossJoin(lost.agg(F.count("*").alias("n"))).select("roundtrip_equal", (F.col("roundtrip_equal") & (F.col("n") == 0)).alias("source_equivalent"))


__all__ = ["SECTIONS", "audit", "compare", "expected", "observed", "verdict"]
