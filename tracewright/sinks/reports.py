"""Exchange files and reports. Large tables are written by Spark; documents of report size are built on the driver."""

from __future__ import annotations

import json
from xml.etree import ElementTree as X

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroid(placements: DataFrame) -> DataFrame:
    """Lines of a centroid file, without the header: six decimals, in order of reference."""
    six = lambda c: F.format_string("%.6f", F.col(c))
    return placements.select(F.col("reference").alias("Reference"), six("x").alias("X_mm"), six("y").alias("Y_mm"), six("rotation").alias("Rotation_deg"), F.col("side").alias("Side"), F.col("footprint").alias("Footprint"), F.col("value").alias("Value")).orderBy("Reference")


def write_centroid(placements: DataFrame, path: str) -> None:
    centroid(placements).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def star_edges(members: DataFrame) -> DataFrame:
    """(source, target): from the first member of each net to all others, by (net_id, member_id, ord)."""
    first = members.groupBy("net_id").agg(F.min_by("member_id", "ord").alias("source"))
    return members.join(first, "net_id").where("member_id <> source").select("net_id", "ord", "source", F.col("member_id").alias("target"))


def graphml(members: DataFrame, most: int = 100_000) -> str:
    """Nets as a GraphML graph; refused beyond most members, as it is one document."""
    edges, nodes = _rows(star_edges(members).orderBy("net_id", "ord"), most), _rows(members.select("member_id").distinct().orderBy("member_id"), most)
    root = X.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    graph = X.SubElement(root, "graph", edgedefault="undirected", id="G")
    for n in nodes:
        X.SubElement(graph, "node", id=n["member_id"])
    for i, e in enumerate(edges):
        X.SubElement(graph, "edge", id=f"e{i}", source=e["source"], target=e["target"])
    return X.tostring(root, encoding="unicode")


def svg(tracks: DataFrame, pads: DataFrame, padding: float = 2.0, most: int = 100_000) -> str:
    t, p = _rows(tracks.select("x1", "y1", "x2", "y2", "width").orderBy("x1", "y1", "x2", "y2", "width"), most), _rows(pads.select("x", "y", "size_x", "size_y").orderBy("x", "y", "size_x", "size_y"), most)
    xs = [v for r in t for v in (r["x1"], r["x2"])] + [v for r in p for v in (r["x"] - r["size_x"] / 2, r["x"] + r["size_x"] / 2)]
    ys = [v for r in t for v in (r["y1"], r["y2"])] + [v for r in p for v in (r["y"] - r["size_y"] / 2, r["y"] + r["size_y"] / 2)]
    root = X.Element("svg", xmlns="http://www.w3.org/2000/svg")
    if xs:
        root.set("viewBox", f"{min(xs) - padding} {min(ys) - padding} {max(xs) - min(xs) + 2 * padding} {max(ys) - min(ys) + 2 * padding}")
    for r in t:
        X.SubElement(root, "line", {"x1": str(r["x1"]), "y1": str(r["y1"]), "x2": str(r["x2"]), "y2": str(r["y2"]), "stroke": "black", "stroke-width": str(r["width"])})
    for r in p:
        X.SubElement(root, "rect", {"x": str(r["x"] - r["size_x"] / 2), "y": str(r["y"] - r["size_y"] / 2), "width": str(r["size_x"]), "height": str(r["size_y"]), "fill": "none", "stroke": "black"})
    return X.tostring(root, encoding="unicode")


def _xml(c: Column) -> Column:
    out = c.cast("string")
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(name))
    return out


def _put(df: DataFrame, place: int, key: Column | str, *parts: Column | str) -> DataFrame:
    """(place, key, line): lines of one part of a document."""
    return df.select(F.lit(place).alias("place"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("line"))


def _fixed(df: DataFrame, place: int, text: str) -> DataFrame:
    return _put(df.sparkSession.range(1), place, F.lit(""), text)


def _together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graphml_lines(members: DataFrame) -> DataFrame:
    """graphml() of any size, as lines (place, key, line)."""
    nodes = members.select("member_id").distinct()
    edges = star_edges(members)
    return _together(
        _fixed(members, 0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected" id="G">'),
        _put(nodes, 1, "member_id", '<node id="', _xml(F.col("member_id")), '" />'),
        _put(edges, 2, F.concat_ws("|", "net_id", F.lpad(F.col("ord").cast("string"), 19, "0")), '<edge source="', _xml(F.col("source")), '" target="', _xml(F.col("target")), '" />'),
        _fixed(members, 3, "</graph></graphml>"),
    )


def svg_lines(tracks: DataFrame, pads: DataFrame, padding: float = 2.0) -> DataFrame:
    """svg() of any size, as lines (place, key, line); only the frame is known beforehand, by one aggregate."""
    corners = tracks.select(F.least("x1", "x2").alias("x0"), F.greatest("x1", "x2").alias("x1"), F.least("y1", "y2").alias("y0"), F.greatest("y1", "y2").alias("y1"))
    corners = corners.unionByName(pads.select((F.col("x") - F.col("size_x") / 2).alias("x0"), (F.col("x") + F.col("size_x") / 2).alias("x1"), (F.col("y") - F.col("size_y") / 2).alias("y0"), (F.col("y") + F.col("size_y") / 2).alias("y1")))
    box = corners.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    view = F.when(F.col("x0").isNull(), "").otherwise(F.concat(F.lit(' viewBox="'), F.concat_ws(" ", F.col("x0") - padding, F.col("y0") - padding, F.col("x1") - F.col("x0") + 2 * padding, F.col("y1") - F.col("y0") + 2 * padding), F.lit('"')))
    key = lambda *cs: F.concat_ws("|", *[F.format_string("%020.6f", F.col(c)) for c in cs])
    return _together(
        _put(box, 0, F.lit(""), '<svg xmlns="http://www.w3.org/2000/svg"', view, ">"),
        _put(tracks, 1, key("x1", "y1", "x2", "y2"), '<line x1="', F.col("x1"), '" y1="', F.col("y1"), '" x2="', F.col("x2"), '" y2="', F.col("y2"), '" stroke="black" stroke-width="', F.col("width"), '" />'),
        _put(pads, 2, key("x", "y"), '<rect x="', F.col("x") - F.col("size_x") / 2, '" y="', F.col("y") - F.col("size_y") / 2, '" width="', F.col("size_x"), '" height="', F.col("size_y"), '" fill="none" stroke="black" />'),
        _fixed(tracks, 3, "</svg>"),
    )


def markdown_lines(issues: DataFrame, counts: dict[str, int]) -> DataFrame:
    """markdown() of any size, as lines (place, key, line)."""
    top = ["# Board report", "", "## Object counts", *[f"- {k}: {v}" for k, v in sorted(counts.items())], "", "## Findings"]
    none = issues.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return _together(_fixed(issues, 0, "\n".join(top)), _put(issues, 1, F.concat_ws("|", "severity", "code", "message"), "- **", F.upper("severity"), " ", F.col("code"), "**: ", F.col("message")), _put(none, 2, F.lit(""), "- none"))


def junit_lines(issues: DataFrame, suite: str = "checks") -> DataFrame:
    """junit() of any size, as lines (place, key, line)."""
    n = issues.agg(F.count("*").alias("n"), F.count(F.when(F.col("severity") == "error", 1)).alias("bad"))
    case = F.when(F.col("severity") == "error", F.concat(F.lit('"><failure message="'), _xml(F.col("message")), F.lit('" /></testcase>'))).otherwise('" />')
    return _together(
        _put(n, 0, F.lit(""), '<testsuite name="', _xml(F.lit(suite)), '" tests="', F.greatest("n", F.lit(1)), '" failures="', F.col("bad"), '">'),
        _put(issues, 1, F.concat_ws("|", "code", "message"), '<testcase name="', _xml(F.col("code")), case),
        _put(n.where("n = 0"), 1, F.lit(""), '<testcase name="all" />'),
        _fixed(issues, 2, "</testsuite>"),
    )


def document(lines: DataFrame) -> str:
    """Lines (place, key, line) as one text on the driver, for documents that fit there."""
    return "\n".join(r["line"] for r in lines.orderBy("place", "key", "line").collect()) + "\n"


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (place, key, line) as text files whose names are in order: together they are the document."""
    lines.repartitionByRange("place", "key", "line").sortWithinPartitions("place", "key", "line").select("line").write.mode("overwrite").text(path)


def canonical_json(df: DataFrame, order: list[str], most: int = 100_000) -> str:
    rows = [json.loads(r["j"]) for r in _rows(df.select(F.to_json(F.struct(*[df[c] for c in df.columns])).alias("j"), *order).orderBy(*order), most)]
    return json.dumps(rows, sort_keys=True, separators=(",", ":"))


def write_bundle(tables: dict[str, DataFrame], path: str, validation: DataFrame | None = None) -> None:
    """Each table as Parquet in a folder of its own, and the findings as JSON lines in the folder validation."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    if validation is not None:
        write_ndjson(validation.orderBy("severity", "code", "message"), f"{path.rstrip('/')}/validation")


def canonical_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(value) one JSON object a row, keys in order of name, rows in order: canonical JSON of any size."""
    return df.orderBy(*order).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("value"))


def ndjson_rows(lines: DataFrame, schema: str) -> DataFrame:
    """The rows of JSON lines (value)."""
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(issues: DataFrame, counts: dict[str, int], most: int = 10_000) -> str:
    rows = _rows(issues.orderBy("severity", "code", "message"), most)
    lines = ["# Board report", "", "## Object counts", *[f"- {k}: {v}" for k, v in sorted(counts.items())], "", "## Findings"]
    lines += [f"- **{r['severity'].upper()} {r['code']}**: {r['message']}" for r in rows] or ["- none"]
    return "\n".join(lines) + "\n"


def junit(issues: DataFrame, suite: str = "checks", most: int = 10_000) -> str:
    rows = _rows(issues.orderBy("code", "message"), most)
    root = X.Element("testsuite", name=suite, tests=str(len(rows) or 1), failures=str(sum(r["severity"] == "error" for r in rows)))
    for r in rows:
        case = X.SubElement(root, "testcase", name=r["code"])
        if r["severity"] == "error":
            X.SubElement(case, "failure", message=r["message"])
    if not rows:
        X.SubElement(root, "testcase", name="all")
    return X.tostring(root, encoding="unicode")


def _rows(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: too many for one document")
    return rows
