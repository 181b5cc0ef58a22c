"""The tables of a board, as explicit schemas; readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


_PROVENANCE = "prov struct<sources:array<struct<path:string,line:int,raw:string>>,evidence:array<struct<kind:string,detail:string,confidence:double,source:string>>>"
_RING = "array<struct<x:double,y:double>>"

TRACKS = _table(f"id string, x1 double, y1 double, x2 double, y2 double, width double, layer string, net_id string, {_PROVENANCE}")
PADS = _table(f"id string, x double, y double, size_x double, size_y double, shape string, layer string, drill double, net_id string, {_PROVENANCE}")
DRILLS = _table(f"id string, x double, y double, diameter double, plating string, tool string, from_layer string, to_layer string, span_proven boolean, {_PROVENANCE}")
SLOTS = _table(f"id string, x1 double, y1 double, x2 double, y2 double, width double, plating string, tool string, {_PROVENANCE}")
ROUTES = _table(f"id string, points {_RING}, width double, plating string, tool string, {_PROVENANCE}")
REGIONS = _table(f"id string, points {_RING}, holes array<{_RING}>, layer string, net_id string, {_PROVENANCE}")
OUTLINE = _table(f"id string, ord bigint, x1 double, y1 double, x2 double, y2 double, {_PROVENANCE}")
NETS = _table("net_id string, members array<string>, confidence double, label string")
NET_MEMBERS = _table("net_id string, member_id string")
COMPONENTS = _table("id string, pad_ids array<string>, kind string, confidence double, evidence array<string>, reference string, package_hint string, pin_map map<string,string>, pin_functions map<string,string>")
PIN_EDGES = _table("component_id string, pin_id string, net_id string")
EVIDENCE = _table("id string, object_id string, kind string, confidence double, source string, detail string, group_key string")
CLAIMS = _table("subject_id string, field string, value string, source string, confidence double, independent_group string, ord bigint")
ISSUES = _table("source string, severity string, code string, message string, object_ids array<string>")
DIAGNOSTICS = _table("severity string, code string, message string, path string, line int")
EVENTS = _table("seq bigint, kind string, message string, source string, object_id string, data map<string,string>")
SNAPSHOTS = _table("id string, parent_id string, payload string, sha256 string, label string")
CANDIDATES = _table("id string, kind string, confidence double, evidence array<string>, assumptions array<string>")

BOARD = {
    "tracks": TRACKS, "pads": PADS, "drills": DRILLS, "slots": SLOTS, "routes": ROUTES, "regions": REGIONS, "outline": OUTLINE,
    "nets": NETS, "net_members": NET_MEMBERS, "components": COMPONENTS, "pin_edges": PIN_EDGES, "evidence": EVIDENCE, "claims": CLAIMS,
    "issues": ISSUES, "diagnostics": DIAGNOSTICS, "events": EVENTS, "snapshots": SNAPSHOTS,
}
