"""Excellon drill files: tools, hits, slots and routes."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

from tracewright.sources.common import Image, ParseError, UnsupportedFeatureError, arc_points, decode, parse_texts, read_files

WORD = re.compile(r"([A-Z])([+-]?[0-9.]+)")
TOOL = re.compile(r"T(\d+)(?:.*?C([0-9.]+))?")


class Drill:
    """The state of one file. A tool is known by its digits as they stand: T1 and T01 differ."""

    def __init__(self, path: str, strict: bool):
        self.image, self.strict = Image(path), strict
        self.whole, self.fraction, self.zeros, self.scale = 3, 3, "L", None
        self.tools: dict[str, float] = {}
        self.plating: dict[str, str] = {}
        self.file_plating, self.tool = "unknown", None
        self.incremental, self.routing, self.ended = False, None, False
        self.x = self.y = 0.0

    def fail(self, line: int, code: str, message: str) -> None:
        if self.strict:
            raise ParseError(f"line {line}: {message}")
        self.image.warn(line, code, message)
        self.image.drop()

    def number(self, text: str) -> float:
        value = decode(text, self.whole, self.fraction, self.zeros)
        return value * (self.scale or 1.0)

    def at(self, words: dict[str, str]) -> tuple[float, float]:
        x, y = (self.number(words[c]) if c in words else None for c in "XY")
        if self.incremental:
            return self.x + (x or 0.0), self.y + (y or 0.0)
        return self.x if x is None else x, self.y if y is None else y

    def need_tool(self, line: int) -> tuple[str, float]:
        if self.tool is None:
            raise ParseError(f"line {line}: no tool is selected")
        return self.tool, self.tools[self.tool]

    def plated(self, tool: str) -> str:
        return self.plating.get(tool, self.file_plating)

    def run(self, text: str) -> Image:
        header = False
        for line, raw in enumerate(text.splitlines(), 1):
            s = raw.strip()
            if not s:
                continue
            if s.startswith(";"):
                self.comment(s)
            elif self.ended:
                self.fail(line, "INVALID_EXCELLON_DATA_AFTER_M30", "data after the end of the program")
                break
            elif s == "M48":
                header = True
            elif s in ("%", "M95"):
                header = False
            elif s in ("M30", "M00"):
                self.ended = True
            elif s.startswith(("METRIC", "INCH")) or s in ("M71", "M72"):
                metric = s.startswith("METRIC") or s == "M71"
                self.whole, self.fraction, self.scale = (3, 3, 1.0) if metric else (2, 4, 25.4)
                if "," in s:
                    self.zeros = "T" if "LZ" in s.split(",")[1:] else "L"
            elif s.startswith("T") and (m := TOOL.match(s)):
                self.tool_line(line, m[1], m[2], header)
            elif s in ("G90", "ICI,OFF"):
                self.incremental = False
            elif s in ("G91", "ICI", "ICI,ON"):
                self.incremental = True
            elif s in ("G05", "G81"):
                self.routing = None
            elif s.startswith(("X", "Y", "G00", "G01", "G02", "G03", "G85", "M15", "M16", "M17")):
                self.move(line, s)
            elif s.startswith(("FMT", "VER", "ATC", "DETECT", "G93", "R", "M47", "M97")) or header:
                continue
            elif self.strict:
                raise UnsupportedFeatureError(f"line {line}: {s}")
            else:
                self.image.warn(line, "UNKNOWN_EXCELLON_STATEMENT", s)
        if self.routing is not None and len(self.routing) > 1:
            self.end_route(line)
        return self.image

    def comment(self, s: str) -> None:
        """Attributes in comments tell the plating of the file or of the tool defined last."""
        low = s.lower()
        if "#@!" not in low and "type=" not in low:
            return
        told = "non-plated" if re.search(r"nonplated|non-plated|npth", low) else "mixed" if "mixed" in low else "plated" if re.search(r"plated|,pth", low) else None
        if told:
            value = "unknown" if told == "mixed" else told
            if "taperfunction" in low or "ta." in low:
                self.pending = value
            else:
                self.file_plating = value

    def tool_line(self, line: int, digits: str, size: str | None, header: bool) -> None:
        if size is not None and (header or digits not in self.tools):
            if digits in self.tools:
                return self.fail(line, "INVALID_EXCELLON_TOOL_REDEFINITION", f"tool {digits} is defined twice")
            self.tools[digits] = float(size) * (self.scale or 1.0)
            if pending := getattr(self, "pending", None):
                self.plating[digits], self.pending = pending, None
            if header:
                return None
        if digits.strip("0") == "":
            self.tool = None
        elif digits not in self.tools:
            return self.fail(line, "INVALID_EXCELLON_TOOL_SELECTION", f"tool {digits} is not defined")
        else:
            self.tool = digits
        return None

    def move(self, line: int, s: str) -> None:
        if s.startswith("M15"):
            self.need_tool(line)
            self.routing = [(self.x, self.y)]
            return
        if s.startswith(("M16", "M17")):
            if self.routing is not None and len(self.routing) > 1:
                self.end_route(line)
            self.routing = None
            return
        command = s[:3] if s[0] == "G" and not s.startswith("G85") else ""
        rest = s[len(command) :]
        if "G85" in rest:
            first, second = rest.split("G85", 1)
            tool, width = self.need_tool(line)
            a = self.at(dict(WORD.findall(first)))
            words = dict(WORD.findall(second))
            if not {"X", "Y"} & words.keys():
                return self.fail(line, "INVALID_EXCELLON_SLOT", "a slot needs an end")
            self.x, self.y = a
            b = self.at(words)
            self.x, self.y = b
            self.image.add("slot", line, x1=a[0], y1=a[1], x2=b[0], y2=b[1], size_x=width, tool=tool, plating=self.plated(tool))
            return
        words = dict(WORD.findall(rest))
        to = self.at(words)
        if self.routing is not None:
            if command in ("G02", "G03"):
                centre = self.centre(line, (self.x, self.y), to, words, command == "G02")
                if centre is None:
                    return
                self.routing += arc_points((self.x, self.y), to, centre, command == "G02")
            else:
                self.routing.append(to)
        elif command in ("", "G05") and words:
            tool, width = self.need_tool(line)
            self.image.add("drill", line, x1=to[0], y1=to[1], size_x=width, tool=tool, plating=self.plated(tool))
        self.x, self.y = to

    def centre(self, line: int, a: tuple[float, float], b: tuple[float, float], words: dict[str, str], clockwise: bool) -> tuple[float, float] | None:
        if "I" in words or "J" in words:
            return a[0] + (self.number(words["I"]) if "I" in words else 0.0), a[1] + (self.number(words["J"]) if "J" in words else 0.0)
        if "A" not in words:
            self.fail(line, "INVALID_EXCELLON_ARC", "an arc needs a centre or a radius")
            return None
        r, gap = abs(self.number(words["A"])), math.hypot(b[0] - a[0], b[1] - a[1])
        if gap == 0 or gap > 2 * r + 1e-9:
            self.fail(line, "INVALID_EXCELLON_ARC", "no arc of this radius joins the points")
            return None
        # of the two centres the one whose arc is at most half a turn
        h = math.sqrt(max(0.0, r * r - gap * gap / 4))
        side = 1.0 if clockwise else -1.0
        return (a[0] + b[0]) / 2 + side * h * (b[1] - a[1]) / gap, (a[1] + b[1]) / 2 - side * h * (b[0] - a[0]) / gap

    def end_route(self, line: int) -> None:
        tool, width = self.need_tool(line)
        self.image.add("route", line, points=[{"x": x, "y": y} for x, y in self.routing], size_x=width, tool=tool, plating=self.plated(tool))
        self.routing = None


def parse(text: str, path: str = "", strict: bool = True) -> Image:
    return Drill(path, strict).run(text)


def parse_frame(files: DataFrame, strict: bool = True) -> DataFrame:
    return parse_texts(files, parse, strict)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_frame(read_files(spark, path), strict)
