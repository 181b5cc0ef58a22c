"""Import of mixed files: the format is detected, checked against what was expected, and handed to its reader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources import excellon, formats, gerber, tables

Reader = Callable[[DataFrame], DataFrame]

# In which order formats are taken, and what part they play.
PRIORITY = {"ipc356": 10, "gerber": 20, "excellon": 30, "kicad_board": 40, "kicad_schematic": 50, "csv": 60, "json": 70, "unknown": 99}
OTHER_PRIORITY = 90
ROLES = {"gerber": "manufacturing", "excellon": "drill", "ipc356": "electrical_test", "kicad_board": "design_board", "kicad_schematic": "design_schematic", "csv": "tabular", "json": "structured"}


def _looked_up(format_: Column, names: dict, otherwise: object) -> Column:
    out = F.lit(otherwise)
    for name, value in names.items():
        out = F.when(format_ == name, value).otherwise(out)
    return out


def priority(format_: Column) -> Column:
    return _looked_up(format_, PRIORITY, OTHER_PRIORITY)


def role(format_: Column) -> Column:
    return _looked_up(format_, ROLES, "unknown")


@dataclass
class Adapters:
    """Readers by format: each takes rows (path, content) and returns a table."""

    readers: dict[str, Reader] = field(default_factory=dict)

    def add(self, format_: str, reader: Reader) -> None:
        if format_ in self.readers:
            raise ValueError(f"duplicate adapter {format_}")
        self.readers[format_] = reader

    def formats(self) -> list[str]:
        return sorted(self.readers)


def default_adapters() -> Adapters:
    out = Adapters()
    lines = lambda files: files.select("path", F.explode(F.split("content", r"\r?\n")).alias("value"))
    out.add("gerber", lambda files: gerber.parse_frame(files, strict=False))
    out.add("excellon", lambda files: excellon.parse_frame(files, strict=False))
    out.add("ipc356", lambda files: tables.ipc356(lines(files)))
    out.add("kicad_board", tables.kicad)
    out.add("kicad_schematic", tables.schematics)
    out.add("csv", lines)
    out.add("json", lambda files: files.select("path", F.try_parse_json("content").alias("value")))
    return out


def requests(files: DataFrame, adapters: Adapters, text_col: str = "content") -> DataFrame:
    """(path, format, role, priority, success, diagnostic) of each file (path, content, and expected, if known).

    A file of another format than expected is no success, nor one of a format without a reader, without a
    path or without a text.
    """
    found = files.join(formats.detect(files, text_col).withColumnRenamed("path", "__path"), F.col("path").eqNullSafe(F.col("__path"))).drop("__path")
    expected = F.col("expected") if "expected" in files.columns else F.lit(None).cast("string")
    wrong = (F.coalesce(expected, F.lit("")) != "") & (F.col("format") != expected)
    why = F.when(F.coalesce("path", F.lit("")) == "", "IMPORT_PATH_EMPTY").when(F.col(text_col).isNull(), "IMPORT_TEXT_NONE").when(wrong, F.concat(F.lit("FORMAT_MISMATCH:"), expected, F.lit(":"), F.col("format"))).when(~F.col("format").isin(adapters.formats()), "NO_ADAPTER")
    return found.select("path", "format", role(F.col("format")).alias("role"), priority(F.col("format")).alias("priority"), why.isNull().alias("success"), why.alias("diagnostic"), F.col(text_col).alias("content"))


def import_files(files: DataFrame, adapters: Adapters | None = None, text_col: str = "content") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The report on all files in order of priority and path, and the table of each format's reader."""
    adapters = adapters or default_adapters()
    asked = requests(files, adapters, text_col)
    good = {f: adapters.readers[f](asked.where(F.col("success") & (F.col("format") == f)).select("path", "content")) for f in adapters.formats()}
    return asked.drop("content").orderBy("priority", "path"), good


def summary(report: DataFrame) -> DataFrame:
    """(format, total, passed, failed)."""
    ok = F.count(F.when(F.col("success"), 1))
    return report.groupBy("format").agg(F.count("*").alias("total"), ok.alias("passed"), (F.count("*") - ok).alias("failed"))
