"""Input packages: a folder, one file, a ZIP or a TAR, read within limits."""

from __future__ import annotations

import io
import stat
import tarfile
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS, BYTES = 20_000, 2 << 30


class PackageError(ValueError):
    """An archive that is refused."""


def safe_name(name: str) -> str:
    """A member's path, refused where it leaves the archive."""
    path = PurePosixPath(name.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts or not path.parts or ":" in path.parts[0]:
        raise PackageError(f"unsafe path {name!r}")
    return str(path)


def members(data: bytes, most: int = MEMBERS, most_bytes: int = BYTES) -> list[tuple[str, bytes]]:
    """(path, content) of the files of a ZIP or TAR, in order of path.

    Refused: links, devices, encrypted or repeated members, paths that leave the archive, and more
    members or bytes than the limits, counted as read and not as announced.
    """
    out: dict[str, bytes] = {}
    total = 0

    def take(name: str, stream) -> None:
        nonlocal total
        path = safe_name(name)
        if path in out:
            raise PackageError(f"{path} occurs twice")
        if len(out) >= most:
            raise PackageError(f"more than {most} members")
        content = stream.read(most_bytes - total + 1)
        total += len(content)
        if total > most_bytes:
            raise PackageError(f"more than {most_bytes} bytes")
        out[path] = content

    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                if info.flag_bits & 1:
                    raise PackageError(f"{info.filename} is encrypted")
                mode = info.external_attr >> 16
                if mode and not stat.S_ISREG(mode) and stat.S_IFMT(mode):
                    raise PackageError(f"{info.filename} is not a file")
                with z.open(info) as f:
                    take(info.filename, f)
    else:
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for info in t:
                    if info.isdir():
                        continue
                    if not info.isreg():
                        raise PackageError(f"{info.name} is not a file")
                    take(info.name, t.extractfile(info))
        except tarfile.TarError as error:
            raise PackageError("neither a ZIP nor a TAR") from error
    return sorted(out.items())


def unpack(files: DataFrame) -> DataFrame:
    """(path, content as text) of rows (path, content as bytes): the members of archives, and other files as they are."""
    import pandas as pd

    def run(parts):
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                packed = name.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz"))
                rows = [(f"{name}!/{p}", c) for p, c in members(content)] if packed else [(name, content)]
                yield pd.DataFrame([(p, c.decode("utf-8", "replace")) for p, c in rows], columns=["path", "content"])

    return files.select("path", F.col("content")).mapInPandas(run, "path string, content string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """unpack() of the files under a path; archives are unpacked in the tasks."""
    return unpack(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
