"""A driver-side graph of named steps whose results are DataFrames, run in order and remembered by fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Node:
    name: str
    requires: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None
    cacheable: bool = True


@dataclass
class Result:
    artifacts: dict[str, DataFrame]
    executed: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)


class Dag:
    def __init__(self, nodes: list[Node] = ()):
        self.nodes: dict[str, Node] = {}
        for node in nodes:
            self.add(node)

    def add(self, node: Node) -> None:
        if node.name in self.nodes:
            raise ValueError(f"duplicate step {node.name}")
        taken = {p for n in self.nodes.values() for p in n.produces}
        if clash := taken & set(node.produces):
            raise ValueError(f"already produced: {sorted(clash)}")
        self.nodes[node.name] = node

    def parents(self) -> dict[str, set[str]]:
        maker = {p: n.name for n in self.nodes.values() for p in n.produces}
        return {n.name: {maker[r] for r in n.requires if r in maker and maker[r] != n.name} for n in self.nodes.values()}

    def order(self) -> list[str]:
        """Steps after all that they need; those that are ready together by name."""
        left, out = self.parents(), []
        while left:
            ready = sorted(n for n, needs in left.items() if not needs & left.keys())
            if not ready:
                raise ValueError("pipeline dependency cycle")
            out += ready
            for n in ready:
                del left[n]
        return out

    def impacted(self, changed: list[str]) -> list[str]:
        """The changed steps and all that follow from them."""
        parents, seen = self.parents(), set(changed)
        for name in self.order():
            if parents[name] & seen:
                seen.add(name)
        return sorted(seen)

    def execute(self, given: dict[str, DataFrame] | None = None, cache: Cache | None = None, version: str = "1", stop_on_error: bool = True) -> Result:
        """Run all steps; one without its inputs is skipped, one found in the cache is read, not run."""
        out, prints = Result(dict(given or {})), {k: f"given:{k}" for k in given or {}}
        for name in self.order():
            node = self.nodes[name]
            if node.run is None or any(r not in out.artifacts for r in node.requires):
                out.skipped.append(name)
                continue
            key = fingerprint(node, {r: prints[r] for r in node.requires}, version)
            if cache is not None and node.cacheable and (found := cache.get(key)) is not None:
                out.artifacts |= found
                out.skipped.append(name)
            else:
                try:
                    made = node.run({r: out.artifacts[r] for r in node.requires}) or {}
                    if cache is not None and node.cacheable:
                        made = cache.put(key, made)
                    out.artifacts |= made
                    out.executed.append(name)
                except Exception as error:  # a step's failure is a result of the run
                    out.failed.append((name, f"{type(error).__name__}: {error}"))
                    if stop_on_error:
                        break
                    continue
            prints |= {p: f"{key}:{p}" for p in node.produces}
        return out


def fingerprint(node: Node, inputs: dict[str, str], version: str = "1") -> str:
    text = json.dumps([node.name, list(node.requires), list(node.produces), inputs, version], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


class Cache:
    """Parquet tables under a shared folder, one folder for each fingerprint."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, key: str) -> list[str] | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        return [s.getPath().getName() for s in fs.listStatus(path)]

    def get(self, key: str) -> dict[str, DataFrame] | None:
        names = self._names(key)
        return None if names is None or "_done" not in names else {n: self.spark.read.parquet(f"{self.folder}/{key}/{n}") for n in names if n != "_done"}

    def put(self, key: str, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{key}/{name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/{key}/_done")
        return self.get(key)
