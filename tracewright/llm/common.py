"""What the corpus operators share: text batches, word hashing, links inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.graph import components
from tracewright.storage import cut, drop, drop_tables, few_files, release, shared_folder

__all__ = ["WordHashes", "components", "cut", "drop", "drop_tables", "few_files", "mix", "pieces", "release", "repeated", "roots", "shared_folder", "shingles", "windows"]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about size bytes at most, so that Python never holds many long texts at once."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def repeated(df: DataFrame, n: Column, out: str, most: int = 10_000) -> DataFrame:
    """Each row of df n times, numbered from 0 in the column out; a row of more than most copies is made by several tasks."""
    names = [F.col(f"`{c}`") for c in df.columns]
    few = df.where(n <= most).select(*names, F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias(out))
    parts = df.where(n > most).select(*names, n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / most))).alias("__part"))
    spread = parts.repartition(F.xxhash64("__part", *df.columns))
    many = spread.select(*names, F.explode(F.sequence(F.col("__part") * most, F.least(F.col("__n"), (F.col("__part") + 1) * most) - 1)).alias(out))
    return few.where(n > 0).unionByName(many)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are few enough."""

    LIMIT = 200_000  # some 30 MB

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in order; a shorter text is one run of all its words, an empty one none."""
    if len(h) == 0:
        return h
    if len(h) < n:
        n, h = len(h), h.copy()
    s = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix(s + np.uint64(n))


def shingles(words: list[str], hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    return np.unique(windows(hashes.of(words), n))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links (i, j) lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label
