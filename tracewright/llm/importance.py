"""Quality selection by importance resampling (Xie et al., 2023).

Two generative models of hashed word n-grams, of target texts (labelled good) and of all texts, give
each text the log ratio of its probabilities as importance weight. Adding Gumbel noise to the weights
and keeping the k largest sums samples k texts without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WordHashes, cut, pieces, repeated, windows


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    n: int = 2
    #: Share of all rows to keep; None takes the share of labelled texts that are good.
    keep: float | None = None
    smoothing: float = 1.0
    seed: int = 5
    cells: int = 4096
    #: So many rows at most are ranked in one task, but for rows of different ids whose draws are equal.
    edge_rows: int = 20_000
    #: The target model is fitted on so many labelled texts at most, those of least hash; the other covers all texts.
    target_rows: int = 20_000


def buckets_of(text: str | None, hashes: WordHashes, set_: Settings) -> np.ndarray:
    """The bucket of every n-gram of 1 to n lower-cased words, in order of n."""
    h = hashes.of(text.lower().split()) if text else np.zeros(0, dtype=np.uint64)
    grams = [windows(h, k) for k in range(1, set_.n + 1) if len(h) >= k]
    return (np.concatenate(grams) % np.uint64(set_.buckets)).astype(np.int64) if grams else np.zeros(0, dtype=np.int64)


def counts(df: DataFrame, set_: Settings) -> np.ndarray:
    """(2, buckets): n-grams of the target rows and of all rows of (text, target), summed inside each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), np.zeros((2, set_.buckets), dtype=np.int64)
        for batch in pieces(batches):
            for text, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.bincount(buckets_of(text, hashes, set_), minlength=set_.buckets)
                total[1] += c
                if target:
                    total[0] += c
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], names=["b", "t", "r"])

    out = np.zeros((2, set_.buckets), dtype=np.int64)
    for row in df.mapInArrow(run, "b int, t bigint, r bigint").groupBy("b").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).collect():
        out[:, row["b"]] = row["t"], row["r"]
    return out


def select(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, log_weight, draw (weight plus noise) and kept for every row of df.

    k is keep times the number of rows, rounded up; without labels all rows are kept. The noise depends on the id and the seed alone, so
    the sample repeats; equal draws are ordered by id. A null or empty text has weight 0 (neither model
    favours it). Repeated rows share their draw and are kept in any order. A label with a null id or value is
    ignored; without target texts the weights are those of the smoothed models. Further columns are
    not carried; an empty table gives none.
    """
    set_ = settings
    good = labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("id")).where("id is not null").distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(set_.target_rows).withColumn("target", F.lit(True))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(F.broadcast(good), "id", "left")  # target_rows short rows at most
    both = counts(marked.select("text", F.coalesce("target", F.lit(False)).alias("target")), set_).astype(np.float64)
    smooth = both + set_.smoothing
    ratio = np.log(smooth[0] / smooth[0].sum()) - np.log(smooth[1] / smooth[1].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            w = [float(ratio[buckets_of(t, hashes, set_)].sum()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(w, pa.float64())], names=["id", "log_weight"])

    u = (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(set_.seed)), 11).cast("double") + 0.5) / float(2**53)
    weighted = rows.mapInArrow(run, "id bigint, log_weight double").withColumn("draw", F.col("log_weight") - F.log(-F.log(u)))
    weighted = cut(weighted, "weights", "snappy")
    low, high, n = weighted.agg(F.min("draw"), F.max("draw"), F.count("*")).first()
    share = set_.keep
    if share is None:
        share = labels.where("doc_id is not null").agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
    k = math.ceil((1.0 if share is None else share) * n)
    if k >= n:
        return weighted.select(F.col("id").alias(id_col), "log_weight", "draw", F.lit(True).alias("kept"))
    # narrow the range of draws that holds the k-th, by cells, until few different rows are left in it
    rest, inside = k, n
    while inside > set_.edge_rows and low < high:
        width = (high - low) / set_.cells
        cell = F.least(F.floor((F.col("draw") - low) / width), F.lit(set_.cells - 1)).cast("int")
        cells = weighted.where(F.col("draw").between(low, high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("draw").alias("low"), F.max("draw").alias("high"))
        for c in sorted(cells.collect(), key=lambda c: -c["c"]):  # at most set_.cells rows
            if rest <= c["n"]:
                break
            rest -= c["n"]
        if (c["low"], c["high"]) == (low, high):
            break
        low, high, inside = c["low"], c["high"], c["n"]
    edge = F.col("draw").between(low, high)
    # rows that repeat are ranked as one and dealt out again
    once = weighted.where(edge).groupBy("id", "log_weight", "draw").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("draw").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = repeated(once.withColumn("room", rest - before), F.col("n"), "copy").select("id", "log_weight", "draw", (F.col("copy") < F.col("room")).alias("kept"))
    outside = weighted.where(~edge).withColumn("kept", F.col("draw") > high)
    return dealt.unionByName(outside).select(F.col("id").alias(id_col), "log_weight", "draw", "kept")
