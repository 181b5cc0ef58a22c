"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector o is turned by a fixed random rotation; its code holds the signs, packed, and its correction the inner product
c of o with its own sign vector s (of length 1). For a turned unit query q the inner product is estimated as <s, q> / c, off by no more than
sqrt(1/c^2 - 1) / sqrt(d - 1) times a factor of confidence, but with small probability. A query first ranks the vectors that its codes put
in front by their exact cosine; then every other vector whose estimate plus error bound reaches the k-th best cosine so far is
ranked exactly too.

Equal vectors are one class, of which the ids that can be among the answers stand in the index. Classes are dealt into blocks
by their fingerprint, queries into blocks as well; a task holds one block of codes and streams all query blocks past it, and a second one
merges what the blocks of codes give for a block of queries. Nothing grows with the number of pairs but the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, pieces
from tracewright.llm.embedding_join import turned


@dataclass(frozen=True)
class Settings:
    """k nearest; error bounds of confidence deviations; blocks of about so many vectors and queries.

    2.5 deviations leave out about one in 160 of the vectors that belong among the nearest; the recall on the given tables
    is in the README.
    """

    k: int = 5
    confidence: float = 2.5
    first: int = 16
    block: int = 32_768
    queries: int = 1_024
    seed: int = 11


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of x times powers of two, so that squares neither vanish nor overflow and no digit changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with the same row of y, in double precision, alike wherever the rows stand."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


@dataclass
class Codes:
    """Packed signs of turned unit vectors and their corrections."""

    dim: int
    bits: np.ndarray
    correction: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, seed: int, known: dict[int, np.ndarray]) -> Codes:
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        x = turned(unit, seed, known)
        return Codes(x.shape[1], np.packbits(x >= 0, axis=1), np.abs(x).sum(axis=1) / np.sqrt(x.shape[1]))

    def bounds(self, confidence: float) -> np.ndarray:
        """How far an estimate may be off."""
        c = np.minimum(self.correction, 1.0)
        return confidence * np.sqrt(1 / (c * c) - 1) / np.sqrt(max(self.dim - 1, 1))

    def estimates(self, queries: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Estimated cosines of turned unit queries with the vectors lo to hi."""
        signs = np.unpackbits(self.bits[lo:hi], axis=1, count=self.dim).astype(np.float32)
        signs *= 2
        signs -= 1
        return (queries @ signs.T) / (self.correction[lo:hi] * np.sqrt(self.dim)).astype(np.float32)


def search(codes: Codes, vectors: np.ndarray, queries: np.ndarray, set_: Settings, known: dict[int, np.ndarray], tile: int = 256, wide: int = 4_096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, its vectors in ascending order, their cosines) of those that may be among the k + 1 best here, query by query.

    Whatever ties with the last of them is there too. The tiles bound the memory, whatever the number of vectors that are close.
    """
    top, n = set_.k + 1, len(vectors)
    bound = codes.bounds(set_.confidence).astype(np.float32)
    unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    turned_ = turned(unit, set_.seed, known).astype(np.float32)
    for at in range(0, len(queries), tile):
        here = turned_[at : at + tile]
        estimate = np.concatenate([codes.estimates(here, lo, min(n, lo + wide)) for lo in range(0, n, wide)], axis=1)
        some = min(n, max(set_.first, top))
        front = np.argpartition(-estimate, some - 1, axis=1)[:, :some]
        for k in range(len(here)):
            q = queries[at + k]
            chosen = np.sort(front[k])
            cosine = cosines(np.broadcast_to(q, (len(chosen), len(q))), vectors[chosen])
            least = np.sort(cosine)[-top] if len(cosine) >= top else -np.inf
            rest = estimate[k] + bound >= least - 1e-6
            rest[chosen] = False
            chosen, cosine = [chosen], [cosine]
            more = np.flatnonzero(rest)
            for lo in range(0, len(more), wide):  # a dense neighbourhood is read in parts, and only its best are kept
                part = more[lo : lo + wide]
                c = cosines(np.broadcast_to(q, (len(part), len(q))), vectors[part])
                chosen.append(part)
                cosine.append(c)
                c, part = np.concatenate(cosine), np.concatenate(chosen)
                if len(c) > top:
                    kept = c >= np.partition(c, len(c) - top)[-top]
                    c, part = c[kept], part[kept]
                chosen, cosine = [part], [c]
            order = np.argsort(chosen[0], kind="stable")
            yield at + k, chosen[0][order], cosine[0][order]


def read_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, fp, dim, v) of the rows that take part: v are the components as doubles, in bytes, fp their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4_096):
            ids, fps, dims, vs = [], [], [], []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array([np.nan if c is None else c for c in v] if v else [], dtype=np.float64) + 0.0  # no negative zero
                if key is not None and len(x) and np.isfinite(x).all() and x.any():
                    ids.append(key)
                    dims.append(len(x))
                    vs.append(x.tobytes())
                    fps.append(hashlib.md5(vs[-1]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(dims, pa.int32()), pa.array(vs, pa.binary())], names=["id", "fp", "dim", "v"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id bigint, fp binary, dim int, v binary")


def matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


PACKED = "dim int, qblock int, block int, fps binary, vectors binary, sizes binary, ids binary, scores binary"


def ranked(index: DataFrame, queries: DataFrame, blocks: int, qblocks: int, set_: Settings) -> DataFrame:
    """(fp, ids, scores): the k + 1 nearest of each query vector, nearest first, from index (fp, dim, v, ids) and queries (fp, dim, v)."""
    by = lambda n: F.pmod(F.xxhash64("fp"), F.lit(n)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query rows, sorted by length and block, into one row for each block."""
        at, rows = None, []

        def close() -> pa.RecordBatch:
            cols = [[at[0]], [at[1]], [b"".join(r[0] for r in rows)], [b"".join(r[1] for r in rows)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["dim", "qblock", "fps", "vectors"])

        for batch in batches:
            for dim, block, fp, v in zip(*(batch.column(c).to_pylist() for c in ("dim", "qblock", "fp", "v")), strict=True):
                if rows and (at != (dim, block) or len(rows) >= 2 * set_.queries):
                    yield close()
                    rows = []
                at = dim, block
                rows.append((fp, v))
        if rows:
            yield close()

    asked = queries.withColumn("qblock", by(qblocks)).select("dim", "qblock", "fp", "v")
    asked = asked.repartition(qblocks, "qblock").sortWithinPartitions("dim", "qblock", "fp").mapInArrow(pack, "dim int, qblock int, fps binary, vectors binary")
    nothing = {c: F.lit(None) for c in ("fp", "v", "ids", "fps", "vectors")}
    held = index.withColumns({"block": by(blocks), "kind": F.lit(0), "qblock": F.lit(0)} | {c: nothing[c].cast("binary") for c in ("fps", "vectors")})
    sent = asked.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1), "fp": nothing["fp"].cast("binary"), "v": nothing["v"].cast("binary"), "ids": nothing["ids"].cast("array<bigint>")})
    names = ["dim", "block", "kind", "qblock", "fp", "v", "ids", "fps", "vectors"]
    streams = held.select(names).unionByName(sent.select(names)).repartition(blocks, "block").sortWithinPartitions("block", "dim", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First the vectors of a block, then the queries: one row with what the block has for each block of queries."""
        at, known, rows = None, {}, []
        codes = vectors = sizes = ids = None
        for batch in batches:
            for dim, block, kind, qblock, v, members, fps, asked_ in zip(*(batch.column(c).to_pylist() for c in ("dim", "block", "kind", "qblock", "v", "ids", "fps", "vectors")), strict=True):
                if at != (dim, block):
                    at, rows, codes = (dim, block), [], None
                if kind == 0:
                    rows.append((v, members))
                    continue
                if not rows and codes is None:
                    continue
                if codes is None:
                    vectors = scaled(matrix([r[0] for r in rows]))
                    sizes = np.array([len(r[1]) for r in rows])
                    ids = np.array([i for r in rows for i in r[1]], dtype=np.int64)
                    firsts = np.cumsum(sizes) - sizes
                    codes, rows = Codes.of(vectors, set_.seed, known), []
                counts, found, scores = [], [], []
                for _, near, cosine in search(codes, vectors, scaled(matrix([asked_]).reshape(-1, dim)), set_, known):
                    own = np.concatenate([ids[firsts[k] : firsts[k] + sizes[k]] for k in near])
                    score = np.repeat(cosine, sizes[near])
                    kept = best(score, own, set_.k + 1)
                    counts.append(len(kept))
                    found.append(own[kept])
                    scores.append(score[kept])
                cols = [[dim], [qblock], [block], [fps], [None], [np.array(counts, dtype="<i4").tobytes()], [np.concatenate(found).astype("<i8").tobytes()], [np.concatenate(scores).astype("<f8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.binary()] * 5, strict=True)], names=["dim", "qblock", "block", "fps", "vectors", "sizes", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of all blocks for one block of queries after another; the best so far is all that is held."""
        at, state = None, None

        def close() -> Iterator[pa.RecordBatch]:
            fps = [at[2][k : k + 16] for k in range(0, len(at[2]), 16)]
            for lo in range(0, len(fps), 1_000):
                part = slice(lo, lo + 1_000)
                yield pa.RecordBatch.from_arrays([pa.array(fps[part], pa.binary()), pa.array([i.tolist() for i, _ in state[part]], pa.list_(pa.int64())), pa.array([s.tolist() for _, s in state[part]], pa.list_(pa.float64()))], names=["fp", "ids", "scores"])

        for batch in batches:
            for dim, qblock, fps, sizes, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("dim", "qblock", "fps", "sizes", "ids", "scores")), strict=True):
                edges = np.cumsum(np.frombuffer(sizes, dtype="<i4"))[:-1]
                new = list(zip(np.split(np.frombuffer(ids, dtype="<i8"), edges), np.split(np.frombuffer(scores, dtype="<f8"), edges), strict=True))
                if at != (dim, qblock, fps):
                    if at is not None:
                        yield from close()
                    at, state = (dim, qblock, fps), new
                    continue
                for k, (i, s) in enumerate(new):
                    i, s = np.concatenate([state[k][0], i]), np.concatenate([state[k][1], s])
                    kept = best(s, i, set_.k + 1)
                    state[k] = i[kept], s[kept]
        if at is not None:
            yield from close()

    parts = streams.mapInArrow(scan, PACKED).select("dim", "qblock", "fps", "sizes", "ids", "scores")
    parts = parts.repartition(qblocks, "qblock").sortWithinPartitions("dim", "qblock", "fps")
    return parts.mapInArrow(merge, "fp binary, ids array<bigint>, scores array<double>")


def nearest(df: DataFrame, is_query: Column, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows of greatest cosine of each row of df for which is_query, a condition on id, holds.

    Candidates are all rows but those of the query's own id, and of the same number of components. Ties go to the smaller id; fewer
    candidates than k are all returned. A null, empty or zero vector, one with a null or non-finite component, and a row with a null id
    take no part. Rows that repeat an id are one, the one of the least fingerprint. Further columns are not carried;
    an empty table gives none. Vectors of any length fit; a block holds fewer of long ones.
    """
    set_ = settings
    rows = read_vectors(df, id_col, vector_col)
    rows = rows.groupBy("id").agg(F.min(F.struct("fp", "dim", "v")).alias("r")).select("id", "r.*")
    vectors = cut(rows.withColumn("asked", F.coalesce(is_query, F.lit(False))), "search-vectors", "snappy")
    order = F.row_number().over(Window.partitionBy("fp").orderBy("id"))  # the ids of a class that can be answers; each task keeps no more
    index = vectors.withColumn("n", order).where(F.col("n") <= set_.k + 1)
    index = index.groupBy("fp").agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    index = cut(index, "search-index", "snappy")
    queries = cut(vectors.where("asked").groupBy("fp").agg(F.first("dim").alias("dim"), F.first("v").alias("v")), "search-queries", "snappy")
    size = index.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    asked = queries.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    room = max(1, set_.block * 64 // max(64, size["dim"] or 0))
    blocks = max(1, -(-size["n"] // room), min(2 * cores, -(-size["n"] // 512)))
    found = cut(ranked(index, queries, blocks, max(1, -(-asked // set_.queries)), set_), "search-found", "snappy")
    own = vectors.where("asked").select(F.col("id").alias("query_id"), "fp").join(found, "fp")
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    out = own.select("query_id", F.posexplode(F.slice(pairs, 1, set_.k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.ids").alias(id_col), F.col("x.scores").alias("score"))


def embeddings(df: DataFrame) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(df, F.col("id") % 50 == 0)
