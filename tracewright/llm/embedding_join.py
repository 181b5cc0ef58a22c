"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are turned by a fixed rotation and split into blocks of equal dimension. If two vectors
are within squared distance 2 (1 - t), then in some block they are within that block's share of it
(the pigeonhole), so the union of the block joins misses nothing. Each block join is a range join on a
grid over the block's first coordinates, of cells twice as wide as the block radius: a vector lives in
one cell and visits the lower-numbered cells that its ball touches. A pair counts in the first block whose
budget it meets, once the cosine of the vectors as given, in double precision, is verified.

The vectors are dealt into chunks of bounded size, and each two chunks meet in one task, which joins them on all
blocks. In a round each chunk meets one other (those whose numbers add up to the round, by the count of chunks), so
a round sends every vector once; the cleaner is told to drop its shuffle files before the next few rounds, so the disk needed is a
multiple of the vectors, whatever their number. A task returns one row per vector (links and the least vector that they
lead to), never the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import components, cut, drop, pieces, roots
from tracewright.storage import new_folder, release


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    blocks: int = 4
    grid: int = 3
    chunk: int = 16384
    seed: int = 7
    #: Rows of 64 components that a few rounds send at once, if one round sends fewer.
    at_once: int = 1_000_000


#: Up to this dimension a rotation is a matrix.
DENSE = 512


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def turned(x: np.ndarray, seed: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """The rows of x rotated; long ones by signs, a Fourier transform and a shuffle, three times, without a matrix."""
    dim = x.shape[1]
    if dim <= DENSE:
        if dim not in known:
            known[dim] = rotation(dim, seed)
        return x @ known[dim].T
    rng = np.random.default_rng([seed, dim])
    for _ in range(3):
        f = np.fft.rfft(x * rng.choice([-1.0, 1.0], dim), axis=1, norm="ortho")
        inner = f[:, 1 : (dim + 1) // 2] * np.sqrt(2)
        ends = [f[:, :1].real, *([f[:, -1:].real] if dim % 2 == 0 else [])]
        x = np.concatenate([*ends, inner.real, inner.imag], axis=1)[:, rng.permutation(dim)]
    return x


def budgets(dim: int, set_: Settings) -> list[tuple[int, int, float]]:
    """(from, to, squared distance) of each block: shares in proportion to dimension, with room for rounding."""
    m = min(set_.blocks, dim)
    ends = [round(k * dim / m) for k in range(m + 1)]
    whole = 2 * (1 - set_.threshold)
    return [(a, b, whole * (b - a) / dim * (1 + 1e-9) + 1e-12) for a, b in zip(ends, ends[1:], strict=False)]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """The rows of dim components that read_vectors() has packed, as doubles."""
    x = np.empty((len(blobs), dim))
    for k, blob in enumerate(blobs):
        x[k] = np.frombuffer(blob, dtype=np.float32 if len(blob) == 4 * dim else np.float64)
    return x


def read_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, fp, dim, v): the vector as given, in single precision if that is exact; fp of its unit vector. Null where it can't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in pieces(batches, 4096):
            col = batch.column(1)
            lens = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values, starts = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(lens) - lens
            fps, blobs = [None] * len(col), [None] * len(col)
            for dim in np.unique(lens[lens > 0]):
                mine = np.flatnonzero(lens == dim)
                x = values[starts[mine][:, None] + np.arange(dim)].astype(np.float64)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                mine, x = mine[good], x[good]
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                exact = (short == x).all(axis=1)
                for at, given, single, brief, unit in zip(mine, x, short, exact, unit_rows(x), strict=True):
                    fps[at], blobs[at] = hashlib.md5(unit.tobytes()).digest(), (single if brief else given).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(lens, pa.int32()), pa.array(blobs, pa.binary())], names=["id", "fp", "dim", "v"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id bigint, fp binary, dim int, v binary")


def cells_of(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) for each row of points: its home cell, then the lower cells that a ball around it touches."""
    width, n = 2 * radius, len(x)
    home = np.floor(x / width).astype(np.int64)
    rows, cells = [np.arange(n)], [home]
    for offset in itertools.product((-1, 0, 1), repeat=x.shape[1]):
        if offset >= (0,) * len(offset):
            continue  # only cells below the home cell, in order of coordinates
        cell = home + np.array(offset)
        gap = np.maximum(np.maximum(cell * width - x, x - (cell + 1) * width), 0)
        touched = np.flatnonzero((gap * gap).sum(axis=1) <= radius * radius * (1 + 1e-9))
        rows.append(touched)
        cells.append(cell[touched])
    at = np.concatenate(rows)
    return at, np.concatenate(cells), np.arange(len(at)) < n


def close_pairs(left: np.ndarray, right: np.ndarray | None, limit: float, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the squared distance: of left and right, or inside left (i < j), at most so many at once.

    Single precision with slack; the caller verifies.
    """
    y = left if right is None else right
    one = lambda z: np.ones((len(z), 1), dtype=np.float32)
    size = lambda z: (z * z).sum(axis=1, keepdims=True)
    of_x, of_y = np.hstack([left, size(left), one(left)]), np.hstack([-2 * y, one(y), size(y)]).T  # their product is the squared distance
    slack, tile = np.float32(limit * (1 + 1e-5) + 1e-5), max(1, min(1024, most // max(1, len(y))))
    for at in range(0, len(left), tile):
        i, j = np.divmod(np.flatnonzero(of_x[at : at + tile] @ of_y <= slack), len(y))
        i += at
        if right is None:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j


def grid_pairs(x: np.ndarray, first: np.ndarray | None, limit: float, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x within about the squared distance, by the grid: inside x, or of those that are first with the others."""
    at, cells, home = cells_of(x[:, :grid], limit**0.5)
    order = np.lexsort(cells.T)
    at, cells, home = at[order], cells[order], home[order]
    starts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
    ends = np.append(starts[1:], len(at))
    lives = np.add.reduceat(home.astype(np.int64), starts)
    x = x.astype(np.float32)
    for k in np.flatnonzero((lives > 0) & (ends - starts > 1)):
        rows, own = at[starts[k] : ends[k]], home[starts[k] : ends[k]]
        if first is None:
            meetings = [(rows[own], None), (rows[own], rows[~own])]
        else:
            one = first[rows]
            meetings = [(rows[own & one], rows[~one]), (rows[own & ~one], rows[~own & one])]
        for left, right in meetings:
            if len(left) and (right is None or len(right)):
                for i, j in close_pairs(x[left], None if right is None else x[right], limit):
                    yield left[i], (left if right is None else right)[j]


def linked_pairs(units: np.ndarray, first: np.ndarray | None, set_: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows (as in grid_pairs) whose cosine reaches the threshold, each once."""
    x = turned(units, set_.seed, {})
    shares = budgets(x.shape[1], set_)
    step = max(1, 65536 * 64 // max(64, x.shape[1]))
    for k, (a, b, limit) in enumerate(shares):
        for i, j in grid_pairs(x[:, a:b], first, limit, set_.grid):
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                gap = (x[p] - x[q]) ** 2
                met = gap[:, a:b].sum(axis=1) <= limit
                for f, t, share in shares[:k]:
                    met &= gap[:, f:t].sum(axis=1) > share
                p, q = p[met], q[met]
                good = (units[p] * units[q]).sum(axis=1) >= set_.threshold
                if good.any():
                    yield p[good], q[good]


def join(df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept for every row of df.

    Vectors of equal length in components are compared; equal vectors form one class and are expanded
    again at the end. A null, empty or zero vector, or one with a null or non-finite component, links
    with nothing. A row with a null id is not compared: it has no links, no component, and is kept.
    Rows that repeat an id are one node. Further columns are not carried; an empty table gives none.
    """
    set_ = settings
    spark = df.sparkSession
    read = cut(read_vectors(df, id_col, vector_col), "vectors", "snappy")
    usable = read.where("id is not null and fp is not null")
    # vectors of one fingerprint have one unit vector, so that any of them will do
    reps = usable.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct("dim", "v")).alias("x")).select("fp", "rep", "copies", "x.*")
    reps = cut(reps, "vector-classes", "snappy")
    vectors = cut(read.select("id", "fp"), "vector-ids", "snappy")
    drop(read)
    classes = reps.select("fp", "rep", "copies")
    # long vectors stand in smaller chunks; a small table in a few chunks, for the sake of all cores
    chunks = F.greatest(F.ceil(F.col("n") * F.greatest("dim", F.lit(64)) / (64 * set_.chunk)), F.least(F.lit(8), F.ceil(F.col("n") / 512)))
    sizes = cut(reps.groupBy("dim").agg(F.count("*").alias("n")).select("dim", "n", chunks.cast("int").alias("chunks")), "vector-sizes", "snappy")
    size = sizes.agg(F.sum(F.col("n") * F.greatest("dim", F.lit(64)) / 64).alias("n"), F.max("chunks").alias("chunks"), F.sum(F.col("chunks") * (F.col("chunks") + 1) / 2).alias("units")).first()
    rounds = size["chunks"] or 0
    step = max(1, min(rounds, int(set_.at_once / (size["n"] or 1))))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        dim, low, high = (group.column(c)[0].as_py() for c in ("dim", "low", "high"))
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        first = None if low == high else group.column("own").to_numpy() == low
        units = unit_rows(matrix(group.column("v").to_pylist(), dim))
        links, label, found, waiting = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep)), [], 0

        def fold() -> np.ndarray:
            i, j = (np.concatenate(side) for side in zip(*found, strict=True))
            for p, q in ((i, j), (j, i)):
                np.add.at(links, p, copies[q])
            found.clear()
            return roots(len(rep), np.concatenate([np.arange(len(rep)), i]), np.concatenate([label, j]))

        for pair in linked_pairs(units, first, set_):
            found.append(pair)
            waiting += len(pair[0])
            if waiting > 1 << 20:
                label, waiting = fold(), 0
        if found:
            label = fold()
        some = np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[label[some]]})

    held = reps.join(F.broadcast(sizes.select("dim", "chunks")), "dim").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    schema, folder = "rep bigint, links bigint, root bigint", new_folder(spark, "vector-links")
    spark.createDataFrame([], schema).write.parquet(folder)
    for at in range(0, rounds, step):
        last = F.least(F.lit(at + step), F.col("chunks")) - 1
        sent = held.where(F.col("chunks") > at).withColumn("round", F.explode(F.sequence(F.lit(at), last))).withColumn("other", F.pmod(F.col("round") - F.col("own"), F.col("chunks")))
        sent = sent.select("dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "v")
        tasks = max(1, int(size["units"] * step // rounds))
        sent.repartition(tasks, "dim", "low", "high").groupBy("dim", "low", "high").applyInArrow(compare, schema).write.mode("append").parquet(folder)
        release(spark)
    linked = spark.read.schema(schema).parquet(folder)
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = vectors.select("id", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp")).join(known, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
