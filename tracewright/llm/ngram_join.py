"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

1. Each text becomes the set of its word 5-grams and a MinHash signature; texts with equal sets form
   one class, of which a single member goes on.
2. Classes that agree on a band of the signature are candidates (32 bands of 4 values: a pair of
   similarity 0.8 is missed with probability 5e-8). Band groups are not expanded into pairs. Every
   class joins the lowest class within two steps of shared bands; such a neighbourhood is split by hash
   into blocks of bounded classes and n-grams, and a work unit is a pair of blocks that some band touches.
3. Inside a unit candidates are compared 16 MinHash values at a time. After n comparisons with m
   agreements the similarity has posterior Beta(m + 1, n - m + 1) under a uniform prior; a pair whose
   posterior probability of reaching the threshold falls under the tolerance is dropped.
4. The rest is verified exactly on the n-gram sets, which are made once for each class with a candidate
   and shipped in binary. A unit returns one row per class: its number of links and the least class that
   they lead to inside the unit. A near-copy group of g classes in b blocks ships its sets about b times
   and compares its g (g - 1) / 2 pairs in memory, as counting its links asks for; rows stay g b.
5. Components of these rows are the duplicate groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WordHashes, components, cut, drop, few_files, mix, pieces, roots, shingles


@dataclass(frozen=True)
class Settings:
    n: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    block: int = 512
    block_grams: int = 400_000

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> np.ndarray:
        return mix(np.arange(1, 2 * self.size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)

    def least_matches(self) -> dict[int, int]:
        """For each number of comparisons the least agreements that keep a pair alive."""
        out = {}
        for n in range(self.step, self.size + 1, self.step):
            tail, m = 0.0, 0
            while m <= n:  # P(similarity >= t) = P(Binomial(n + 1, t) <= m)
                tail += comb(n + 1, m) * self.threshold**m * (1 - self.threshold) ** (n + 1 - m)
                if tail >= self.tolerance:
                    break
                m += 1
            out[n] = m
        return out


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def minhash(s: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    a, b = multipliers[0] | np.uint64(1), multipliers[1]
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(s), 512):
        np.minimum(out, ((s[at : at + 512, None] * a + b) >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    k = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), k.shape[:2])
    for r in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + k[:, :, r])
    return h


def signatures(df: DataFrame, set_: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fp, n, sig) of every row; h is of the text, fp of the n-gram set, null for a text without words and where the id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        hashes, mult = WordHashes(), set_.multipliers()
        for batch in pieces(batches):
            fps, counts, sigs = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(words_of(text), hashes, set_.n)
                counts.append(len(s))
                fps.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sigs.append(minhash(s, mult).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary()), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary())], names=["id", "h", "fp", "n", "sig"])

    rows = keyed(df, id_col, text_col).select("id", "h", F.when(F.col("id").isNotNull(), F.col("text")).alias("text"))
    return rows.mapInArrow(run, "id bigint, h bigint, fp binary, n int, sig binary")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): h tells rows of one id apart by their texts."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def candidate_pairs(a: np.ndarray, b: np.ndarray | None, set_: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows that share a band: of a and b, or of a with itself (i < j)."""
    ka = band_keys(a, set_.bands, set_.rows)
    kb = ka if b is None else band_keys(b, set_.bands, set_.rows)
    hit = np.zeros((len(ka), len(kb)), dtype=bool)
    for band in range(set_.bands):
        hit |= ka[:, band][:, None] == kb[:, band][None, :]
    return np.nonzero(np.triu(hit, 1) if b is None else hit)


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, set_: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Compare MinHash values step by step and drop pairs whose posterior falls under the tolerance."""
    least = set_.least_matches()
    out_i, out_j = [], []
    for at in range(0, len(i), 65536):
        x, y = i[at : at + 65536], j[at : at + 65536]
        same = np.zeros(len(x), dtype=np.int32)
        for k in range(0, set_.size, set_.step):
            same += (a[x, k : k + set_.step] == b[y, k : k + set_.step]).sum(axis=1, dtype=np.int32)
            alive = same >= least[k + set_.step]
            x, y, same = x[alive], y[alive], same[alive]
        out_i.append(x)
        out_j.append(y)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def verify(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of sets reach the threshold, counted exactly."""
    if not len(i):
        return np.zeros(0, dtype=bool)
    used = np.unique(np.concatenate([i, j]))
    flat = np.concatenate([sets[k] for k in used])
    names, ids = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.zeros(len(sets), dtype=np.int64)
    starts[used] = np.concatenate([[0], np.cumsum(sizes[used])[:-1]])
    mark, ok = np.zeros(len(names), dtype=np.int32), np.zeros(len(i), dtype=bool)
    order = np.argsort(i, kind="stable")
    edges = np.flatnonzero(np.diff(i[order], prepend=-1))
    for k, at in enumerate(edges):
        rows = order[at : edges[k + 1] if k + 1 < len(edges) else len(order)]
        own = i[rows[0]]
        mine = ids[starts[own] : starts[own] + sizes[own]]
        mark[mine] = 1
        for part in range(0, len(rows), 256):
            some = rows[part : part + 256]
            lengths = sizes[j[some]]
            ends = np.cumsum(lengths)
            where = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts[j[some]], lengths)
            both = np.add.reduceat(mark[ids[where]], ends - lengths)
            ok[some] = both >= threshold * (sizes[own] + lengths - both) - 1e-9
        mark[mine] = 0
    return ok


def sets_of(docs: DataFrame, set_: Settings) -> DataFrame:
    """(node, copies, sig, grams) of rows (node, copies, sig, text): the n-gram set as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches):
            grams = [shingles(words_of(t), hashes, set_.n).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.binary())], names=["node", "copies", "sig", "grams"])

    return docs.select("node", "copies", "sig", "text").mapInArrow(run, "node bigint, copies bigint, sig binary, grams binary")


def deal_blocks(members: DataFrame, nodes: DataFrame, set_: Settings) -> DataFrame:
    """(node, lead, chunk): the block of every class that shares a band, from (key, node) and (node, n).

    lead is the lowest class within two steps of shared bands. A neighbourhood is split by hash so that
    a block has about set_.block classes and set_.block_grams n-grams; a class of more than a quarter of
    these n-grams is a block of its own.
    """
    once = members.groupBy("node").agg(F.min("low").alias("lead"))
    again = members.select("key", "node").join(once, "node").groupBy("key").agg(F.min("lead").alias("low"))
    leads = members.select("key", "node").join(again, "key").groupBy("node").agg(F.min("low").alias("lead")).join(nodes, "node")
    large = F.col("n") > set_.block_grams // 4
    small = F.when(~large, F.col("n"))
    sizes = leads.groupBy("lead").agg(F.greatest(F.ceil(F.count(small) / set_.block), F.ceil(F.coalesce(F.sum(small), F.lit(0)) / set_.block_grams)).alias("chunks"))
    chunk = F.when(large, -1 - F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.col("chunks")))
    return leads.join(sizes, "lead").select("node", "lead", chunk.alias("chunk"))


def deal_units(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(unit, a, b): each block of several classes with itself, and the pairs of blocks that share a band.

    A band of many blocks is joined in parts of 256 blocks on one side.
    """
    at = F.struct("lead", "chunk")
    touched = members.join(blocks, "node").select("key", at.alias("b")).distinct()
    several = touched.join(touched.groupBy("key").agg(F.ceil(F.count("*") / 256).alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n"), "key")
    left = several.select("key", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("a"))
    right = several.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "b")
    across = left.join(right, ["key", "part"]).where("a < b").select("a", "b")
    within = blocks.groupBy("lead", "chunk").agg(F.count("*").alias("n")).where("n > 1").select(at.alias("a"), at.alias("b"))
    return across.unionByName(within).distinct().withColumn("unit", F.monotonically_increasing_id())


def grouped(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, class_id, component_id, n_links, kept) for every row of df; see join. h is the hash of the text."""
    set_ = settings
    sigs = cut(few_files(signatures(df, set_, id_col, text_col)), "signatures", "snappy")
    rows = sigs.count()
    low = sigs.where("fp is not null").groupBy("fp").agg(F.min(F.struct("id", "h", "n", "sig")).alias("low"), F.count("*").alias("copies"))
    # the number of a class is fixed once it is written
    classes = cut(low.select(F.monotonically_increasing_id().alias("node"), "fp", "low.*", "copies"), "classes", "snappy", rows=rows)
    rows = classes.count()

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, set_.size)
            keys = band_keys(sig, set_.bands, set_.rows)
            node = np.repeat(batch.column("node").to_numpy(), set_.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])

    banded = classes.select("node", "sig").mapInArrow(bands, "key bigint, node bigint")
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1").select("key", "low")
    # Spark sizes the bands as one row for each class, a tenth of what they are, and would send them through the driver
    members = cut(banded.hint("merge").join(shared, "key"), "bands", "snappy", rows=rows * set_.bands, per_file=2_000_000)
    blocks = cut(deal_blocks(members, classes.select("node", "n"), set_), "blocks", "snappy", rows=rows, per_file=2_000_000)
    rows = blocks.count()
    units = cut(deal_units(members, blocks), "units", "snappy", rows=rows, per_file=2_000_000)

    # the n-gram sets of classes that have a candidate, each made once
    wanted = blocks.select("node").join(classes.select("node", "id", "h", "copies", "sig"), "node")
    texts = keyed(df, id_col, text_col).join(wanted, ["id", "h"]).dropDuplicates(["node"])
    sets = cut(sets_of(texts, set_), "sets", "snappy", rows=rows, per_file=50_000, for_core=2)
    one = F.col("a") == F.col("b")
    sides = units.select("unit", one.alias("one"), F.explode(F.when(one, F.array(F.col("a"))).otherwise(F.array("a", "b"))).alias("at"), F.col("a"))
    sides = sides.select("unit", "one", F.col("at.lead").alias("lead"), F.col("at.chunk").alias("chunk"), (F.col("at") != F.col("a")).alias("side"))
    loaded = sides.join(blocks, ["lead", "chunk"]).select("unit", "side", "one", "node").join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("node", "ascending")])
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, set_.size)
        if group.column("one")[0].as_py():
            i, j = candidate_pairs(sig, None, set_)
        else:
            split = len(node) - sum(group.column("side").to_pylist())
            i, j = candidate_pairs(sig[:split], sig[split:], set_)
            j = j + split
        i, j = prune(sig, sig, i, j, set_)
        sets = [np.frombuffer(b, dtype=np.uint64) for b in group.column("grams").to_pylist()]
        ok = verify(sets, i, j, set_.threshold)
        i, j = i[ok], j[ok]
        links = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
        root = node[roots(len(node), i, j)]
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some].astype(np.int64), "root": root[some]})

    linked = cut(loaded.groupBy("unit").applyInArrow(compare, "node bigint, links bigint, root bigint"), "links", "snappy", rows=sides.count(), per_file=500, for_core=4)
    drop(members, blocks, units, sets)
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")), rows=linked.count()).join(classes.select("node", "id", "h"), "node")
    least = groups.groupBy("component").agg(F.min(F.struct("id", "h")).alias("least"))
    groups = groups.join(least, "component").select("node", "least")
    known = classes.join(counts, "node", "left").join(groups, "node", "left")
    known = known.select("fp", F.col("id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", F.struct("id", "h")).alias("least"))
    return sigs.select("id", "h", "fp").join(known, "fp", "left").select(
        "id", "h", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("least.id", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce(F.col("least") == F.struct("id", "h"), F.lit(True)).alias("kept"),
    )


def join(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, component_id, n_links and kept for every row of df.

    class_id is the least id of an equal n-gram set; n_links counts the other rows, copies included,
    whose similarity reaches the threshold; component_id is the least id reachable by links, and kept
    marks the row that has it. Words are lower-cased and split at white space. A text of one to four
    words is one n-gram of all its words; a null or empty text has none, is its own class and links with
    nothing. Rows with a null id are not compared: they have no class, component or links, and are kept.
    Rows of one id with different texts are compared like others, and of those in one component
    the text of least hash is kept; rows that repeat id and text are marked alike. Further columns are
    not carried. An empty table gives an empty result.
    """
    return grouped(df, settings, id_col, text_col).drop("h").withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that join keeps, all columns, and of rows that repeat id and text one."""
    marked = grouped(df, settings, id_col, text_col)
    kept = cut(marked.where("kept and id is not null").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct(), "kept", "snappy", rows=df.count(), per_file=2_000_000)
    own = df.withColumns({"__id": F.col(f"`{id_col}`").cast("bigint"), "__h": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    known = own.where("__id is not null").join(kept, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
    return known.unionByName(own.where("__id is null")).select(*[F.col(f"`{c}`") for c in df.columns])
