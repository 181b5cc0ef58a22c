"""Benchmark decontamination by greedy string tiling.

Texts and test items that share a seed, a run of min_match tokens, are joined by rolling Karp-Rabin
hashes. Then the longest match of tokens that are still free, found by running Karp-Rabin and confirmed
token by token, is marked as a tile, again and again, until none of min_match tokens is left; tiles may stand in any order, so reordered passages count too. An item of fewer tokens is found
where it stands whole in the text, as its one tile. A text is contaminated where the
tiles cover enough of some item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, mix, pieces

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


@dataclass(frozen=True)
class Settings:
    min_match: int = 5
    coverage: float = 0.5
    block_bytes: int = 8 << 20
    blocks_at_once: int = 4


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids, from the hashes of all beginnings (modulo 2^64)."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    def powers(base: np.uint64, count: int) -> np.ndarray:
        out = np.full(count, base)
        out[0] = 1
        return np.multiply.accumulate(out)

    # sums of ids[k] BASE^k; what a run adds is divided by the power of its place
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(ids * powers(BASE, len(ids)))])
    return mix((sums[n:] - sums[:-n]) * powers(INVERSE, len(ids) - n + 1))


def free_runs(used: np.ndarray, n: int) -> np.ndarray:
    """The places where n unused tokens begin."""
    before = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(before[n:] == before[:-n]) if len(used) >= n else np.zeros(0, dtype=np.int64)


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, in text, length): the longest match of unused tokens is marked, again and again.

    Of equal lengths the first in the item goes first, then the first in the text. The greatest length
    at which free runs of both have a hash in common is found by bisection; all matches of that length are
    marked in one sweep, so the work of a round is linear in both texts, however often a run repeats.
    """
    mine, theirs, tiles = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool), []
    most = min(len(item), len(text))

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p, q = free_runs(mine, n), free_runs(theirs, n)
        hp, hq = rolling(item, n)[p], rolling(text, n)[q]
        left, right = np.isin(hp, hq), np.isin(hq, hp)
        return p[left], hp[left], q[right], hq[right]

    while most >= least:
        low, high, best = least, most, None
        while low <= high:
            n = (low + high) // 2
            found = common(n)
            if len(found[0]):
                best, low = (n, found), n + 1
            else:
                high = n - 1
        if best is None:
            break
        n, (p, hp, q, hq) = best
        order = np.argsort(hq, kind="stable")
        names, first = np.unique(hq[order], return_index=True)
        ends, at = np.append(first[1:], len(order)), dict(zip(names.tolist(), first.tolist(), strict=True))
        stop = dict(zip(names.tolist(), ends.tolist(), strict=True))
        for place, h in zip(p.tolist(), hp.tolist(), strict=True):
            if mine[place : place + n].any():
                continue
            k = at[h]
            while k < stop[h]:
                there = int(q[order[k]])
                if not theirs[there : there + n].any():
                    if (item[place : place + n] == text[there : there + n]).all():
                        mine[place : place + n] = theirs[there : there + n] = True
                        tiles.append((place, there, n))
                    break
                k += 1
            at[h] = k  # places before it are used up
        most = n - 1
    return sorted(tiles)


class Index:
    """The items of one block: token ids and the items of every seed; items shorter than min_match by all their tokens, those without any left out."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.n, self.vocabulary, self.items = min_match, {}, []
        short: dict[int, dict[tuple[str, ...], list[int]]] = {}
        hashes, owners = [], []
        for item, text in items:
            words = tokens(text)
            if len(words) < min_match:
                if words:
                    short.setdefault(len(words), {}).setdefault(tuple(words), []).append(int(item))
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            hashes.append(np.unique(rolling(ids, min_match)))
            owners.append(np.full(len(hashes[-1]), len(self.items)))
            self.items.append((item, ids))
        self.short = sorted(short.items())
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], np.concatenate(owners)[order] if owners else np.zeros(0, dtype=np.int64)

    def candidates(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's token ids (0: in no item) and the items that share a seed with it."""
        words = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        none = np.zeros(0, dtype=np.int64)
        if len(ids) < self.n or not len(self.hashes):
            return ids, none
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        at = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        if not len(at):
            return ids, none
        h = np.unique(rolling(ids, self.n)[at])
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = high - low
        if not count.any():
            return ids, none
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return ids, np.unique(self.owners[rows])

    def whole(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """Each short item that the text holds, covered by one tile at its first place."""
        words, out = tokens(text) if self.short else [], []
        for n, items in self.short:
            first: dict[tuple[str, ...], int] = {}
            for at, run in enumerate(zip(*[words[k:] for k in range(n)], strict=False)):
                if run in items:
                    first.setdefault(run, at)
            out += [(item, 1.0, [(0, at, n)]) for run, at in first.items() for item in items[run]]
        return out

    def tiles(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
        """For each item with a seed, and each short item in the text: its id, its coverage and the tiles (place in item, in text, length)."""
        ids, found = self.candidates(text)
        out = self.whole(text)
        for i in found:
            item, own = self.items[i]
            tiles = greedy_tiles(own, ids, self.n)
            if tiles:
                out.append((int(item), sum(n for *_, n in tiles) / len(own), tiles))
        return out


TILES = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<item_at:int,text_at:int,length:int>>>>"


def mark(df: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_tiles: bool = True) -> DataFrame:
    """df with contaminated, coverage (the largest), item_ids (contaminating, ascending) and matches (all tiles).

    Columns of these names in df are replaced; all others stay, whatever they are called. A null or
    empty text is not contaminated, and neither a null item nor one without tokens can contaminate; an
    item of fewer than min_match tokens does so where it stands whole in the text. Items that repeat count
    once each. The benchmark goes to the tasks in blocks of about block_bytes, or of one longer item; a
    task holds blocks_at_once of them, and goes on with further ones from a written table, so that the
    benchmark may be of any size. df is not shuffled.
    """
    names = ("contaminated", "coverage", "item_ids", "matches")
    out = df.drop(*names)
    own = out.columns
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // settings.block_bytes))
    numbered = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(count)))
    if count > 1:
        numbered = cut(numbered.sort("b"), "benchmark")  # in order, so that a block is read from its own files
    out = out.select("*", F.array().cast(TILES).alias("matches"))
    schema, share = out.schema, settings.coverage
    for block in range(count):
        rows = numbered.where(F.col("b") == block).collect() if count > 1 else items.collect()
        index = Index([(r["i"], r["t"]) for r in sorted(rows)], settings.min_match)
        sent = df.sparkSession.sparkContext.broadcast(index)  # about block_bytes of text

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in pieces(batches):
                at = batch.schema.get_field_index(text_col)
                found = [
                    before + [{"item_id": i, "coverage": c, "tiles": [dict(zip(("item_at", "text_at", "length"), t, strict=True)) for t in tiles] if with_tiles else []} for i, c, tiles in index.tiles(text)]
                    for text, before in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist(), strict=True)
                ]
                field = batch.schema.field(len(own))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(found, field.type)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
        if (block + 1) % settings.blocks_at_once == 0 and block + 1 < count:
            out = cut(out, "matches")
    enough = F.filter("matches", lambda m: m["coverage"] >= share)
    return out.select(
        *[F.col(f"`{c}`") for c in own],
        (F.size(enough) > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_sort(F.array_distinct(F.transform(enough, lambda m: m["item_id"]))).alias("item_ids"),
        "matches",
    )
