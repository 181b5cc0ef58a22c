"""Runs of words that repeat with a period, found by the runs theorem.

Every run (a stretch whose smallest period fits in it at least twice, and that no neighbour extends) holds, within its first period, a
word that is the longest Lyndon word from its place under the order of the alphabet or under the opposite one. So two orders give at most two
candidate roots for each place: the longest Lyndon word from i ends at the next smaller value of the inverse suffix array. A root is
extended to both sides by longest common extensions, range minima over the LCP array. All of it is vectorised over
a batch of texts that stand one after another, each closed by a mark of its own, so that nothing reaches over an end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import pieces

BLOCK = 16


def suffix_ranks(key: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes of key by their first 1, 2, 4, ... values; the last array tells all of them apart.

    key must hold closing marks that occur once each, or equal suffixes could run over its end. Only suffixes that are not yet told
    apart are sorted again.
    """
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    first = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    rank = np.empty(len(key), dtype=np.int32)
    rank[order] = first[of]
    sizes = np.diff(np.append(first, len(key)))
    active, levels, h = order[sizes[of] > 1], [rank], 1
    while len(active):
        rank = rank.copy()
        both = rank[active].astype(np.int64) * len(key) + rank[active + h]
        order = np.argsort(both, kind="stable")
        active, both = active[order], both[order]
        old = rank[active]
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        first, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        start = group[np.searchsorted(group, np.arange(len(active)), side="right") - 1]
        rank[active] = old + (first[of] - start)
        sizes = np.diff(np.append(first, len(active)))
        active = active[sizes[of] > 1]
        levels.append(rank)
        h *= 2
    return levels


def lcp_array(suffixes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each place in the suffix array the length that its suffix shares with the one before it; 0 for the first."""
    out = np.zeros(len(suffixes), dtype=np.int32)
    at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    i, j, length = suffixes[at], suffixes[at - 1], np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][i + length] == levels[k][j + length]).astype(np.int64) << k
    out[at] = length
    return out


class Minima:
    """Range minima: a sparse table over the minima of blocks of 16, and the values at both ends."""

    def __init__(self, values: np.ndarray):
        self.values = np.concatenate([values, np.full(-len(values) % BLOCK + BLOCK, np.iinfo(values.dtype).max, dtype=values.dtype)])
        self.table = [self.values.reshape(-1, BLOCK).min(axis=1)]
        while len(self.table[-1]) > 1 << len(self.table) - 1:
            half = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in low <= place < high, for each; ranges must not be empty."""
        out = self.values[low].copy()
        left, right = -(-low // BLOCK), high // BLOCK
        whole = np.flatnonzero(left < right)
        level = np.frexp((right - left)[whole].astype(np.float64))[1] - 1
        for k in np.unique(level):
            mine = whole[level == k]
            t = self.table[k]
            out[mine] = np.minimum(out[mine], np.minimum(t[left[mine]], t[right[mine] - (1 << k)]))
        stop, start = np.minimum(left * BLOCK, high), np.maximum(right * BLOCK, low)
        for k in range(BLOCK):
            out = np.where(low + k < stop, np.minimum(out, self.values[low + k]), out)
            out = np.where(start + k < high, np.minimum(out, self.values[start + k]), out)
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one of a smaller value; the length where there is none.

    A pointer goes from place to place over greater values, and takes with it what the place that it stands on has passed by already.
    What a few such steps leave open is settled by descending in the minima of 1, 2, 4, ... values.
    """
    n = len(rank)
    value = np.append(rank, -1)
    to = np.arange(1, n + 2)
    to[n] = n
    open_ = np.flatnonzero(value[to[:n]] > value[:n])
    for _ in range(8):
        to[open_] = to[to[open_]]
        open_ = open_[value[to[open_]] > value[open_]]
    if len(open_):
        levels = [value]
        while 2 << len(levels) - 1 <= len(value):
            half = 1 << len(levels) - 1
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        at, least = to[open_], value[open_]
        for k in range(len(levels) - 1, -1, -1):
            inside = at + (1 << k) <= len(value)
            passed = inside & (levels[k][np.where(inside, at, 0)] > least)
            at = at + (passed.astype(np.int64) << k)
        to[open_] = at
    return to[:n]


class Extensions:
    """How far two places of one array agree onwards, by range minima over the LCP array."""

    def __init__(self, levels: list[np.ndarray]):
        self.rank = levels[-1]
        suffixes = np.empty(len(self.rank), dtype=np.int64)
        suffixes[self.rank] = np.arange(len(self.rank))
        self.least = Minima(lcp_array(suffixes, levels))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places i and j."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        return self.least.of(np.minimum(a, b) + 1, np.maximum(a, b) + 1).astype(np.int64)


def runs(words: np.ndarray, ends: np.ndarray, exponent: int = 2, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of at least exponent periods and least words, by text, start and period.

    words: the words of all texts as numbers from 0, one text after another; ends: where each text ends. Any two exponents of 2 or more
    differ in what is kept only. Memory grows with the words, and with the logarithm of the longest repeat inside one text.
    """
    if exponent < 2:
        raise ValueError("a run repeats at least twice")
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, dtype=np.int64)
    none = (np.zeros(0, dtype=np.int64),) * 4
    if not len(words):
        return none
    text = np.repeat(np.arange(len(ends)), ends - begins)
    place = np.arange(len(words)) + text  # each earlier text has a closing mark
    marks = ends + np.arange(len(ends))
    size = len(words) + len(ends)
    top = int(words.max()) + 2
    whole, owner = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    owner[place], owner[marks] = text, np.arange(len(ends))
    found: list[tuple[np.ndarray, ...]] = []
    reach: Extensions | None = None
    for opposite in (False, True):
        whole[:] = 0
        whole[place] = top - 1 - words if opposite else words + 1
        levels = suffix_ranks(owner * top + whole)
        # a later text has greater values, so a search must not cross its mark: marks are the least of their text and end it
        root = next_smaller(levels[-1]) - np.arange(size)
        reach = reach or Extensions(levels)
        del levels
        i = place[root[place] + place <= marks[text]]
        p = root[i]
        same = whole[i] == whole[i + p]
        i, p = i[same], p[same]
        if not len(i):
            continue
        right = reach.of(i, i + p)
        enough = right > p * (exponent - 2)  # within its first period a run has a root, from which that much is left
        i, p, right = i[enough], p[enough], right[enough]
        first = marks[owner[i]] - (ends - begins)[owner[i]]
        low, high = np.zeros(len(i), dtype=np.int64), np.minimum(p, i - first)
        while (open_ := np.flatnonzero(low < high)).size:  # how far to the left both agree; a whole period: an earlier root has this run
            mid = (low[open_] + high[open_] + 1) // 2
            a = i[open_] - mid
            good = reach.of(a, a + p[open_]) >= mid
            low[open_] = np.where(good, mid, low[open_])
            high[open_] = np.where(good, high[open_], mid - 1)
        length = low + p + right
        kept = (low < p) & (length >= exponent * p) & (length >= least)
        found.append((owner[i[kept]], (i - low - first)[kept], length[kept], p[kept]))
    if not found:
        return none
    every = np.stack([np.concatenate(c) for c in zip(*found, strict=True)])
    every = np.unique(every[[0, 1, 3, 2]], axis=1)
    return every[0], every[1], every[3], every[2]


@dataclass(frozen=True)
class Settings:
    """Runs of at least exponent periods and least words; batch: texts of about so many words are worked on together."""

    exponent: int = 4
    least: int = 6
    batch: int = 1 << 17


class _Numbers(dict):
    """A number for each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def told(rows: list[tuple[int, int, int]], words: list[bytes], order: np.ndarray | None) -> tuple:
    """The columns of one text: its runs (start, length, period) by start and period, its words, and their order where it is another."""
    best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if rows else None
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest()
    if rows:
        kept = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, p in rows:
            kept[s + p] += 1
            kept[s + n] -= 1
        places = np.flatnonzero(np.cumsum(kept[:-1]) == 0)
        words = [words[k] for k in (places if order is None else order[places])]
    elif order is not None:
        words = [words[k] for k in order]
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(rows), *facts, listed, b" ".join(words)


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256"]


def find(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", reorder=None) -> DataFrame:
    """(id, n_runs; start, length, period, exponent_milli of the run that repeats most; runs_sha256, collapsed) for each row of df.

    Words are parted by ASCII white space. collapsed is the text without what runs repeat, its words joined by one space. A null or empty
    text has no words and so no run; a row with a null id is a row like others, as are rows that repeat. A text is worked on
    whole however long it is, with about 200 bytes a word. Further columns are not carried; an empty table gives none.
    reorder, where given, maps (id, number of words) to the order in which the words are read, or to None.
    """
    set_ = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers()
        names = ["id", *FIELDS, "collapsed"]
        kinds = [None, *[pa.int64()] * 5, pa.string(), pa.string()]

        def judged(ids: list, texts: list[list[bytes]], orders: list, coded: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
            ends = np.cumsum([len(c) for c in coded])
            of, start, length, period = runs(np.concatenate(coded) if coded else np.zeros(0, dtype=np.int64), ends, set_.exponent, set_.least)
            edges = np.searchsorted(of, np.arange(len(texts) + 1))
            out = []
            for k, (words, order) in enumerate(zip(texts, orders, strict=True)):
                mine = slice(edges[k], edges[k + 1])
                out.append(told(list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True)), words, order))
            columns = [pa.array(ids, kind), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds[1:-1], strict=False)]]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x[-1].decode() for x in out], pa.string())], names=names)

        for batch in pieces(batches):
            ids, texts, orders, coded, size = [], [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()
                c = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
                order = reorder(key, len(words)) if reorder and words else None
                for col, v in zip((ids, texts, orders, coded), (key, words, order, c if order is None else c[order]), strict=True):
                    col.append(v)
                size += len(words)
                if size >= set_.batch:
                    yield judged(ids, texts, orders, coded, batch.schema.field(0).type)
                    ids, texts, orders, coded, size = [], [], [], [], 0
            if ids:
                yield judged(ids, texts, orders, coded, batch.schema.field(0).type)
            if len(numbers) > 500_000:  # only within one batch must numbers agree
                numbers.clear()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = {c: "bigint" for c in FIELDS[:-1]} | {"runs_sha256": "string", "collapsed": "string"}
    schema = rows.select("id", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def planted(key: int | None, n: int) -> np.ndarray | None:
    """The order that gives one text in ten a stretch that repeats, dealt by the checksum of its id."""
    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def documents(df: DataFrame) -> DataFrame:
    """The runs of documents, with planted repetitions, and the digest of the collapsed text."""
    return find(df, reorder=planted).select("doc_id", *FIELDS, F.sha2("collapsed", 256).alias("collapsed_sha256"))
