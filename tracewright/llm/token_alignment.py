"""Alignment of two tokenizers over the same texts, token by token.

The B tokens of a text are a static index of byte intervals; each A token stabs it by bisection and lists the B tokens that it overlaps. A
gap between neighbouring A tokens that no B token spans ends a group, so that groups are the finest parts that both cut
out. Every A token of a group is linked to every B token of it, and a pair of ids counts once for each text that links it.

Tasks work on batches of texts: a batch lists its distinct pairs of ids once, its texts name them by their place in that list,
and only the lists travel to be counted and back. So what is shuffled are the pairs of a batch, not of each text,
and a pair that all texts hold is one row for each batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracewright.llm.common import cut, drop, few_files, pieces
from tracewright.llm.packing import Encoder, follows_ids, letters

#: More pairs than these aren't made at once for one text.
MOST = 1 << 21


class IntervalIndex:
    """Static index of half-open intervals that are sorted by start and by end, as tokens are; no interval is empty."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each asked interval the range [low, high) of those here that it overlaps."""
        return np.searchsorted(self.ends, starts, side="right"), np.searchsorted(self.starts, ends, side="left")


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group, from 0, of each A token and of each B token; both tile the same bytes and end where the arrays say."""
    a_starts, b_starts = (np.concatenate([[0], e[:-1]]) for e in (a_ends, b_ends))
    low, high = IntervalIndex(b_starts, b_ends).stab(a_starts, a_ends)
    free = low[1:] >= high[:-1]  # the next A token overlaps no B token that this one does: nothing spans the gap
    of_a = np.concatenate([[0], np.cumsum(free)])
    of_b = np.zeros(len(b_ends), dtype=np.int64)
    first = np.concatenate([[0], np.flatnonzero(free) + 1])
    of_b[low[first[1:]]] = 1
    return of_a, np.cumsum(of_b)


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A id, B id, links) of each linked pair of ids, in blocks of about most rows made; no pair is in two blocks."""
    if not len(a):
        return
    width = int(max(of_a[-1], of_b[-1])) + 1
    ka, na = np.unique(a.astype(np.int64) * width + of_a, return_counts=True)
    kb, nb = np.unique(of_b * (1 << 32) + b, return_counts=True)
    ids, group = ka // width, ka % width
    b_group, b_ids = kb >> 32, kb & 0xFFFFFFFF
    edge = np.searchsorted(b_group, np.arange(width + 1))
    sizes = np.diff(edge)[group]
    fresh = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    grown = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(fresh):
        stop = max(at + 1, int(np.searchsorted(grown[fresh], grown[fresh[at]] + most, side="right")) - 1)
        lo, hi = fresh[at], fresh[stop] if stop < len(fresh) else len(ids)
        n = sizes[lo:hi]
        left = np.repeat(np.arange(lo, hi), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edge[group[lo:hi]], n)
        key, back = np.unique(ids[left] << 32 | b_ids[right], return_inverse=True)
        links = np.bincount(back, weights=(na[left] * nb[right]).astype(np.float64), minlength=len(key)).astype(np.int64)
        yield key >> 32, key & 0xFFFFFFFF, links
        at = stop


class Tokenizers:
    """Ids and bytes of both tokenizers: A from a byte-level file of tokenizers, B from a model of sentencepiece.

    parts tells whether a long text may be encoded in parts, from a space that follows no white space on, a place that both always cut:
    A's pattern does so wherever follows_ids() holds; B does if it leaves texts as they are, puts one space before them, and
    no piece holds a space behind anything but spaces.
    """

    LONG = 1 << 20

    def __init__(self, a_file: str, b_file: str, fast: bool):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as form

        self.encoder = Encoder(a_file, fast)
        spec = json.loads(self.encoder.slow.to_str())
        self.encoder.slow.encode_special_tokens = True  # their strings in a text are text like any other
        self.encoder.special = {}
        back = letters()
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if i not in added} | added
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        model = form.ModelProto()
        with open(b_file, "rb") as f:
            model.ParseFromString(f.read())
        byte = form.ModelProto.SentencePiece.BYTE
        self.b_bytes = [bytes([int(p.piece[3:-1], 16)]) if p.type == byte else p.piece.replace("▁", " ").encode() for p in model.pieces]
        self.space = self.b.piece_to_id("▁")
        n = model.normalizer_spec
        as_is = n.name == "identity" and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.parts = fast and as_is and self.b_bytes[self.space] == b" " and not any(re.search("[^▁]▁", p.piece) for p in model.pieces)

        self.a_size, self.b_size = 1 + max(self.a_bytes), len(self.b_bytes)
        self.a_lengths = np.array([len(self.a_bytes.get(i, b"")) for i in range(self.a_size)])
        self.b_lengths = np.array([len(x) for x in self.b_bytes])
        ids = [[str(i) for i in range(n)] for n in (self.a_size, self.b_size)]
        # how an id is written: A as the first of its group or a later one, B likewise
        self.written = [mark + i for mark, of in ((";", ids[0]), (",", ids[0]), ("|", ids[1]), (",", ids[1])) for i in of]

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """The ids of both for a text, with a space before it; None where the bytes of either are not those of the text."""
        whole = " " + text
        cuts = [0, len(whole)]
        if self.parts and len(whole) > self.LONG:
            cuts[1:1] = [m.end() for m in re.finditer(r"(?s).{%d}.*?\S(?= )" % self.LONG, whole)]
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = whole[lo:hi]
            if part:
                a += self.encoder(part)
                b += self.b.encode(part[1:]) if len(part) > 1 else [self.space]  # which puts the space there itself
        raw = whole.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
        return (a, b) if same else None


@dataclass
class Aligned:
    """What one text gives: counts, its groups as text, and its distinct pairs of ids (A id times size of B plus B id) with their links."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))


def align(coded: list[tuple[list[int], list[int]] | None], both: Tokenizers, most: int = MOST) -> list[Aligned]:
    """The alignments of texts, all at once; without tokens there is nothing to align."""
    out = [Aligned() for _ in coded]
    mine = [k for k, c in enumerate(coded) if c]
    if not mine:
        return out
    n_a, n_b = (np.array([len(coded[k][side]) for k in mine]) for side in (0, 1))
    a, b = (np.fromiter((i for k in mine for i in coded[k][side]), dtype=np.int64, count=n.sum()) for side, n in ((0, n_a), (1, n_b)))
    of_a, of_b = groups(np.cumsum(both.a_lengths[a]), np.cumsum(both.b_lengths[b]))  # a text ends in both, so that no group crosses its end
    a_at, b_at = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    group_at = np.append(of_a, of_a[-1] + 1)[a_at]
    in_a, in_b = np.bincount(of_a), np.bincount(of_b)
    total = np.add.reduceat(in_a * in_b, group_at[:-1])
    # each group is written A ids first
    first_a, first_b = (np.concatenate([[0], np.cumsum(n)[:-1]]) for n in (in_a, in_b))
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    place_a, place_b = np.arange(len(a)) + first_b[of_a], np.arange(len(b)) + (first_a + in_a)[of_b]
    later_a, later_b = np.diff(of_a, prepend=-1) == 0, np.diff(of_b, prepend=-1) == 0
    codes[place_a] = a + later_a * both.a_size
    codes[place_b] = b + 2 * both.a_size + later_b * both.b_size
    for j, k in enumerate(mine):
        text = "".join(map(both.written.__getitem__, codes[a_at[j] + b_at[j] : a_at[j + 1] + b_at[j + 1]].tolist()))
        out[k] = Aligned(int(n_a[j]), int(n_b[j]), int(group_at[j + 1] - group_at[j]), int(total[j]), text[1:])
    few = np.flatnonzero(total <= most)
    at = 0
    while at < len(few):  # texts whose pairs are few together
        stop = at + max(1, int(np.searchsorted(np.cumsum(total[few[at:]]), most, side="right")))
        some = few[at:stop]
        from_ = np.concatenate([np.arange(a_at[j], a_at[j + 1]) for j in some])
        n = in_b[of_a[from_]]
        left = np.repeat(from_, n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first_b[of_a[from_]], n)
        text = np.repeat(np.repeat(np.arange(len(some)), n_a[some]), n)
        key, links = np.unique((text * both.a_size + a[left]) * both.b_size + b[right], return_counts=True)
        edges = np.searchsorted(key, np.arange(len(some) + 1) * both.a_size * both.b_size)
        for j, lo, hi in zip(some, edges, edges[1:], strict=False):
            out[mine[j]].pairs, out[mine[j]].links = key[lo:hi] % (both.a_size * both.b_size), links[lo:hi]
        at = stop
    for j in np.flatnonzero(total > most):
        x, y = slice(a_at[j], a_at[j + 1]), slice(b_at[j], b_at[j + 1])
        blocks = list(linked(a[x], b[y], of_a[x] - group_at[j], of_b[y] - group_at[j], most))
        out[mine[j]].pairs = np.concatenate([p * both.b_size + q for p, q, _ in blocks])
        out[mine[j]].links = np.concatenate([n for *_, n in blocks])
    return out


def packed(values: np.ndarray) -> bytes:
    """Small whole numbers, four planes of bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


FACTS = ["n_a", "n_b", "n_groups", "n_links"]
#: Pairs whose links in one text don't fit into 32 bits would be split; one text can't hold so many tokens.
WIDE = 0xFFFFFFFF


@dataclass(frozen=True)
class Settings:
    """A batch ends at so many pairs named by its texts; texts of about so many tokens are aligned together."""

    named: int = 1 << 22
    tokens: int = 1 << 17


def encode(df: DataFrame, a_file: str, b_file: str, settings: Settings) -> DataFrame:
    """Rows of texts (batch, id, facts, groups_sha256, uses: places in the list of the batch, and links) and of lists
    (batch, pairs and texts that hold them), told apart by listed."""
    from tokenizers import Tokenizer

    fast = follows_ids(json.loads(Tokenizer.from_file(a_file).to_str()))  # once, on the driver
    others = "batch bigint, listed boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, one binary, two binary"
    schema = StructType([StructField("id", df.schema["id"].dataType), *StructType.fromDDL(others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = Tokenizers(a_file, b_file, fast), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        used: list[tuple[np.ndarray, np.ndarray]] = []
        named = 0
        kind: pa.DataType = pa.int64()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, rows, used, named
            keys, back, held = np.unique(np.concatenate([u for u, _ in used]), return_inverse=True, return_counts=True)
            order = np.argsort(-held, kind="stable")  # what most texts hold comes first: small places
            to = np.empty(len(order), dtype=np.int64)
            to[order] = np.arange(len(order))
            back, blobs, at = to[back], [], 0
            for u, n in used:
                place = back[at : at + len(u)]
                by = np.argsort(place)
                blobs.append((packed(np.diff(place[by], prepend=0)), packed(n[by])))
                at += len(u)
            for at in range(0, len(rows), 2_000):  # a message of Arrow stays small
                part = slice(at, at + 2_000)
                cols = [pa.array([r[k] for r in rows[part]], t) for k, t in enumerate([kind, *[pa.int64()] * 4, pa.string()])]
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([cols[0], pa.array([number] * n, pa.int64()), pa.array([False] * n), *cols[1:], *[pa.array([b[k] for b in blobs[part]], pa.binary()) for k in (0, 1)]], names=schema.names)
            lists = packed(np.stack(np.divmod(keys[order], both.b_size)).ravel()), packed(held[order])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([number], pa.int64()), pa.array([True]), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *[pa.array([x], pa.binary()) for x in lists]], names=schema.names)
            number, rows, used, named = number + 1, [], [], 0

        def add(keys: list, coded: list) -> None:
            nonlocal named
            for key, x in zip(keys, align(coded, both), strict=True):
                if len(x.links) and x.links.max() > WIDE:
                    raise ValueError("a text links a pair of ids too often to be counted")
                rows.append((key, x.n_a, x.n_b, x.n_groups, x.n_links, hashlib.sha256(x.groups.encode()).hexdigest() if x.groups else ""))
                used.append((x.pairs, x.links))
                named += len(x.pairs)

        for batch in pieces(batches):
            kind = batch.schema.field(0).type
            keys, coded, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                coded.append(both.encode(text) if text else None)
                size += len(coded[-1][0]) if coded[-1] else 0
                if size >= settings.tokens:
                    add(keys, coded)
                    keys, coded, size = [], [], 0
            add(keys, coded)
            if named >= settings.named:
                yield from close()
        if rows:
            yield from close()

    return df.mapInArrow(run, schema)


def pair_counts(lists: DataFrame) -> DataFrame:
    """(batch, place, a, b, texts) of each pair in the list of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, one, two in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                (a, b), held = unpacked(one).reshape(2, -1), unpacked(two)
                for at in range(0, len(a), 10_000):
                    part = slice(at, at + 10_000)
                    n = len(a[part])
                    cols = [np.full(n, number), np.arange(at, at + n, dtype=np.int32), a[part].astype(np.int32), b[part].astype(np.int32), held[part].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["batch", "place", "a", "b", "texts"])

    return lists.select("batch", "one", "two").mapInArrow(run, "batch bigint, place int, a int, b int, texts bigint")


def counted(listed: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many texts each pair of ids is linked, and whether no pair of its A id is in more."""
    counts = listed.groupBy("a", "b").agg(F.sum("texts").alias("count"))
    tops = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("top")))  # one row for each id of A at most
    return counts.join(tops, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_table(df: DataFrame, a_file: str, b_file: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of df.

    A null or empty text, or one that either tokenizer does not spell back byte by byte, has no tokens: zeros, and '' for the digest.
    Strings of special tokens are text. Rows that repeat, or bear a null id, are texts like others and count each. Long texts are aligned
    whole; of one text no more than about two million pairs stand in memory while they are summed up. Further columns
    are not carried; an empty table gives none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    coded = cut(encode(few_files(rows), a_file, b_file, settings), "alignments")
    listed = cut(pair_counts(coded.where("listed")), "alignment-pairs")
    counts = cut(counted(listed), "alignment-counts")
    answers = listed.select("batch", "place", "a", "b").join(counts, ["a", "b"]).select("batch", "place", "count", "best")

    def answer(texts: pa.Table, told: pa.Table) -> pa.Table:
        count, best = np.zeros(len(told), dtype=np.int64), np.zeros(len(told), dtype=bool)
        at = told.column("place").to_numpy()
        count[at] = told.column("count").to_numpy()
        best[at] = np.array(told.column("best").to_pylist(), dtype=bool)
        n_best, sums = [], []
        for one, two in zip(texts.column("one").to_pylist(), texts.column("two").to_pylist(), strict=True):
            u, n = np.cumsum(unpacked(one).astype(np.int64)), unpacked(two).astype(np.int64)
            n_best.append(int(n[best[u]].sum()))
            sums.append(int((n * count[u]).sum()))
        out = texts.drop_columns(["batch", "one", "two"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    texts = coded.where("not listed").drop("listed")
    schema = StructType([*texts.drop("batch", "one", "two").schema, *[StructField(c, LongType()) for c in ("n_best", "count_sum")]])
    out = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(answer, schema)
    return out.select(F.col("id").alias(id_col), *FACTS, "n_best", "count_sum", "groups_sha256")
