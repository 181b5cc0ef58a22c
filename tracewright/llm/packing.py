"""Packing by concatenate and cut: all tokens form one stream, cut into windows of equal length.

First pass: each task encodes its rows and writes ids with the running total inside its partition.
The partition totals, one number each, are summed up on the driver. Second pass: every row knows its
place in the stream and is cut at the window ends; each piece is a boundary record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, few_files, pieces

# Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself where it can be seen, else the next letters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def follows_ids(spec: dict) -> bool:
    """Whether merging the pair of least id gives the same tokens as the merges of a byte-level BPE file.

    So it is if ids grow along the merges, every longer token comes from a merge, and every token
    that a merge makes comes out whole when its characters alone are merged: then a pair of tokens that
    together spell a third stands side by side only where the merges would join it.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ids = [vocab.get(a + b, -1) for a, b in merges]
    if any(y <= x for x, y in zip([-1, *ids], ids, strict=False)) or {t for t in vocab if len(t) > 1 and t not in special} != {a + b for a, b in merges}:
        return False
    rank = {m: k for k, m in enumerate(merges)}

    def whole(token: str) -> bool:
        parts = list(token)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda m: rank.get(m, len(rank)))
            if best not in rank:
                return False
            k = 0
            while k < len(parts) - 1:
                if (parts[k], parts[k + 1]) == best:
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                k += 1
        return True

    return all(whole(a + b) for a, b in merges)


class Encoder:
    """Token ids of a tokenizers file.

    Where fast says that follows_ids() holds for the file, its merges are run by tiktoken, several
    times faster for the same ids. A text that its pattern search can't take (a million blanks in a row
    overflow its stack) is run by tokenizers.
    """

    def __init__(self, path: str, fast: bool = False):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.loads(self.slow.to_str())
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.fast = None
        if fast:
            import tiktoken

            back = letters()
            ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the pattern search is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """(id, part, start, n_tokens, ids): ids are 16-bit, or 32-bit where one doesn't fit; start counts inside the partition."""
    from tokenizers import Tokenizer

    fast = follows_ids(json.loads(Tokenizer.from_file(tokenizer).to_str()))  # once, on the driver
    schema = df.select(F.col(id_col).alias("doc_id")).withColumns({"part": F.lit(0), "start": F.lit(0).cast("bigint"), "n_tokens": F.lit(0).cast("bigint"), "wide": F.lit(True), "ids": F.lit(b"").cast("binary")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, total = Encoder(tokenizer, fast), TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            starts, counts, wide, blobs = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.array([*enc(text or ""), end], dtype=np.uint32)
                big = bool(ids.max() > 65535)
                starts.append(total)
                counts.append(len(ids))
                wide.append(big)
                blobs.append(ids.astype("<u4" if big else "<u2").tobytes())
                total += len(ids)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(wide, pa.bool_()), pa.array(blobs, pa.binary())], names=["doc_id", "part", "start", "n_tokens", "wide", "ids"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """One row for each piece of each row of df, in windows of length tokens; only the last window is short.

    doc_id, start and length in the document, doc_tokens, sequence_id, offset there, and ids as
    little-endian unsigned 32-bit bytes. A null or empty text is the end token alone; repeated rows and
    null ids are packed like others; further columns are not carried; an empty table gives no rows.
    The driver holds one total for each partition of df.
    """
    if length < 1:
        raise ValueError("windows need a positive length")
    coded = cut(encode(few_files(df), tokenizer, id_col, text_col, end), "tokens")
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    offsets, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        offsets[row["part"]] = at
        at += row["n"]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = coded.select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in names[1:-1]], "ids").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, out = [], [[] for _ in names[1:]]
            for i, (part, start, n, wide, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n_tokens", "wide", "ids")), strict=True)):
                whole = np.frombuffer(blob, dtype="<u4" if wide else "<u2").astype("<u4").tobytes()
                place, done = offsets[part] + start, 0
                while done < n:
                    here = (place + done) % length
                    size = min(n - done, length - here)
                    rows.append(i)
                    for col, value in zip(out, (done, size, n, (place + done) // length, here, whole[4 * done : 4 * (done + size)]), strict=True):
                        col.append(value)
                    done += size
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in out[:-1]], pa.array(out[-1], pa.binary())], names=names)

    return coded.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the input ids (bytes, as in pack) of each window, with its boundary records in order."""
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", "n_tokens", F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"))).alias("boundaries"), F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of pack with the checksum of their ids."""
    return pack(documents, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
