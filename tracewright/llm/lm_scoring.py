"""Language-model scores of texts, from an n-gram trie that is spread over the cluster.

The model is a bigram model with a Dirichlet prior (MacKay and Peto, 1995) over smoothed word
probabilities: p(w | v) = (c(v w) + m p(w)) / (c(v) + m), with p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

A batch of texts is the unit of exchange: it sums up its own n-grams before anything is shuffled.
1. Each task encodes its texts against the words of the batch and writes the batches.
2. Words are dealt by hash: a word shard sums the counts of all batches, numbers the words and answers
   every batch. 3. Each batch sends its distinct bigrams, with their training counts and the texts that
   use them, to bigram shards (frequent first words are split over several). 4. A bigram shard builds
   its part of the trie, memory-maps it, looks up every bigram that any batch asks about, and returns
   one sum for each text. 5. The sums of a batch are added up.
No table of words or n-grams ever reaches the driver or all executors.

Batches and shards both grow with the corpus, so their messages would with its square. Beyond direct_shards
a batch sends to groups of about the square root of the shards, and what as many batches send to one group is
sorted to its shards in one task; answers come back the same way.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, mix, pieces
from tracewright.llm.ngram_trie import Trie, quantise, restore

END = b"\n"  # holds white space, so no word equals it
UNKNOWN = np.uint64(2**64 - 1)
MARK = np.uint64(0xFFFFFF)


@dataclass(frozen=True)
class Settings:
    fold: int = 10  # every fold-th document, by checksum of its id, is held out
    add: float = 0.1
    prior: float = 100.0
    batch_tokens: int = 3_000_000
    shard_words: int = 1_500_000
    shard_tokens: int = 2_500_000
    split_tokens: int = 200_000
    direct_shards: int = 1024


def planes(a: np.ndarray, dtype: str) -> bytes:
    """The bytes of an array, lowest bytes of all values first, compressed: the high bytes are mostly zero."""
    import zstandard

    a = np.ascontiguousarray(a, dtype=dtype)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 3)


def unplanes(b: bytes, dtype: str) -> np.ndarray:
    import zstandard

    t = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), dtype=np.uint8).reshape(t.itemsize, -1).T).view(t).ravel()


def runs(a: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)


def dealt(targets: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of target, and where each target's places begin."""
    small = targets.astype(np.uint16) if parts <= 65536 else targets
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(targets[order], np.arange(parts + 1))


@dataclass(frozen=True)
class Routes:
    """How batches reach shards: shards of one group are fan in a row, and a unit is what some batches send to a group."""

    shards: int
    fan: int
    groups: int
    supers: int

    @staticmethod
    def of(shards: int, batches: int, set_: Settings) -> Routes:
        fan = 1 if shards <= set_.direct_shards else math.ceil(math.sqrt(shards))
        groups = -(-shards // fan)
        return Routes(shards, fan, groups, max(1, -(-batches // groups)))

    @property
    def direct(self) -> bool:
        return self.fan == 1

    def unit(self, batch: str, group) -> Column:
        return F.pmod(F.xxhash64(batch), F.lit(self.supers)) * self.groups + group


def is_held(doc_id: int | None, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % fold == 0


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BATCH = "batch bigint, n_tokens bigint, n_words bigint, docs array<bigint>, held binary, lengths binary, tokens binary, words binary, marks binary, counts binary"


def encode(df: DataFrame, set_: Settings, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        schema = pa.schema([("batch", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("docs", pa.list_(pa.int64())), *[(n, pa.binary()) for n in ("held", "lengths", "tokens", "words", "marks", "counts")]])

        def flush() -> pa.RecordBatch:
            flat, lengths, held = np.concatenate(tokens), np.array([len(t) for t in tokens]), np.array([is_held(d, set_.fold) for d in docs])
            often = np.bincount(flat, minlength=len(words))
            order = np.argsort(-often, kind="stable")  # common words get small numbers
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            trained = np.bincount(flat[np.repeat(~held, lengths)], minlength=len(words))[order]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))[order]
            row = [(part << 32) | seq, len(flat), len(words), docs, held.tobytes(), planes(lengths, "<u4"), planes(rank[flat], "<u4"), hashes.tobytes(), planes(hashes & MARK, "<u4"), planes(trained, "<u4")]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        words, tokens, docs, size = Words(), [], [], 0
        for batch in pieces(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = text.encode().lower().split() if text else []
                found.append(END)
                tokens.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
                docs.append(doc)
                size += len(found)
                if size >= set_.batch_tokens:
                    yield flush()
                    words, tokens, docs, size, seq = Words(), [], [], 0, seq + 1
        if docs:
            yield flush()

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BATCH)


def word_shards(marks: np.ndarray, shards: int) -> np.ndarray:
    """By the lowest 24 bits of the hashes, so that a batch can place its answers without the rest of them."""
    return marks.astype(np.int64) % shards


def count_words(coded: DataFrame, routes: Routes) -> DataFrame:
    """(batch, shard, ids, counts, n, v): the answers to every batch, by shard or group of shards; n and v are set once for each shard."""
    shards = routes.shards

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for b, words, counts in zip(*(batch.column(c).to_pylist() for c in ("batch", "words", "counts")), strict=True):
                h, c = np.frombuffer(words, dtype=np.uint64), unplanes(counts, "<u4")
                order, ends = dealt(word_shards(h & MARK, shards) // routes.fan, routes.groups)
                for k in np.flatnonzero(np.diff(ends)):
                    at = order[ends[k] : ends[k + 1]]
                    for col, value in zip(out, (b, int(k), h[at].tobytes(), planes(c[at], "<u4")), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["batch", "shard", "words", "counts"])

    def answer(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        asked = [np.frombuffer(w.as_py(), dtype=np.uint64) for w in group.column("words")]
        counts = np.concatenate([unplanes(c.as_py(), "<u4") for c in group.column("counts")]).astype(np.int64)
        names, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(names)).astype(np.int64)
        ids = np.where(total > 0, (np.cumsum(total > 0) - 1).astype(np.uint64) * np.uint64(shards) + np.uint64(shard), UNKNOWN)
        ends = np.cumsum([len(a) for a in asked])
        rows = [inverse[e - len(a) : e] for a, e in zip(asked, ends, strict=True)]
        first = [1] + [0] * (len(rows) - 1)
        kept = {"place": group.column("place")} if "place" in group.column_names else {}
        return pa.table({
            "batch": group.column("batch"), "shard": group.column("shard"), **kept,
            "ids": pa.array([planes(ids[r], "<u8") for r in rows], pa.binary()), "counts": pa.array([planes(total[r], "<u8") for r in rows], pa.binary()),
            "n": pa.array([f * int(total.sum()) for f in first], pa.int64()), "v": pa.array([f * int((total > 0).sum()) for f in first], pa.int64()),
        })

    asked = coded.select("batch", "words", "counts").mapInArrow(deal, "batch bigint, shard int, words binary, counts binary")
    if routes.direct:
        return asked.groupBy("shard").applyInArrow(answer, "batch bigint, shard int, ids binary, counts binary, n bigint, v bigint")

    def route(group: pa.Table) -> pa.Table:
        """The words of a unit by shard, with their places in the unit, batches in order."""
        group = group.sort_by("batch")
        h = np.concatenate([np.frombuffer(w.as_py(), dtype=np.uint64) for w in group.column("words")])
        c = np.concatenate([unplanes(x.as_py(), "<u4") for x in group.column("counts")])
        target = word_shards(h & MARK, shards)
        order = np.argsort(target, kind="stable")
        parts = np.split(order, runs(target[order])[1:])
        unit = group.column("unit")[0].as_py()
        return pa.table({
            "batch": pa.array([unit] * len(parts), pa.int64()), "shard": pa.array([int(target[p[0]]) for p in parts], pa.int32()), "words": pa.array([h[p].tobytes() for p in parts], pa.binary()),
            "counts": pa.array([planes(c[p], "<u4") for p in parts], pa.binary()), "place": pa.array([planes(p, "<u4") for p in parts], pa.binary()),
        })

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        """The answers to a unit, put in place and cut into those to its batches."""
        left = left.sort_by("batch")
        lengths = left.column("size").to_numpy()
        ids, counts = np.full(lengths.sum(), UNKNOWN), np.zeros(lengths.sum(), dtype=np.uint64)
        for place, i, c in zip(*(right.column(k).to_pylist() for k in ("place", "ids", "counts")), strict=True):
            at = unplanes(place, "<u4")
            ids[at], counts[at] = unplanes(i, "<u8"), unplanes(c, "<u8")
        ends = np.cumsum(lengths)
        cuts = [slice(e - k, e) for e, k in zip(ends, lengths, strict=True)]
        once = lambda name: pa.array([sum(right.column(name).to_pylist())] + [0] * (len(cuts) - 1), pa.int64())
        return pa.table({
            "batch": left.column("batch"), "shard": left.column("shard"), "ids": pa.array([planes(ids[x], "<u8") for x in cuts], pa.binary()),
            "counts": pa.array([planes(counts[x], "<u8") for x in cuts], pa.binary()), "n": once("n"), "v": once("v"),
        })

    asked = asked.withColumn("unit", routes.unit("batch", F.col("shard")))
    sizes = asked.select("unit", "batch", "shard", (F.length("words") / 8).cast("bigint").alias("size"))
    sent = asked.groupBy("unit").applyInArrow(route, "batch bigint, shard int, words binary, counts binary, place binary")
    told = sent.groupBy("shard").applyInArrow(answer, "batch bigint, shard int, place binary, ids binary, counts binary, n bigint, v bigint")
    return sizes.groupBy("unit").cogroup(told.withColumnRenamed("batch", "unit").groupBy("unit")).applyInArrow(back, "batch bigint, shard int, ids binary, counts binary, n bigint, v bigint")


def bigram_shards(first: np.ndarray, total: np.ndarray, second: np.ndarray, shards: int, set_: Settings) -> np.ndarray:
    """Bigrams go by their first word; frequent first words are split over several shards by the second."""
    salt = mix(second) % (total // np.uint64(set_.split_tokens) + np.uint64(1))
    return (mix(first * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(shards)).astype(np.int64)


def message(first: np.ndarray, total: np.ndarray, second: np.ndarray, code: np.ndarray, trained: np.ndarray, uses: np.ndarray, texts: np.ndarray, n_docs: int) -> dict:
    """The columns of a request about bigrams with equal first words in a row; texts is flat, uses of them for each bigram."""
    new = runs(first)
    return {
        "first": planes(first[new], "<u8"), "first_count": planes(total[new], "<u8"), "children": planes(np.diff(new, append=len(first)), "<u4"), "second": planes(second, "<u8"), "second_code": planes(code, "<u2"),
        "trained": planes(trained, "<u4"), "uses": planes(uses, "<u4"), "texts": planes(texts, "<u2" if n_docs <= 65536 else "<u4"), "n_docs": n_docs,
    }


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of given starts and lengths, one after another."""
    stop = np.cumsum(lengths)
    return np.arange(stop[-1]) - np.repeat(stop - lengths - starts, lengths)


#: A request (kind 0) to a bigram shard, or (kind 1) what a batch already knows of its texts.
REQUEST = "shard int, kind int, batch bigint, n_docs int, first binary, first_count binary, children binary, second binary, second_code binary, trained binary, uses binary, texts binary, docs array<bigint>, held binary, facts binary"
REQUEST_NAMES = [f.split()[0] for f in REQUEST.split(", ")]
#: Sums for some texts of a batch, or a row of another kind handed on.
PARTIAL = "batch bigint, kind int, at binary, sums binary, docs array<bigint>, held binary, facts binary"
PARTIAL_NAMES = [f.split()[0] for f in PARTIAL.split(", ")]


def partial_schema() -> pa.Schema:
    return pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("at", pa.binary()), ("sums", pa.binary()), ("docs", pa.list_(pa.int64())), ("held", pa.binary()), ("facts", pa.binary())])


def request_schema() -> pa.Schema:
    types = {"shard": pa.int32(), "kind": pa.int32(), "batch": pa.int64(), "n_docs": pa.int32(), "docs": pa.list_(pa.int64())}
    return pa.schema([(c, types.get(c, pa.binary())) for c in REQUEST_NAMES])


def ask_bigrams(coded: DataFrame, answers: DataFrame, routes: Routes, words_by: Routes, n: int, v: int, set_: Settings) -> DataFrame:
    """Requests to shards, or to groups of them."""
    schema = request_schema()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        answer = {s: (unplanes(i, "<u8"), unplanes(c, "<u8")) for s, i, c in zip(*(right.column(k).to_pylist() for k in ("shard", "ids", "counts")), strict=True)}
        for row in left.to_pylist():
            shard = word_shards(unplanes(row["marks"], "<u4"), words_by.shards) // words_by.fan
            ids, counts = np.full(len(shard), UNKNOWN), np.zeros(len(shard), dtype=np.uint64)
            for s, (i, c) in answer.items():
                mine = shard == s
                ids[mine], counts[mine] = i, c
            lengths, held = unplanes(row["lengths"], "<u4").astype(np.int64), np.frombuffer(row["held"], dtype=bool)
            s = unplanes(row["tokens"], "<u4")
            starts = np.cumsum(lengths) - lengths
            p1 = (counts.astype(np.float64) + set_.add) / (n + set_.add * (v + 1))
            base = np.add.reduceat(np.log10(p1)[s], starts)
            known = np.add.reduceat((counts > 0)[s], starts, dtype=np.int64)
            before = np.concatenate([s[-1:], s[:-1]])  # every text follows an end, the first one too
            doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
            # a bigram with a word that training lacks is in no trie: its score is known here
            strange = ids == UNKNOWN
            lost = strange[before] | strange[s]
            share = set_.prior / (counts.astype(np.float64) + set_.prior)
            local = np.bincount(doc[lost], weights=np.log10(share[before[lost]] * p1[s[lost]]), minlength=len(lengths))
            facts = np.concatenate([lengths.astype(np.float64), known.astype(np.float64), base, local])
            blank = dict.fromkeys(REQUEST_NAMES)
            out.append(blank | {"shard": row["batch"] % routes.groups, "kind": 1, "batch": row["batch"], "n_docs": len(lengths), "docs": row["docs"], "held": row["held"], "facts": facts.tobytes()})
            at = np.flatnonzero(~lost)
            key = (before[at].astype(np.uint64) << np.uint64(32)) | s[at]
            order = np.argsort(key)
            key, texts = key[order], doc[at][order]
            offsets = runs(key)
            if not len(offsets):
                continue
            trained = np.add.reduceat(~held[texts], offsets, dtype=np.int64)
            uses = np.diff(offsets, append=len(key))
            a, b = (key[offsets] >> np.uint64(32)).astype(np.int64), (key[offsets] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            del before, doc, lost, at, order, key, s
            target = bigram_shards(ids[a], counts[a], ids[b], routes.shards, set_) // routes.fan
            code = quantise(p1)
            order, ends = dealt(target, routes.groups)
            for k in np.flatnonzero(np.diff(ends)):
                e = order[ends[k] : ends[k + 1]]
                sent = message(ids[a[e]], counts[a[e]], ids[b[e]], code[b[e]], trained[e], uses[e], texts[gathered(offsets[e], uses[e])], len(lengths))
                out.append(blank | sent | {"shard": int(k), "kind": 0, "batch": row["batch"]})
        return pa.Table.from_pylist(out, schema=schema)

    return coded.drop("words", "counts", "n_tokens", "n_words").groupBy("batch").cogroup(answers.select("batch", "shard", "ids", "counts").groupBy("batch")).applyInArrow(run, REQUEST)


def grams(group: pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """first, total, second and trained of the k-th request, a value for each bigram."""
    get = lambda c, t: unplanes(group.column(c)[k].as_py(), t)
    kids = get("children", "<u4")
    return np.repeat(get("first", "<u8"), kids), np.repeat(get("first_count", "<u8"), kids), get("second", "<u8"), get("trained", "<u4")


def use_of(group: pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """code and uses of the k-th request, a value for each bigram, and its texts, uses of them for each."""
    get = lambda c, t: unplanes(group.column(c)[k].as_py(), t)
    return get("second_code", "<u2"), get("uses", "<u4"), get("texts", "<u2" if group.column("n_docs")[k].as_py() <= 65536 else "<u4")


def route_bigrams(requests: DataFrame, routes: Routes, set_: Settings) -> DataFrame:
    """What the batches of a unit ask of its group, as requests to the shards of the group in the name of the unit.

    The texts of a unit are those of its batches in order, one after another; a row of kind 2 tells which (docs) and how many of each.
    """
    schema = request_schema()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch")
        blank, out, parts, batches, sizes, unit = dict.fromkeys(REQUEST_NAMES), [], [], [], [], group.column("unit")[0].as_py()
        for k in range(group.num_rows):
            batch, n_docs = group.column("batch")[k].as_py(), group.column("n_docs")[k].as_py()
            if group.column("kind")[k].as_py() == 1:
                out.append(blank | {c: group.column(c)[k].as_py() for c in ("kind", "batch", "n_docs", "docs", "held", "facts")} | {"shard": batch % routes.shards})
                continue
            first, total, second, trained = grams(group, k)
            code, uses, texts = use_of(group, k)
            parts.append((first, total, second, code, trained, uses, texts.astype(np.uint32) + np.uint32(sum(sizes))))
            batches.append(batch)
            sizes.append(n_docs)
        if parts:
            first, total, second, code, trained, uses, texts = (np.concatenate([p[c] for p in parts]) for c in range(7))
            target = bigram_shards(first, total, second, routes.shards, set_)
            order = np.lexsort((second, first, target))
            starts = np.cumsum(uses, dtype=np.int64) - uses
            for e in np.split(order, runs(target[order])[1:]):
                sent = message(first[e], total[e], second[e], code[e], trained[e], uses[e], texts[gathered(starts[e], uses[e].astype(np.int64))], sum(sizes))
                out.append(blank | sent | {"shard": int(target[e[0]]), "kind": 0, "batch": unit})
            out.append(blank | {"shard": unit % routes.shards, "kind": 2, "batch": unit, "n_docs": 0, "docs": batches, "facts": np.array(sizes, dtype=np.int64).tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    return requests.withColumn("unit", routes.unit("batch", F.col("shard"))).groupBy("unit").applyInArrow(run, REQUEST)


def bring_back(partials: DataFrame, routes: Routes) -> DataFrame:
    """The sums of units as sums of their batches."""
    schema = partial_schema()

    def run(group: pa.Table) -> pa.Table:
        rows = group.drop_columns(["unit"]).to_pylist()
        out, told = [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 0]
        if told:
            own = next(r for r in rows if r["kind"] == 2)
            ends = np.cumsum(np.frombuffer(own["facts"], dtype=np.int64))
            told.sort(key=lambda r: r["at"])
            at, sums = np.concatenate([unplanes(r["at"], "<u4") for r in told]).astype(np.int64), np.concatenate([np.frombuffer(r["sums"], dtype=np.float64) for r in told])
            order = np.argsort(at, kind="stable")
            new = runs(at[order])
            at, sums = at[order][new], np.add.reduceat(sums[order], new)
            cuts = np.searchsorted(at, np.concatenate([[0], ends]))
            for k, batch in enumerate(own["docs"]):
                some = slice(cuts[k], cuts[k + 1])
                if cuts[k] < cuts[k + 1]:
                    out.append(dict.fromkeys(PARTIAL_NAMES) | {"batch": batch, "kind": 0, "at": planes(at[some] - (ends[k - 1] if k else 0), "<u4"), "sums": sums[some].tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    unit = F.when(F.col("kind") == 1, routes.unit("batch", F.pmod("batch", F.lit(routes.groups)))).otherwise(F.col("batch"))
    return partials.withColumn("unit", unit).groupBy("unit").applyInArrow(run, PARTIAL)


def build_trie(first: np.ndarray, total: np.ndarray, second: np.ndarray, count: np.ndarray, prior: float) -> Trie:
    """From bigrams in any order, with repeats; total is the count of the first word in the corpus."""
    if len(first) and max(first.max(), second.max()) < 2**32:
        order = np.argsort((first << np.uint64(32)) | second)
    else:
        order = np.lexsort((second, first))
    first, total, second, count = first[order], total[order], second[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])) if len(first) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(count, new, dtype=np.int64) if len(new) else np.zeros(0)
    first, total, second = first[new], total[new], second[new]
    heads = runs(first)
    parent = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(first)))
    weight = prior / (total[heads].astype(np.float64) + prior)  # what a first word leaves to the words' own probabilities
    return Trie.build([
        (np.zeros(len(heads), dtype=np.int64), first[heads], quantise(weight)),
        (parent, second, quantise(sums / (total.astype(np.float64) + prior))),
    ])


def answer_bigrams(requests: DataFrame, set_: Settings) -> DataFrame:
    """A row of sums for each request; rows of other kinds are handed on."""
    schema = partial_schema()

    def run(group: pa.Table) -> pa.Table:
        blank, out, asked = dict.fromkeys(PARTIAL_NAMES), [], []
        for k in range(group.num_rows):
            row = {c: group.column(c)[k].as_py() for c in ("kind", "batch", "n_docs", "docs", "held", "facts")}
            if row["kind"]:
                out.append(blank | {c: row[c] for c in ("batch", "kind", "docs", "held", "facts")})
                continue
            asked.append((row["batch"], row["n_docs"], *grams(group, k), k))
        if asked:
            seen = [r[5] > 0 for r in asked]
            parts = [np.concatenate([r[k][m] for r, m in zip(asked, seen, strict=True)]) for k in (2, 3, 4, 5)]
            trie = build_trie(*parts, set_.prior).mapped()
            del parts, seen
            for batch, n_docs, first, total, second, _, k in asked:
                code, uses, texts = use_of(group, k)
                node = trie.lookup(first, second)
                f = np.zeros(len(node))
                hit = np.flatnonzero(node >= 0)
                f[hit] = restore(trie.levels[1].codes[node[hit]])
                p = f + set_.prior / (total.astype(np.float64) + set_.prior) * restore(code)
                named, place = np.unique(texts, return_inverse=True) if n_docs > 4 * len(texts) else (np.arange(n_docs), texts)
                sums = np.bincount(place, weights=np.repeat(np.log10(p), uses), minlength=len(named))
                some = np.flatnonzero(sums)
                out.append(blank | {"batch": batch, "kind": 0, "at": planes(named[some], "<u4"), "sums": sums[some].tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    return requests.groupBy("shard").applyInArrow(run, PARTIAL)


def add_up(partials: DataFrame, n: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["kind"] == 1)
        tokens, known, base, score = np.frombuffer(own["facts"], dtype=np.float64).reshape(4, -1)
        score = score.copy()
        for r in sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["at"]):
            score[unplanes(r["at"], "<u4").astype(np.int64)] += np.frombuffer(r["sums"], dtype=np.float64)
        held = np.frombuffer(own["held"], dtype=bool)
        return pa.table([pa.array(own["docs"], pa.int64()), pa.array(held), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(held), n, dtype=np.int64)), pa.array(base), pa.array(score)], schema=schema)

    return partials.groupBy("batch").applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of df.

    A null or empty text is the end token alone. A null id has the checksum of no bytes (0) and is held
    out. Repeated rows each count in training and are scored each. Without training texts the
    word probabilities are those of the smoothing. Further columns are not carried; an empty table
    gives none.
    """
    set_ = settings
    coded = cut(encode(df, set_, id_col, text_col), "batches", "none")  # its columns are compressed already
    words, tokens, batches = (x or 0 for x in coded.agg(F.sum("n_words"), F.sum("n_tokens"), F.count("*")).first())
    words_by = Routes.of(min(int(MARK) + 1, max(1, -(-words // set_.shard_words))), batches, set_)
    routes = Routes.of(max(1, -(-tokens // set_.shard_tokens)), batches, set_)
    answers = cut(count_words(coded, words_by), "words", "none")
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    requests = ask_bigrams(coded, answers, routes, words_by, n, v, set_)
    if routes.direct:
        return add_up(answer_bigrams(requests, set_), n)
    return add_up(bring_back(answer_bigrams(route_bigrams(requests, routes, set_), set_), routes), n)
