"""Toxicity by a classifier chain of linear models.

The categories are learnt one after another. Each is a logistic regression on the words of a text and
the beginnings of its words, plus the probabilities of the categories before it; in training those come
from models that did not see the text (out-of-fold), so that a later model learns how far to
trust them. The chain is fitted in one task on at most train_rows labelled texts, those of least
hash, so that the driver holds the finished weights only; scoring is a map over all texts.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import pieces

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    #: Label column and the value that means yes; the order of the chain. The last category decides.
    categories: tuple[tuple[str, str, int], ...] = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
    train_rows: int = 12_000
    features: int = 600
    least_texts: int = 3
    #: Least log-likelihood ratio of a feature; weaker ties to a category are mostly chance among so many features.
    least_ratio: float = 12.0
    prefixes: tuple[int, ...] = (4, 6)
    folds: int = 4
    decay: float = 1e-4
    rounds: int = 150
    seed: int = 11


class Features(dict):
    """Feature hashes of a word, remembered while there are few enough words."""

    def __init__(self, prefixes: tuple[int, ...], known: dict[int, int] | None = None):
        super().__init__()
        self.prefixes, self.known = prefixes, known

    def __missing__(self, word: str) -> tuple[int, ...]:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        hashes = [xxhash.xxh32_intdigest(word, 1), *(xxhash.xxh32_intdigest(word[:k], 2 + k) for k in self.prefixes if len(word) >= k)]
        out = tuple(hashes) if self.known is None else tuple(self.known[h] for h in hashes if h in self.known)
        self[word] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        """The sorted distinct features of a text."""
        words = set(WORD.findall(text.lower())) if text else ()
        return np.unique(np.array([h for w in words for h in self[w]], dtype=np.uint32))


@dataclass
class Linear:
    columns: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def score(self, indptr: np.ndarray, indices: np.ndarray, dense: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.columns[indices])]) if len(indices) else np.zeros(1)
        z = total[indptr[1:]] - total[indptr[:-1]] if len(indices) else np.zeros(len(indptr) - 1)
        return 1 / (1 + np.exp(-np.clip(z + dense @ self.dense + self.bias, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(indptr: np.ndarray, indices: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, set_: Settings) -> Linear:
    """Logistic regression with weight decay, by full-batch Adam."""
    n = len(y)
    if n == 0:
        return Linear(np.zeros(width), np.zeros(dense.shape[1]), -20.0)
    rate = (y.sum() + 0.5) / (n + 1)
    model = Linear(np.zeros(width), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    row = np.repeat(np.arange(n), np.diff(indptr))
    w = np.concatenate([model.columns, model.dense, [model.bias]])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, set_.rounds + 1):
        model = Linear(w[:width], w[width:-1], w[-1])
        gap = (model.score(indptr, indices, dense) - y) / n
        g = np.concatenate([np.bincount(indices, weights=gap[row], minlength=width), gap @ dense, [gap.sum()]])
        g[:-1] += set_.decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.1 / (1 + t / 100) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return Linear(w[:width], w[width:-1], float(w[-1]))


@dataclass
class Chain:
    """The fitted models, the features that they use, and the deciding threshold of the last one."""

    names: list[str]
    known: dict[int, int]
    models: list[Linear]
    threshold: float
    prefixes: tuple[int, ...]

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        indptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        indices = np.concatenate(sets).astype(np.int64) if len(sets) and indptr[-1] else np.zeros(0, dtype=np.int64)
        out = np.zeros((len(sets), 0))
        for model in self.models:
            out = np.column_stack([out, model.score(indptr, indices, logit(out))])
        return out


def train(sets: list[np.ndarray], labels: np.ndarray, set_: Settings) -> Chain:
    """The chain of labelled feature sets; labels has a column for each category, with -1 where it isn't known."""
    seen: dict[bytes, int] = {}
    for k, s in enumerate(sets):
        seen.setdefault(s.tobytes() + labels[k].tobytes(), k)  # equal texts count once
    rows = np.array(sorted(seen.values()), dtype=np.int64)
    sets, labels = [sets[k] for k in rows], labels[rows]
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint32)
    names, inverse = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    chosen = np.zeros(len(names), dtype=bool)
    for c in range(labels.shape[1]):
        y, given = np.maximum(labels[:, c], 0), labels[:, c] >= 0
        total = np.bincount(inverse, weights=given[row].astype(float), minlength=len(names))
        yes = np.bincount(inverse, weights=y[row].astype(float), minlength=len(names))
        share = y[given].mean() if given.any() else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):  # log-likelihood ratio of word and category
            g = 2 * (np.nan_to_num(yes * np.log(yes / (total * share))) + np.nan_to_num((total - yes) * np.log((total - yes) / (total * (1 - share)))))
        g[total < set_.least_texts] = 0
        best = np.argsort(-g, kind="stable")[: set_.features]
        chosen[best[g[best] >= set_.least_ratio]] = True
    number = np.cumsum(chosen) - 1
    use = chosen[inverse]
    indices = number[inverse[use]].astype(np.int64)
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row[use], minlength=len(sets)))]).astype(np.int64)
    known = {int(h): int(k) for h, k in zip(names[chosen], number[chosen], strict=True)}
    fold = np.random.default_rng(set_.seed).permutation(len(sets)) % set_.folds

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(indptr)
        return np.concatenate([[0], np.cumsum(counts[mask])]).astype(np.int64), indices[np.repeat(mask, counts)]

    apart, models = np.zeros((len(sets), 0)), []
    for c in range(labels.shape[1]):
        y, dense, given = labels[:, c].astype(float), logit(apart), labels[:, c] >= 0
        held = np.zeros(len(sets))
        for f in range(set_.folds):
            use = given & (fold != f)
            model = fit(*part(use), dense[use], y[use], len(known), set_)
            held[fold == f] = model.score(*part(fold == f), dense[fold == f])
        models.append(fit(*part(given), dense[given], y[given], len(known), set_))
        apart = np.column_stack([apart, held])
    threshold, given = 0.5, labels[:, -1] >= 0
    if 0 < (labels[:, -1] == 1).sum() < given.sum():
        order = np.flatnonzero(given)[np.argsort(-apart[given, -1], kind="stable")]
        hits, p = np.cumsum(labels[order, -1]), apart[order, -1]
        f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
        at = int(np.argmax(f1))
        threshold = float(np.clip((p[at] + (p[at + 1] if at + 1 < len(p) else 0.0)) / 2, 0.1, 0.9))
    return Chain([n for n, *_ in set_.categories], known, models, threshold, set_.prefixes)


def learn(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain on at most train_rows labelled texts.

    Labels with a null id are left out, a null value counts for no category of its column; of several
    rows of an id the largest values count, and of several texts that of least hash.
    """
    set_ = settings
    values = [F.coalesce(F.max((F.col(c) == v).cast("int")), F.lit(-1)).alias(f"y{k}") for k, (_, c, v) in enumerate(set_.categories)]
    given = [f"y{k}" for k in range(len(values))]
    whole = labels.where(F.col(id_col).isNotNull() & F.coalesce(*[F.col(c) for _, c, _ in set_.categories]).isNotNull())
    sample = whole.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(*values).orderBy(F.xxhash64("id"), "id").limit(set_.train_rows)
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(sample), "id")  # train_rows short rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(set_.prefixes)
        for batch in pieces(batches):
            sets = [features.of(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), *map(batch.column, given), pa.array(sets, pa.binary())], names=["id", "h", *given, "features"])

    schema = "id bigint, h bigint, " + ", ".join(f"{g} int" for g in given) + ", features binary"
    made = texts.select("id", F.xxhash64("text").alias("h"), "text", *given).mapInArrow(run, schema)
    one = made.groupBy("id").agg(F.min(F.struct("h", *given, "features")).alias("one"))  # a row for each id of the sample

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, features_schema).sort_by("id")
        sets = [np.frombuffer(b.as_py(), dtype=np.uint32) for b in rows.column("features")]
        y = np.column_stack([rows.column(g).to_numpy() for g in given]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sets, y, set_))], pa.binary())], names=["chain"])

    features_schema = pa.schema([("id", pa.int64()), *((g, pa.int32()) for g in given), ("features", pa.binary())])
    # the rows of the sample, train_rows at most; one task even where there are none
    fitted = one.select("id", *[F.col(f"one.{c}").alias(c) for c in (*given, "features")]).coalesce(1).mapInArrow(fit_all, "chain binary").collect()
    return pickle.loads(fitted[0]["chain"])


def score(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """df with p_<category> for each category and toxic, the decision of the last one.

    Columns of these names in df are replaced, all others stay. A null or empty text has the
    probabilities of a text without known words and is never toxic; a probability equal to the threshold
    is toxic. Repeated rows are scored alike, an empty table gives none. No shuffle.
    """
    added = [*(f"p_{n}" for n in chain.names), "toxic"]
    base = df.drop(*added)
    schema = base.select("*", *[F.lit(0.0).alias(a) for a in added[:-1]], F.lit(True).alias("toxic")).schema
    sent = df.sparkSession.sparkContext.broadcast(chain)  # at most categories x features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        features = Features(chain.prefixes, chain.known)
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            p = chain.predict([features.of(t) for t in texts])
            toxic = (p[:, -1] >= chain.threshold) & np.array([bool(t) for t in texts], dtype=bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, c]) for c in range(p.shape[1])], pa.array(toxic)], names=[*batch.schema.names, *added])

    return base.mapInArrow(run, schema)
