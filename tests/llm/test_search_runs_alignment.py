"""One-bit search, periodic runs and token alignment against plain versions of them."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import one_bit_search, periodic_runs, queries, token_alignment

# ---- one-bit search


def exact_nearest(rows, asked, k):
    """{query: [(vec_id, cosine)]} over rows (id, vector), all pairs."""
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in sorted(i for i in good if asked(i)):
        x = good[q]
        near = [((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), i) for i, y in good.items() if i != q and len(y) == len(x)]
        out[q] = [(i, s) for s, i in sorted(near, key=lambda t: (-t[0], t[1]))[:k]]
    return out


def answered(df, id_col="vec_id"):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r[id_col], r["score"]))
    return dict(got)


def test_search_recall(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    exact = exact_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda i: i % 50 == 0, 5)
    got = answered(queries.op11_one_bit_search(spark, small_dir))
    assert got.keys() == exact.keys() and all(len(got[q]) == len(exact[q]) for q in exact)
    scores = {q: dict(exact_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()], lambda i, q=q: i == q, 10**6)[q]) for q in list(exact)[:3]}
    assert all(scores[q][i] == pytest.approx(s, abs=1e-12) for q in scores for i, s in got[q])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hits >= 0.97 * sum(map(len, exact.values()))


def test_search_blocks_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(24).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(7)
    sure = one_bit_search.Settings(confidence=50.0, block=100, queries=7)
    got = answered(one_bit_search.nearest(df, F.col("id") % 9 == 0, sure))
    exact = exact_nearest(rows, lambda i: i % 9 == 0, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in exact.items()}


def test_search_copies_ties_and_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(i, v) for i in range(40)] + [(50, w), (51, [6.0, -2.0, 1.0]), (52, None), (53, []), (54, [0.0] * 3), (55, [1.0, None, 2.0]), (56, [float("nan"), 1.0, 1.0]), (None, v), (0, v), (100, [1.0, 2.0]), (150, [2.0, 4.0]), (200, [1e-300, 2e-300]), (250, [1e300, 2e300])]
    df = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id bigint, embedding array<double>, score string")
    got = answered(one_bit_search.embeddings(df))
    assert got.keys() == {0, 50, 100, 150, 200, 250}
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert got[50][0][0] == 51 and [i for i, _ in got[50][1:]] == [0, 1, 2, 3]
    assert sorted(i for i, _ in got[100]) == [150, 200, 250] and all(s == pytest.approx(1) for _, s in got[100])
    assert one_bit_search.embeddings(df.where("false")).count() == 0


def test_search_dense_neighbourhood(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(16) + 1e-3 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = answered(one_bit_search.nearest(df, F.col("id") % 500 == 0))
    exact = exact_nearest(rows, lambda i: i % 500 == 0, 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in exact.items()}


# ---- periodic runs


def plain_runs(w, exponent=4, least=6):
    found = set()
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(exponent * p, least) and not any(all(w[k] == w[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                found.add((i, length, p))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 == 0 and n and key is not None:
        a, old = g % n, words[:]
        p = 1 + (n - a) // (3 + g % 8)
        words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_of_small_texts():
    rng = random.Random(5)
    for _ in range(400):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 2, 9, 30]))] for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            texts = [(t[:11] * 9)[:40] for t in texts]
        exponent, least = rng.choice([2, 3, 4]), rng.choice([2, 6])
        got = [[] for _ in texts]
        for t, *run in zip(*periodic_runs.runs(np.array([w for t in texts for w in t], dtype=np.int64), np.cumsum([len(t) for t in texts]), exponent, least), strict=True):
            got[t].append(tuple(map(int, run)))
        assert got == [plain_runs(t, exponent, least) for t in texts]
    with pytest.raises(ValueError):
        periodic_runs.runs(np.arange(3), np.array([3]), 1)


def test_runs_query(spark, small_dir):
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, small_dir).collect()}
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        if len((r["text"] or "").split()) < 700:  # the plain version is quadratic
            assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])


def test_runs_of_odd_texts(spark):
    texts = [None, "", "  \n\t", "a", "a a a a a a", "a a a a a", "x " * 5000, "ä ä b " * 9, "a b a b a b a b c", "b a b a b a b a", "\x0b".join(["q"] * 6), " ".join(f"w{k}" for k in range(30_000)) + " end" * 7]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(4, texts[4], 1), (None, texts[4], 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_runs int")
    got = periodic_runs.documents(df).collect()
    few = lambda found: sorted((tuple(r) for r in found if r[0] not in (6, 11)), key=str)
    assert few(got) == few(plain_row(k, t) for k, t, _ in rows if k not in (6, 11))
    by_id = {r["doc_id"]: r for r in got}
    assert tuple(by_id[6])[1:6] == (1, 0, 5000, 1, 5_000_000) and tuple(by_id[11])[1:6] == (1, 30_000, 7, 1, 7000)
    assert periodic_runs.documents(df.where("false")).count() == 0
    assert periodic_runs.find(df).where("doc_id = 8").first()["collapsed"] == "a b c"


# ---- token alignment


@pytest.fixture(scope="module")
def files():
    return queries.tokenizer_file(), queries.tokenizer_file("piece_bpe_32k.model")


def plain_alignment(both, tokenizer, text):
    """(n_a, n_b, groups, links by pair) by sets of common ends; None without tokens."""
    if not text:
        return None
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    sides = []
    for ids, known in ((a, both.a_bytes), (b, both.b_bytes)):
        if b"".join(known[i] for i in ids) != (" " + text).encode():
            return None
        sides.append(np.cumsum([len(known[i]) for i in ids]).tolist())
    ends = sorted(set(sides[0]) & set(sides[1]))
    parts = [([], []) for _ in ends]
    for side, (ids, at) in enumerate(zip((a, b), sides, strict=True)):
        for i, e in zip(ids, at, strict=True):
            parts[bisect.bisect_left(ends, e)][side].append(i)
    return len(a), len(b), parts, Counter((x, y) for xs, ys in parts for x in xs for y in ys)


def plain_table(files, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(files[0])
    tokenizer.encode_special_tokens = True
    both = token_alignment.Tokenizers(*files, True)
    told = [(key, plain_alignment(both, tokenizer, text)) for key, text in rows]
    count = Counter(pair for _, t in told if t for pair in t[3])
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for key, t in told:
        if t is None:
            yield (key, 0, 0, 0, 0, 0, 0, "")
            continue
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in t[2])
        yield (key, t[0], t[1], len(t[2]), sum(t[3].values()), sum(n for p, n in t[3].items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in t[3].items()), hashlib.sha256(written.encode()).hexdigest())


def test_alignment_query(spark, small_dir, files):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_token_alignment(spark, small_dir).collect())
    assert got == sorted(plain_table(files, rows))


ODD = [None, "", " ", "  ", "a ", " a", "a\n b", "\n \n", "😀😀 é", "<|endoftext|> hi <s> </s>", "▁x", "a　b  c\t d", "<0x41>", "a" * 300, "\x00 a", "ａ ﬁ", "日本語 日本語", "x" + " " * 300 + "y", "word " * 2000]


def test_alignment_of_odd_texts(spark, files):
    rows = [*enumerate(ODD), (4, ODD[4]), (None, "a word"), (99, ODD[9])]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, batch string").repartition(3)
    expected = sorted(plain_table(files, rows), key=str)
    for settings in (token_alignment.Settings(), token_alignment.Settings(named=40, tokens=10)):  # many batches give the same
        assert sorted((tuple(r) for r in token_alignment.align_table(df, *files, settings).collect()), key=str) == expected
    assert token_alignment.align_table(df.where("false"), *files).count() == 0
    assert token_alignment.align_table(df.where("text is null"), *files).first()["n_a"] == 0


def test_alignment_in_parts(files, monkeypatch):
    text = " ".join(t for t in ODD if t and "▁" not in t)
    whole = token_alignment.Tokenizers(*files, True).encode(text)
    monkeypatch.setattr(token_alignment.Tokenizers, "LONG", 50)
    both = token_alignment.Tokenizers(*files, True)
    assert both.parts and both.encode(text) == whole
    few, many = (token_alignment.align([whole], both, most)[0] for most in (20, 1 << 20))
    assert few.groups == many.groups and dict(zip(few.pairs.tolist(), few.links.tolist(), strict=True)) == dict(zip(many.pairs.tolist(), many.links.tolist(), strict=True))


def test_groups_are_the_finest_common_parts():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = (sorted({n, *(rng.randrange(1, n + 1) for _ in range(rng.randrange(20)))}) for _ in range(2))
        ends = sorted(set(a) & set(b))
        of_a, of_b = token_alignment.groups(np.array(a), np.array(b))
        assert of_a.tolist() == [bisect.bisect_left(ends, e) for e in a] and of_b.tolist() == [bisect.bisect_left(ends, e) for e in b]
