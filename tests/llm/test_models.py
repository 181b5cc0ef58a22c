"""Toxicity, importance resampling, language-model scores, the trie, and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tracewright.llm import importance, lm_scoring, ngram_trie, queries, toxicity


def test_chain_learns_out_of_fold(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([2, 3, 5]))) for _ in range(rnd.randrange(5, 60))]
        bad = k % 6 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["nastyone", "nastytwo", "horrid"])
        rows.append((k, " ".join(words), 0.5))
        labels.append((k, 0 if bad or k % 7 == 0 else 1, int(bad)))
    df = spark.createDataFrame([*rows, (900, None, 0.5), (901, "", 0.5), (902, "fine " * 30000, 0.5), (902, "NASTYTHREE!! nastyone###", 0.5)], "doc_id long, text string, p_toxic double")
    given = spark.createDataFrame([*labels[:450], (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(df, given)
    out = toxicity.score(df, chain).collect()
    assert len(out) == len(rows) + 4
    hits = [(r["toxic"], r["doc_id"] % 6 == 0) for r in out if 450 <= r["doc_id"] < 600]
    assert sum(a and b for a, b in hits) >= 0.95 * sum(b for _, b in hits) and not any(a and not b for a, b in hits)
    last = {(r["doc_id"], r["text"]): r["toxic"] for r in out if r["doc_id"] >= 900}
    assert last == {(900, None): False, (901, ""): False, (902, "fine " * 30000): False, (902, "NASTYTHREE!! nastyone###"): True}
    assert len(chain.models[1].dense) == 1  # the second model sees the first category


def plain_chain(rows, labels, s):
    """The chain over (id, text) and {id: (quality, toxic)} with dictionaries and loops; {id: (p_low_quality, p_toxic)}."""
    import re

    import xxhash

    def features(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        return {xxhash.xxh32_intdigest(w, 1) for w in words} | {xxhash.xxh32_intdigest(w[:k], 2 + k) for w in words for k in s.prefixes if len(w) >= k}

    sets = {i: features(t) for i, t in rows}
    first = {}
    for i in sorted(i for i in sets if i in labels):
        first.setdefault((frozenset(sets[i]), labels[i]), i)  # equal texts count once
    train = sorted(first.values())
    y = {c: {i: int(labels[i][c] == (0, 1)[c]) for i in train if labels[i][c] is not None} for c in (0, 1)}
    chosen = set()
    for c in (0, 1):
        share = sum(y[c].values()) / len(y[c])
        score = {}
        for f in {f for i in y[c] for f in sets[i]}:
            total, yes = sum(f in sets[i] for i in y[c]), sum(y[c][i] for i in y[c] if f in sets[i])
            if total >= s.least_texts:
                part = lambda a, b: a * math.log(a / b) if a else 0.0
                score[f] = 2 * (part(yes, total * share) + part(total - yes, total * (1 - share)))
        chosen |= {f for f in sorted(score, key=lambda f: (-score[f], f))[: s.features] if score[f] >= s.least_ratio}
    names = sorted(chosen)
    fold = dict(zip(train, (np.random.default_rng(s.seed).permutation(len(train)) % s.folds).tolist(), strict=True))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))

    def predict(w, i, before):
        z = w["bias"] + sum(w[f] for f in sets[i] if f in chosen) + sum(w["p", k] * logit(p) for k, p in enumerate(before))
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    def fit(ids, target, before):
        keys = [*names, *[("p", k) for k in range(len(before))], "bias"]
        rate = (sum(target[i] for i in ids) + 0.5) / (len(ids) + 1)
        w = dict.fromkeys(keys, 0.0) | {"bias": math.log(rate / (1 - rate))}
        m, v = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)
        for t in range(1, s.rounds + 1):
            g = {k: s.decay * w[k] for k in keys} | {"bias": 0.0}
            for i in ids:
                gap = (predict(w, i, [b[i] for b in before]) - target[i]) / len(ids)
                for f in sets[i] & chosen:
                    g[f] += gap
                for k, b in enumerate(before):
                    g["p", k] += gap * logit(b[i])
                g["bias"] += gap
            for k in keys:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
                w[k] -= 0.1 / (1 + t / 100) * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.99**t)) + 1e-9)
        return w

    models, apart = [], []
    for c in (0, 1):
        held = {}
        for f in range(s.folds):
            w = fit([i for i in train if fold[i] != f and i in y[c]], y[c], apart)
            held |= {i: predict(w, i, [b[i] for b in apart]) for i in train if fold[i] == f}
        models.append(fit([i for i in train if i in y[c]], y[c], apart))
        apart.append(held)
    out = {}
    for i in sets:
        p = predict(models[0], i, [])
        out[i] = (p, predict(models[1], i, [p]))
    return out


def test_chain_against_plain_python(spark):
    """Every probability, against the same chain by loops; one label lacks its quality, another its toxicity."""
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice(["calm", "kind", "warm", "odd", "junkword", "vilest", "green", f"own{k}x"]) for _ in range(rnd.randrange(3, 12)))) for k in range(90)]
    rows += [(90, ""), (91, None), (92, "Vilest JUNKWORD")]
    text = dict(rows)
    labels = {k: (int("junkword" not in text[k] and "vilest" not in text[k]), int("vilest" in text[k])) for k in range(70)} | {3: (None, 1), 4: (1, None)}
    s = toxicity.Settings(least_ratio=2.0, rounds=40, folds=3)
    chain = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int"), s)
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    want = plain_chain(rows, labels, s)
    assert all(np.allclose(got[i], want[i], rtol=1e-6, atol=1e-9) for i in want), [(i, got[i], want[i]) for i in want if not np.allclose(got[i], want[i], rtol=1e-6)][:3]


def test_repeated_ids_of_labels_stay_bounded(spark):
    """A labelled id that repeats is one row of the sample, that of least hash."""
    rows = [(1, f"word{k}") for k in range(500)] + [(2, "other")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (toxicity.learn(d, labels, toxicity.Settings(least_texts=1, least_ratio=0.1)) for d in (df, df.orderBy("text").repartition(3)))
    assert a.known == b.known and len(a.known) <= 2 * 3


def test_chain_without_labels(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["toxic"] for r in toxicity.score(df, toxicity.learn(df, none)).collect()] == [False]
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(df.limit(0), toxicity.learn(df, one)).count() == 0


def test_chain_is_not_fitted_on_the_driver(spark, monkeypatch):
    """The training rows stay in a task: train() never runs in the driver's process."""
    driver, train = os.getpid(), toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: train(*a) if os.getpid() != driver else None)
    df = spark.createDataFrame([(i, "vile thing" if i % 3 == 0 else "good thing") for i in range(60)], "doc_id long, text string")
    labels = df.selectExpr("doc_id", "cast(doc_id % 3 <> 0 as int) quality", "cast(doc_id % 3 = 0 as int) toxic")
    assert len(toxicity.learn(df, labels).models) == 2


def test_toxicity_held_out(spark):
    """Trained on two thirds of the labelled documents, right on the rest."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chain = toxicity.learn(docs, labels.where("doc_id % 3 <> 0"))
    got = toxicity.score(docs.where("doc_id % 3 = 0"), chain).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").select("toxic", "truth").collect()
    hit = sum(r["toxic"] and r["truth"] == 1 for r in got)
    assert hit >= 0.85 * sum(r["truth"] == 1 for r in got) and hit >= 0.95 * sum(r["toxic"] for r in got)


def plain_buckets(text, buckets):
    """The buckets of 1- and 2-grams, by integers of Python."""
    import xxhash

    def scramble(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 % 2**64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB % 2**64
        return h ^ h >> 31

    h = [xxhash.xxh64_intdigest(w) for w in (text or "").lower().split()]
    return [scramble((a + 1) % 2**64) % buckets for a in h] + [scramble((a * 0x9E3779B97F4A7C15 + b + 2) % 2**64) % buckets for a, b in zip(h, h[1:], strict=False)]


def test_importance_of_long_texts_and_ties(spark):
    """One very long text stretches the range of draws; rows that repeat share a draw at the edge, and some of them are kept."""
    rows = [(k, f"a{k % 7} b") for k in range(400)] + [(1000, "junk " * 200_000)] + [(5000, "good tie")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 7 < 3), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    for keep in (0.1, 0.3, 0.6, 0.9):
        got = importance.select(df, labels, importance.Settings(buckets=97, keep=keep, edge_rows=10, cells=8)).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == math.ceil(keep * len(rows))
        assert min(r["draw"] for r in got if r["kept"]) >= max(r["draw"] for r in got if not r["kept"])


def test_importance_against_plain_python(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["good", "fine", "well", "junk", "spam", "the"]) for _ in range(rnd.randrange(0, 30))), 1) for k in range(300)]
    rows += [(300, None, 1), (301, "", 1), (5, rows[5][1], 1), (None, "good", 1)]
    good = [k for k in range(0, 300, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(k, 1, 0) for k in good] + [(7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    s = importance.Settings(buckets=97, keep=0.4, cells=16, edge_rows=5)
    got = importance.select(df, labels, s).collect()
    target, raw = np.ones(97), np.ones(97)
    for i, t, _ in rows:
        for g in plain_buckets(t, 97):
            raw[g] += 1
            target[g] += i in set(good)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((str(i), round(sum(ratio[g] for g in plain_buckets(t, 97)), 9)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 9)) for r in got) == want
    k = math.ceil(0.4 * len(rows))
    kept, rest = [r["draw"] for r in got if r["kept"]], [r["draw"] for r in got if not r["kept"]]
    assert len(kept) == k and min(kept) >= max(rest)
    assert importance.select(df.limit(0), labels, s).count() == 0
    assert importance.select(df, labels.limit(0), s).where("kept").count() == k


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, top in ((1, 1), (5, 3), (1000, 50), (3000, 10**12), (2000, 2**40)):
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = ngram_trie.EliasFano.build(v)
        assert (ef.get(np.arange(n)) == v).all()
        ask = np.concatenate([v, v + np.uint64(1), rng.integers(0, 2 * top, 500).astype(np.uint64), np.array([0], dtype=np.uint64)])
        assert (ef.successor(ask) == np.searchsorted(v, ask)).all()
    assert ngram_trie.EliasFano.build(np.zeros(0)).successor(np.array([3])).tolist() == [0]


def test_trie_round_trip(tmp_path):
    rng = np.random.default_rng(6)
    grams = {tuple(int(x) for x in rng.integers(0, 40, 3)) for _ in range(2000)}
    ones, twos = sorted({g[:1] for g in grams}), sorted({g[:2] for g in grams})
    threes = sorted(grams)
    at1, at2 = {g: k for k, g in enumerate(ones)}, {g: k for k, g in enumerate(twos)}
    code = lambda gs: np.arange(len(gs)).astype(np.uint16)
    levels = [
        (np.zeros(len(ones), dtype=np.int64), np.array([g[0] for g in ones]), code(ones)),
        (np.array([at1[g[:1]] for g in twos]), np.array([g[1] for g in twos]), code(twos)),
        (np.array([at2[g[:2]] for g in threes]), np.array([g[2] for g in threes]), code(threes)),
    ]
    path = str(tmp_path / "t.trie")
    ngram_trie.Trie.build(levels).save(path)
    trie = ngram_trie.Trie.open(path)
    ask = np.array([(a, b, c) for a in range(42) for b in range(42) for c in range(0, 42, 3)])
    index = {g: k for k, g in enumerate(threes)}
    assert trie.lookup(*ask.T).tolist() == [index.get(tuple(int(x) for x in g), -1) for g in ask]
    assert trie.lookup(*ask[:, :2].T).tolist() == [at2.get(tuple(int(x) for x in g[:2]), -1) for g in ask]
    p = np.array([1.0, 0.5, 1e-7])
    assert np.allclose(ngram_trie.restore(ngram_trie.quantise(p)), p, rtol=3e-4)


def lm_expected(docs, s):
    tok = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in docs]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in tok if not held(i) for w in t)
    b = Counter(x for i, t in tok if not held(i) for x in zip([b"\n", *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for i, t in tok:
        base = sum(math.log10(p1(w)) for w in t)
        score = sum(math.log10((b[x, w] + s.prior * p1(w)) / (c[x] + s.prior)) for x, w in zip([b"\n", *t[:-1]], t, strict=True))
        out.append((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out)


def test_lm_scores(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    docs += [(None, "the the The\x0bÄ x  y"), (900001, None), (900002, ""), (900003, "the " * 30000), (900003, "the " * 30000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, batch int").repartition(3)
    small = lm_scoring.Settings(batch_tokens=9000, shard_words=3000, shard_tokens=20000, split_tokens=300)
    routed = lm_scoring.Settings(batch_tokens=9000, shard_words=900, shard_tokens=6000, split_tokens=300, direct_shards=3)
    for s in (lm_scoring.Settings(), small, routed):
        got = sorted((str(r["doc_id"]), *r[1:]) for r in lm_scoring.score(df, s).collect())
        for g, w in zip(got, lm_expected(docs, s), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-12) and abs(g[6] - w[6]) <= 1e-3 * w[2], (g, w)
    assert lm_scoring.score(df.limit(0)).count() == 0
    untrained = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert lm_scoring.score(untrained).first()["base_score"] == 0.0


def test_pipeline(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    seen = [set(r["doc_id"] for r in docs.collect())]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    from pyspark.sql import functions as F

    part = docs.select("*", F.lit(1).alias("toxic"), F.lit("x").alias("email"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = part
        part = stage(spark, part, small_dir).persist()
        assert part.columns == before.columns and dict(part.dtypes) == dict(before.dtypes), name
        seen.append(set(r["doc_id"] for r in part.collect()))
        assert seen[-1] <= seen[-2]
    # toxic texts that share a telling word with two others at least can be learnt, and must be
    words = {r["doc_id"]: set(toxicity.WORD.findall((r["text"] or "").lower())) for r in docs.collect()}
    seen_in = {t: Counter(w for i, v in labels.items() if v == t for w in words[i]) for t in (0, 1)}
    telling = {w for w, n in seen_in[1].items() if n >= 3 and not seen_in[0][w]}
    learnable = {i for i, v in labels.items() if v == 1 and words[i] & telling}
    assert len(learnable) >= 5 and learnable <= seen[0] - seen[1] and not [i for i in seen[0] - seen[1] if labels.get(i) == 0]
    want = {r["component_id"] for r in queries.ngram_join.join(docs.where(F.col("doc_id").isin(list(seen[1])))).collect()}
    assert seen[2] == want and seen[3] == seen[4]
    texts = {r["doc_id"]: r for r in part.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values()) and not any("@mail" in r["text"] for r in texts.values())
    last = corpus_pipeline.STAGES[-1][1](spark, part, small_dir)
    assert {r["doc_id"] for r in last.collect()} == seen[4]


def test_pipeline_keeps_texts_of_one_id_and_odd_columns(spark, small_dir):
    """Rows that share an id but not a text stay, with their own columns; tables between the stages go."""
    from tracewright import storage

    one, other = "the quiet river runs past the old mill and the long green field", "seven red boats lay in the small harbour under a pale winter sun"
    rows = [(1, one, "en", "s", 63, 7), (1, other, "en", "s", 61, 8), (2, one, "en", "s", 63, 9), (None, one, None, None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, phone int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "phone"], name
    assert sorted((str(r["doc_id"]), r["text"], r["phone"]) for r in docs.collect()) == sorted([("1", one, 7), ("1", other, 8), ("None", one, 10)])
    with storage.tables_of_run() as made:
        packed = corpus_pipeline.run(spark, small_dir)
        assert len(made) <= 3 and packed.count() > 0


def test_pipeline_stages_take_odd_tables(spark, small_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None)], schema)
    for name, stage in corpus_pipeline.STAGES:
        # the copies of row 1 become one, all else stays; packing gives a piece for each row
        assert stage(spark, odd, small_dir).count() == (4 if name == "ngram_jaccard_join" else 5), name
        assert stage(spark, odd.limit(0), small_dir).count() == 0
