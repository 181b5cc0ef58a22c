"""Joins and tiling against all pairs."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from tracewright.llm import decontaminate, embedding_join, ngram_join, pii, queries
from tracewright.llm.common import components


def closed(nodes, links):
    label = {n: n for n in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return {n: top(n) for n in nodes}


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(docs):
    sets = [(i, grams(t)) for i, t in docs]
    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(k)
    links, count = set(), defaultdict(int)
    pairs = {(a, b) for ks in by.values() for a in ks for b in ks if a < b} if docs else set()
    for a, b in pairs:
        x, y = sets[a][1], sets[b][1]
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            links.add((sets[a][0], sets[b][0]))
            count[a] += 1
            count[b] += 1
    return closed([i for i, _ in sets], links), [(sets[k][0], count[k]) for k in range(len(sets))]


def near_copies(seed, groups, copies, words=60):
    rnd, docs = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(groups):
        own = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            t = list(own)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                t[rnd.randrange(words)] = rnd.choice(vocabulary)
            docs.append(" ".join(t))
    return docs


@pytest.mark.parametrize("block", [7, 256])
def test_jaccard_join(spark, block):
    texts = near_copies(3, 12, 14) + ["a b c d", "A  b c D", "a b c", "", None, "   ", "same same same same same same"] * 2 + ["long " * 4000 + "x", "long " * 4000 + "x y"]
    docs = [(k * 3 % 1009, t, True) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*docs, (None, texts[0], True)], "doc_id long, text string, kept boolean").repartition(5)
    want, counts = expected([(i, t) for i, t, _ in docs])
    got = ngram_join.join(df, ngram_join.Settings(block=block, block_grams=100 * block)).collect()
    assert len(got) == len(docs) + 1
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, None, None, 0, True)]
    got = [r for r in got if r["doc_id"] is not None]
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted(counts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_jaccard_join_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(df).count() == 0
    same = spark.createDataFrame([(1, "one two three four five six")] * 3 + [(2, "one two three four five six")], "doc_id long, text string")
    assert {(r["component_id"], r["n_links"]) for r in ngram_join.join(same).collect()} == {(1, 3)}


def test_rows_of_one_id_with_different_texts(spark):
    one, other = "the first text of this number has ten words here", "an unrelated second text under the very same number stands here"
    rows = [(1, one, 5), (1, other, 6), (1, other, 6), (2, one.upper(), 7), (3, one + " tail", 8), (1, one + "  ", 9), (None, one, 1), (None, one, 1), (4, None, 2), (4, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = ngram_join.join(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in got if r["doc_id"] in (2, 3)) == [(2, 1, 3), (3, 1, 3)]
    kept = [(r["doc_id"], r["text"], r["component_id"]) for r in ngram_join.keep_one(df).collect()]
    assert sorted((i, t) for i, t, _ in kept if i == 1 and t == other) == [(1, other)]
    assert sum(i is not None and bool(t) and t.lower().split()[:3] == ["the", "first", "text"] for i, t, _ in kept) == 1
    assert sorted(str(t) for i, t, _ in kept if i == 4) == ["", "None"] and sum(i is None for i, *_ in kept) == 2 and len(kept) == 6
    assert ngram_join.keep_one(df).columns == df.columns and ngram_join.keep_one(df.limit(0)).count() == 0


def test_large_group_of_long_near_copies(spark):
    """Many near copies of a long text, one very long text among them, in blocks of few n-grams: against the sizes known beforehand."""
    base = [f"word{k}" for k in range(600)]
    rows = [(k, " ".join([*base[:580], f"own{k}", *base[581:]])) for k in range(3000)] + [(5000, "long " + " ".join(f"t{k}" for k in range(120_000))), (5001, " ".join(f"t{k}" for k in range(120_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["component_id"], r["n_links"], r["kept"]) for r in ngram_join.join(df, ngram_join.Settings(block_grams=100_000)).collect()}
    assert all(got[k] == (0, 2999, k == 0) for k in range(3000)) and got[5000] == (5000, 1, True) and got[5001] == (5000, 1, False)


def test_jaccard_query(spark, small_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    want, counts = expected(docs)
    got = queries.op1_ngram_jaccard_join(spark, small_dir).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == sorted(counts)


def test_bayesian_limits():
    s = ngram_join.Settings()
    least = s.least_matches()
    assert least[128] < 0.8 * 128 and list(least.values()) == sorted(least.values())
    assert least[128] > 64  # a pair of similarity one half is dropped


def all_pairs(rows, threshold):
    vs = []
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v] if v else [], dtype=float)
        vs.append((i, x / np.sqrt((x * x).sum()) if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0 else None))
    count, links = [0] * len(vs), []
    for a in range(len(vs)):
        for b in range(a):
            x, y = vs[a][1], vs[b][1]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= threshold:
                count[a] += 1
                count[b] += 1
                links.append((vs[a][0], vs[b][0]))
    return closed([i for i, _ in vs], links), sorted((vs[k][0], count[k]) for k in range(len(vs)))


@pytest.mark.parametrize("settings", [embedding_join.Settings(), embedding_join.Settings(blocks=8, grid=2, chunk=16)])
def test_pigeonhole_join(spark, settings):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 24))
    rows = [(i, (base[i % 40] + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.2, 0.3])).tolist()) for i in range(320)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0, None]), (1004, [float("nan")] * 24), (1005, [float("inf")] + [0.0] * 23), (1006, (base[3] * 1e-30).tolist()), (1007, (base[3] * 5).tolist()), (1008, [1.0]), (1009, [2.0]), (1010, [-1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows] + [(None, rows[0][1], 1)], "vec_id long, embedding array<double>, rep int").repartition(3)
    want, counts = all_pairs(rows, 0.95)
    got = embedding_join.join(df, settings).collect()
    assert len(got) == len(rows) + 1
    known = [r for r in got if r["vec_id"] is not None]
    assert {r["vec_id"]: r["component_id"] for r in known} == want
    assert sorted((r["vec_id"], r["n_links"]) for r in known) == counts
    assert embedding_join.join(df.limit(0)).count() == 0


def test_pigeonhole_rounds_send_a_vector_once(spark, monkeypatch):
    """What is shuffled at once is bounded by the vectors, not by the square of a dense cell; every link is found all the same."""
    from pyspark.sql.group import GroupedData

    rng, sent, real = np.random.default_rng(4), [], GroupedData.applyInArrow

    def counted(self, *args):
        sent.append(self._df.count())
        return real(self, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", counted)
    base = rng.standard_normal((100, 24))
    rows = [(i, (base[i % 100] + rng.standard_normal(24) * rng.choice([0.1, 0.2, 0.3])).tolist()) for i in range(300)]
    got = embedding_join.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), embedding_join.Settings(chunk=40, at_once=1)).collect()
    want, counts = all_pairs([(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v in rows], 0.95)
    assert {r["vec_id"]: r["component_id"] for r in got} == want and sorted((r["vec_id"], r["n_links"]) for r in got) == counts
    assert sent == [300] * 8


def test_long_vectors(spark):
    """Vectors too long for a rotation matrix, of even and odd length; the turn keeps all distances."""
    rng = np.random.default_rng(2)
    rows = []
    for dim, at in ((20_000, 0), (9_999, 100)):
        base = rng.standard_normal((4, dim))
        x = base / np.linalg.norm(base, axis=1)[:, None]
        y = embedding_join.turned(x, 7, {})
        assert np.allclose(y @ y.T, x @ x.T) and not np.allclose(np.abs(y).max(), np.abs(x).max())
        rows += [(at + k, (base[k % 4] + rng.standard_normal(dim) * rng.choice([0.0, 0.2, 0.4])).tolist()) for k in range(16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want, counts = all_pairs(rows, 0.95)
    got = embedding_join.join(df).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == want and sorted((r["vec_id"], r["n_links"]) for r in got) == counts


def test_pigeonhole_query(spark, small_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    want, counts = all_pairs(rows, 0.95)
    got = queries.op3_subspace_pigeonhole(spark, small_dir).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == want and sorted((r["vec_id"], r["n_links"]) for r in got) == counts


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 90), (90, 95), (95, 100), (200, 200)]
    want = closed({n for link in links if link[0] != link[1] for n in link}, links[:-1])
    for at_once in (0, 1_000_000):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long"), at_once=at_once).collect()}
        assert got == want
    words = [(f"n{a}", f"n{b}") for a, b in links]
    small, large = (sorted(map(tuple, components(spark.createDataFrame(words, "u string, v string"), at_once=k).collect())) for k in (1000, 0))
    assert small == large


def plain_tiles(item, text, n):
    """Greedy string tiling by trying every pair of places."""
    mine, theirs, out = [False] * len(item), [False] * len(text), []
    while True:
        best = None
        for p in range(len(item)):
            for q in range(len(text)):
                k = 0
                while p + k < len(item) and q + k < len(text) and item[p + k] == text[q + k] and not mine[p + k] and not theirs[q + k]:
                    k += 1
                if k >= n and (best is None or (-k, p, q) < best):
                    best = (-k, p, q)
        if best is None:
            return sorted(out)
        k, p, q = -best[0], best[1], best[2]
        for d in range(k):
            mine[p + d] = theirs[q + d] = True
        out.append((p, q, k))


def test_tiling_against_all_places():
    rnd = random.Random(5)
    for _ in range(60):
        item = [rnd.choice("abcd") for _ in range(25)]
        text = [rnd.choice("abcd") for _ in range(20)] + item[10:18] + ["z"] + item[:9] + [rnd.choice("abcd") for _ in range(9)]
        index = decontaminate.Index([(1, " ".join(item))], 4)
        found = index.tiles(" ".join(text))
        want = plain_tiles(item, text, 4)
        got = found[0][2] if found else []
        assert got == want  # places of ties included


def test_long_repeated_runs_are_tiled_fast():
    """A text of one word against a long item of it: 10^8 pairs of places, which are never made."""
    index = decontaminate.Index([(1, "buy " * 5000), (2, "buy now " * 2000)], 5)
    began = time.perf_counter()
    found = {i: (c, t) for i, c, t in index.tiles("buy " * 20_000)}
    assert found == {1: (1.0, [(0, 0, 5000)])}
    found = {i: (c, t) for i, c, t in index.tiles("buy " * 3000 + "or " + "now buy " * 3000)}
    assert found[1] == (0.6, [(0, 0, 3000)]) and found[2] == (1.0, [(0, 3002, 4000)])
    assert time.perf_counter() - began < 10


def test_tiling_query(spark, small_dir):
    """The registered query against tiling by plain Python for every document and item that share five words."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    items = [(r["item_id"], re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    seeds = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in items]
    got = {r["doc_id"]: r for r in queries.op2_greedy_string_tiling(spark, small_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        words = re.findall(r"\w+", (r["text"] or "").lower())
        mine = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        cover = {}
        for (item, w), s in zip(items, seeds, strict=True):
            if mine & s:
                near = [k for k in range(len(words)) if any(tuple(words[j : j + 5]) in s for j in range(max(0, k - 4), k + 1))]
                part, last = [], None  # only words of seeds can lie in a tile; gaps become a word that no item has
                for k in near:
                    part += [words[k]] if last is None or k == last + 1 else [None, words[k]]
                    last = k
                cover[item] = sum(n for *_, n in plain_tiles(w, part, 5)) / len(w)
        row = got[r["doc_id"]]
        assert abs(row["coverage"] - max(cover.values(), default=0.0)) < 1e-12, r["doc_id"]
        assert row["item_ids"] == sorted(i for i, c in cover.items() if c >= 0.5) and row["contaminated"] == bool(row["item_ids"])


def test_short_items_are_found_whole(spark):
    rows = [(1, "So, what is BASALT? What is basalt!"), (2, "what is the basalt"), (3, "先问：玄武岩是什么？再答。"), (4, "basalt"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(20, "What is basalt?"), (21, "玄武岩是什么"), (22, "..."), (23, "what is basalt")], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"], [[tuple(t) for t in m["tiles"]] for m in r["matches"]]) for r in decontaminate.mark(df, items).collect()}
    none = (False, [], [])
    assert got == {1: (True, [20, 23], [[(0, 1, 3)], [(0, 1, 3)]]), 2: none, 3: (True, [21], [[(0, 1, 1)]]), 4: none, 5: none, 6: none}


def test_reordered_passages_are_caught(spark):
    item = " ".join(f"token{k}" for k in range(40))
    parts = item.split()
    moved = " ".join(["Some", "words", *parts[20:], "between", *parts[:20], "end."])
    rows = [(1, moved), (2, "clean text " * 3000), (3, None), (4, ""), (5, item.upper() + "!"), (6, " ".join(parts[:15])), (7, moved), (7, moved)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, coverage int")
    items = spark.createDataFrame([(10, item), (11, "too short"), (None, item), (12, None), (10, item)], "item_id long, text string")
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_bytes=100)):
        got = [(r["doc_id"], r["contaminated"], r["item_ids"]) for r in decontaminate.mark(df, items, settings).collect()]
        assert sorted(got) == [(1, True, [10]), (2, False, []), (3, False, []), (4, False, []), (5, True, [10]), (6, False, []), (7, True, [10]), (7, True, [10])]
    assert decontaminate.mark(df, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.mark(df.limit(0), items).count() == 0


def test_rows_made_in_tasks_are_not_broadcast(spark, monkeypatch):
    """Bands and exploded terms are many rows for each that Spark counts on; at its own threshold they don't go through the driver."""
    plans = {}

    def seen(module):
        real = module.cut

        def cut(df, name, *a, **k):
            if name in ("bands", "entity-groups", "terms"):
                df.collect()
                plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return real(df, name, *a, **k)

        monkeypatch.setattr(module, "cut", cut)

    seen(ngram_join), seen(pii)
    docs = spark.createDataFrame([(i, f"{t} write to clerk{i % 7}@office.example") for i, t in enumerate(near_copies(3, 6, 4))], "doc_id long, text string")
    ngram_join.join(docs).collect()
    pii.digest(docs).collect()
    assert plans.keys() == {"bands", "entity-groups", "terms"}
    merged = {"bands": ["key#"], "entity-groups": ["e#"], "terms": ["term#", "texts_of#", "hash#"]}
    for name, keys in merged.items():
        assert all(f"SortMergeJoin [{k}" in plans[name] for k in keys), name
