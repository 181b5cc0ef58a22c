"""Sharding, URL rules, packing, personal data: digests against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tracewright.llm import packing, pii, queries, sharding, url_filter

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a.b%x@d.e.f-g@h.i and a@b.c%x@d.e a@b.c.@d.e a@b@c.d x@y",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 99999.1.2.3 1..2.3.4",
    "4111 1111-1111 1111, 4111111111111111 41111111111111112 4111-1111-1111-1112 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 4111  1111",
    "+1 (017) 555-7713 +12 +1(2)3-45678 +123456789012345678 ++49 30 1234567- +1.",
    "",
    None,
    "9" * 3000 + " " + "a" * 3000 + "@" + "1." * 2000,
    "é😀 +49 30 1234567 ü😀x@y.zz " * 90,
    "no data at all, only words",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        spans = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        out[kind] = spans
    return out


def test_pii_base_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(None, "me@x.org", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, email string")
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(HARD):
        want = base(t)
        for kind in PATTERNS:
            assert got[i][f"n_{kind}"] == len(want[kind]), (i, kind)
        joined = ",".join(s for k in PATTERNS for s in want[k])
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), i
        assert got[i]["spans"].startswith(joined)


def test_pii_on_tables(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_disclosure_sanitiser(spark, small_dir).collect()}
    for r in docs.collect():
        want = ",".join(s for k in PATTERNS for s in base(r["text"])[k])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def brute_disclosures(texts, s):
    n = len(texts)
    words = [set(w for w in re.split(r"[\W\d_]+", (t or "").lower()) if len(w) >= s.least_length) for t in texts]
    ents = [{(k, (t or "")[int(a):int(b)].lower()) for k, spans in base(t).items() for a, b in (x.split(":")[1:] for x in spans)} for t in texts]
    df_t, df_e, df_et = Counter(w for ws in words for w in ws), Counter(e for es in ents for e in es), Counter()
    texts_e, texts_et = defaultdict(set), defaultdict(set)
    for t, ws, es in zip(texts, words, ents, strict=True):
        for e in es:
            texts_e[e].add(t)
            for w in ws:
                if w not in e[1]:
                    df_et[e, w] += 1
                    texts_et[e, w].add(t)
    out = {}
    for (e, w), k in df_et.items():
        if len(texts_et[e, w]) >= s.least_texts and df_e[e] < n:
            share = math.log(n * k / (df_e[e] * df_t[w])) / math.log(n / df_e[e])
            if share >= s.generalise_at:
                out[(*e, w)] = share
    return out


def test_pii_disclosed_terms(spark):
    texts = [f"common words zorblat here ann{i} x@y.org" for i in "abcd"] + [f"common words here {w}" for w in ("one", "two", "six", "ten", "zed", "fob")] + ["common zorblat alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = pii.Settings(generalise_at=0.5, remove_at=0.95)
    found = pii.find(df, s).collect()
    want = brute_disclosures(texts, s)
    assert ("email", "x@y.org", "zorblat") in want
    terms = {(r["text"][x["start"] : x["end"]]) for r in found for k in pii.METHOD_KINDS for x in r[k]}
    assert terms == {w for *_, w in want}
    assert not any(r[k] for r in found if "@" not in r["text"] for k in pii.METHOD_KINDS)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, s).collect()}
    assert clean[10] == texts[10] and "x@y.org" not in clean[0] and "zorblat" not in clean[0] and "common words" in clean[0]


def test_pii_terms_of_rare_entities(spark):
    """On a production table, where every entity stands in one text: against plain Python."""
    small = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    s, n = pii.Settings(), len(texts)
    words = {i: {w for w in re.split(r"[\W\d_]+", t.lower()) if len(w) >= s.least_length} for i, t in texts.items()}
    ents = {i: {(k, t[int(x.split(":")[1]) : int(x.split(":")[2])].lower()) for k, spans in base(t).items() for x in spans} for i, t in texts.items()}
    df_t, df_e = Counter(w for ws in words.values() for w in ws), Counter(e for es in ents.values() for e in es)
    pairs = defaultdict(list)
    for i, es in ents.items():
        for e in es:
            for w in words[i]:
                if w not in e[1]:
                    pairs[e, w].append(texts[i])
    told = defaultdict(dict)
    for (e, w), of in pairs.items():
        share = math.log(n * len(of) / (df_e[e] * (df_t[w] + max(0, s.least_texts - len(set(of)))))) / math.log(n / df_e[e])
        if share >= s.generalise_at:
            told[e][w] = share
    assert told
    got = pii.find(spark.read.parquet(f"{small}/documents.parquet")).collect()
    for r in got:
        want = defaultdict(float)
        for e in ents[r["doc_id"]]:
            for w, share in told[e].items():
                want[w] = max(want[w], share)
        for kind in pii.METHOD_KINDS:
            assert {(r["text"] or "")[x["start"] : x["end"]].lower() for x in r[kind]} == {w for w, v in want.items() if (v >= s.remove_at) == (kind == "remove")}, r["doc_id"]


def test_pii_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(df).count() == 0
    rows = [(1, "a@b.cd", 5, "t", 1.5, "h")] * 3 + [(None, None, 6, None, None, None)]
    same = spark.createDataFrame(rows, "doc_id long, text string, phone int, terms string, _email double, __hash string")
    out = pii.sanitise(same).collect()
    assert pii.sanitise(same).columns == same.columns
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(1, "[EMAIL]", 5, "t", 1.5, "h")] * 3 + [(None, None, 6, None, None, None)]))
    found = pii.find(same)
    assert found.columns[:4] == ["doc_id", "text", "terms", "_email"] and found.where("size(phone) = 0").count() == 4


def test_pii_many_entities_in_one_text(spark):
    """A thousand addresses of one text are one group; terms inside an address are no clue to that address alone."""
    many = " ".join(f"u{k}@zorblat.org" for k in range(1000))
    texts = [f"{many} zorblat quibble fnord"] + [f"common words {k}" for k in range(60)] + ["fnord common words"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    row = pii.find(df, pii.Settings(generalise_at=0.5, least_texts=1)).where("doc_id = 0").first()
    assert len(row["email"]) == 1000
    terms = {texts[0][x["start"] : x["end"]] for k in pii.METHOD_KINDS for x in row[k]}
    assert terms == {"quibble"}


def test_shards_follow_the_law(spark):
    rows = [(i, "x" * (i % 7)) for i in range(3000)] + [(5, "x" * 5)] * 4 + [(None, None), (None, "ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, 16).collect()
    assert len(got) == len(rows)
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got) and any(r["grown_shard"] == 16 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "key"
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert max(map(len, by.values())) < 1.5 * len(rows) / 16
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_shards_of_long_and_often_repeated_rows(spark):
    """A row of more copies than one task makes, a long text, and columns of the names that the operator makes."""
    row = spark.createDataFrame([(7, "abc", 1, 2)], "doc_id long, text string, shard int, slot int")
    df = row.crossJoin(spark.range(25_003).drop("id")).unionByName(spark.createDataFrame([(8, "é" * 3_000_000, 0, 0)], row.schema))
    got = sharding.shard_documents(df).collect()
    mine = sorted(r["slot"] for r in got if r["doc_id"] == 7)
    assert len(mine) == 25_003 and mine == list(range(mine[0], mine[0] + 25_003))
    assert [r["size"] for r in got if r["doc_id"] == 8] == [6_000_001]


def test_weights_confine_movement(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.Tree.even(16)
    one = {r["doc_id"]: r["shard"] for r in sharding.assign(df, tree).collect()}
    two = {r["doc_id"]: r["shard"] for r in sharding.assign(df, tree.weighted({0: 3.0})).collect()}
    moved = [(one[k], two[k]) for k in one if one[k] != two[k]]
    assert moved and all(b in (0, 1, 2, 3) for _, b in moved)  # into the region of shard 0 only
    assert sum(v == 0 for v in two.values()) > 2 * sum(v == 0 for v in one.values())
    zero = {r["shard"] for r in sharding.assign(df, tree.weighted({9: 0.0})).collect()}
    assert zero == set(range(16)) - {9}


def test_descent_against_plain_python(spark):
    import xxhash

    tree = sharding.Tree.even(6)

    def draw(key, place, w):
        h = xxhash.xxh64_intdigest(f"{key}/{place}".encode(), seed=42)
        return -math.log(((h >> 11) + 0.5) / 2**53) / w

    def walk(key):
        r = min(range(len(tree.regions)), key=lambda r: draw(key, str(r), sum(w for k in tree.regions[r] for _, w in k)))
        k = min(range(len(tree.regions[r])), key=lambda k: draw(key, f"{r}.{k}", sum(w for _, w in tree.regions[r][k])))
        return min(tree.regions[r][k], key=lambda s: draw(key, f"{r}.{k}.{s[0]}", s[1]))[0]

    got = sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), tree).collect()
    assert all(r["shard"] == walk(r["doc_id"]) for r in got)


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Www.EXAMPLE.com/en/7x?q#f", "a://b://c/d", "http://example.net?x", "http://x.org/es/#casino-win", "ftp://free-bets.Example.NET/de/8/", "http://h.test/casino/bets", "http://h.test/casinobets", "http://h.test/spam-farms", "http://ÄÖ.com/en/", "http://notexample.com/en/7", "http://org/es/", "http://a\nb.net/de/\nx", "http://h.test/c%61sino/%62ETS", "http://h.test/p%6Frn", "http://h.test/%2570orn", "http://h.test/" + "x" * 300_000 + "/porn/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    rows = url_filter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.sql("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(r["page_id"], r["url"]) for r in df.collect()])
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, con.sql(url_filter.judge_urls_sql()).fetchall()))
    by = {r["page_id"]: r for r in rows}
    assert (by[3]["host"], by[3]["path"], by[3]["rule"], by[3]["verdict"]) == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (by[4]["host"], by[4]["path"]) == ("b:", "//c/d") and by[8]["verdict"] == "block" and by[9]["verdict"] == "allow" and by[10]["verdict"] == "allow"
    assert by[15]["verdict"] == by[16]["verdict"] == by[18]["verdict"] == "block" and by[17]["verdict"] == "allow"
    assert by[0]["host"] == by[0]["path"] == "" and by[7]["rule"] == "example.net/de/8"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", None), ("odd", 1.0), ("ODD", 0.5), ("queer-fish", 0.6), ("", 1.0), (None, 1.0), ("dual", 1.0), ("dual", None)], "term string, weight double")
    v = url_filter.vocabulary(terms)
    assert v.strict == ("bad", "dual") and v.soft == (("odd", 1.0), ("queer-fish", 0.6))
    df = spark.createDataFrame([(0, "http://x/bad"), (1, "http://x/odd"), (2, "http://x/odd/queer-fish"), (3, "http://x/badly")], "page_id long, url string")
    rows = url_filter.judge_urls(df, v, ()).select("page_id", "host", "path", "rule", "verdict").collect()
    assert {r["page_id"]: r["verdict"] for r in rows} == {0: "block", 1: "allow", 2: "block", 3: "allow"}
    with pytest.raises(ValueError):
        url_filter.vocabulary(terms, most=2)


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_file()
    texts = [None, "", "Hello  world!\n\n it's <|endoftext|> ok", "ünï 日本 😀" * 400, "a" * 5000, "word " * 9000, "x"] * 2
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "null id", 0)], "doc_id long, text string, offset int").repartition(3)
    plain = tokenizers.Tokenizer.from_file(path)
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in [*enumerate(texts), (None, "null id")]}
    got = packing.pack(df, path, 1024)
    rows = got.collect()
    for doc, ids in want.items():
        mine = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [sum(r["length"] for r in mine[:k]) for k in range(len(mine))]
        assert b"".join(r["ids"] for r in mine) == b"".join(i.to_bytes(4, "little") for i in ids) and all(r["doc_tokens"] == len(ids) for r in mine)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(seqs) == list(range(len(seqs)))
    for k, parts in seqs.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or k == len(seqs) - 1
    whole = packing.sequences(got).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(map(len, want.values())) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    digest = packing.pack_documents(df, path).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in digest) == Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in rows)
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_of_blanks_without_end(spark):
    """A run of blanks that the fast encoder can't take, against the tokenizer itself."""
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_file()
    texts = [" " * 2_000_000 + "x", "\n" * 1_200_000 + "y z", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    plain = tokenizers.Tokenizer.from_file(path)
    got = defaultdict(int)
    for r in packing.pack_documents(df, path).collect():
        got[r["doc_id"]] += r["length"]
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_ranks_that_differ_from_merges_are_seen():
    plain = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, "merges": [["a", "b"], ["b", "c"], ["ab", "c"]]}, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}}
    assert packing.follows_ids(plain)
    model = plain["model"]
    assert not packing.follows_ids(plain | {"model": model | {"merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}})  # ids don't grow
    assert not packing.follows_ids(plain | {"model": model | {"merges": [["a", "b"], ["b", "c"], ["a", "bc"]]}})  # "abc" alone ends as ab, c
    assert not packing.follows_ids(plain | {"model": model | {"vocab": model["vocab"] | {"cc": 6}}}) and not packing.follows_ids(plain | {"normalizer": {"type": "NFC"}})
