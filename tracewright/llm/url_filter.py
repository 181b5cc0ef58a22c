"""URL filtering by site rules and by a weighted vocabulary found with an Aho-Corasick automaton.

A term counts where neither neighbour is an ASCII letter or digit, percent codes of letters, digits and marks undone. One strict term rejects a URL;
so do soft terms of at least two different kinds whose weights reach the limit. A matching site rule
goes before the vocabulary, the longest rule first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default vocabulary (strict terms; soft terms and their weights). vocabulary() takes another from a table.
STRICT = (
    "18plus", "adult-x", "ads-track", "camgirl", "camgirls", "casino-win", "cheap-pills", "clickbait", "crackme", "free-bets", "hentai", "keygen", "malware", "milf", "nsfw", "phishing", "porn", "pornhub", "ransomware",
    "sexcam", "spam-farm", "spyware", "trojan-horse", "warez", "xnxx", "xvideos", "xxx",
)
SOFT = {
    "ads": 1.0, "adult": 1.0, "affiliate": 0.5, "banner": 0.5, "bet": 1.0, "bets": 1.0, "betting": 1.5, "bitcoin": 0.5, "bonus": 0.5, "casino": 1.5, "cheap": 0.5, "cialis": 1.5, "coupon": 0.5, "crack": 1.0, "dating": 1.0,
    "discount": 0.5, "download": 0.25, "erotic": 1.5, "escort": 1.5, "forex": 1.0, "free": 0.5, "gambling": 1.5, "hack": 0.5, "hot": 0.25, "jackpot": 1.0, "loan": 0.75, "loans": 0.75, "lottery": 1.0, "nude": 1.5, "nudes": 1.5,
    "payday": 1.0, "pharmacy": 0.75, "pills": 1.0, "pirate": 0.75, "poker": 1.0, "popup": 0.75, "prize": 0.5, "redirect": 0.5, "roulette": 1.0, "serial": 0.25, "sex": 1.5, "sexy": 1.0, "slots": 1.0, "spam": 1.0, "strip": 0.5,
    "torrent": 1.0, "track": 0.5, "viagra": 1.5, "webcam": 0.75, "win": 0.5, "winner": 0.5,
}
# The site rules of the query, host and path in one string.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, float], ...] = tuple(SOFT.items())
    least_terms: int = 2
    least_weight: float = 1.5

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term in sorted({*self.strict, *(t for t, _ in self.soft)} - {""}):
            a.add_word(term, term)
        if len(a):
            a.make_automaton()
        return a


def vocabulary(table: DataFrame, least_terms: int = 2, least_weight: float = 1.5, most: int = 1_000_000) -> Vocabulary:
    """The vocabulary of a table (term, weight): strict where the weight is null. Terms are lower-cased; of repeated ones the strictest counts.

    It goes into every task, so a table of more than most terms is refused.
    """
    rows = table.where("term <> ''").groupBy(F.translate("term", UPPER, LOWER).alias("term")).agg(F.bool_or(F.col("weight").isNull()).alias("strict"), F.max("weight").cast("double").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return Vocabulary(tuple(sorted(r["term"] for r in rows if r["strict"])), tuple(sorted((r["term"], r["weight"]) for r in rows if not r["strict"])), least_terms, least_weight)


#: Percent codes of letters, digits and - . _ ~, which never need one, in the order they are replaced (in lower case).
CODES = tuple((f"%{ord(c):02x}", c.lower()) for c in "-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~")


def plain(url: str) -> str:
    """The text that terms are looked for in: A-Z in lower case, needless percent codes undone."""
    url = url.translate(str.maketrans(UPPER, LOWER))
    if "%" in url:
        for code, letter in CODES:
            url = url.replace(code, letter)
    return url


def host_of(url: Column) -> Column:
    """From the first :// to / ? # or the end, with A-Z in lower case; empty without :// or URL."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def term_hits(df: DataFrame, url: str, vocabulary: Vocabulary) -> DataFrame:
    """df with strict_hits and soft_terms (distinct, sorted), soft_weight and rejected.

    Columns of these names in df are replaced. A null or empty URL has no hits.
    """
    kept = df.drop("strict_hits", "soft_terms", "soft_weight", "rejected")
    schema = kept.select("*", F.array().cast("array<string>").alias("strict_hits"), F.array().cast("array<string>").alias("soft_terms"), F.lit(0.0).alias("soft_weight"), F.lit(True).alias("rejected")).schema
    soft = dict(vocabulary.soft)
    strict = frozenset(vocabulary.strict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = vocabulary.automaton()
        word = frozenset(LOWER + "0123456789")
        for batch in batches:
            rows = []
            for text in batch.column(url).to_pylist():
                hits = set()
                if text and len(a):
                    text = plain(text)
                    for end, term in a.iter(text):
                        at = end - len(term) + 1
                        if term not in hits and (at == 0 or text[at - 1] not in word) and (end + 1 == len(text) or text[end + 1] not in word):
                            hits.add(term)
                found = sorted(h for h in hits if h in soft)
                weight = float(sum(soft[h] for h in found))
                hard = sorted(hits & strict)
                rows.append((hard, found, weight, bool(hard) or len(found) >= vocabulary.least_terms and weight >= vocabulary.least_weight))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "strict_hits", "soft_terms", "soft_weight", "rejected"])

    return kept.mapInArrow(run, schema)


def judge_urls(pages: DataFrame, vocabulary: Vocabulary = Vocabulary(), rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages, with the terms found.

    A null URL or one without :// has an empty host and path, fits no rule and is allowed unless its
    own text holds rejected terms. Repeated rows give repeated results, an empty table none; further
    columns of pages are not carried. No shuffle.
    """
    hits = term_hits(pages.select("page_id", F.col("url").cast("string").alias("url")), "url", vocabulary)
    out = hits.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "strict_hits", "soft_terms", "soft_weight")


def judge_urls_sql(vocabulary: Vocabulary = Vocabulary(), rules=RULES) -> str:
    """The digest columns of judge_urls in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hit = lambda term: f"regexp_matches(low, {quote('(^|[^a-z0-9])' + term.replace('.', '[.]') + '($|[^a-z0-9])')})"
    strict = " OR ".join(hit(t) for t in vocabulary.strict) or "FALSE"
    count = " + ".join(f"CASE WHEN {hit(t)} THEN 1 ELSE 0 END" for t, _ in vocabulary.soft) or "0"
    weight = " + ".join(f"CASE WHEN {hit(t)} THEN {w} ELSE 0 END" for t, w in vocabulary.soft) or "0"
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    for code, letter in CODES:
        low = f"replace({low}, '{code}', '{letter}')"
    cases, says = [], []
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        site, slash, rest = text.partition("/")
        fits = f"((host = {quote(site)} OR ends_with(host, {quote('.' + site)})) AND starts_with(path, {quote(slash + rest)}))"
        cases.append(f"WHEN {fits} THEN {quote(text)}")
        says.append(f"WHEN {fits} THEN {quote(verdict)}")
    return f"""
WITH parts AS (
  SELECT page_id, {low} AS low,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {' '.join(cases)} ELSE NULL END AS rule,
       CASE {' '.join(says)} WHEN ({strict}) OR (({count}) >= {vocabulary.least_terms} AND ({weight}) >= {vocabulary.least_weight}) THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
