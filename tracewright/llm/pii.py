"""Personal data: patterns, and terms that give the found entities away.

Four kinds of entity are found by patterns. Then the corpus says which other terms disclose an entity:
with document frequencies over all documents, a term t tells PMI(e; t) = log(N df(e,t) / (df(e) df(t)))
of the information IC(e) = log(N / df(e)) that the entity e carries (Sánchez and Batet, 2016). In a
document that holds e, terms that disclose a share of remove_at or more are removed, terms from
generalise_at on are generalised, i.e. replaced by the name of the entity's kind. No entity and no pair
is too rare to count; a pair that stands in fewer than least_texts different texts is weak evidence, and
each text it lacks counts as one more document that holds the term without the entity.

DataFrame functions only. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, few_files

KINDS = ("email", "ip", "card", "phone")
METHOD_KINDS = ("generalise", "remove")

#: Patterns of the base kinds. The look-behinds only save tries: a match never begins inside a run of
#: its own characters, unless an earlier match has ended there (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Of the runs of digits with single separators only those of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


@dataclass(frozen=True)
class Settings:
    generalise_at: float = 0.8
    remove_at: float = 0.95
    least_texts: int = 3
    least_length: int = 3


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, step: int = 64) -> Column:
    """Exclusive running totals of an array of longs; in steps, so that the work stays near linear."""
    zero = F.lit(0).cast("bigint")

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def chunk(v: Column, acc: Column, k: Column) -> Column:
        start = F.struct(acc["sum"].alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return let(F.aggregate(F.slice(v, k * step + 1, F.lit(step)), start, add), lambda c: F.struct(c["sum"].alias("sum"), F.concat(acc["out"], F.array(c["out"])).alias("out")))

    steps = lambda v: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / step).cast("int") - 1, F.lit(0)))
    start = F.struct(zero.alias("sum"), F.array().cast("array<array<bigint>>").alias("out"))
    return let(values, lambda v: F.flatten(F.aggregate(steps(v), start, lambda acc, k: chunk(v, acc, k))["out"]))


def located(text: Column, pattern: Column, found: Column) -> Column:
    """Array of (start, end, value) of the matches found: the pieces between matches give their places."""
    length = lambda x: F.length(x).cast("bigint")

    def place(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(m)), length)
        return let(gaps, lambda g: F.arrays_zip(m.alias("m"), g.alias("g"), running(F.zip_with(m, g, lambda x, y: length(x) + y)).alias("r")))

    spans = F.transform(let(found, place), lambda z: F.struct((z["r"] + z["g"]).alias("start"), (z["r"] + z["g"] + length(z["m"])).alias("end"), z["m"].alias("value")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    def check(d: Column) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int"))
        doubled = F.transform(at, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
        return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0

    return let(F.reverse(digits(value)), check)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def accepted(kind: str):
    return lambda s: valid(kind, s["value"])


def base_spans(df: DataFrame, text_col: str) -> DataFrame:
    """df with an array of spans for each kind, named as the kind; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = df.withColumns({f"_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()})
    for kind, pattern in PATTERNS.items():
        spans = located(text, F.lit(pattern), F.col(f"_{kind}"))
        out = out.withColumn(kind, F.filter(spans, accepted(kind)))
    return out.drop(*[f"_{k}" for k in PATTERNS])


def words(text: Column) -> Column:
    """The distinct lower-cased runs of letters."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))


def entities(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), F.lower(s["value"]).alias("value")))


def disclosures(docs: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """(hash, terms): for each text of found the terms in it that disclose one of its entities, with share and kind.

    docs has text; found has text, hash and ents (its distinct entities) of the documents that
    hold any. Frequencies count rows of docs; support counts different texts, and what a pair lacks of
    least_texts is added to df(t). Entities that stand in exactly the same texts tell the same, and are
    scored as one: a text of a thousand addresses of its own makes no more pairs than a text of one.
    The kind is that of the entity that is disclosed most, and a term inside an entity itself (an
    address, say) is no clue to that entity.
    """
    set_, rows = settings, found.count()
    texts = found.groupBy("hash").agg(F.first("text").alias("text"), F.first("ents").alias("ents"), F.count("*").alias("n"))
    postings = texts.select("hash", "n", F.explode("ents").alias("e"))
    where = F.struct(F.count("*").alias("m"), F.bit_xor(F.xxhash64("hash")).alias("x"), F.bit_xor(F.xxhash64("hash", F.lit(1))).alias("y"))
    known = postings.groupBy("e").agg(F.sum("n").alias("df_e"), where.alias("texts_of"))
    groups = postings.hint("merge").join(known, "e").groupBy("hash", "texts_of").agg(F.first("n").alias("n"), F.first("df_e").alias("df_e"), F.collect_list("e").alias("es"))
    groups = cut(groups, "entity-groups", rows=rows)
    terms = groups.drop("es").join(texts.select("hash", "text"), "hash").withColumn("term", F.explode(words(F.col("text")))).where(F.length("term") >= set_.least_length)
    pairs = terms.groupBy("texts_of", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("df_et"), F.first("df_e").alias("df_e"))
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).where(F.length("term") >= set_.least_length).groupBy("term").agg(F.count("*").alias("df_t"))
    total = docs.count()
    # Spark sizes exploded terms as one row for each group and arrays by their compressed files, and keeps to a broadcast once
    # planned, as merging takes a shuffle more; merged by hint, none goes through the driver
    lacking = F.greatest(F.lit(set_.least_texts) - F.col("texts"), F.lit(0))
    pmi = F.log(F.lit(float(total)) * F.col("df_et") / (F.col("df_e") * (F.col("df_t") + lacking)))
    ic = F.log(F.lit(float(total)) / F.col("df_e"))
    told = pairs.hint("merge").join(seen, "term").withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0)).where(F.col("share") >= set_.generalise_at).select("texts_of", "term", "share")
    # only terms of the text itself, with those entities of the group that don't hold them
    own = terms.select("hash", "texts_of", "term").hint("merge").join(told, ["texts_of", "term"]).groupBy("hash", "texts_of").agg(F.collect_list(F.struct("term", "share")).alias("ts"))
    kind = lambda t: F.array_max(F.transform(F.filter("es", lambda e: ~F.contains(e["value"], t["term"])), lambda e: e["kind"]))
    marked = own.hint("merge").join(groups.select("hash", "texts_of", "es"), ["hash", "texts_of"]).select("hash", F.explode(F.transform("ts", lambda t: F.struct(t["term"].alias("term"), t["share"].alias("share"), kind(t).alias("kind")))).alias("t"))
    best = marked.where("t.kind is not null").groupBy("hash", F.col("t.term").alias("term")).agg(F.max(F.struct("t.share", "t.kind")).alias("top"))
    return best.groupBy("hash").agg(F.collect_list(F.struct("term", F.col("top.share").alias("share"), F.col("top.kind").alias("kind"))).alias("terms"))


def _found(df: DataFrame, settings: Settings, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows of df with spans of all kinds, and under what name each column of df goes meanwhile.

    The patterns run once over all texts; only rows with an entity are joined with terms.
    """
    set_ = settings
    names = {c: f"__{k}" for k, c in enumerate(df.columns)}
    text = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    renamed = df.toDF(*names.values())
    whole = cut(few_files(base_spans(renamed, names[text_col])), "spans")
    hash_ = F.struct(F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"))
    any_ = F.size(KINDS[0]) + sum((F.size(k) for k in KINDS[1:]), F.lit(0)) > 0
    ents = F.array_distinct(F.flatten(F.array(*[entities(k) for k in KINDS])))
    held = whole.where(any_).withColumns({"__text": text, "__hash": hash_})
    found = cut(few_files(held.select(F.col("__text").alias("text"), F.col("__hash").alias("hash"), ents.alias("ents"))), "entities")
    flagged = cut(disclosures(whole.select(text.alias("text")), found, set_).withColumnRenamed("hash", "__hash"), "terms", rows=found.count())

    out = held.hint("merge").join(flagged, "__hash", "left")
    pattern = F.when(F.col("terms").isNotNull(), F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit("(?!)"))
    out = out.withColumn("__pattern", pattern).withColumn("__found", F.when(F.col("terms").isNotNull(), F.regexp_extract_all(F.col("__text"), F.col("__pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("__spans", located(F.col("__text"), F.col("__pattern"), F.col("__found")))
    told_of = F.map_from_entries(F.transform("terms", lambda t: F.struct(t["term"], F.struct(t["share"].alias("share"), t["kind"].alias("kind")))))
    told = F.coalesce(told_of, F.create_map().cast("map<string,struct<share:double,kind:string>>"))
    as_told = let(told, lambda t: F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(t[F.lower(s["value"])]["kind"], F.lit("any")).alias("value"), F.coalesce(t[F.lower(s["value"])]["share"], F.lit(0.0)).alias("share"))))
    out = out.withColumn("__told", as_told)
    bare = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    out = out.withColumn("remove", F.transform(F.filter("__told", lambda s: s["share"] >= set_.remove_at), bare))
    out = out.withColumn("generalise", F.transform(F.filter("__told", lambda s: s["share"] < set_.remove_at), bare))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    rest = whole.where(~any_).withColumns({k: none for k in METHOD_KINDS})
    columns = [*names.values(), *KINDS, *METHOD_KINDS]
    return out.select(*columns).unionByName(rest.select(*columns)), names


def find(df: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """df with one array of spans (start, end, value) for each of the kinds and for generalise and remove.

    Columns of those names in df are replaced, all others stay. Null and empty texts have no spans.
    Rows that are equal have equal spans. An empty table gives an empty result.
    """
    found, names = _found(df, settings, text_col)
    own = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in (*KINDS, *METHOD_KINDS)]
    return found.select(*own, *KINDS, *METHOD_KINDS)


def places(kind: str) -> Column:
    ordered = F.array_sort(F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.transform(ordered, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed and then start, comma-joined."""
    return F.array_join(F.flatten(F.array(*map(places, kinds))), ",")


def marks_of(kind: str) -> Column:
    """What stands for each span: (start, minus end, label); in this order the longer of two at one place comes first."""

    def label(s: Column) -> Column:
        if kind == "remove":
            return F.lit("")
        return F.concat(F.lit("["), F.upper(s["value"]), F.lit(" TERM]")) if kind == "generalise" else F.lit(f"[{kind.upper()}]")

    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), label(s).alias("label")))


def redacted(text: Column) -> Column:
    """The text of find() with entities replaced by [KIND], generalised terms by [KIND TERM] and removed terms by nothing."""
    marks = [marks_of(k) for k in (*KINDS, *METHOD_KINDS)]
    spans = F.array_sort(F.flatten(F.array(*marks)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.coalesce(text.cast("string"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        skip = -s["back"] <= acc["at"]
        begin = F.greatest(s["start"], acc["at"])
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int")), F.when(s["start"] >= acc["at"], s["label"]).otherwise(F.lit("")))
        return F.when(skip, acc).otherwise(F.struct((-s["back"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    done = F.aggregate(spans, start, step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def sanitise(df: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """df with every text sanitised, all other columns as they are, whatever they are called.

    A null text stays null, and a text without spans is unchanged.
    """
    found, names = _found(df, settings, text_col)
    any_ = sum((F.size(k) for k in (*KINDS, *METHOD_KINDS)), F.lit(0)) > 0
    return found.select(*[(F.when(any_, redacted(F.col(n))).otherwise(F.col(n)) if c == text_col else F.col(n)).alias(c) for c, n in names.items()])


def digest(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts and places of the spans of every row of documents."""
    found = find(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), settings)
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*KINDS, *METHOD_KINDS)).alias("spans"))
