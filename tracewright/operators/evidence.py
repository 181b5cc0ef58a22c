"""Evidence: fusion, consensus, conflicts, best claims, resolution, scores and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.storage import cut

INFINITY = float("inf")


def bounded(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c.cast("double")))


def noisy_or(df: DataFrame, keys: list[str], group: Column | None = None, confidence: str = "confidence", out: str = "confidence") -> DataFrame:
    """1 - product(1 - c) for each key, over the best c of each independent group."""
    best = df.withColumn("__g", group if group is not None else F.monotonically_increasing_id()).groupBy(*keys, "__g").agg(F.max(bounded(F.col(confidence))).alias("__c"))
    # the logarithm of 0 is avoided: a certain group makes the whole certain
    miss = F.when(F.max(F.col("__c")) >= 1.0, 0.0).otherwise(F.product(1 - F.col("__c")))
    return best.groupBy(*keys).agg((1 - miss).alias(out), F.array_sort(F.collect_set("__g")).alias("groups"))


def fuse(df: DataFrame, subject: list[str], order: str = "ord") -> DataFrame:
    """Of each subject the claim that comes first, fused over its sources (group: independent_group, else source)."""
    first = df.groupBy(*subject).agg(F.min_by("claim", order).alias("claim"))
    own = df.join(first, [*subject, "claim"])
    fused = noisy_or(own, [*subject, "claim"], F.coalesce("independent_group", "source"))
    sources = own.groupBy(*subject, "claim").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return fused.join(sources, [*subject, "claim"]).withColumn("confidence", F.round("confidence", 12))


def consensus(df: DataFrame, subject: list[str], value: str = "value") -> DataFrame:
    """One row for each subject and value: confidence, rank (1 is best) and the confidence of the next in rank."""
    scored = noisy_or(df, [*subject, value], F.coalesce("independent_group", "source"))
    order = Window.partitionBy(*subject).orderBy(F.desc("confidence"), value)
    return scored.withColumns({"rank": F.row_number().over(order), "next": F.lead("confidence").over(order), "claims": F.count("*").over(Window.partitionBy(*subject))})


def consistency_findings(df: DataFrame, subject: list[str], value: str = "value", ambiguity: float = 0.1) -> DataFrame:
    """(subject, code, severity, delta): conflicts between claims, and subjects whose best claim is weak."""
    best = consensus(df, subject, value).where("rank = 1")
    delta = F.col("confidence") - F.col("next")
    conflict = best.where("claims > 1").select(*subject, F.lit("EVIDENCE_CONFLICT").alias("code"), F.when((delta <= ambiguity) & (F.col("next") >= 0.5), "error").otherwise("warning").alias("severity"), delta.alias("delta"))
    weak = best.where("confidence < 0.5").select(*subject, F.lit("EVIDENCE_WEAK_CONSENSUS").alias("code"), F.lit("warning").alias("severity"), F.col("confidence").alias("delta"))
    return conflict.unionByName(weak)


def conflicts(df: DataFrame, subject: list[str], value: str = "value") -> DataFrame:
    """Subjects with several values, with those values and all sources, sorted."""
    return df.groupBy(*subject).agg(F.array_sort(F.collect_set(value)).alias("values"), F.array_sort(F.collect_list("source")).alias("sources")).where(F.size("values") > 1)


def best_claim(df: DataFrame, subject: list[str], value: str = "value") -> DataFrame:
    """The claim of the highest confidence, ties to the highest source."""
    return df.groupBy(*subject).agg(F.max(F.struct("confidence", "source", value)).alias("b")).select(*subject, f"b.{value}", "b.source", "b.confidence")


def resolve(df: DataFrame, subject: list[str], value: str = "value") -> DataFrame:
    """The best-supported value, its confidence and sources, and the rejected values in order of support."""
    per = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*subject, value).agg(F.max("confidence").alias("c"), F.array_sort(F.collect_set("source")).alias("s"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), F.col(value).alias("v"), "s")))
    out = per.groupBy(*subject).agg(ranked.alias("r"))
    return out.select(*subject, F.col("r")[0]["v"].alias(value), F.round(-F.col("r")[0]["k"], 12).alias("confidence"), F.col("r")[0]["s"].alias("sources"), F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["v"]).alias("conflicts"))


# How far each source is trusted.
SOURCE_WEIGHT = {"ipc356": 1.0, "source_cad": 1.0, "kicad": 0.95, "bom": 0.9, "pick_place": 0.85, "gerber_x2": 0.8, "silkscreen": 0.55, "geometry_inference": 0.4}
IDENTITY_WEIGHT = {"bom": 1.0, "pick_place": 0.9, "marking": 0.75, "footprint_match": 0.65, "geometry": 0.5, "heuristic": 0.35}


def source_weight(source: Column, weights: dict[str, float] | None = None, default: float = 0.25) -> Column:
    out = F.lit(default)
    for name, w in (SOURCE_WEIGHT if weights is None else weights).items():
        out = F.when(F.lower(source) == name, w).otherwise(out)
    return out


def weighted(df: DataFrame, weights: dict[str, float] | None = None, default: float = 0.25) -> DataFrame:
    return df.withColumn("weighted", F.round(F.least(F.lit(1.0), F.col("confidence") * source_weight(F.col("source"), weights, default)), 12))


def resolve_identity(df: DataFrame, fields: tuple[str, ...] = ("kind", "value", "footprint", "mpn")) -> DataFrame:
    """Of each component the best value of every field by weighted confidence, their mean, and all rejected values."""
    rated = weighted(df, IDENTITY_WEIGHT, 0.5)
    out = rated.groupBy("component_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    lost = []
    for f in fields:
        own = rated.where((F.coalesce(F.col(f), F.lit("")) != "") & ((F.lit(f) != "kind") | (F.lower(F.col(f)) != "unknown")))
        own = own.groupBy("component_id", f).agg(F.max("weighted").alias("w")).groupBy("component_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("k"), F.col(f).alias("v")))).alias("r"))
        own = own.select("component_id", F.col("r")[0]["v"].alias(f), (-F.col("r")[0]["k"]).alias(f"__{f}"), F.transform(F.slice("r", F.lit(2), F.size("r")), lambda x: x["v"]).alias(f"__lost_{f}"))
        out = out.join(own, "component_id", "left")
        lost.append(F.coalesce(f"__lost_{f}", F.array().cast("array<string>")))
    rates = F.filter(F.array(*[F.col(f"__{f}") for f in fields]), lambda x: x > 0)
    mean = F.when(F.size(rates) > 0, F.round(F.aggregate(rates, F.lit(0.0), lambda s, x: s + x) / F.size(rates), 12)).otherwise(0.0)
    return out.select("component_id", *fields, mean.alias("confidence"), "sources", F.array_sort(F.array_distinct(F.flatten(F.array(*lost)))).alias("conflicts"))


def duplicates(df: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(id_col)).alias("ids")).where(F.size("ids") > 1)


def merge_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in order."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def merge_strict(*parts: DataFrame, key: str = "id") -> DataFrame:
    """All rows once; rows of one key that differ are refused, when the rows are read."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    row = F.struct(*[F.col(f"`{c}`") for c in every.columns])
    one = every.groupBy(key).agg(F.countDistinct(F.xxhash64(row)).alias("__n"), F.any_value(row).alias("__row"))
    return one.where(F.assert_true(F.col("__n") == 1, F.concat(F.lit("conflicting record: "), F.col(key).cast("string"))).isNull()).select("__row.*")


def merge_best(*parts: DataFrame, key: list[str], score: str = "confidence", ties: list[str] = ()) -> DataFrame:
    """Of rows with equal keys the one of the highest score, ties in order of further columns; nulls are the worst."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = Window.partitionBy(*key).orderBy(F.desc_nulls_last(score), *ties)
    return every.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def merge_distinct(*parts: DataFrame, key: list[str]) -> DataFrame:
    """Rows with equal keys once."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.dropDuplicates(key)


def statistics(df: DataFrame, value: str, key: tuple[str, ...] = ()) -> DataFrame:
    """(count, mean, median, min, max, pstdev) of a column, for each key; nulls without values, the count 0."""
    v = F.col(value).cast("double")
    return df.groupBy(*key).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("pstdev"))


#: A round of selection counts so many parts of a range.
PARTS = 1_024


def _select(rows: DataFrame, states: DataFrame) -> DataFrame:
    """What the counts of one round say: states (k, share, rank, next, below, a, b) with low and high, the values at both ranks, or a narrower range.

    The parts of a range are told by a function that grows with the value, so ranks in different parts lie at their ends.
    """
    small = states.limit(100_001).count() <= 100_000
    wide = F.col("b") / 2 - F.col("a") / 2
    part = F.when(F.col("v") == -INFINITY, -1).when(F.col("v") == INFINITY, PARTS).when(wide > 0, F.floor((F.col("v") / 2 - F.col("a") / 2) / wide * (PARTS - 1)).cast("int")).when(F.col("v") > F.col("a"), PARTS - 1).otherwise(0)
    asked = F.broadcast(states) if small else states
    inside = (F.col("first") | F.col("v").between(F.col("a"), F.col("b")))
    met = rows.withColumnRenamed("k", "same").join(asked, F.col("same").eqNullSafe(F.col("k"))).where(inside)
    told = ["k", "share", "rank", "next", "below"]
    counts = met.groupBy(*told, part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    until = F.col("below") + F.sum("n").over(Window.partitionBy("k", "share").orderBy("part"))
    placed = counts.withColumn("until", until).withColumn("since", F.col("until") - F.col("n"))
    at = lambda rank: F.max(F.when((F.col("since") <= F.col(rank)) & (F.col(rank) < F.col("until")), F.struct("part", "since", "least", "most")))
    both = placed.groupBy(*told).agg(at("rank").alias("x"), at("next").alias("y"))
    apart = F.col("x.part") != F.col("y.part")
    found = apart | (F.col("x.least") == F.col("x.most"))
    return both.select("k", "share", "rank", "next", F.col("x.since").alias("below"), F.col("x.least").alias("a"), F.col("x.most").alias("b"), F.lit(False).alias("first"), F.when(found, F.col("x.most")).alias("low"), F.when(found, F.col("y.least")).alias("high"))


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...], key: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """(key, p<share in percent>) by linear interpolation between the two nearest ranks; nulls and NaN don't count.

    exact narrows a range round each pair of ranks, by counts of its parts, until they are found: no task holds the values of a group,
    however many there are. Otherwise a sketch of bounded size tells about where they are.
    """
    name = lambda p: f"p{p * 100:g}".replace(".", "_")
    if not exact:
        return df.groupBy(*key).agg(*[F.percentile_approx(F.col(value).cast("double"), p, 100_000).alias(name(p)) for p in shares])
    rows = df.select(F.struct(*(key or [F.lit(0).alias("all")])).alias("k"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("v"))
    finite = F.when(F.abs("v") < INFINITY, F.col("v"))
    facts = cut(rows.groupBy("k").agg(F.count("v").alias("n"), F.min(finite).alias("a"), F.max(finite).alias("b")), "percentile-groups", free=False)
    rows = rows.where("v is not null")
    wanted = facts.where("n > 0").withColumn("share", F.explode(F.array(*[F.lit(float(p)) for p in shares]))).withColumn("place", F.col("share") * (F.col("n") - 1))
    states = wanted.select("k", "share", F.floor("place").alias("rank"), F.ceil("place").alias("next"), F.lit(0).cast("bigint").alias("below"), "a", "b", F.lit(True).alias("first"))
    found: list[DataFrame] = []
    while True:
        told = cut(_select(rows, states), "percentile-ranks", free=False)
        found.append(told.where("low is not null").select("k", "share", "low", "high"))
        states = told.where("low is null").drop("low", "high")
        if states.isEmpty():
            break
    step = F.col("place") - F.floor("place")
    # a weight of 0 leaves out an infinite neighbour
    between = F.when((step == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("low") * (1 - step) + F.col("high") * step)
    done = wanted.join(reduce(DataFrame.unionByName, found), ["k", "share"]).select("k", "share", between.alias("value"))
    each = done.groupBy("k").agg(*[F.max(F.when(F.col("share") == float(p), F.col("value"))).alias(name(p)) for p in shares])
    out = facts.select("k").join(each.withColumnRenamed("k", "same"), F.col("k").eqNullSafe(F.col("same")), "left")
    return out.select(*[F.col("k")[c].alias(c) for c in key], *[name(p) for p in shares])


def coverage(covered: DataFrame, all_: DataFrame, key: str, empty: float = 1.0) -> DataFrame:
    """Share of the distinct keys of all_ that covered has too."""
    marked = all_.select(key).distinct().join(covered.select(key).distinct().withColumn("__c", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count("__c").alias("covered")).withColumn("coverage", F.when(F.col("total") == 0, empty).otherwise(F.round(F.col("covered") / F.col("total"), 6)))


def precision_recall(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    a = predicted.select(key).distinct().withColumn("p", F.lit(1))
    b = truth.select(key).distinct().withColumn("t", F.lit(1))
    n = a.join(b, key, "full").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count(F.col("p") + F.col("t")).alias("tp"))
    n = n.withColumn("precision", F.when(F.col("np") > 0, F.col("tp") / F.col("np")).when(F.col("nt") == 0, 1.0).otherwise(0.0)).withColumn("recall", F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(1.0))
    return n.select("precision", "recall", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("f1"))


def weighted_score(df: DataFrame, score: str = "score", weight: str = "weight") -> DataFrame:
    w = F.greatest(F.lit(0.0), F.col(weight).cast("double"))
    return df.agg(F.sum(bounded(F.col(score)) * w).alias("n"), F.sum(w).alias("d")).select(F.when(F.col("d") > 0, F.round(F.col("n") / F.col("d"), 6)).otherwise(0.0).alias("score"))


def score(base: float, steps: list[tuple[Column, float, str]], names: tuple[str, str] = ("confidence", "evidence"), first: tuple[str, ...] = ()) -> list[Column]:
    """A confidence that grows by each step whose condition holds, and the names of those steps."""
    total, said = F.lit(base), [F.lit(f) for f in first]
    for test, gain, name in steps:
        test = F.coalesce(test, F.lit(False))
        total = total + F.when(test, gain).otherwise(0.0)
        said.append(F.when(test, name))
    return [F.round(F.least(total, F.lit(1.0)), 12).alias(names[0]), F.array_compact(F.array(*said)).alias(names[1])]
