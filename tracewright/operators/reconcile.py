"""Reconciliations and differences: full outer joins with a status for each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.windows import numbered

from tracewright.functions.geometry import angle_gap
from tracewright.functions.text import normal_reference, normal_text


def both_sides(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join by key; values are structs b and a, null where the side has no row."""
    fields = lambda df: F.struct(*[c for c in df.columns if c not in key])
    return before.select(*key, fields(before).alias("b")).join(after.select(*key, fields(after).alias("a")), key, "full")


def changes(before: DataFrame, after: DataFrame, key: list[str], names: tuple[str, str, str] = ("added", "removed", "changed"), same: str | None = None) -> DataFrame:
    """(key, kind): keys of one side only, and keys whose values differ, nulls being equal."""
    added, removed, changed = names
    kind = F.when(F.col("b").isNull(), added).when(F.col("a").isNull(), removed).when(~F.col("b").eqNullSafe(F.col("a")), changed)
    out = both_sides(before, after, key).select(*key, kind.alias("kind"))
    return out.where("kind is not null") if same is None else out.fillna(same, ["kind"])


def change_counts(diff: DataFrame) -> DataFrame:
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(k)
    return diff.agg(F.count("*").alias("total"), count("added"), count("removed"), count("changed"))


def set_differences(before: DataFrame, after: DataFrame, key: str, member: str) -> DataFrame:
    """(key, removed, added): members that a key lost or won, for keys where any did."""
    sets = lambda df: df.groupBy(key).agg(F.collect_set(member).alias("m"))
    a, b = sets(before), sets(after)
    none = F.array().cast(a.schema["m"].dataType)
    both = a.withColumnRenamed("m", "x").join(b.withColumnRenamed("m", "y"), key, "full").select(key, F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    out = both.select(key, F.array_sort(F.array_except("x", "y")).alias("removed"), F.array_sort(F.array_except("y", "x")).alias("added"))
    return out.where((F.size("removed") > 0) | (F.size("added") > 0))


def bom(bill: DataFrame, placed: DataFrame) -> DataFrame:
    """(reference, code, expected, observed) by normalised reference; columns reference, value, footprint on both sides."""
    own = lambda df, p: df.select(normal_reference(F.col("reference")).alias("reference"), *[F.col(c).alias(p + c) for c in ("value", "footprint")]).where("reference <> ''")
    b, c = own(bill, "b_").dropDuplicates(["reference"]).withColumn("in_b", F.lit(True)), own(placed, "c_").withColumn("in_c", F.lit(True))
    both = b.join(c, "reference", "full")

    def issue(test: Column, code: str, expected: Column, observed: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.coalesce(expected, F.lit("")).alias("expected"), F.coalesce(observed, F.lit("")).alias("observed")))

    present = F.col("in_b") & F.col("in_c")
    differ = lambda f: present & (normal_text(F.col("c_" + f)) != "") & (F.col("b_" + f) != "") & (normal_text(F.col("c_" + f)) != normal_text(F.col("b_" + f)))
    found = F.array_compact(F.array(
        issue(F.col("in_b").isNull(), "MISSING_FROM_BOM", F.lit(""), F.lit("")),
        issue(F.col("in_c").isNull(), "NOT_PLACED", F.lit(""), F.lit("")),
        issue(differ("value"), "VALUE_MISMATCH", F.col("b_value"), F.col("c_value")),
        issue(differ("footprint"), "FOOTPRINT_MISMATCH", F.col("b_footprint"), F.col("c_footprint")),
    ))
    return both.select("reference", F.explode(found).alias("i")).select("reference", "i.code", "i.expected", "i.observed")


def placements(source: DataFrame, rebuilt: DataFrame, position: float = 0.25, rotation: float = 5.0) -> DataFrame:
    """(reference, distance_mm, rotation_delta_deg, side_match, code); columns reference, x, y, rotation, side."""
    a = source.select("reference", *[F.col(c).alias("a_" + c) for c in ("x", "y", "rotation", "side")]).withColumn("in_a", F.lit(True))
    b = rebuilt.select("reference", *[F.col(c).alias("b_" + c) for c in ("x", "y", "rotation", "side")]).withColumn("in_b", F.lit(True))
    both = a.join(b, "reference", "full")
    d, r = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")), angle_gap(F.col("a_rotation"), F.col("b_rotation"))
    side = F.lower("a_side").eqNullSafe(F.lower("b_side"))
    alone = F.col("in_a").isNull() | F.col("in_b").isNull()
    code = F.when(F.col("in_a").isNull(), "ONLY_RECONSTRUCTED").when(F.col("in_b").isNull(), "ONLY_SOURCE").when((d <= position) & (r <= rotation) & side, "OK").otherwise("PLACEMENT_MISMATCH")
    return both.select("reference", F.when(alone, 0.0).otherwise(F.round(d, 6)).alias("distance_mm"), F.when(alone, 0.0).otherwise(F.round(r, 6)).alias("rotation_delta_deg"), (alone | side).alias("side_match"), code.alias("code"))


def pins(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(component_id, pin, code, expected, observed) over (component_id, pin, name); code OK where they agree or one is empty."""
    own = lambda df, out: df.select("component_id", F.trim(F.upper("pin")).alias("pin"), F.replace(F.trim(F.upper(F.coalesce("name", F.lit("")))), F.lit(" "), F.lit("_")).alias(out))
    both = own(expected, "expected").join(own(observed, "observed"), ["component_id", "pin"], "full")
    code = F.when(F.col("expected").isNull(), "UNEXPECTED_PIN").when(F.col("observed").isNull(), "MISSING_PIN").when((F.col("expected") != "") & (F.col("observed") != "") & (F.col("expected") != F.col("observed")), "PIN_NAME_MISMATCH").otherwise("OK")
    return both.select("component_id", "pin", code.alias("code"), F.coalesce("expected", F.lit("")).alias("expected"), F.coalesce("observed", F.lit("")).alias("observed"))


def metric_differences(expected: DataFrame, observed: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(name, kind) over (name, value): unexpected, missing, or mismatch beyond the tolerance."""
    both = expected.select("name", F.col("value").alias("e"), F.lit(True).alias("in_e")).join(observed.select("name", F.col("value").alias("o"), F.lit(True).alias("in_o")), "name", "full")
    apart = ~F.col("e").eqNullSafe(F.col("o")) if tolerance is None else F.abs(F.col("e") - F.col("o")) > tolerance
    kind = F.when(F.col("in_e").isNull(), "unexpected").when(F.col("in_o").isNull(), "missing").when(apart, "mismatch")
    return both.select("name", kind.alias("kind")).where("kind is not null")


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b that the other lacks, counted: side, and the columns of a."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


def multiset_similarity(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Sum of the smaller counts over sum of the larger; 1 for two empty tables."""
    n = a.groupBy(*key).agg(F.count("*").alias("x")).join(b.groupBy(*key).agg(F.count("*").alias("y")), key, "full").fillna(0, ["x", "y"])
    return n.agg(F.sum(F.least("x", "y")).alias("s"), F.sum(F.greatest("x", "y")).alias("l")).select(F.when(F.coalesce("l", F.lit(0)) == 0, 1.0).otherwise(F.round(F.col("s") / F.col("l"), 6)).alias("similarity"))


def variant_matrix(parts: DataFrame, variants: list[str] | None = None, most: int = 1_000) -> DataFrame:
    """One row for each reference, one boolean column for each variant; a part that a variant doesn't list is fitted.

    More than most variants are refused, as each is a column.
    """
    names = variants or [r[0] for r in parts.select("variant").distinct().orderBy("variant").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} variants")
    out = parts.groupBy("reference").pivot("variant", names).agg(F.max("fitted"))
    return out.select("reference", *[F.coalesce(F.col(f"`{n}`"), F.lit(True)).alias(n) for n in names])


#: So many rows, or digests, are hashed together.
LEAF = 4_096


def table_fingerprint(df: DataFrame, row: Column, order: list[str], leaf: int = LEAF, levels: int | None = None) -> DataFrame:
    """(fingerprint) of the row strings in order: a tree of SHA-256 digests over ranges of leaf rows, joined by line feeds.

    However the table is partitioned, the tree is the same, and no task holds more than leaf rows together; up to leaf rows it is the
    digest of all of them. Rows that tie in order go by their strings. An empty table has no fingerprint: null.
    levels ends the tree there: of the digests of that level, if they are several, the greatest stands for the table, so
    that a change elsewhere may go unseen. Leave it out for a fingerprint of every row.
    """
    level = numbered(df.select(row.alias("r"), *order), [*order, "r"], "n").select("r", (F.col("n") - 1).alias("n"))
    rows, height = level.count(), 0
    while True:
        height += 1
        together = F.array_sort(F.collect_list(F.struct("n", "r")))
        joined = level.groupBy(F.floor(F.col("n") / leaf).alias("n")).agg(F.array_join(F.transform(together, lambda x: x["r"]), "\n").alias("r"))
        level, rows = joined.select(F.sha2("r", 256).alias("r"), "n"), -(-rows // leaf)
        if rows <= 1 or height == levels:
            return level.agg(F.max("r").alias("fingerprint"))


def partition_fingerprint(df: DataFrame) -> DataFrame:
    """An order-free fingerprint for tables of any size: count and sum of row hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def one_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
