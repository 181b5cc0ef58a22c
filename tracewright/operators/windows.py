"""What is a window over ordered rows: spacings, margins, numbering, trends, first-in-group comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.storage import cut


def spacing(df: DataFrame, key: list[str], position: str, ties: list[str], out: str = "spacing") -> DataFrame:
    """Distance from the neighbour before, in order of position; null for the first."""
    w = Window.partitionBy(*key).orderBy(position, *ties)
    return df.withColumn(out, F.round(F.col(position) - F.lag(position).over(w), 6))


def regular(df: DataFrame, key: list[str], position: str, ties: list[str], tolerance: float = 0.1) -> DataFrame:
    """(key, regular): whether all positive spacings, two at least, lie within the tolerance of their mean."""
    s = spacing(df, key, position, ties).where("spacing > 0").groupBy(*key).agg(F.avg("spacing").alias("m"), F.min("spacing").alias("a"), F.max("spacing").alias("b"), F.count("*").alias("n"))
    return s.select(*key, ((F.col("n") >= 2) & (F.col("b") - F.col("m") <= tolerance) & (F.col("m") - F.col("a") <= tolerance)).alias("regular"))


def angular_gaps(df: DataFrame, key: list[str], angle: str, ties: list[str]) -> DataFrame:
    """Degrees to the next spoke, the last one wrapping to the first; groups of one have none."""
    w = Window.partitionBy(*key).orderBy("__a", *ties)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("__a", F.pmod(F.col(angle), F.lit(360.0)))
    nxt = F.coalesce(F.lead("__a").over(w), F.first("__a").over(every))
    return out.withColumn("gap", F.when(F.count("*").over(every) > 1, F.pmod(nxt - F.col("__a"), F.lit(360.0)))).drop("__a")


def path_length(points: DataFrame, key: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(key, length, direct): of the polyline through the points in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    legs = points.withColumn("__d", F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)))
    ends = F.struct(*order, x, y)
    out = legs.groupBy(*key).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"), F.min(ends).alias("f"), F.max(ends).alias("l"))
    return out.select(*key, "length", F.hypot(F.col(f"l.{x}") - F.col(f"f.{x}"), F.col(f"l.{y}") - F.col(f"f.{y}")).alias("direct"))


def winner(df: DataFrame, key: list[str], score: str, ties: list[str]) -> DataFrame:
    """The best row of each key, with its margin to the runner-up (null without one)."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), *ties)
    return df.withColumns({"__r": F.row_number().over(w), "margin": F.col(score) - F.lead(score).over(w)}).where("__r = 1").drop("__r")


def pages(df: DataFrame, key: list[str], order: list[str], size: int = 30) -> DataFrame:
    """Place and page (from 1) of each row in its group."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).withColumn("page", (F.floor((F.col("place") - 1) / size) + 1).cast("int"))


def trend(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """(key, count, latest, delta) of the last value against the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    step = df.withColumn("__d", F.col(value) - F.lag(value).over(w))
    last = F.max(F.struct(*order, F.col(value).alias("__v"), "__d"))
    return step.groupBy(*key).agg(F.count("*").alias("count"), last.alias("l")).select(*key, "count", F.col("l.__v").alias("latest"), F.round("l.__d", 6).alias("delta"))


def against_first(df: DataFrame, key: list[str], order: list[str], value: str, out: str = "same") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.col(value).eqNullSafe(F.first(value).over(w)))


def radial_order(df: DataFrame, key: list[str], ties: list[str], x: str = "x", y: str = "y", digits: int | None = None) -> DataFrame:
    """Place of each row around the centre of its group, by angle; digits rounds centre and angle, so that equal angles tie."""
    about = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    centre = Window.partitionBy(*key)
    out = df.withColumns({"__cx": about(F.avg(x).over(centre)), "__cy": about(F.avg(y).over(centre))}).withColumn("angle", about(F.atan2(F.col(y) - F.col("__cy"), F.col(x) - F.col("__cx"))))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("angle", *ties))).drop("__cx", "__cy")


def assign_references(components: DataFrame) -> DataFrame:
    """(id, reference): given references stay; each other component takes the next free number of its prefix, in order of id.

    Numbers already given within a prefix are skipped: the free numbers 1, 2, ... are those that no given
    reference holds, so the n-th nameless component takes the n-th free number.
    """
    from tracewright.functions.text import prefix_for_kind

    named = components.where("coalesce(reference, '') <> ''").select("id", "reference")
    bare = components.where("coalesce(reference, '') = ''").select(prefix_for_kind(F.col("kind")).alias("prefix"), "id")
    ranked = _ranked(bare, "prefix", ["id"], "n")
    used = named.select(F.regexp_extract("reference", r"^([A-Z]+)([1-9][0-9]*)$", 1).alias("prefix"), F.regexp_extract("reference", r"^([A-Z]+)([1-9][0-9]*)$", 2).try_cast("bigint").alias("u")).where("u is not null").distinct()
    # the k-th used number u leaves u - k free numbers before it; it is passed over by the components of a greater n
    gaps = _ranked(used, "prefix", ["u"], "k").select("prefix", (F.col("u") - F.col("k")).alias("n"), "u", F.lit(None).cast(bare.schema["id"].dataType).alias("id"))
    both = ranked.select("prefix", "n", F.lit(0).cast("bigint").alias("u"), "id").unionByName(gaps)
    # the place among components and used numbers together is n and the used numbers passed over
    placed = _ranked(both, "prefix", ["n", "u", "id"], "place").where("u = 0")
    return named.unionByName(placed.select("id", F.concat("prefix", F.col("place").cast("string")).alias("reference")))


def _ranked(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """df with numbers from 1 in each group of key, which may be of any size: numbered over ranges, less what stands before the group."""
    n = numbered(df, [key, *order], "__at")
    sizes = df.groupBy(key).agg(F.count("*").alias("__size"))
    before = sizes.select(key, F.coalesce(F.sum("__size").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row for each key
    return n.join(before, key).withColumn(out, F.col("__at") - F.col("__before")).drop("__at", "__before")


def first_of(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def numbered(df: DataFrame, keys: list[str], name: str = "number") -> DataFrame:
    """df with numbers from 1 in the order of keys, which must tell its rows apart, without bringing all rows into one task.

    Rows are dealt by ranges of keys and numbered inside each; a range then adds what the ranges before it hold, one number each.
    """
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the lower bits of the id count the rows of a task, whose number the upper ones are
    dealt = cut(sorted_.withColumn("__id", F.monotonically_increasing_id()), "numbered", free=False).withColumn("__part", F.shiftright("__id", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row for each task
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__id", "__before")
