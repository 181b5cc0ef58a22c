"""The filter language: one comparison as text, compiled to a Column; sorting, presets, top-k, even samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The operators, in the order in which they are looked for.
OPERATORS = (">=", "<=", "!=", "==", ">", "<", "~")


@dataclass(frozen=True)
class Query:
    field: str
    operator: str
    value: object


def parse(text: str) -> Query:
    """field OP value; the first operator of OPERATORS that stands anywhere in the text splits it."""
    text = str(text).strip()
    op = next((o for o in OPERATORS if o in text), None)
    if op is None:
        raise ValueError("query operator required")
    field, value = (part.strip() for part in text.split(op, 1))
    if not field:
        raise ValueError("query field required")
    return Query(field, op, literal(value))


def literal(text: str) -> object:
    """true and false are booleans, numbers with a point are floats, other numbers integers, the rest text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    try:
        return float(text) if "." in text else int(text)
    except ValueError:
        return text.strip('"').strip("'")


def field_of(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """A dotted path into structs and maps; null (of type void) where a part is absent."""
    kind: T.DataType = df.schema
    out: Column | None = None
    for part in str(path).split("."):
        if isinstance(kind, T.StructType):
            match = next((f for f in kind.fields if f.name == part), None)
            if match is None:
                return F.lit(None), T.NullType()
            out, kind = (F.col(f"`{part}`") if out is None else out.getField(part)), match.dataType
        elif isinstance(kind, T.MapType):
            out, kind = out.getItem(part), kind.valueType
        else:
            return F.lit(None), T.NullType()
    return out, kind


def condition(df: DataFrame, query: Query) -> Column:
    """True or false for each row, never null: a missing field differs from every value, and no order holds for it."""
    value, kind = field_of(df, query.field)
    numeric = isinstance(kind, (T.NumericType, T.BooleanType))
    if query.operator in ("==", "!="):
        if isinstance(query.value, (bool, int, float)):
            same = value.cast("double").eqNullSafe(F.lit(float(query.value))) if numeric else F.lit(False)
        else:
            same = value.eqNullSafe(F.lit(query.value)) if isinstance(kind, T.StringType) else F.lit(False)
        return same if query.operator == "==" else ~same
    if query.operator == "~":
        shown = F.when(value, "True").otherwise("False") if isinstance(kind, T.BooleanType) else value.cast("string")
        shown = F.coalesce(shown, F.lit("None")) if not isinstance(kind, T.BooleanType) else F.when(value.isNull(), "None").otherwise(shown)
        return F.contains(F.lower(shown), F.lit(str(query.value).lower()))
    try:
        limit = float(query.value)
    except ValueError:
        return F.lit(False)
    number = value.cast("double") if numeric else F.expr("cast(null as double)") if isinstance(kind, T.NullType) else value.try_cast("double")
    test = {">": number > limit, "<": number < limit, ">=": number >= limit, "<=": number <= limit}[query.operator]
    return F.coalesce(test, F.lit(False))


def as_query(q: Query | str) -> Query:
    return q if isinstance(q, Query) else parse(q)


def execute(df: DataFrame, query: Query | str) -> DataFrame:
    return df.where(condition(df, as_query(query)))


def all_of(df: DataFrame, *queries: Query | str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (condition(df, as_query(q)) for q in queries), F.lit(True)))


def any_of(df: DataFrame, *queries: Query | str, order: str | None = None) -> DataFrame:
    """Rows that match some query, each once; order names a column for the number of the first that it matches."""
    tests = [condition(df, as_query(q)) for q in queries]
    first = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]) if tests else F.lit(None).cast("int")
    out = df.withColumn(order or "__first", first).where(F.col(order or "__first").isNotNull())
    return out if order else out.drop("__first")


def sort(df: DataFrame, field: str, reverse: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Nulls last ascending and first descending; ties in the order of further columns."""
    value, _ = field_of(df, field)
    return df.orderBy(value.desc_nulls_first() if reverse else value.asc_nulls_last(), *ties)


def issues(query: Query) -> list[str]:
    return ["QUERY_EMPTY_FIELD"] * (not query.field.strip()) + ["QUERY_BAD_OPERATOR"] * (query.operator not in OPERATORS)


def summary(df: DataFrame, query: Query | str) -> DataFrame:
    q = as_query(query)
    return execute(df, q).agg(F.count("*").alias("matches")).select(F.lit(q.field).alias("field"), F.lit(q.operator).alias("operator"), F.lit(str(q.value)).alias("value"), "matches")


@dataclass(frozen=True)
class Preset:
    name: str
    query: str
    scope: str = "all"
    sort_field: str = ""
    reverse: bool = False


# The presets that every project starts with.
PRESETS = (
    Preset("Low confidence", "confidence<0.7"),
    Preset("Unresolved", "status==unresolved"),
    Preset("Power nets", "class_name~power"),
    Preset("Critical findings", "severity==critical"),
)


def apply_preset(df: DataFrame, preset: Preset) -> DataFrame:
    out = execute(df, preset.query)
    return sort(out, preset.sort_field, preset.reverse) if preset.sort_field else out


def keyed(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on every argument that is not None."""
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in wanted.items() if v is not None), F.lit(True)))


def text_search(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Rows with the text in any of the fields, whatever its case; an empty text finds all."""
    if not text:
        return df
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(f)), F.lit(text.lower())), F.lit(False)) for f in fields)))


def top(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def even_sample(df: DataFrame, limit: int, order: list[str], key: str | None = None) -> DataFrame:
    """limit rows at even distances in the given order: those of places floor(i * n / limit).

    Places come from counts of ranges, so that no task holds all rows: rows are dealt to 1,024 ranges of
    hash-free order by approximate quantiles of the first order column.
    """
    n = df.count()
    if limit >= n:
        return df
    if limit <= 0:
        return df.limit(0)
    first = order[0]
    cuts = sorted(set(df.approxQuantile(first, [k / 64 for k in range(1, 64)], 0.005))) if dict(df.dtypes)[first] in ("int", "bigint", "double", "float", "smallint", "tinyint") else []
    part = sum((F.when(F.col(first) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    ranged = df.withColumn("__part", part)
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = starts.withColumn("__from", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 64 rows at most
    place = F.col("__from") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = ranged.join(F.broadcast(starts.drop("__n")), "__part").withColumn("__at", place)
    # place p is taken when p = floor(i n / limit) for some i, that is i = ceil(p limit / n)
    i = F.floor((F.col("__at") * limit + n - 1) / n)
    return out.where(F.floor(i * n / limit) == F.col("__at")).drop("__part", "__from", "__at")
