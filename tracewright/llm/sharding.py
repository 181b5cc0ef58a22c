"""Sharding by a hierarchical weighted hash tree: every row descends region, rack and shard.

At each level the children draw -ln(u) / weight, u being a hash of the key and the child's place;
the least draw wins. A draw depends on nothing but key, place and weight, so a changed weight moves
rows only into or out of the subtree that it belongs to. A new shard opens a region of its own: all
other draws stay, and it only takes rows, from everywhere in proportion to their weights.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut, repeated

BUCKETS = 1024


@dataclass(frozen=True)
class Tree:
    """regions > racks > (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
        """Shards 0 to shards - 1 of weight 1, dealt to racks and regions in order."""
        if shards < 1:
            raise ValueError("at least one shard")
        ids = [tuple((i, 1.0) for i in range(at, min(at + per_rack, shards))) for at in range(0, shards, per_rack)]
        return Tree(tuple(tuple(ids[at : at + racks]) for at in range(0, len(ids), racks)))

    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s, _ in rack]

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        return Tree((*self.regions, (((max(self.shards()) + 1, weight),),)))

    def weighted(self, weights: dict[int, float]) -> Tree:
        """The same tree with other weights for some shards."""
        return Tree(tuple(tuple(tuple((s, weights.get(s, w)) for s, w in rack) for rack in region) for region in self.regions))


def _draw(key: Column, place: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("/" + place))), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, int]]) -> Column:
    """The number of the child with the least draw; ties go to the lower number."""
    live = [c for c in children if c[1] > 0]
    if not live:
        raise ValueError("every subtree needs a positive weight")
    if len(live) == 1:
        return F.lit(live[0][2])
    return F.array_min(F.array(*[F.struct(_draw(key, place, w).alias("d"), F.lit(i).alias("i")) for place, w, i in live]))["i"]


def _weight(rack) -> float:
    return sum(w for _, w in rack)


def descend(key: Column, tree: Tree) -> Column:
    """The shard of a key (a string column; null counts as empty)."""
    key = F.coalesce(key.cast("string"), F.lit(""))

    def pick(chosen: Column, options: list[Column]) -> Column:
        out = options[-1]
        for i in range(len(options) - 2, -1, -1):
            out = F.when(chosen == i, options[i]).otherwise(out)
        return out

    none = F.lit(None).cast("int")
    regions, weights = [], []
    for r, region in enumerate(tree.regions):
        racks = [_winner(key, [(f"{r}.{k}.{s}", w, s) for s, w in rack]) if _weight(rack) > 0 else none for k, rack in enumerate(region)]
        weights.append(sum(map(_weight, region)))
        regions.append(pick(_winner(key, [(f"{r}.{k}", _weight(rack), k) for k, rack in enumerate(region)]), racks) if weights[-1] > 0 else none)
    return pick(_winner(key, [(str(r), w, r) for r, w in enumerate(weights)]), regions).cast("int")


def assign(df: DataFrame, tree: Tree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """df with the shard of each row, without a shuffle; a column of the name out is replaced."""
    return df.drop(*[c for c in df.columns if c.lower() == out.lower()]).withColumn(out, descend(df[key], tree))


def number(df: DataFrame, shard: str, by: list[str], out: str = "slot") -> DataFrame:
    """Distinct rows of df with their places, gapless from 0 in each shard.

    Equal rows are counted before the shuffle and dealt consecutive places. A shard is split into
    1,024 hash buckets; the 1,024 totals of each shard are summed up first (a table of that many
    rows for each shard at most, hence broadcast), then each bucket counts on from its own start.
    """
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int"))
    rows = cut(rows, "slots", "lz4")
    order = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_sum")).select(shard, "_bucket", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_from"))
    inner = Window.partitionBy(shard, "_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("_from") + F.sum("_n").over(inner) - F.col("_n")
    placed = rows.join(F.broadcast(starts), [shard, "_bucket"]).withColumn("_first", first)
    made = repeated(placed.select(*df.columns, "_first", "_n"), F.col("_n"), "_copy")
    return made.select(*df.columns, (F.col("_first") + F.col("_copy")).alias(out))


def shard_documents(documents: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of documents.

    A null text has size 1 (its 0 bytes plus 1) and the checksum of no bytes; a null doc_id counts
    as the empty key. Repeated rows take places of their own. Further columns are not carried; an
    empty table gives an empty result.
    """
    tree = Tree.even(shards)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    digest = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = assign(assign(digest, tree), tree.grown(), out="grown_shard")
    return number(placed, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard")
