"""Sharding by a weighted hash tree: region, then rack, then shard, each drawn by weighted hashes.

At a node each child draws -ln(u) / weight, where u comes from a hash of the key and the child's name; the smallest draw
wins. A child's draw depends on nothing but the key, its name and its weight. So when weights change, a key moves only if
it enters or leaves a child whose weight changed, and below any other child nothing moves.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 40
#: Shards 0 to BASE - 1 stand in full regions; each later one opens a region of its own.
BASE, REGION, RACK = 40, 10, 5
#: Added to a row's bytes of text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Tree:
    """Weights of the shards: regions of racks of shards. Shards count through in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def levels(self) -> list[list[list[float]]]:
        """For each level, for each node above it, its children's weights."""
        racks = [rack for region in self.regions for rack in region]
        return [[[sum(map(sum, r)) for r in self.regions]], [[sum(rack) for rack in r] for r in self.regions], [list(r) for r in racks]]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own. No other weight changes, so rows move into the new shard only."""
        return Tree((*self.regions, ((float(weight),),)))

    def __post_init__(self):
        weights = [w for region in self.regions for rack in region for w in rack]
        if not weights or any(not 0 <= w < float("inf") for w in weights) or not any(weights):
            raise ValueError("shards have weights of 0 or more, and not all of them 0")


def tree(shards: int = SHARDS, base: int = BASE, region: int = REGION, rack: int = RACK) -> Tree:
    """Equal weights: regions of racks of shards up to `base`, then regions of one shard. Below `base` a tree of one shard more
    has another weight inside, so rows move beside it too; Tree.grown() adds a shard to any tree without that."""
    cut = lambda x, n: [x[i : i + n] for i in range(0, len(x), n)]
    full = cut([1.0] * min(shards, base), region)
    return Tree(tuple(tuple(tuple(r) for r in cut(x, rack)) for x in full) + ((((1.0,),),) * max(0, shards - base)))


M32 = (1 << 32) - 1


def mixed(x):
    """Bijective mixing of 32 bits, of an int, an array, Bits or Sql; products stay below 2 ** 63."""
    x = ((x ^ (x >> 16)) * 0x45D9F3B) & M32
    x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & M32
    return x ^ (x >> 16)


class Bits:
    """Integer operations spelled as Spark columns."""

    def __init__(self, column: Column):
        self.column = column

    def __xor__(self, other: Bits | int) -> Bits:
        return Bits(self.column.bitwiseXOR(other.column if isinstance(other, Bits) else F.lit(other).cast("bigint")))

    def __and__(self, other: int) -> Bits:
        return Bits(self.column.bitwiseAND(F.lit(other).cast("bigint")))

    def __rshift__(self, n: int) -> Bits:
        return Bits(F.shiftright(self.column, n))

    def __mul__(self, n: int) -> Bits:
        return Bits(self.column * F.lit(n).cast("bigint"))

    def __add__(self, n: int) -> Bits:
        return Bits(self.column + F.lit(n).cast("bigint"))


def name_of(level: int, node, child: int):
    """32 bits that name a child, from its level (0 to 2), its node's number in that level and its own."""
    return (node * 0x3779B1 + (level * 0x10001 + child * 0x9E35 + 1)) & M32


def shards_of(keys: np.ndarray, tree: Tree) -> np.ndarray:
    """The shards of 64-bit keys, level by level for all keys at once."""
    hashes = mixed((keys & M32) ^ mixed((keys >> 32 & M32) ^ 0x5BD1E995))
    node = np.zeros(len(keys), np.int64)
    for level, nodes in enumerate(tree.levels):
        first = np.cumsum([0, *map(len, nodes)])
        best, child = np.full(len(keys), np.inf), np.zeros(len(keys), np.int64)
        for j in range(max(map(len, nodes))):
            # A child that a node lacks, or that has no weight, is never drawn.
            weight = np.array([w[j] if j < len(w) else 0.0 for w in nodes])[node]
            with np.errstate(divide="ignore", invalid="ignore"):
                draw = -np.log((mixed(hashes ^ name_of(level, node, j)) + 1) / 2.0**32) / weight
            less = draw < best
            child[less], best[less] = j, draw[less]
        node = first[node] + child
    return node.astype(np.int32)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a 64-bit key; null counts as -1. Batches pass through Arrow: as a column expression each level would be
    inlined several times into the next wherever a plan's filter meets it."""

    def shards(keys: pd.Series) -> pd.Series:
        return pd.Series(shards_of(keys.to_numpy(np.int64), tree))

    return F.pandas_udf(shards, "int")(F.coalesce(key.cast("bigint"), F.lit(-1).cast("bigint")))


def weighted(weights: list[float], region: int = REGION, rack: int = RACK) -> Tree:
    """Shards of these weights, in regions of `region` and racks of `rack`."""
    cut = lambda x, n: [x[i : i + n] for i in range(0, len(x), n)]
    return Tree(tuple(tuple(tuple(map(float, r)) for r in cut(x, rack)) for x in cut(list(weights), region)))


def with_slots(rows: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """`rows` with slot, a gapless number from 0 in each shard by `order`.

    Rows are dealt out by ranges of (shard, order), so that a large shard is many tasks; each range's count of rows of a
    shard then gives the first slot of the next.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The last key parts rows that are equal in all others.
    keys = [F.col(shard), *(F.col(c) for c in order), F.col("slot_tie")]
    dealt = rows.withColumn("slot_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    dealt = written(dealt.withColumn("slot_place", place).drop("slot_tie"), "shard-ranges")
    part, row = F.shiftright("slot_place", 33), F.col("slot_place").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("slot_part", part).withColumn("slot_row", row)
    # At most one row for each range and shard that meet: ranges plus shards.
    counts = dealt.groupBy(F.col(shard).alias("slot_shard"), F.col("slot_part").alias("slot_of")).agg(F.count("*").alias("n"), F.min("slot_row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("slot_shard").orderBy("slot_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("slot_shard", "slot_of", (before - F.col("first")).alias("slot_from"))
    joined = dealt.join(F.broadcast(starts), (F.col(shard) == F.col("slot_shard")) & (F.col("slot_part") == F.col("slot_of")))
    return joined.withColumn("slot", F.col("slot_row") + F.col("slot_from")).drop("slot_place", "slot_part", "slot_row", "slot_shard", "slot_of", "slot_from")


def sharded(docs: DataFrame, *, shards: int | Tree = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of `docs`; shard and grown_shard follow from id and
    the tree alone. `shards`: a count of equal shards, or a tree of weighted ones. grown_shard is of the same tree with a
    shard more in a region of its own, which takes rows only into itself.

    Only `id`, 64 bits, and `text` are read, so other columns may have any name. A null text has no bytes; null ids count
    as -1 and so share a shard; rows that repeat an id share its shard and have slots of their own. Slots
    follow id (nulls first), checksum and size. An empty table gives none.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    present = shards if isinstance(shards, Tree) else tree(shards)
    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        (F.octet_length(data) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(id), present).alias("shard"),
        shard_of(F.col(id), present.grown()).alias("grown_shard"),
    )
    # Texts are read once: dealing out by ranges samples its input first.
    rows = written(rows, "shard-rows")
    return with_slots(rows, ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op5_hash_tree(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


class Sql(str):
    """Integer operations spelled as DuckDB's SQL."""

    __xor__ = lambda a, b: Sql(f"xor({a}, cast({b} AS BIGINT))")
    __and__ = lambda a, b: Sql(f"({a} & {b})")
    __rshift__ = lambda a, b: Sql(f"({a} >> {b})")
    __mul__ = lambda a, b: Sql(f"({a} * {b})")
    __add__ = lambda a, b: Sql(f"({a} + {b})")


def shard_sql(table: str, shards: Tree, out: str) -> str:
    """`table`, which has the key's hash k, with the shard in `out`."""
    sql = f"SELECT *, cast(0 AS BIGINT) AS node FROM {table}"
    for level, nodes in enumerate(shards.levels):
        firsts = list(accumulate((len(w) for w in nodes), initial=0))
        draw = lambda j: f"-ln(({mixed(Sql('k') ^ name_of(level, Sql('node'), j))} + 1) / 4294967296.0) / {nodes}[node + 1][{j + 1}]"  # noqa: B023, E731
        draws = ", ".join(map(draw, range(max(map(len, nodes)))))
        sql = f"SELECT * EXCLUDE (node, d), cast({firsts}[node + 1] + list_position(d, list_min(d)) - 1 AS BIGINT) AS node FROM (SELECT *, [{draws}] AS d FROM ({sql}))"
    return f"SELECT * EXCLUDE (node), cast(node AS INTEGER) AS {out} FROM ({sql})"


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


_KEY = mixed((Sql("id") & M32) ^ mixed(((Sql("id") >> 32) & M32) ^ 0x5BD1E995))

OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(doc_id, -1) AS id, coalesce(text, '') AS text FROM documents),
crc AS (
  SELECT doc_id, {_KEY} AS k, strlen(text) + {ROW_BYTES} AS size,
         xor(list_reduce(list_transform(range(1, strlen(text) + 1), lambda i: cast('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
             lambda c, b: xor({_crc_table()}[(xor(c, b) & 255) + 1], c >> 8), cast(4294967295 AS BIGINT)), cast(4294967295 AS BIGINT)) AS crc
  FROM (SELECT doc_id, id, text, hex(encode(text)) AS h FROM d)),
s AS ({shard_sql(f"({shard_sql('crc', tree(SHARDS), 'shard')})", tree(SHARDS).grown(), "grown")})
SELECT doc_id, cast(size AS BIGINT) AS size, cast(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
       cast(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS BIGINT) AS slot, grown AS grown_shard
FROM s
"""
