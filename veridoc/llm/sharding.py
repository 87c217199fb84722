"""Sharding by a hierarchical weighted hash tree (operator 4).

Shards are leaves of a tree of regions and racks. A key descends from the root: it draws an exponential for each
region, divided by the weight of the shards below, and goes where the draw is least; then so among the racks of
that region, and among the shards of that rack. A key so costs as many hashes as the nodes on its way have
children, and each draw depends on the key and the node alone. If weights change, only the draws of nodes whose
weight changed differ: rows move between subtrees only into one that grew or out of one that shrank, and a
subtree whose weights are as before keeps the rows that still enter it where they were.

The law that holds is `key`: the key and the shard count decide, and one more shard takes rows only into itself.
For that, `grown` adds a shard as a region of its own, so that no weight of an older node changes; a shard put
into an older rack instead draws rows into all of its region. Slots number the rows of a shard from 0 without
gaps, by (spread bucket, key); they come from bucket counts and their running sums, so no task holds a whole shard.

Defined results: null keys hash as one value; repeated rows keep separate slots; an empty table gives an
empty result. Columns named region, rack, shard or slot are replaced; others stay.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, settle

ROWS_PER_BUCKET = 20_000
REGION, RACK, SHARD = range(3)  # levels, which keep the draws of nodes of one number apart


@dataclass(frozen=True)
class HashTree:
    regions: tuple[tuple[tuple[int, ...], ...], ...]  # the shards of each rack of each region
    weights: dict[int, float] = field(default_factory=dict)  # 1 where not named; 0 drains a shard

    @classmethod
    def even(cls, shards: int, racks_per_region: int = 3, shards_per_rack: int = 2, weights: dict[int, float] | None = None) -> HashTree:
        """Racks and regions filled one after the other."""
        cut = lambda items, size: tuple(tuple(items[i : i + size]) for i in range(0, len(items), size))
        return cls(cut(cut(range(shards), shards_per_rack), racks_per_region), weights or {})

    def __post_init__(self):
        if any(w < 0 for w in self.weights.values()) or not any(self.weight(s) for region in self.regions for rack in region for s in rack):
            raise ValueError("a tree needs a shard of positive weight")

    def weight(self, shard: int) -> float:
        return float(self.weights.get(shard, 1))

    def grown(self) -> HashTree:
        """With one more shard, in a region of its own."""
        return replace(self, regions=(*self.regions, ((1 + max(s for region in self.regions for rack in region for s in rack),),)))

    def children(self) -> tuple[list, list, list]:
        """(id, weight) of the regions, of each region's racks and of each rack's shards. Nodes of no weight are left out."""
        node = lambda i, w: {"id": i, "weight": w}
        some = lambda nodes: [n for n in nodes if n["weight"]]
        shards = [some(node(s, self.weight(s)) for s in rack) for region in self.regions for rack in region]
        total = lambda nodes: sum(n["weight"] for n in nodes)
        first = [sum(map(len, self.regions[:r])) for r in range(len(self.regions))]
        racks = [some(node(a, total(shards[a])) for a in range(first[r], first[r] + len(region))) for r, region in enumerate(self.regions)]
        return some(node(r, total(x)) for r, x in enumerate(racks)), racks, shards


_NODES = "array<struct<id:int,weight:double>>"


def _least_draw(key: Column, level: int, nodes: Column) -> Column:
    """The id of the node that the key draws, ties to the least id."""

    def draw(node: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node["id"]), 11)
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / node["weight"]).alias("draw"), node["id"].alias("id"))

    return F.array_min(F.transform(nodes, draw))["id"]


def assign_shards(rows: DataFrame, tree: HashTree, key: str = "doc_id") -> DataFrame:
    """rows with region, rack and shard."""
    regions, racks, shards = (json.dumps(x) for x in tree.children())
    at = F.col("__key")
    down = rows.withColumn("__key", F.col(key)).drop(*({"region", "rack", "shard"} & set(rows.columns)))
    down = down.withColumn("region", _least_draw(at, REGION, F.from_json(F.lit(regions), _NODES)))
    down = down.withColumn("rack", _least_draw(at, RACK, F.get(F.from_json(F.lit(racks), f"array<{_NODES}>"), F.col("region"))))
    return down.withColumn("shard", _least_draw(at, SHARD, F.get(F.from_json(F.lit(shards), f"array<{_NODES}>"), F.col("rack")))).drop("__key")


def number_slots(sharded: DataFrame, key: str = "doc_id") -> DataFrame:
    """sharded with slot: its rows are settled first, so that both passes see the same buckets."""
    each = sharded.drop("slot").withColumn("__row", F.monotonically_increasing_id())
    each = settle(each, "shards")
    buckets = max(1, each.count() // ROWS_PER_BUCKET)
    each = each.withColumn("__bucket", F.pmod(F.xxhash64(F.col("__row")), F.lit(buckets)).cast("int"))
    held = each.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__held"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("shard", "__bucket", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("shard", "__bucket").orderBy(key, "__row")
    numbered = each.withColumn("__rank", F.row_number().over(within))
    return numbered.join(base, ["shard", "__bucket"]).withColumn("slot", F.col("__base") + F.col("__rank") - 1).drop("__row", "__bucket", "__rank", "__base")


def write_shards(rows: DataFrame, path: str, tree: HashTree, key: str = "doc_id") -> None:
    """The rows as Parquet, a folder for each shard. A shard's rows are spread over as many tasks as wrote any."""
    assign_shards(rows, tree, key).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    tree = HashTree.even(24)
    grown = assign_shards(docs, tree.grown()).withColumnRenamed("shard", "grown_shard")
    placed = number_slots(assign_shards(grown, tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
