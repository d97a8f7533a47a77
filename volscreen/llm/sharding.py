"""Sharding by longest-processing-time scheduling.

Groups of equal texts stay together.  Groups of at least ``total / (shards * SPLIT)`` bytes are
scheduled one by one; the smaller ones are first bound into ``BUNDLES`` bundles by hash, so the
heap never holds more than ``shards * SPLIT + BUNDLES`` items however large the corpus is.
Items sorted by size go to the least-loaded shard through a heap.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volscreen.llm.common import staged, table

SHARDS = 16
#: Largest groups scheduled singly: at most shards * SPLIT of them can reach total / (shards * SPLIT) bytes.
SPLIT = 2048
BUNDLES = 16384
#: Cells in which the rows of one shard are numbered apart.
CELLS = 1024


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """LPT: (item, size) pairs to item -> shard.  Ties: smaller item first, then lower shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[item] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row in a shard; returns doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes (null: none) plus 1.  Rows of equal text share a shard, null
    texts count as equal; a group larger than a shard's share still stays whole.  ``slot`` is
    gapless from 0 in each shard.  Null ids and repeated rows are kept and numbered like others;
    a null text has a null text_crc32.  Other columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = staged(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, -(-total // (shards * SPLIT)))
    bundle = F.pmod(F.xxhash64("g"), F.lit(BUNDLES))
    groups = rows.groupBy("g").agg(F.sum("size").alias("size"))
    items = groups.groupBy(
        F.when(F.col("size") >= least, F.col("g")).alias("g"), F.when(F.col("size") < least, bundle).alias("bundle")
    ).agg(F.sum("size").alias("size")).collect()  # at most shards * SPLIT + BUNDLES rows
    keys = {i: (r.g, r.bundle) for i, r in enumerate(sorted(items, key=lambda r: (r.g is None, r.g or 0, r.bundle or 0)))}
    sizes = {(r.g, r.bundle): r.size for r in items}
    placed = schedule([(i, sizes[k]) for i, k in keys.items()], shards)
    single = spark.createDataFrame(
        [(k[0], placed[i]) for i, k in keys.items() if k[0] is not None], "g long, single int"
    )
    bound = spark.createDataFrame(
        [(k[1], placed[i]) for i, k in keys.items() if k[0] is None], "bundle long, bound int"
    )
    put = (
        rows.join(F.broadcast(single), "g", "left")  # bounded by shards * SPLIT rows
        .withColumn("bundle", bundle)
        .join(F.broadcast(bound), "bundle", "left")  # bounded by BUNDLES rows
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("single", "bound").alias("shard"),
            F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int").alias("cell"),
        )
    )
    base = (
        put.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n"))
        .drop("n")
    )
    place = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        put.withColumn("local", F.row_number().over(place) - 1)
        .join(F.broadcast(base), ["shard", "cell"])  # bounded by shards * CELLS rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("local")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
