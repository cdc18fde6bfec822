"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, join_heavy, read, scope

#: Groups of one size that are numbered in one go; more are numbered in SLICES parts.
PLENTY, SLICES = 10_000, 256


def longest_first(sizes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """For rows (size, number of groups of that size): how many of them each shard gets, when groups go, largest first, each
    to the least-loaded shard (ties to the smaller number). Groups of one size are alike, so which ones a shard gets does
    not matter. Where one size has very many groups, those that must go below a common level go there at once; the
    others pass through the heap one by one."""
    loads = [0] * n_shards
    out = []
    for size, count in sorted(sizes, reverse=True):
        dealt = [0] * n_shards
        if count > 4 * n_shards:
            low = list(range(n_shards))
            while True:  # a shard's i-th group starts at load + i * size; all that start below the level are among the first
                level = (count * size + sum(loads[i] for i in low)) // len(low) - size
                fewer = [i for i in low if loads[i] < level]
                if len(fewer) == len(low) or not fewer:
                    break
                low = fewer
            for i in low:
                dealt[i] = max(0, -((loads[i] - level) // size))
        heap = [(load + n * size, i) for i, (load, n) in enumerate(zip(loads, dealt, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(dealt)):
            load, i = heap[0]
            dealt[i] += 1
            heapq.heapreplace(heap, (load + size, i))
        loads = [load + n * size for load, n in zip(loads, dealt, strict=True)]
        out.append((size, dealt))
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, slices: int = 256) -> DataFrame:
    """Deals documents into ``n_shards`` shards of near equal bytes; documents with equal text share a shard.

    Returns (id, size, text_crc32, shard, slot). Size is the UTF-8 bytes of the text plus 1. Groups of equal texts go, by
    their bytes and largest first, to the least-loaded shard. The driver gets only how many groups there are of each size,
    and every size is a number of bytes, so k sizes take k * (k + 1) / 2 bytes of documents at least; it decides how many
    of a size each shard gets, and groups are numbered within their size to take their places. A group larger than a
    shard's fair share makes its shard exceed the others: it cannot be split.

    Null text counts as no bytes: size 1, checksum 0, one group with the empty texts. Repeated rows get slots of their
    own. Null ids are kept. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    with scope(spark) as tables:
        rows = checkpointed(
            docs.select(
                F.col(id_col).alias("id"),
                (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                F.crc32(text).alias("text_crc32"),
                F.unhex(F.md5(text)).alias("key"),
            )
        )
        groups = checkpointed(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
        sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("groups"))
        dealt = longest_first([(r["bytes"], r["groups"]) for r in sizes.collect()], n_shards)
        # bytes, and the numbers of the groups at which each shard's part ends
        ends = [(size, [sum(counts[: i + 1]) for i in range(n_shards)], sum(counts) > PLENTY) for size, counts in dealt]
        ends = checkpointed(spark.createDataFrame(ends, "bytes long, ends array<long>, plenty boolean"))
        ends = F.broadcast(ends) if len(dealt) <= 1 << 17 else ends
        places = groups.join(ends, "bytes").withColumn("part", F.when(F.col("plenty"), F.pmod(F.xxhash64("key"), F.lit(SLICES)).cast("int")).otherwise(F.lit(-1)))
        in_part = F.row_number().over(Window.partitionBy("bytes", "part").orderBy("key"))
        parts = places.where("plenty").groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("m"))
        parts = parts.select("bytes", "part", (F.sum("m").over(Window.partitionBy("bytes").orderBy("part")) - F.col("m")).alias("start"))
        numbered = places.withColumn("nth", in_part).join(parts, ["bytes", "part"], "left")
        nth = F.coalesce("start", F.lit(0)) + F.col("nth")
        numbered = numbered.withColumn("number", nth).select("key", "n", F.expr("cast(size(filter(ends, e -> e < number)) as int)").alias("shard"))
        placed = checkpointed(join_heavy(rows, checkpointed(numbered), "key", "n")).withColumn("slice", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(slices)).cast("int"))
        counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
        before = counts.select(
            "shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("offset")
        )  # n_shards * slices rows
        within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "text_crc32", "size"))
        out = placed.withColumn("nth", within).join(F.broadcast(before), ["shard", "slice"])
        return tables.keep(out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot")))


def op8_shard_lpt(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
