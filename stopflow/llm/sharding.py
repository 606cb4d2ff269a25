"""Placing documents into shards of near-equal bytes, equal texts together, by longest-processing-time scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, with_positions, written

# A group is large from this share of one shard's mean load; there are fewer than shards / LARGE_SHARE of them.
LARGE_SHARE = 1 / 1000
# Small groups are scheduled in parts of about this many, of which there are at most PARTS; a part needs many times the number of
# shards to come out level.
PART_GROUPS = 1000
PARTS = 4096
BUCKETS = 64


def schedule(items: Iterator[tuple[object, int]], loads: list[float], first: int = 0) -> Iterator[tuple[object, int]]:
    """Give each (name, size), largest first, to the least-loaded shard; ``loads`` are changed. Ties: by number, from ``first`` on."""
    heap = [(load, (s - first) % len(loads), s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for name, size in items:
        load, tie, s = heap[0]
        heapq.heapreplace(heap, (load + size, tie, s))
        loads[s] = load + size
        yield name, s


def place_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Shards of groups (group, bytes), as rows (group, shard).

    Large groups, fewer than ``shards`` * 1,000 by their share of all bytes, are scheduled first and in one
    heap. The others are dealt by hash over parts; each part schedules its own, largest first, in
    one pass over its sorted rows with a heap that starts from the part's share of the large groups' loads,
    so all parts fill up to the same level.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bound = total / shards * LARGE_SHARE
    large = [(r["group"], r["bytes"]) for r in groups.filter(F.col("bytes") > bound).collect()]
    large.sort(key=lambda x: (-x[1], x[0]))
    loads = [0.0] * shards
    placed = list(schedule(iter(large), loads))
    done = spark.createDataFrame(placed, "group string, shard int")
    rest = groups.filter(F.col("bytes") <= bound)
    parts = max(1, min(PARTS, rest.count() // PART_GROUPS))
    rest = rest.withColumn("_part", F.pmod(F.xxhash64("group"), F.lit(parts)).cast("int"))
    share = rest.groupBy("_part").agg(F.sum("bytes").alias("b")).collect()  # one number per part
    remaining = sum(r["b"] for r in share) or 1
    shares = {r["_part"]: r["b"] / remaining for r in share}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[float]] = {}
        for batch in batches:
            cols = batch.to_pydict()
            out = [0] * batch.num_rows
            at = 0
            while at < batch.num_rows:
                part, end = cols["_part"][at], at
                while end < batch.num_rows and cols["_part"][end] == part:
                    end += 1
                state = own.setdefault(part, [x * shares[part] for x in loads])
                for i, s in schedule(zip(range(at, end), cols["bytes"][at:end], strict=True), state, part):
                    out[i] = s
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(out, pa.int32())], names=["group", "shard"])

    dealt = rest.repartition(parts, "_part").sortWithinPartitions("_part", F.col("bytes").desc(), "group").select("_part", "group", "bytes")
    return done.unionByName(dealt.mapInArrow(run, "group string, shard int"))


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """A shard and a slot in it for every document; equal texts share a shard, bytes per shard are near equal.

    Size is the UTF-8 bytes of the text plus ``overhead``. Returns one row per input row: doc_id, size, text_crc32, shard,
    slot (from 0 without gaps in each shard). A group larger than a shard's mean still stays together.

    NULL text counts as empty, repeated rows are equal texts, an empty table gives no rows, other columns are ignored.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + overhead).cast("bigint").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"), F.substring(F.sha2(t.cast("binary"), 256), 1, 32).alias("group"))
    slim = written(slim, "shard-sizes")
    groups = written(slim.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("_n")), "shard-groups")
    homes = written(place_groups(groups.select("group", "bytes"), shards), "shard-homes")
    placed = join_skewed(slim, homes.join(groups.select("group", "_n"), "group"), "group").drop("group")
    spread = F.xxhash64("doc_id", "text_crc32")
    placed = placed.withColumn("_level", F.pmod(spread, F.lit(BUCKETS)).cast("int"))
    placed = placed.withColumn("_bucket", F.pmod(F.shiftright(spread, 20), F.lit(BUCKETS)).cast("int"))
    return with_positions(placed, "shard", "_level", "_bucket", ["doc_id", "text_crc32", "size"], "slot").drop("_level", "_bucket")


def write_shards(docs: DataFrame, plan: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write the documents as one folder per shard, rows in slot order within a file. Needs unique doc_id."""
    placed = docs.join(plan.select(F.col("doc_id").alias("_id"), "shard", "slot"), F.col(doc_id) == F.col("_id")).drop("_id")
    (placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
