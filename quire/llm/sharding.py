"""Sharding by longest-processing-time scheduling.

Documents with equal text stay together, so that no copy of a document is in another shard. Groups, largest first (ties by
digest), go to the shard with the least load through a heap (ties to the lowest number).

Groups of one size are interchangeable but for their order, so the driver gets the histogram of group sizes and nothing
else: its rows are the different sizes, not the groups. While a run of equal groups fills shards whose loads lie within one group of each other, the heap
pops them in a fixed cycle; such runs are laid out in one step, and a shard joins the cycle when the others have caught up with it. The result is that of the plain heap, group for group.
The groups look up their shard by size and rank among their size. Ranks come from a sort of the groups over many tasks, so a size that very many groups have is no single task's work.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SHARDS = 16


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """For (size, number of groups), by size falling: (size, starts, cycles); the group of rank r has the shard ``cycle[(r - start) % len(cycle)]`` of the last start not above r."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, count in sorted(histogram, reverse=True):
        starts, cycles, rank = [], [], 0
        while rank < count:
            todo = count - rank
            starts.append(rank)
            if size == 0:
                cycles.append([heap[0][1]])
                break
            if todo <= 2 * shards:
                pops = []
                for _ in range(todo):
                    load, i = heap[0]
                    pops.append(i)
                    heapq.heapreplace(heap, (load + size, i))
                cycles.append(pops)
                break
            heap.sort()
            (low, first), p = heap[0], 1
            while p < shards and heap[p] < (low + size, first):
                p += 1
            rounds = -(-todo // p)
            if p < shards:
                load, i = heap[p]
                rounds = min(rounds, (load - low) // size - ((load - low) % size == 0 and i < first))
            length = min(todo, rounds * p)
            cycles.append([i for _, i in heap[:p]])
            full, rest = divmod(length, p)
            heap = [(load + size * (full + (k < rest)), i) if k < p else (load, i) for k, (load, i) in enumerate(heap)]
            heapq.heapify(heap)
            rank += length
        out.append((size, starts, cycles))
    return out


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, shard) for every row of ``documents``; shards count from 0, a document's size is its characters.

    Null texts form one group of size 0, empty ones another. Repeated rows stay together, so do documents with equal texts and different ids;
    null ids are carried. Empty documents give no rows. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    keyed = cut(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.md5(text), F.lit("")).alias("group"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("size")))
    sized = keyed.groupBy("group").agg(F.sum("size").alias("size"))
    # numbered in order, partition by partition: the number's high bits are the partition's, so ranks come from where a size begins in each
    groups = cut(sized.repartitionByRange("size", "group").sortWithinPartitions("size", "group").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = cut(groups.groupBy("size", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    histogram = runs.groupBy("size").agg(F.sum("n").alias("n")).toArrow()
    plan = schedule(list(zip(histogram.column(0).to_pylist(), histogram.column(1).to_pylist())), shards)
    kind = pa.schema([("size", pa.int64()), ("starts", pa.list_(pa.int64())), ("cycles", pa.list_(pa.list_(pa.int32())))])
    lookup = spark.createDataFrame(pa.table([pa.array([p[i] for p in plan], t) for i, t in enumerate(kind.types)], schema=kind))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.join(runs.withColumn("before", before).join(lookup, "size"), ["size", "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before"))
    place = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    placed = (
        ranked.withColumn("place", place)
        .withColumn("cycle", F.element_at("cycles", F.col("place")))
        .select("group", F.element_at("cycle", ((F.col("rank") - F.element_at("starts", F.col("place"))) % F.size("cycle") + 1).cast("int")).cast("bigint").alias("shard"))
    )
    return keyed.select("doc_id", "group").join(placed, "group").select("doc_id", "shard")
