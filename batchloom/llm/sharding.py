"""Operator 3: shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts.

Differencing keeps partial partitions, each a vector of shard totals. It repeatedly takes the two with the largest spread,
adds them in opposite order (largest with smallest) and puts the sum back, until one is left. Groups are dealt to blocks by
the hash of their text and differenced there; a block's result is again a partial partition, and blocks are combined by the
same rule, ``FAN`` at a time, level by level. Blocks hold about ``BLOCK_GROUPS`` groups whatever the input's size, so no
task and not the driver meets more than a bounded number of groups. Above ``BLOCK_GROUPS`` groups the result is not that of
one differencing of all of them; a sum of two partial partitions in opposite order spreads no more than the wider of the
two, so the bytes of the shards differ at most by the widest spread of a block, which is at most its largest group.

A copy group of any size is one row of (rows, bytes) after a partial aggregation, and its shard comes back to its rows as a
hot key. Slots come from counts per shard and bucket: a prefix sum over buckets plus a row number inside the bucket, so no
shard is sorted in one task. Buckets are dealt by the hash of a whole row; a bucket that equal rows fill is cut further.

Edge cases: a null text counts as an empty one (crc 0, 16 bytes) and shares its group; a null id gets a shard like any
other row; repeated rows are copies of one group; a group larger than a shard's share stays whole; texts of any length
enter by size, CRC and hash; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import forget, join_hot, stored, table, text_or_empty
from batchloom.session import ship

SHARDS = 40
OVERHEAD = 16
BLOCK_GROUPS = 4096
FAN = 64
#: Rows that a bucket of slots holds on average.
SLOT_ROWS = 20_000


def difference(vectors: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over rows of shard totals: for each row, the final shard of each of its places."""
    n, k = vectors.shape
    heap: list[tuple[float, int]] = []
    totals: dict[int, np.ndarray] = {}
    members: dict[int, tuple] = {}
    for i in range(n):
        order = np.argsort(-vectors[i], kind="stable")
        totals[i] = vectors[i][order]
        members[i] = (i, order)
        heap.append((float(totals[i][-1] - totals[i][0]), i))
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = totals.pop(a) + totals.pop(b)[::-1]
        order = np.argsort(-total, kind="stable")
        totals[number] = total[order]
        members[number] = (a, b, order)
        heapq.heappush(heap, (float(totals[number][-1] - totals[number][0]), number))
        number += 1
    place = np.empty((n, k), np.int32)
    stack = [(number - 1, np.arange(k))] if n else []
    while stack:  # from the last sum down: where each place of a partial partition ended
        i, to = stack.pop()
        if i < n:
            place[i, members[i][1]] = to
            continue
        a, b, order = members[i]
        before = np.empty(k, np.int64)
        before[order] = to
        stack += [(a, before), (b, before[::-1])]
    return place


def group_blocks(shards: int):
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "gid"], ascending=[False, True])
        vectors = np.zeros((len(frame), shards), np.int64)
        vectors[:, 0] = frame["bytes"].to_numpy()
        return pd.DataFrame({"block": frame["block"], "gid": frame["gid"], "n": frame["n"], "part": difference(vectors)[:, 0], "bytes": frame["bytes"]})

    return solve


def level_blocks(shards: int):
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(frame["block"].unique())
        vectors = np.zeros((len(ids), shards), np.int64)
        vectors[np.searchsorted(ids, frame["block"]), frame["part"]] = frame["bytes"]
        place = difference(vectors)
        return pd.DataFrame({"block": np.repeat(ids, shards), "part": np.tile(np.arange(shards), len(ids)), "up": frame["up"].iloc[0], "place": place.ravel(), "bytes": vectors.ravel()})

    return solve


def karmarkar_karp(groups: DataFrame, shards: int) -> DataFrame:
    """``gid, n, shard`` for a table of groups ``gid, n, bytes``."""
    ship(groups.sparkSession)
    n_blocks = max(1, math.ceil(groups.count() / BLOCK_GROUPS))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(n_blocks)))
    parts = stored(dealt.groupBy("block").applyInPandas(group_blocks(shards), "block long, gid binary, n long, part int, bytes long"), "kk-groups")
    sums = parts.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
    where = None  # block, part -> place on the last level
    while True:
        up = sums.withColumn("up", F.expr(f"block div {FAN}"))
        solved = stored(up.groupBy("up").applyInPandas(level_blocks(shards), "block long, part int, up long, place int, bytes long"), "kk-level")
        if where is None:
            where = solved.select("block", "part", F.col("up").alias("at"), "place")
        else:
            step = solved.select(F.col("block").alias("at"), F.col("part").alias("place"), F.col("up"), F.col("place").alias("next"))
            where = stored(where.join(step, ["at", "place"]).select("block", "part", F.col("up").alias("at"), F.col("next").alias("place")), "kk-where")
        if n_blocks <= FAN:
            break
        n_blocks = math.ceil(n_blocks / FAN)
        sums = solved.groupBy(F.col("up").alias("block"), F.col("place").alias("part")).agg(F.sum("bytes").alias("bytes"))
    return parts.join(where, ["block", "part"]).select("gid", "n", F.col("place").alias("shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """``slot``: a gapless number from 0 inside each ``shard``, in the order of hash buckets and then of the row."""
    whole = ["doc_id", "text_crc32", "size"]
    buckets = max(1, math.ceil(rows.count() / SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*whole), F.lit(buckets)).cast("int"))
    filled = stored(rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SLOT_ROWS).alias("subs")), "slot-buckets")
    rows = join_hot(rows, filled, ["shard", "bucket"])
    rows = stored(rows.withColumn("sub", F.when(F.col("subs") > 4, F.pmod(F.xxhash64("rid"), F.col("subs"))).otherwise(0).cast("int")).drop("subs"), "slot-rows")
    counts = rows.groupBy("shard", "bucket", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket", "sub").orderBy(*whole)
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket", "sub"]).withColumn("slot", F.col("first") + F.col("nth"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = text_or_empty("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("gid"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    groups = stored(rows.groupBy("gid").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    placed = stored(join_hot(rows, stored(karmarkar_karp(groups, shards), "shard-of"), ["gid"]).drop("gid"), "shard-placed")
    forget(docs.sparkSession, rows, groups)
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
