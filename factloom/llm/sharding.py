"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes from groups that can't be divided.

Rows of equal text are one group. A partial partition is a tuple of shard sums; differencing takes the two with the largest
spread and adds them in opposite order, largest to smallest, until one is left. It runs in levels: groups are dealt into
buckets by hash, a task differences each bucket, and the buckets' partial partitions are differenced the same way, up to
FAN of them in a task, until one remains. A level's choices are a small table that maps the slots below to those above.

Rules for input: a row's size is its text's UTF-8 bytes plus 8, a null text having none; nulls are a group of their own,
apart from empty texts; repeated rows are rows like any other; one group may exceed a shard's fair part, and then its shard
is as large as the group; fewer groups than shards leave shards empty; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, ready

#: Groups that a task differences, partial partitions that a task joins, and rows that a task numbers, about.
BUCKET_GROUPS, FAN, NUMBERED_ROWS = 10_000, 500, 4_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows; a column for each shard). For each, which shard its columns go to; and the sums."""
    n, k = parts.shape
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        down = np.argsort(-total, kind="stable")
        place = np.empty(k, np.int64)
        place[down] = np.arange(k)  # where each column of the sum stands after sorting
        joins.append((a, b, place, place[::-1].copy()))
        sums[a] = sums[b] = None
        sums.append(total[down])
        heapq.heappush(heap, (-int(total[down][0] - total[down][-1]), len(sums) - 1))
    to = {heap[0][1]: np.arange(k)}
    for i in range(len(joins) - 1, -1, -1):
        a, b, at_a, at_b = joins[i]
        up = to.pop(n + i)
        to[a], to[b] = up[at_a], up[at_b]
    goes = np.empty((n, k), np.int64)
    for i in range(n):
        goes[i, order[i]] = to[i]
    return goes, sums[heap[0][1]]


def byte_shards(groups: DataFrame, shards: int) -> DataFrame:
    """(g, shard) from (g, bytes), one row for each group."""
    spark = groups.sparkSession
    ready(spark)
    n = groups.count()
    buckets = max(1, math.ceil(n / BUCKET_GROUPS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True])
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        goes, _ = difference(parts)
        return pd.DataFrame({"g": pdf["g"], "bytes": pdf["bytes"], "node": pdf["node"], "slot": goes[:, 0]})

    dealt = groups.withColumn("node", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    low = cut(dealt.groupBy("node").applyInPandas(pack, "g string, bytes long, node long, slot long"), "shard-groups")
    sums = low.groupBy("node", "slot").agg(F.sum("bytes").alias("bytes"))
    where = low.select("g", "node", "slot")
    while True:
        above = max(1, math.ceil(buckets / FAN))

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes = np.sort(pdf["node"].unique())
            parts = np.zeros((len(nodes), shards), np.int64)
            parts[np.searchsorted(nodes, pdf["node"]), pdf["slot"]] = pdf["bytes"]
            goes, _ = difference(parts)
            return pd.DataFrame({"node": np.repeat(nodes, shards), "slot": np.tile(np.arange(shards), len(nodes)), "up": np.repeat(pdf["up"].iloc[0], goes.size), "to": goes.ravel(), "bytes": parts.ravel()})

        level = cut(sums.withColumn("up", F.pmod(F.col("node"), F.lit(above))).groupBy("up").applyInPandas(join, "node long, slot long, up long, to long, bytes long"), "shard-level")
        where = where.join(level.select("node", "slot", "up", "to"), ["node", "slot"]).select("g", F.col("up").alias("node"), F.col("to").alias("slot"))
        if above == 1:
            return where.select("g", F.col("slot").cast("int").alias("shard"))
        sums = level.groupBy(F.col("up").alias("node"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        buckets = above


def numbered(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """rows plus slot: 0, 1, ... within each shard. Shards are numbered in pieces, so no task holds a whole one."""
    n = rows.count()
    pieces = max(1, math.ceil(n / NUMBERED_ROWS / 8))
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    sizes = rows.groupBy(shard, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(shard, "_piece", F.coalesce(F.sum("_n").over(W.partitionBy(shard).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(shard, "_piece").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(before, [shard, "_piece"]).withColumn("slot", (F.col("_before") + F.col("_own")).cast("long")).drop("_piece", "_own", "_before")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row in one of the shards, bytes nearly equal, equal texts together."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null"))
    rows = cut(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group.alias("g")), "shard-rows")
    groups = cut(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "shard-sizes")
    placed = cut(rows.join(byte_shards(groups, shards), "g"), "shard-placed")
    return numbered(placed, "shard", ["id", "g"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
