"""Nearest vectors by cosine: exactly, all queries against all rows block by block; and through an index of cells.

Vectors that are null, have a null or non-finite component, or another width than most are zero vectors: their similarity is 0
with all. Scores are rounded to nine places and ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import shared_folder, ship

from .ranking import topk

#: Bytes of queries, as 32-bit numbers, that are sent to every executor at once; rows of a block; scores of a product.
SENT_BYTES, BLOCK_ROWS, SCORES = 32 << 20, 4096, 4_000_000
#: Rows that the cells are learned from at most, the most cells, and steps of learning.
SAMPLE_ROWS, MOST_CELLS, STEPS = 20_000, 1024, 8
#: Share of the nearest rows that is to be found, and rows of the sample by which it is told how many cells that takes.
RECALL, PROBED = 0.92, 500


def raw(vectors, width: int) -> np.ndarray:
    """Rows as 32-bit numbers; what is no vector of this width is zero."""
    out = np.zeros((len(vectors), width), np.float32)
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) == width]
    if good:
        x = np.array([vectors[i] for i in good], np.float64).astype(np.float32)
        x[~np.isfinite(x).all(axis=1)] = 0
        out[good] = x
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, as 64-bit numbers; zero rows stay."""
    x = rows.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def unpacked(rows: bytes, width: int) -> np.ndarray:
    return unit(np.frombuffer(rows, np.float32).reshape(-1, width))


class Best:
    """The best k of each query so far: a block of scores at a time."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.zeros((queries, 0)), np.zeros((queries, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        score = np.concatenate((self.score, scores), axis=1)
        of = np.concatenate((self.id, np.broadcast_to(ids, scores.shape)), axis=1)
        if score.shape[1] > 4 * self.k:  # few candidates are sorted: the k-th score and what ties with it
            least = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
            keep = score >= least[:, None]
            wide = int(keep.sum(axis=1).max())
            if wide < score.shape[1]:
                at = np.argsort(~keep, axis=1, kind="stable")[:, :wide]
                score, of = np.where(np.take_along_axis(keep, at, 1), np.take_along_axis(score, at, 1), -np.inf), np.take_along_axis(of, at, 1)
        order = np.lexsort((of, -score), axis=1)[:, : self.k]
        self.score, self.id = np.take_along_axis(score, order, 1), np.take_along_axis(of, order, 1)

    def rows(self, qids: np.ndarray) -> pd.DataFrame:
        some = self.score > -np.inf
        return pd.DataFrame({"qid": np.repeat(qids, some.sum(axis=1)), "table_id": self.id[some], "score": self.score[some]})


def _width(rows: DataFrame, dims: str) -> tuple[int, int]:
    """(rows, the width that most vectors have; the larger of two as frequent)."""
    sizes = rows.groupBy(F.size(dims).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()  # widths are few
    return sum(r["n"] for r in sizes), max(((r["n"], r["w"]) for r in sizes if r["w"] and r["w"] > 0), default=(0, 1))[1]


def _sent(rows: DataFrame, key: str, dims: str, width: int):
    """(ids, matrix) of a side of bounded size, on all executors."""
    got = rows.select(key, dims).collect()
    return rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in got], np.int64), raw([r[1] for r in got], width)))


def vector_topk(queries: DataFrame, index: DataFrame, k: int = 5, dims: str = "embedding") -> DataFrame:
    """(qid, table_id, score, rank): cosine top k of each query (qid, embedding) over the index (table_id, embedding).

    Queries are sent to the executors, SENT_BYTES of them at a time, and multiplied with the index where it lies: nothing of
    it is shuffled, and a task gives the best k of what it has read.
    """
    ship(queries.sparkSession)
    n, width = _width(queries, dims)
    chunks = max(1, -(-n * 4 * width // SENT_BYTES))
    found = None
    for c in range(chunks):
        here = queries if chunks == 1 else queries.filter(F.pmod(F.xxhash64("qid"), F.lit(chunks)) == c)
        sent = _sent(here, "qid", dims, width)

        def best(batches, sent=sent):
            qids, q = sent.value
            q = unit(q)
            rows = max(1, min(BLOCK_ROWS, SCORES // max(1, len(q))))
            held = Best(len(q), k)
            for pdf in batches:
                for a in range(0, len(pdf), rows):
                    part = pdf.iloc[a : a + rows]
                    held.add(np.round(q @ unit(raw(part["v"].to_list(), width)).T, 9), part["k"].to_numpy(np.int64))
            yield held.rows(qids)

        got = index.select(F.col("table_id").cast("long").alias("k"), F.col(dims).alias("v")).mapInPandas(best, "qid long, table_id long, score double")
        found = got if found is None else found.unionByName(got)
    return topk(found, ["qid"], [F.desc("score"), "table_id"], k)


def index_topk(queries: DataFrame, index: DataFrame, k: int = 10, floor: float = 0.5) -> DataFrame:
    """vector_topk, and after it the rows at the floor or above."""
    return vector_topk(queries, index, k).filter(F.col("score") >= floor)


def learn_cells(index: DataFrame, dims: str = "embedding", cells: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of the index's cells, the rows that they are learned on): at most SAMPLE_ROWS, those with the smallest hashes of their ids.

    There are about as many as the root of the number of rows. The rows are a bounded sample, and only they reach the driver.
    """
    n, width = _width(index, dims)
    rows = index.orderBy(F.xxhash64("table_id"), "table_id").limit(SAMPLE_ROWS).select(dims).collect()
    x = unit(raw([r[0] for r in rows], width))
    x = x[np.linalg.norm(x, axis=1) > 0]
    many = min(cells or max(1, min(MOST_CELLS, int(math.sqrt(n)))), max(1, len(x)))
    if not len(x):
        return np.zeros((1, width)), x
    c = x[np.random.default_rng(7).choice(len(x), many, replace=False)]
    for _ in range(STEPS):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        some = np.linalg.norm(sums, axis=1) > 0
        c[some] = sums[some] / np.linalg.norm(sums[some], axis=1, keepdims=True)
    return c, x


class CellIndex:
    """An inverted file: every row of the index under its nearest cell, written to the shared folder.

    A query reads the rows of its `probes` nearest cells only, and is scored with them exactly. Cells are packed into blocks of
    BLOCK_ROWS rows, so a full cell is many rows of the join and not one.
    """

    def __init__(self, index: DataFrame, dims: str = "embedding", cells: int | None = None):
        spark = index.sparkSession
        ship(spark)
        self.dims = dims
        self.centroids, self.sample = learn_cells(index, dims, cells)
        self.width = width = self.centroids.shape[1]
        sent = spark.sparkContext.broadcast(self.centroids)

        def assign(batches):
            c = sent.value
            for pdf in batches:
                x = raw(pdf["v"].to_list(), width)
                yield pd.DataFrame({"cell": (unit(x) @ c.T).argmax(axis=1), "k": pdf["k"], "v": [r.tobytes() for r in x]})

        path = shared_folder(spark, "vector-cells")
        rows = index.select(F.col("table_id").cast("long").alias("k"), F.col(dims).alias("v"))
        rows.mapInPandas(assign, "cell long, k long, v binary").write.parquet(path)
        placed = spark.read.schema("cell long, k long, v binary").parquet(path)
        most = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "ids": [pdf["k"].to_numpy(np.int64).tobytes()], "m": [b"".join(pdf["v"])]})

        self.path = shared_folder(spark, "vector-blocks")
        block = F.pmod(F.xxhash64("k"), F.col("blocks"))
        placed.join(most, "cell").withColumn("b", block).groupBy("cell", "b").applyInPandas(pack, "cell long, ids binary, m binary").write.parquet(self.path)
        self.blocks = spark.read.schema("cell long, ids binary, m binary").parquet(self.path)

    def probes_for(self, recall: float, k: int = 5) -> int:
        """How many cells find that share of the k nearest rows, by the first rows of the sample against all of it.

        Rows of the sample lie further apart than those of the whole index, so this is rather too many.
        """
        x = self.sample
        if len(x) <= k:
            return len(self.centroids)
        q = x[:PROBED]
        near = q @ x.T
        near[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = np.argpartition(-near, k, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(q @ self.centroids.T), axis=1, kind="stable"), axis=1)
        at = np.sort(np.take_along_axis(place, (x @ self.centroids.T).argmax(axis=1)[best], axis=1).ravel())
        return int(at[min(len(at) - 1, math.ceil(recall * len(at)))]) + 1

    def topk(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """(qid, table_id, score, rank): like vector_topk, but over the rows of each query's nearest cells.

        Without a number of cells, as many are read as find RECALL of the k nearest.
        """
        probes = probes or self.probes_for(RECALL, k)
        width, dims = self.width, self.dims
        sent = queries.sparkSession.sparkContext.broadcast(self.centroids)

        def probe(batches):
            c = sent.value
            near = min(probes, len(c))
            for pdf in batches:
                x = raw(pdf["v"].to_list(), width)
                cells = np.argsort(-(unit(x) @ c.T), axis=1, kind="stable")[:, :near]
                yield pd.DataFrame({"cell": cells.ravel(), "qid": np.repeat(pdf["qid"].to_numpy(np.int64), near), "q": [v for r in x for v in [r.tobytes()] * near]})

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "qids": [pdf["qid"].to_numpy(np.int64).tobytes()], "q": [b"".join(pdf["q"])]})

        def score(batches):
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    qids, ids = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                    q, x = unpacked(r.q, width), unpacked(r.m, width)
                    held = Best(len(qids), k)
                    held.add(np.round(q @ x.T, 9), ids)
                    yield held.rows(qids)

        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col(dims).alias("v")).mapInPandas(probe, "cell long, qid long, q binary")
        # a cell's queries are packed in blocks by hash, so a cell that many ask for is many rows too
        packed = asked.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(max(1, math.ceil(queries.count() / BLOCK_ROWS))))).groupBy("cell", "b").applyInPandas(pack, "cell long, qids binary, q binary")
        met = packed.join(self.blocks, "cell").select("qids", "q", "ids", "m")
        return topk(met.mapInPandas(score, "qid long, table_id long, score double"), ["qid"], [F.desc("score"), "table_id"], k)


def index_recall(queries: DataFrame, index: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """(qid, k, found, recall): how many of a query's exact k nearest rows the cells give, and the share over all queries.

    As many cells are read as should find the share `recall`.
    """
    exact = vector_topk(queries, index, k).select("qid", "table_id")
    cells = CellIndex(index)
    near = cells.topk(queries, k, cells.probes_for(recall, k)).select("qid", "table_id", F.lit(1).alias("hit"))
    by = exact.join(near, ["qid", "table_id"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("found"))
    total = by.agg((F.sum("found") / F.sum("k")).alias("recall"))
    return by.crossJoin(F.broadcast(total))
