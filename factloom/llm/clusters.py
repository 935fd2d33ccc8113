"""k-means on whole numbers with a progressive search in the Walsh-Hadamard domain.

Vectors and centroids go through the exact integer transform, which multiplies every squared distance by the same number. Its
coefficients are taken coarse to fine: a few low ones give a lower bound of each centroid's distance. The centroid with the
smallest bound is finished first; any other whose bound already exceeds that distance is strictly worse and is left, and those
that stay take the next block of coefficients, up to the last. All sums are whole numbers, so ties are ties.

Centroids are a few rows and travel with the tasks; a round is one pass over the written vectors, which returns one row of sums
for each task and cluster. As the transform is linear, sums are kept in its domain and turned back on the driver.

Rules for input: vectors with other than `width` components, or with a null or non-finite one, are left out, as is one whose
component lies beyond 2**17 in size, since its squared distance need not fit a long; a null id counts as the empty text where
ids are hashed; rows that share an id, or are equal, are vectors each; fewer vectors than clusters give fewer clusters; an empty
table gives an empty one; other columns are left to the caller.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, ready

#: Where the blocks of coefficients end that are taken one after the other, as parts of the width.
BLOCKS = (8, 4, 2, 1)
#: A component's largest size, before scaling.
LARGEST = 1 << 17


def sequency_order(width: int) -> np.ndarray:
    """Rows of the transform by the number of their sign changes, few first: coarse to fine."""
    h = transform(np.eye(width, dtype=np.int64))
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    x = x.astype(np.int64, copy=True)
    step = 1
    while step < width:
        pair = x.reshape(n, width // (2 * step), 2, step)
        a, b = pair[:, :, 0].copy(), pair[:, :, 1].copy()
        pair[:, :, 0], pair[:, :, 1] = a + b, a - b
        step *= 2
    return x


def search(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, transformed squared distance) of each vector; both are transformed and in coarse-to-fine order.

    Ties go to the smaller number.
    """
    n, width = vectors.shape
    ends = [width // b for b in BLOCKS]
    first = vectors[:, : ends[0]]
    partial = np.stack([((first - c[: ends[0]]) ** 2).sum(axis=1) for c in centroids], axis=1)
    lead = partial.argmin(axis=1)
    best = ((vectors - centroids[lead]) ** 2).sum(axis=1)
    row, of = np.nonzero((partial <= best[:, None]) & (np.arange(len(centroids)) != lead[:, None]))
    sums = partial[row, of]
    for a, b in zip(ends, ends[1:]):
        sums = sums + ((vectors[row, a:b] - centroids[of, a:b]) ** 2).sum(axis=1)
        stay = sums <= best[row]
        row, of, sums = row[stay], of[stay], sums[stay]
    # survivors are finished: the nearest of them and the lead, then the smallest number
    row, of, sums = np.concatenate((np.arange(n), row)), np.concatenate((lead, of)), np.concatenate((best, sums))
    order = np.lexsort((of, sums, row))
    pick = order[np.concatenate(([True], np.diff(row[order]) > 0))] if n else order
    return of[pick], sums[pick]


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(id, key, v): ids, their hash, and the vectors as whole numbers."""
    x = F.col(vector_col)
    usable = (F.size(x) == width) & F.coalesce(F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST)), F.lit(False))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return rows.filter(usable).select(F.col(id_col).alias("id"), F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("key"), whole.alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(len(column), width)


def kmeans(rows: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[tuple[int, ...]]]:
    """((id, cluster, distance) of every vector that is kept; the centroids)."""
    spark = rows.sparkSession
    ready(spark)
    order = sequency_order(width)

    def prepare(batches):
        for pdf in batches:
            x = transform(np.stack(pdf["v"]).astype(np.int64))[:, order] if len(pdf) else np.zeros((0, width), np.int64)
            yield pd.DataFrame({"id": pdf["id"], "w": [r.astype("<i8").tobytes() for r in x]})

    whole = whole_vectors(rows, id_col, vector_col, width, scale)
    seeds = whole.orderBy("key", "v").limit(clusters).select("v").collect()  # a bounded number of rows
    centroids = [tuple(r["v"]) for r in seeds]
    kept = cut(whole.select(F.col("id").cast("string").alias("id"), "v").mapInPandas(prepare, "id string, w binary"), "clusters-vectors")
    kind = rows.schema[id_col].dataType

    def turned() -> np.ndarray:
        return transform(np.array(centroids, np.int64).reshape(-1, width))[:, order]

    def sums_by(c: np.ndarray):
        def run(batches):
            n, total = np.zeros(len(c), np.int64), np.zeros((len(c), width), np.int64)
            for pdf in batches:
                x = _matrix(pdf["w"], width)
                of, _ = search(x, c)
                n += np.bincount(of, minlength=len(c))
                for k in np.unique(of).tolist():
                    total[k] += x[of == k].sum(axis=0)
            yield pd.DataFrame({"cluster": np.arange(len(c)), "n": n, "total": list(total)})

        return run

    for _ in range(rounds if centroids else 0):
        parts = kept.select("w").mapInPandas(sums_by(turned()), "cluster int, n long, total array<long>").filter("n > 0")
        long = parts.select("cluster", "n", F.posexplode("total").alias("i", "t")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
        sums, n = {}, {}
        for r in long.collect():  # clusters x width numbers
            sums.setdefault(r["cluster"], [0] * width)[order[r["i"]]] = int(r["t"])
            n[r["cluster"]] = int(r["n"])
        for k, t in sums.items():
            # the transform is its own inverse but for the factor `width`; Python's whole numbers don't overflow
            step = 1
            while step < width:
                for i in range(0, width, 2 * step):
                    for j in range(i, i + step):
                        t[j], t[j + step] = t[j] + t[j + step], t[j] - t[j + step]
                step *= 2
            centroids[k] = tuple(x // width // n[k] for x in t)

    def place(batches, c=turned()):
        for pdf in batches:
            of, d = search(_matrix(pdf["w"], width), c) if len(c) else (np.zeros(0, np.int64),) * 2
            yield pd.DataFrame({"id": pdf["id"], "cluster": of.astype(np.int32), "distance": d // width})

    placed = kept.mapInPandas(place, "id string, cluster int, distance long")
    return cut(placed.select(F.col("id").cast(kind).alias(id_col), "cluster", "distance"), "clusters-placed"), centroids


def with_inertia(placed: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """placed plus the summed distance of its cluster and of all, and the hash of its centroid. A cluster is one row here."""
    by = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    sha = {k: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for k, c in enumerate(centroids)}

    def of(values: dict, kind: str) -> Column:
        pairs = [x for k in sorted(by) for x in (F.lit(k), F.lit(values[k]).cast(kind))]
        return F.create_map(*pairs)[F.col("cluster")] if pairs else F.lit(None).cast(kind)

    return placed.withColumns({"cluster_inertia": of(by, "long"), "inertia": F.lit(sum(by.values())).cast("long"), "centroid_sha256": of(sha, "string")})
