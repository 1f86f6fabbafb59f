"""Centroid clustering (Lloyd, 1982) of integer vectors, exact: squared distances by |x|^2 - 2 x.c + |c|^2 in blocked float64 BLAS.

All terms are whole numbers. As long as a bound of their magnitude stays below 2^53 each step of the product is exact in
float64, in whatever order BLAS adds; other blocks go by differences in 64-bit integers, and beyond these by Python's. Sums of a
round are combined by a tree over the partitions, so that the driver receives k rows, whatever the number of vectors, and
integers add up to the same in any order: a lost executor's part is made again with the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidecast.llm.common import written

#: Vectors of a block.
BLOCK = 4096
EXACT, LONG = 1 << 53, 1 << 63
OUT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two: as 64-bit integers, or as Python's where these are too narrow."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if not v.size or np.abs(v).max() < 2.0**62:
        return v.astype(np.int64)
    return np.array([[int(np.floor(e * scale)) if abs(e) < 2.0**62 else int(e) * scale for e in row] for row in x.tolist()], object)


def pack(x: np.ndarray) -> tuple[int, bytes]:
    """The bytes of an integer and the block in the narrowest type that holds it; zero and decimal digits beyond 64 bits."""
    if x.dtype == object:
        return 0, ",".join(map(str, x.ravel())).encode()
    top = int(np.abs(x).max()) if x.size else 0
    wide = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return wide, x.astype(f"<i{wide}").tobytes()


def unpack(wide: int, data: bytes, size: int) -> np.ndarray:
    if not wide:
        return np.array([int(e) for e in bytes(data).split(b",")], object).reshape(-1, size)
    return np.frombuffer(data, f"<i{wide}").astype(np.int64).reshape(-1, size)


def largest(x: np.ndarray) -> int:
    return max((abs(int(e)) for e in (x.max(), x.min())), default=0) if x.size else 0


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and c, of which either may hold Python's integers."""
    bound = x.shape[1] * (largest(x) + largest(c)) ** 2
    if bound < EXACT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if bound < LONG else object
    a, b = x.astype(kind), c.astype(kind)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid, the smaller number in ties, and its squared distance."""
    d = distances(x, c)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def sums(x: np.ndarray, best: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """By cluster, in Python's integers: the sum of its vectors, their number, and the sum of their distances."""
    out = np.zeros((k, x.shape[1] + 2), object)
    own = x if largest(x) * len(x) < LONG else x.astype(object)
    for j in np.unique(best).tolist():
        mine = best == j
        out[j, :-2] = own[mine].sum(axis=0).tolist()
        out[j, -2:] = int(mine.sum()), sum(far[mine].tolist())
    return out


def fits(value: int) -> int | None:
    return value if value < LONG else None


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """One row per kept vector: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly ``size`` components, none null or not finite, are kept, as integers floor(scale * x). Of these the ``k``
    with the smallest sha256 of ``seed:id`` are the first centroids (of equal identifiers the smaller vector comes first; a null
    identifier counts as an empty one); with fewer vectors there are fewer clusters. Each of ``rounds`` assigns every vector to
    the nearest centroid and replaces each centroid that has vectors by the floor of their mean; then they are assigned once
    more. ``distance`` is squared, inertias are its sums over the cluster and over all, each null where it passes 64 bits.
    centroid_sha256 is that of the final centroid's components, joined by commas. Rows may repeat and count as often. An empty
    table, or none kept, gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    inf = F.lit(float("inf"))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = own.where((F.size("v") == size) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf)))

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                wide, data = pack(whole(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale))
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([wide], pa.int32()), pa.array([data], pa.binary())], names=["ids", "wide", "data"])

    made = written(kept.mapInArrow(blocks, "ids array<long>, wide int, data binary"))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], f"`{id_col}` long, {OUT}")
    centroids = whole(np.array([r["v"] for r in first], float), scale)

    def assigned(c: np.ndarray) -> np.ndarray:
        def add(total: np.ndarray, block: Row) -> np.ndarray:
            x = unpack(block["wide"], block["data"], size)
            return total + sums(x, *nearest(x, c), len(c))

        return made.rdd.treeAggregate(np.zeros((len(c), size + 2), object), add, lambda a, b: a + b)

    for _ in range(rounds):
        found = assigned(centroids)
        moved = [[s // r[-2] for s in r[:-2]] if r[-2] else old.tolist() for r, old in zip(found, centroids, strict=True)]
        centroids = np.array(moved, np.int64 if max(abs(e) for r in moved for e in r) < 1 << 62 else object)
    inertias = assigned(centroids)[:, -1].tolist()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, wide, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best, far = nearest(unpack(wide, data, size), centroids)
                of_cluster = pa.array(best)
                columns = [
                    ids.values, pa.array(best, pa.int32()), pa.array([fits(int(e)) for e in far], pa.int64()), pa.array(map(fits, inertias), pa.int64()).take(of_cluster),
                    pa.array([fits(sum(inertias))] * len(best), pa.int64()), pa.array(digests).take(of_cluster),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return made.mapInArrow(rows, f"`{id_col}` long, {OUT}")
