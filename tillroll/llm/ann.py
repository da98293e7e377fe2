"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, scaled to length 1 and rotated by a fixed random rotation. A row keeps the
signs of its rotated coordinates as packed bits, its distance to the centre and the inner product
of its code with its own direction. The inner product of a query with a row's direction is then
estimated from the bits alone, with an error that is below a bound for all but a small share of
rotations. A row is compared exactly only if the lower end of its distance estimate is below the
k-th smallest upper end that its task has seen.

Rows are never paired in a join: each block of queries (at most ``BLOCK`` vectors, so the broadcast
has a fixed size) goes over all rows, whose tasks send on k rows per query at most.

Edge cases: vectors that are null, empty, of another length than most, all zero, or hold a null or
non-finite component take no part; equal distances go to the smaller id, then repeated rows keep
their places; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries per broadcast; the queries are cut into blocks by a hash of their id.
BLOCK = 4096
#: Rows of a task compared at once.
ROWS = 4096
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 4.0


@dataclass
class Rotation:
    centre: np.ndarray
    matrix: np.ndarray

    def directions(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated unit vectors from the centre, and the distances to it."""
        moved = vectors - self.centre
        lengths = np.sqrt((moved * moved).sum(axis=1))
        return (moved / np.maximum(lengths, 1e-300)[:, None]) @ self.matrix, lengths


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can take part."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return df.where(
        F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    )


def fit_rotation(df: DataFrame, vector: str, seed: int = 7) -> Rotation | None:
    """The mean of all vectors of the commonest length and a random rotation of that dimension."""
    sizes = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").head(1)
    if not sizes:
        return None
    dim = sizes[0].d
    means = (
        df.where(F.size(vector) == dim)
        .select([F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dim)])
        .first()
    )
    draws = np.random.default_rng(seed).standard_normal((dim, dim))
    q, r = np.linalg.qr(draws)
    return Rotation(np.array(means, float), q * np.sign(np.diag(r)))


@dataclass
class Codes:
    """Packed signs and correction scalars of a block of vectors."""

    bits: np.ndarray  # (rows, bytes)
    length: np.ndarray  # distance to the centre
    fit: np.ndarray  # inner product of the code's unit vector with the direction

    @classmethod
    def of(cls, rotation: Rotation, vectors: np.ndarray) -> Codes:
        turned, length = rotation.directions(vectors)
        dim = turned.shape[1]
        fit = np.abs(turned).sum(axis=1) / np.sqrt(dim)
        return cls(np.packbits(turned > 0, axis=1), length, np.maximum(fit, 1e-9))

    def bounds(
        self, turned: np.ndarray, query_length: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the squared distance of each query to each row."""
        dim = turned.shape[1]
        # <query, sign code> from bits: twice the sum where the bit is set, minus the whole sum.
        table = turned
        if dim % 8:
            table = np.pad(turned, ((0, 0), (0, 8 - dim % 8)))
        unpacked = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
        with_bits = np.zeros((len(turned), len(self.bits)))
        for j in range(self.bits.shape[1]):
            sums = table[:, 8 * j : 8 * j + 8] @ unpacked.T
            with_bits += sums[:, self.bits[:, j]]
        inner = (2 * with_bits - turned.sum(axis=1)[:, None]) / np.sqrt(dim)
        cosine = inner / self.fit
        error = WIDTH * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(1, dim - 1))
        scale = 2 * query_length[:, None] * self.length
        middle = query_length[:, None] ** 2 + self.length**2 - scale * cosine
        return middle - scale * error, middle + scale * error


def exact_distance(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distance of paired vectors in double precision."""
    gap = queries - rows
    return np.sqrt((gap * gap).sum(axis=1))


def search(
    rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank from 1, ``vec_id``, score.

    A row is no neighbour of the query with its own id.
    """
    spark = rows.sparkSession
    rows = usable(rows.select(F.col(key).alias("id"), F.col(vector).alias("v")), "v")
    rows = rows.where("id is not null")
    queries = usable(queries.select(F.col(key).alias("id"), F.col(vector).alias("v")), "v")
    queries = queries.where("id is not null")
    empty = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    rotation = fit_rotation(rows, "v")
    total = queries.count()
    found = empty
    if rotation is not None and total:
        dim = len(rotation.centre)
        rows = rows.where(F.size("v") == dim)
        queries = queries.where(F.size("v") == dim)
        # Twice the blocks that are needed on average, so that none grows far beyond BLOCK.
        blocks = 1 if total <= BLOCK else -(-2 * total // BLOCK)
        for block in range(blocks):
            part = queries
            if blocks > 1:
                part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
            some = part.toPandas()
            if len(some):
                found = found.union(_scan(rows, rotation, some["id"], some["v"], k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scan(rows: DataFrame, rotation: Rotation, ids, vectors, k: int) -> DataFrame:
    """The k best rows of each task for one block of queries."""
    wanted = np.array(vectors.tolist(), float)
    turned, query_length = rotation.directions(wanted)
    shared = rows.sparkSession.sparkContext.broadcast(
        (rotation, ids.to_numpy(np.int64), wanted, turned, query_length)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, ids, wanted, turned, query_length = shared.value
        n = len(ids)
        best = np.full((n, k), np.inf)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            block = flat.astype(float).reshape(len(keys), -1)
            for start in range(0, len(keys), ROWS):
                own_keys, own = keys[start : start + ROWS], block[start : start + ROWS]
                codes = Codes.of(rotation, own)
                for first in range(0, n, 256):
                    here = slice(first, first + 256)
                    low, high = codes.bounds(turned[here], query_length[here])
                    same = own_keys[None, :] == ids[here, None]
                    high[same] = np.inf
                    limit = best[here, -1] ** 2
                    if len(own) >= k:
                        limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
                    keep = (low <= limit[:, None] * (1 + 1e-9) + 1e-12) & ~same
                    for q in np.nonzero(keep.any(axis=1))[0]:
                        at = np.nonzero(keep[q])[0]
                        exact = exact_distance(wanted[first + q], own[at])
                        distance = np.concatenate([best[first + q], exact])
                        number = np.concatenate([best_id[first + q], own_keys[at]])
                        order = np.lexsort((number, distance))[:k]
                        best[first + q], best_id[first + q] = distance[order], number[order]
        query, place = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[query], pa.int64()),
                pa.array(best_id[query, place], pa.int64()),
                pa.array(best[query, place], pa.float64()),
            ],
            names=["query_id", "vec_id", "score"],
        )

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
