"""Centroid clustering (k-means over integers) by Exponion search.

A vector carries its centroid, an upper bound of its distance to that one and a lower bound of its distance to all others.
Where the upper bound is below the lower one, or below half the way from its centroid to that one's nearest neighbour, no
other centroid can be as near, and nothing is measured. Else the upper bound is made exact, u, and only centroids in a ball
around the present one are looked at: those within 2u + s of it, s being the way to its nearest neighbour. They are a
prefix of the present centroid's list of the others in ascending distance. The radius is inclusive, and the bounds are
widened by more than a double's rounding, so centroids at equal distance are always among those that are measured;
distances decide as exact integers, and ties go to the smaller number.

Each round writes the vectors with their bounds and reads them again. Only the centroids, and sums for each of them, pass
through the driver: as many numbers as there are centroids and components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, materialise

#: Components are held within this, so that squared distances of some hundred components fit in 64 bits.
MOST = 1 << 27
#: By how much bounds are widened, relative to their size.
SLACK = 1e-9


def kept(vectors: DataFrame, dims: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (integers) of the vectors with exactly ``dims`` components, none of them null or non-finite."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.size("v") == dims)
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return rows.select("vec_id", F.transform("v", whole).alias("x"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and id; ties to the smaller vector, rows without an id last."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r["x"] for r in rows.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()], np.int64)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


class Balls:
    """What a round's centroids tell a search: for each, the others in ascending distance, and half the way to the nearest."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids, k = centroids, len(centroids)
        between = np.sqrt(np.array([squares(centroids, c) for c in centroids], np.float64))
        # a centroid leads its own list even where another one equals it
        own = between.copy()
        np.fill_diagonal(own, -1.0)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.ways = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.ways[:, 1] if k > 1 else np.full(k, np.inf)

    def search(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings cluster and bounds up to date, in place; returns how many distances were measured."""
        open_ = np.flatnonzero(upper * (1 + SLACK) >= np.maximum(lower * (1 - SLACK), self.nearest[cluster] / 2 * (1 - SLACK)))
        upper[open_] = np.sqrt(squares(x[open_], self.centroids[cluster[open_]]).astype(np.float64))
        measured = len(open_)
        open_ = open_[upper[open_] * (1 + SLACK) >= np.maximum(lower[open_] * (1 - SLACK), self.nearest[cluster[open_]] / 2 * (1 - SLACK))]
        for a in np.unique(cluster[open_]):
            rows = open_[cluster[open_] == a]
            reach = np.searchsorted(self.ways[a], (2 * upper[rows] + self.nearest[a]) * (1 + SLACK), side="right")
            turn = np.argsort(-reach, kind="stable")
            rows, reach = rows[turn], reach[turn]
            best = np.full(len(rows), np.iinfo(np.int64).max)
            second, who = best.copy(), np.full(len(rows), len(self.centroids))
            for p in range(reach[0]):
                n, j = np.searchsorted(-reach, -p), self.order[a, p]  # the first n rows reach farther than p
                d = squares(x[rows[:n]], self.centroids[j])
                measured += n
                nearer = (d < best[:n]) | (d == best[:n]) & (j < who[:n])
                second[:n] = np.where(nearer, best[:n], np.minimum(second[:n], d))
                best[:n], who[:n] = np.where(nearer, d, best[:n]), np.where(nearer, j, who[:n])
            cluster[rows], upper[rows] = who, np.sqrt(best.astype(np.float64))
            lower[rows] = np.sqrt(second.astype(np.float64)) if len(self.centroids) > 1 else np.inf
        return measured


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, measure: bool) -> DataFrame:
    """One assignment of all vectors to centroids that have moved so far since the bounds were set. measure: with the exact
    squared distance."""
    k = len(centroids)
    # of all but a vector's own centroid, the farthest move
    far = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            cluster = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            upper = batch.column(3).to_numpy(zero_copy_only=False) + moved[cluster]
            lower = np.maximum(batch.column(4).to_numpy(zero_copy_only=False) * (1 - SLACK) - far[cluster], 0.0)
            balls.search(x, cluster, upper, lower)
            distance = squares(x, centroids[cluster]) if measure else None
            columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(distance, pa.int64())] if measure else [])], names=["vec_id", "x", "cluster", "upper", "lower", *["distance"] * measure])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.select("vec_id", "x", "cluster", "upper", "lower").mapInArrow(run, f"vec_id {kind}, x array<int>, cluster int, upper double, lower double" + ", distance long" * measure)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each component's mean over a centroid's vectors, exactly; centroids without vectors stay."""
    new = centroids.copy()
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(d)).cast("long")).alias(f"s{d}") for d in range(centroids.shape[1])])
    for r in sums.collect():
        new[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(centroids.shape[1])]
    return new


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Vectors that are null, have another number of components, or hold null or non-finite ones, take no part. Repeated rows
    count as often as they stand there and come out as often; rows without an id take part, but start no centroid while
    others are left. With fewer than k vectors there are as many centroids as vectors; without any, no rows. Components
    beyond MOST count as MOST. An inertia that does not fit in 64 bits is null. Other columns are not read.
    """
    rows = kept(vectors, dims, id_col=id_col, vector_col=vector_col)
    spark = vectors.sparkSession
    state = materialise(rows.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), "vectors")
    centroids = first_centroids(state, k, salt)
    if not len(centroids):
        return state.select("vec_id", "cluster", *[F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit(None).cast("string").alias("centroid_sha256"))
    moved = np.zeros(len(centroids))
    for n in range(rounds + 1):
        last, state = state, materialise(assign(state, centroids, moved, n == rounds), f"assigned-{n}")
        discard(last)
        if n < rounds:
            before, centroids = centroids, means(state, centroids)
            moved = np.sqrt(squares(centroids, before).astype(np.float64)) * (1 + SLACK)
    inertia = state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole = state.agg(F.try_sum("distance").alias("inertia"))
    digest = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    # as many rows as there are centroids
    of = F.broadcast(inertia.join(F.broadcast(digest), "cluster").crossJoin(F.broadcast(whole)))
    return state.select("vec_id", "cluster", "distance").join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
