"""Centroid clustering with Elkan's bounds, exact to the last tie.

Vectors become integers, scale * x rounded down, and centroids stay integers: means are rounded down from exact sums.
Each vector keeps, from round to round, an upper bound of the distance to its centroid and a lower bound of the
distance to every other one, in a written table. When centroids move, the bounds move with them. A distance is
calculated only where neither the lower bound nor half the distance between the centroids is larger than the upper
bound. Bounds are doubles rounded away from what they bound, and only strictly larger ones prune, so a centroid
at an equal distance with a smaller number is never lost. Every distance that decides is an exact integer.

The driver holds the centroids and, each round, their sums and counts: bounded by k times the width.

Cases: vectors that are null, hold null or non-finite components or are not of the asked width take no part;
the first centroids are of the rows with the smallest SHA-256 of "seed:key" (null keys last), then by vector, fewer
where fewer rows are left; equally near centroids go to the smaller number; empty ones stay where they are; rows of
a repeated or null key are rows of their own; an empty table gives an empty result; other columns are ignored,
whatever their names; components too large for exact 64-bit distances raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .vectors import down, group_sums, integers, matrix, squared, up

SCALE, CENTROIDS, ROUNDS, WIDTH, SEED = 64, 16, 3, 64, 1
STATE = "struct<cluster:int,upper:double,lower:array<double>,calculated:int>"


class Centroids:
    """Centroids, half their distances to each other (rounded down) and how far they moved (rounded up)."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None) -> None:
        self.at = at
        each = squared(at[:, None, :], at[None, :, :]).astype(np.float64)
        self.half = down(np.sqrt(each) / 2)
        others = self.half.copy()
        np.fill_diagonal(others, np.inf)
        self.alone = others.min(axis=1)
        self.moved = np.zeros(len(at)) if before is None else up(np.sqrt(squared(at, before).astype(np.float64)))

    def distances(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return squared(v, self.at[cluster])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower, calculated) after the moves: the nearest centroid of every row, and how many distances that took."""
        upper = up(upper + self.moved[cluster])
        lower = np.maximum(0.0, down(lower - self.moved[None, :]))
        cluster, calculated = cluster.copy(), np.zeros(len(v), dtype=np.int32)
        rows = np.flatnonzero(~(upper < self.alone[cluster]))
        x, start, low = v[rows], cluster[rows], lower[rows]
        own = start.copy()
        best = self.distances(x, own)
        reach = up(np.sqrt(best.astype(np.float64)))
        calculated[rows] += 1
        for c in range(len(self.at)):
            open_ = (start != c) & ~(low[:, c] > reach) & ~(self.half[own, c] > reach)
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            d = squared(x[at], self.at[c])
            calculated[rows[at]] += 1
            root = np.sqrt(d.astype(np.float64))
            low[at, c] = down(root)
            nearer = (d < best[at]) | ((d == best[at]) & (c < own[at]))
            won = at[nearer]
            # What was the best is now one of the others: its distance is known.
            low[won, own[won]] = down(np.sqrt(best[won].astype(np.float64)))
            best[won], own[won], reach[won] = d[nearer], c, up(root[nearer])
        cluster[rows], upper[rows], lower[rows] = own, reach, low
        return cluster, upper, lower, calculated

    def updated(self, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
        new = self.at.copy()
        for c, (n, totals) in sums.items():
            new[c] = [t // n for t in totals]
        return Centroids(new, self.at)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.at.tolist()]


def _assigned(state: DataFrame, now: Centroids, width: int) -> DataFrame:
    """state (key, v, s) with s brought to the centroids of now."""
    k = len(now.at)

    @F.arrow_udf(STATE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, held in batches:
            n = len(vectors)
            cluster, upper = (np.asarray(held.field(c).to_numpy(zero_copy_only=False)) for c in ("cluster", "upper"))
            lower = held.field("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            cluster, upper, lower, calculated = now.assign(matrix(vectors, width), cluster.astype(np.int64), upper, lower)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(lower.ravel()), k).cast(pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(upper), lists, pa.array(calculated)], names=["cluster", "upper", "lower", "calculated"])

    return state.select("key", "v", run(F.col("v"), F.col("s")).alias("s"))


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, Centroids | None]:
    """(key, cluster, distance, calculated) of the usable vectors, and the centroids.

    distance: squared and exact; calculated: distances that the last assignment calculated for the row, of k."""
    data, _, rows = integers(vectors, vector, scale, F.col(key).alias("key"), also=F.size(vector) == width)
    if not rows:
        return data.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("calculated")), None
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    chosen = data.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    now = Centroids(np.array([r["v"] for r in chosen], dtype=np.int64))
    none = F.struct(F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), len(chosen)).alias("lower"), F.lit(0).alias("calculated"))
    state = data.withColumn("s", none)

    def assign(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield 0, batch.column(1).to_numpy(zero_copy_only=False), matrix(batch.column(0), width)

    for _ in range(rounds):
        state = durable(_assigned(state, now, width), "clusters")
        now = now.updated(group_sums(state.select("v", F.col("s.cluster").alias("c")), width, assign))
    last = now

    @F.arrow_udf("long")
    def exact(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for v, c in batches:
            yield pa.array(last.distances(matrix(v, width), c.to_numpy(zero_copy_only=False).astype(np.int64)))

    state = durable(_assigned(state, now, width), "clusters").select("key", "v", "s.cluster", "s.calculated")
    return durable(state.select(F.col("key").alias(key), "cluster", exact(F.col("v"), F.col("cluster")).alias("distance"), "calculated"), "clusters-last"), now


def with_inertia(found: DataFrame, now: Centroids) -> DataFrame:
    """found with the distances summed over each row's cluster and over all; a sum for each centroid goes through the driver."""
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    of = lambda values: F.array(*map(F.lit, values))[F.col("cluster")]
    per = [int(sums.get(c, 0)) for c in range(len(now.at))]
    as_long = lambda values: F.array(*(F.lit(x).cast("long") for x in values))[F.col("cluster")]
    return found.withColumns({"cluster_inertia": as_long(per), "inertia": F.lit(sum(per)).cast("long"), "centroid_sha256": of(now.digests())})
