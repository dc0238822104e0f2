"""Exact top-k by inner product as a Voronoi kNN join.

Vectors are quantized to integers. A bounded number of pivots, the square root of the rows up to MOST_PIVOTS,
splits data into Voronoi cells. Summaries of a cell (rows, radius, largest angle to the pivot, smallest and
largest norm) bound every inner product inside it: <q, c> is at most <q, p> + |q| radius and at most
|q| |c| cos(angle(q, p) - largest angle). Each query is first solved in the cells of its best pivots that hold
more than k rows together; its k-th score there is a floor, and the query is replicated only to the other
cells whose bound reaches the floor. Cells, and the queries that reach a cell, are cut into blocks of bounded
size by a hash, so that a cell with a third of all rows (copies of one vector) is many tasks' work; every block
is solved locally with exact integer products, and a query's partial lists are merged.

How much is pruned depends on the data: clustered vectors leave few cells open; vectors that fill 64 dimensions
evenly leave nearly all, since there every radius is close to a right angle, and no exact bound of this kind
separates them (README has the figures).

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; equal scores go to the smaller id; rows are told apart by themselves, not by their id: where
an id is repeated, each of its rows is a query of its own with its own k rows, and the others are candidates to
it, as copies are; fewer than k candidates give fewer rows; no queries or an empty table give an empty result;
columns other than key and vector are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Pivots at most; they are collected.
MOST_PIVOTS = 256
BLOCK_ROWS = 4096
QUERY_ROWS = 32_768
STEP_ROWS = 512
SCALE = 1024
K = 10


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantize(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component of the usable vectors."""
    rows = vectors.filter(usable(F.col(vector))).filter(F.col(key).isNotNull())
    return rows.select(F.col(key).alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(values.value_lengths())
    out = np.zeros((len(values), width), dtype=np.int64)
    if len(sizes):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles (and their fast library) where these can hold every partial sum."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class Pivots:
    """Collected pivots, with distances and angles to them."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors.astype(np.float64)
        self.norm = np.linalg.norm(self.vectors, axis=1)

    def inner(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(norms of v, products with every pivot)."""
        x = v.astype(np.float64)
        return np.linalg.norm(x, axis=1), x @ self.vectors.T

    def angles(self, norms: np.ndarray, inner: np.ndarray) -> np.ndarray:
        size = norms[:, None] * self.norm[None, :]
        return np.arccos(np.clip(np.divide(inner, size, out=np.ones_like(inner), where=size > 0), -1.0, 1.0))


class Summaries:
    """What is known of each cell, and the bounds that follow from it."""

    def __init__(self, pivots: Pivots, rows: list) -> None:
        self.pivots = pivots
        self.cell = np.array([r.cell for r in rows], dtype=np.int64)
        self.n = np.array([r.n for r in rows], dtype=np.int64)
        self.radius, self.angle, self.least, self.most = (np.array([getattr(r, c) for r in rows], dtype=np.float64) for c in ("radius", "angle", "least", "most"))

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each row of v with the members of each cell."""
        norms, inner = self.pivots.inner(v)
        angles = self.pivots.angles(norms, inner)[:, self.cell]
        by_ball = inner[:, self.cell] + norms[:, None] * self.radius[None, :]
        cosine = np.cos(np.maximum(0.0, angles - self.angle[None, :]))
        by_cone = norms[:, None] * np.where(cosine >= 0, self.most[None, :], self.least[None, :]) * cosine
        return np.minimum(by_ball, by_cone) + 1.0 + 1e-9 * norms[:, None] * (self.most + self.radius + self.pivots.norm[self.cell])[None, :]

    def best(self, v: np.ndarray, k: int) -> list[np.ndarray]:
        """For each row the places of its best pivots' cells, as many as hold more than k rows together."""
        order = np.argsort(-self.pivots.inner(v)[1][:, self.cell], axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1)
        return [row[: int(np.searchsorted(h, k, side="right")) + 1] for row, h in zip(order, held, strict=True)]


def summarized(vectors: DataFrame, key: str, vector: str, scale: int, pivots: int | None) -> tuple[DataFrame, Summaries | None, int]:
    """(row, id, v, cell) of all usable rows, the summaries of the cells, and the width.

    Sent to the driver: at most MOST_PIVOTS vectors and five numbers for each of them.
    """
    data = durable(quantize(vectors, key, vector, scale).withColumn("row", F.monotonically_increasing_id()), "knn-vectors")
    width, rows = data.agg(F.max(F.size("v")), F.count("*")).first()
    if not rows:
        return data.withColumn("cell", F.lit(0)), None, 0
    number = pivots or max(1, min(MOST_PIVOTS, math.isqrt(rows)))
    chosen = data.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(number).collect()
    found = Pivots(_matrix(pa.array([r.v for r in chosen], type=pa.list_(pa.int64())), width))

    @F.arrow_udf("struct<cell:int,d:double,angle:double,norm:double>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            norms, inner = found.inner(_matrix(batch, width))
            square = norms[:, None] ** 2 + found.norm[None, :] ** 2 - 2 * inner
            at = square.argmin(axis=1) if len(norms) else np.zeros(0, dtype=np.int64)
            each = np.arange(len(norms))
            columns = [at.astype(np.int32), np.sqrt(np.maximum(square[each, at], 0.0)), found.angles(norms, inner)[each, at], norms]
            yield pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["cell", "d", "angle", "norm"])

    placed = durable(data.select("row", "id", "v", place(F.col("v")).alias("p")).select("row", "id", "v", "p.*"), "knn-cells")
    about = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"), F.max("angle").alias("angle"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    return placed.select("row", "id", "v", "cell"), Summaries(found, about.orderBy("cell").collect()), width


def _cells(summaries: Summaries, width: int, k: int, v: Column, floor: Column | None = None) -> Column:
    """Column of the cells that a query meets: first its best ones, then, given its floor, the others that reach it."""

    @F.arrow_udf("array<int>")
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([summaries.cell[row].tolist() for row in summaries.best(_matrix(batch, width), k)], type=pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def rest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, floors in batches:
            q = _matrix(batch, width)
            least = np.array([float("-inf") if x is None else float(x) for x in floors.to_pylist()])
            open_ = summaries.bounds(q) >= least[:, None]
            for row, done in zip(open_, summaries.best(q, k), strict=True):
                row[done] = False
            yield pa.array([summaries.cell[row].tolist() for row in open_], type=pa.list_(pa.int32()))

    return first(v) if floor is None else rest(v, floor)


def _solved(wanted: DataFrame, placed: DataFrame, summaries: Summaries, width: int, k: int, block_rows: int, query_rows: int) -> DataFrame:
    """(query_row, query_id, id, score): the k best of each block for each wanted (query_row, query_id, q, cell)."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    told = "query_row long, query_id long, id long, score long"
    parts = {r.cell: -(-r.n // query_rows) for r in wanted.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not parts:
        return wanted.sparkSession.createDataFrame([], told)
    blocks = {int(c): -(-int(n) // block_rows) for c, n in zip(summaries.cell, summaries.n, strict=True)}
    n_blocks, n_parts = (F.create_map(*(F.lit(x) for pair in d.items() for x in pair)) for d in (blocks, parts))
    asked = wanted.withColumn("part", F.pmod(F.xxhash64("query_row"), n_parts[F.col("cell")]).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks[F.col("cell")] - 1)))
    held = placed.filter(n_parts[F.col("cell")].isNotNull()).withColumn("block", F.pmod(F.xxhash64("row"), n_blocks[F.col("cell")]).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts[F.col("cell")] - 1)))

    def solve(asked_rows: pa.Table, held_rows: pa.Table) -> pa.Table:
        if not asked_rows.num_rows or not held_rows.num_rows:
            return schema.empty_table()
        ids, own, c = held_rows.column("id").to_numpy(), held_rows.column("row").to_numpy(), _matrix(held_rows.column("v").combine_chunks(), width)
        order = np.argsort(ids, kind="stable")
        ids, own, c = ids[order], own[order], c[order]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for start in range(0, asked_rows.num_rows, STEP_ROWS):
            step = asked_rows.slice(start, STEP_ROWS)
            score = products(_matrix(step.column("q").combine_chunks(), width), c)
            for row, name, s in zip(step.column("query_row").to_numpy(), step.column("query_id").to_numpy(), score, strict=True):
                free = own != row
                theirs, s = ids[free], s[free]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    above = np.flatnonzero(s > least)
                    best = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
                else:
                    best = np.arange(len(s))
                for x, y in zip(out, (np.full(len(best), row), np.full(len(best), name), theirs[best], s[best]), strict=True):
                    x.append(y)
        return pa.Table.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], schema=schema)

    return asked.groupBy("cell", "block", "part").cogroup(held.groupBy("cell", "block", "part")).applyInArrow(solve, told)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def searched(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, pivots: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, scale: int = SCALE) -> tuple[DataFrame, DataFrame, int]:
    """The k best rows of each query, the (query, cell) pairs that were solved, and how many such pairs there are."""
    spark = vectors.sparkSession
    placed, summaries, width = summarized(vectors, key, vector, scale, pivots)
    pairs = spark.createDataFrame([], "query_row long, query_id long, q array<long>, cell int")
    if summaries is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long"), pairs, 0
    queries = placed.filter(is_query).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    one = durable(queries.withColumn("cell", F.explode(_cells(summaries, width, k, F.col("q")))), "knn-first-queries")
    near = durable(_best(_solved(one, placed, summaries, width, k, block_rows, query_rows), k), "knn-first")
    floors = near.filter(F.col("rank") == k).select("query_row", F.col("score").alias("floor"))
    two = queries.join(floors, "query_row", "left")
    two = durable(two.select("query_row", "query_id", "q", F.explode(_cells(summaries, width, k, F.col("q"), F.col("floor"))).alias("cell")), "knn-more-queries")
    more = _solved(two, placed, summaries, width, k, block_rows, query_rows)
    found = _best(near.drop("rank").unionByName(more), k).select("query_id", "rank", "id", "score")
    return found, one.unionByName(two), queries.count() * len(summaries.cell)


def top_k(vectors: DataFrame, is_query: Column, **options) -> DataFrame:
    """(query_id, rank, id, score): the k largest integer inner products of each row where is_query holds (a condition on the id); options as of searched()."""
    return searched(vectors, is_query, **options)[0]
