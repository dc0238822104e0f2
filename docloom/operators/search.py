"""Exact cosine top-k of a query set against all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
FOUND = "query_id long, vec_id long, score double"


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in vectors.to_pylist()]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def top_cosine(queries: DataFrame, data: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank) from queries (query_id, v) and data (vec_id, v); a row isn't its own neighbour.

    Both sides are cut into blocks of about BLOCK rows by hash; every pair of blocks is one product of matrices in one
    task, which gives on k rows a query. Scores are rounded before they are ranked; ties go to the smaller id.
    """
    n_q, n_d = (max(1, -(-df.count() // BLOCK)) for df in (queries, data))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_d - 1).cast("long"))))
    held = data.withColumn("db", F.pmod(F.xxhash64("vec_id"), F.lit(n_d))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        order = np.argsort(b.column("vec_id").to_numpy(), kind="stable")
        ids, asks = b.column("vec_id").to_numpy()[order], a.column("query_id").to_numpy()
        scores = np.round(_unit(a.column("v")) @ _unit(b.column("v"))[order].T, decimals)
        scores[asks[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(scores, best, axis=1)
        keep = np.isfinite(top)
        return pa.Table.from_arrays([pa.array(np.repeat(asks, best.shape[1])[keep.ravel()]), pa.array(ids[best][keep]), pa.array(top[keep])], schema=schema)

    found = asked.groupBy("qb", "db").cogroup(held.groupBy("qb", "db")).applyInArrow(solve, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
