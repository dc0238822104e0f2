"""Queries of the job, chat and retrieval store: paging, latest rows, visibility, upserts, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import cosine


def page(df: DataFrame, order: list[Column], limit: int, offset: int, most: int = 100) -> DataFrame:
    """One page of df with the exact number of rows as `total`. The rows come from a top-k, the total from its own aggregate."""
    limit = min(max(limit, 1), most)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key, numbered from the newest."""
    newest = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("newest", F.row_number().over(newest)).filter(F.col("newest") <= n)


def visible(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, owner: Column) -> DataFrame:
    """Rows whose parent belongs to the owner."""
    return rows.join(parents.filter(owner).select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def insert_new(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of incoming that a unique index on keys lets in: null keys never conflict, of equal ones the first wins."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    fresh = incoming.filter(complete).join(target.select(*keys).distinct(), keys, "left_anti")
    first = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.unionByName(incoming.filter(~complete))


def vector_top_k(chunks: DataFrame, documents: DataFrame, query: list[float], agent: Column, k: int) -> DataFrame:
    """The k chunks of an agent nearest to a query vector by cosine, with their documents. Ties go to the smaller id."""
    near = chunks.filter(agent & F.col("embedding").isNotNull())
    scored = near.withColumn("score", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))))
    return scored.join(documents, scored["vec_id"] == documents["doc_id"]).orderBy(F.desc("score"), "vec_id").limit(k)


def stale(jobs: DataFrame, now: Column, minutes: int, running: tuple[str, ...]) -> DataFrame:
    """jobs with status and error as a sweep leaves them: running rows idle for longer than `minutes` are errors."""
    idle = F.col("status").isin(*running) & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumns({"error": F.when(idle, "PIPELINE_INTERRUPTED"), "status": F.when(idle, "error").otherwise(F.col("status"))})
