"""Queries of Arabic repair (inventory 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import arabic as A
from docloom.operators.rescue import shared_words
from docloom.registry import query
from docloom.sources.tables import fixture


def scanned(spark, sf_dir):
    """Lines, and words with a confidence each; some lines run from right to left, some words have no box or confidence."""
    lines = fixture(spark, sf_dir, "arabic_lines")
    d, n, k = F.col("doc_id"), F.col("line_idx"), F.col("word_idx")
    mirrored = (d + n) % 3 == 0
    w = shared_words(lines).withColumns({"x": F.when((d + n) % 13 != 0, F.when(mirrored, 900 - F.col("x")).otherwise(F.col("x"))), "conf": F.when((d + n * 3 + k) % 11 != 0, (60 + (d * 3 + n * 7 + k * 11) % 40) / 100.0)})
    return lines, w


@query("ar_repair")
def ar_repair(spark, sf_dir):
    """Every change of the repair, in order."""
    return A.repaired(scanned(spark, sf_dir)[1])[1]


@query("ar_reconstruct")
def ar_reconstruct(spark, sf_dir):
    """Lines with their words in reading order."""
    w = A.reordered(scanned(spark, sf_dir)[1], A.LINE)
    return w.groupBy(*A.LINE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), " ").alias("text"))


@query("ar_post_process")
def ar_post_process(spark, sf_dir):
    out = A.post_processed(*scanned(spark, sf_dir))[0]
    numbers = ("conf", "x", "y", "width", "height", "arabic_ratio", "noise_score")
    return out.select("doc_id", "line_idx", "source_line", "text", "original", "repaired", *(F.round(n, 6).alias(n) for n in numbers), F.array_join("reasons", ",").alias("reasons"))
