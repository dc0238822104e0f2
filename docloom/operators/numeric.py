"""Numeric words and their verification against a second reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T


def standalone_tokens(words: DataFrame, least_digits: int = 8) -> DataFrame:
    """words with standalone: a long digit run that ends its line, stands beside a colon, or has at most one neighbour."""
    line = Window.partitionBy("doc_id", "line_idx")
    at = line.orderBy("word_idx")
    near = words.withColumns({"_prev": F.lag("text").over(at), "_next": F.lead("text").over(at), "_n": F.count("*").over(line)})
    n = T.count(F.col("text"), "[0-9]")
    placed = F.col("_next").isNull() | (F.col("_prev") == ":") | (F.col("_next") == ":") | (F.col("_n") <= 2)
    digits = (n >= least_digits) & (n / F.char_length("text") >= 0.85) & (T.count(F.col("text"), "[^0-9.,:/-]") <= 3)
    return near.withColumn("standalone", digits & F.coalesce(placed, F.lit(False))).drop("_prev", "_next", "_n")
