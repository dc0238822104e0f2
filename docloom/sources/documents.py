"""Documents to lines and words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SPACE


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_idx, text): a row for each line."""
    return docs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_idx", "text"))


def words(of_lines: DataFrame) -> DataFrame:
    """The lines' columns but the text, and (word_idx, text) for each word."""
    parts = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    return of_lines.select(*(c for c in of_lines.columns if c != "text"), F.posexplode(parts).alias("word_idx", "text"))
