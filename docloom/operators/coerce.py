"""Typed reading of raw strings by a declared type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def coerce(df: DataFrame, raw: str, kind: str, allowed: list[str]) -> DataFrame:
    """df with number, string and flag: the value in the column of its type, null where it can't be read."""
    s, t = F.col(raw), F.col(kind)
    plain = F.nullif(T.trim_space(s), F.lit(""))
    return df.withColumns(
        {
            "number": F.when(t.isin("number", "currency"), T.to_number(s)),
            "string": F.when(t == "date", T.to_date(s)).when(t == "enum", T.to_enum(s, allowed)).when(t.isin("string", "text"), plain),
            "flag": F.when(t == "boolean", T.to_boolean(s)),
        }
    )
