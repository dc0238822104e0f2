"""The few functions that no native expression covers, as Arrow functions over whole batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, fold_arabic, unify_digits

INVISIBLE = r"[\x{ad}\x{61c}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]"


def nfkc(s: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in batch.to_pylist()], type=pa.string())

    return run(s)


def normalize_arabic(s: Column) -> Column:
    """Compatibility forms, invisible characters, letter variants, separators and digits to their plain form."""
    plain = F.translate(fold_arabic(F.regexp_replace(nfkc(s), INVISIBLE, "")), "٫٬", ".,")
    return unify_digits(F.trim(F.regexp_replace(plain, f"{SPACE}+", " ")))
