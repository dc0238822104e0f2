"""JSON in model replies: fences off, the outer value found, trailing commas repaired."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_fences(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^```(json)?\s*", ""), r"\s*```$", ""))


def balanced(text: str) -> str | None:
    """The first bracketed value that closes, strings skipped; brackets that never close are passed over."""
    start = 0
    while True:
        start = next((k for k in range(start, len(text)) if text[k] in "{["), -1)
        if start < 0:
            return None
        depth, quoted, k = 0, False, start
        while k < len(text):
            c = text[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if depth == 0:
                    return text[start : k + 1]
            k += 1
        start += 1


def outer(s: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else balanced(x) for x in batch.to_pylist()], type=pa.string())

    return run(s)


def repair(reply: Column) -> Column:
    """Variant of the reply's value: as it is, else its outer value, else that without trailing commas."""
    body = strip_fences(reply)
    found = outer(body)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(found), F.try_parse_json(F.regexp_replace(found, r",\s*([}\]])", "$1")))
