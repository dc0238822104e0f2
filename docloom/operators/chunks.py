"""Retrieval chunks: paragraphs folded to a size with overlap, long runs cut at sentence ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, OVERLAP, SEARCH = 800, 150, 100
HARD = SIZE * 3 // 2


def prepared(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(prepared(text), r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def split_point(text: Column) -> Column:
    """Characters before the cut: after a sentence end near SIZE, else after a newline, else after the last space, else SIZE."""
    start = SIZE - SEARCH
    region = F.substring(text, start + 1, 2 * SEARCH)
    sentence = F.regexp_instr(region, F.lit(r"[.!?]\s"))
    newline = F.instr(region, "\n")
    space = F.char_length(F.regexp_extract(region, r"(?s)^(.*) ", 1)) + 1
    return F.when(sentence > 0, start + sentence + 1).when(newline > 0, start + newline).when(F.instr(region, " ") > 0, start + space).otherwise(SIZE)


def _cut_while_long(state: Column, most: Column) -> Column:
    """Cut chunks off the current text while it is longer than HARD; `most` bounds the number of cuts."""

    def step(a: Column, _: Column) -> Column:
        at = split_point(a["now"])
        long = F.char_length(a["now"]) > HARD
        part = F.trim(F.substring(a["now"], F.lit(1), at))
        rest = F.substring(a["now"], F.greatest(F.lit(0), at - OVERLAP) + 1, F.char_length(a["now"]))
        return F.struct(F.when(long, F.concat(a["done"], F.array(part))).otherwise(a["done"]).alias("done"), F.when(long, rest).otherwise(a["now"]).alias("now"))

    return F.aggregate(F.sequence(F.lit(0), most), state, step)


def chunks(text: Column) -> Column:
    """Array of the chunks of a text. A fold over paragraphs; no step looks back further than the text it carries."""
    whole = prepared(text)
    most = (F.char_length(whole) / (SIZE - SEARCH - OVERLAP)).cast("int") + 1
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(a: Column, p: Column) -> Column:
        full = (F.char_length(a["now"]) + F.char_length(p) + 2 > SIZE) & (a["now"] != "")
        done = F.when(full, F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"])
        now = F.when(full, F.concat(F.right(a["now"], F.lit(OVERLAP)), F.lit("\n\n"), p)).when(a["now"] != "", F.concat(a["now"], F.lit("\n\n"), p)).otherwise(p)
        return _cut_while_long(F.struct(done.alias("done"), now.alias("now")), most)

    folded = F.aggregate(paragraphs(text), start, add, lambda a: F.when(F.trim(a["now"]) != "", F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"]))
    return F.when(F.char_length(whole) == 0, F.array().cast("array<string>")).when(F.char_length(whole) <= SIZE, F.array(whole)).otherwise(folded)
