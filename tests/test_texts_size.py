"""Texts are cleaned at a cost that long runs and wide character classes don't drive up, with the same results."""

import random

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import grounding as G
from docloom.plans import text as Q

DIR = "/root/testdata/sf0.001"
WIDE = f"{T.SPACE}+"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_messages_are_not_searched_by_pattern_and_dealt_over_tasks(spark):
    shown = plan(Q.validators(spark, DIR))
    assert "Exchange" in shown and "message#" in shown
    assert not [line for line in shown.splitlines() if "regexp_replace" in line or "RLIKE(message" in line]


def test_blank_and_trimmed_texts(spark):
    texts = ["", " ", "\t\n ", "　﻿ ", "x", " x ", "  x y \n", " é ", " " * 10000, "x" * 10000, " " * 5000 + "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    wide = F.regexp_replace("s", f"^{WIDE}|{WIDE}$", "")
    rows = df.select(T.trim_space(F.col("s")).alias("a"), wide.alias("b"), T.is_blank(F.col("s")).alias("blank")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert [r.blank for r in rows] == [r.b and False if r.b is None else r.b == "" for r in rows]


def test_ascii_texts_have_the_same_normal_form(spark):
    rnd = random.Random(5)
    parts = ["A", "b", "9", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\f", "\x1c", "-", "٣", "۴", "إ", "ـ", "‎", " ", " ", "É"]
    texts = ["".join(rnd.choice(parts[: rnd.choice([12, 12, len(parts)])]) for _ in range(rnd.randrange(12))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    flat = F.regexp_replace(F.regexp_replace(T.unify_digits(F.col("s")), T.BIDI, ""), WIDE, " ")
    label = F.lower(F.trim(F.regexp_replace(F.regexp_replace("s", T.BIDI, ""), WIDE, " ")))
    rows = df.select(T.normalize(F.col("s")).alias("a"), T.fold_arabic(F.lower(F.trim(flat))).alias("b"), G.label_text(F.col("s")).alias("c"), label.alias("d"), T.strip_bidi(F.col("s")).alias("e"), F.regexp_replace("s", T.BIDI, "").alias("f")).collect()
    assert [(r.a, r.c, r.e) for r in rows] == [(r.b, r.d, r.f) for r in rows]
