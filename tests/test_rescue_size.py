"""The rescue pass deals its rows once: plans without further exchanges, arrays against tables of words, folded readings against pointers."""

import re

from pyspark.sql import functions as F

from docloom.operators import grounding as G
from docloom.operators import rescue as R
from docloom.plans import rescue as Q
from docloom.sources import dimensions as D
from docloom.sources.tables import fixture

DIR = "/root/testdata/sf0.001"


def dealt(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_lines_and_readings_are_dealt_once(spark):
    assert dealt(Q.nv_detect(spark, DIR)) == 1  # the pages' lines
    assert dealt(Q.pr_evidence(spark, DIR)) == 1
    assert dealt(Q.pr_plan(spark, DIR)) == 1
    assert dealt(Q.pr_bucket_lines(spark, DIR)) == 1  # the orders
    assert dealt(Q.pr_pair(spark, DIR)) == 1


def test_own_words_are_those_of_the_table(spark):
    lines, words = Q.scans(spark, DIR)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(R.detected(lines)) == rows(R.detected(lines, words.repartition(3)))
    odd = spark.createDataFrame([(1, 0, None, 0.5, 0.0, 0.0, 9.0, 9.0), (1, 1, " ", 0.5, 0.0, 0.0, 9.0, 9.0), (1, 2, "Total 1234567890", None, None, 0.0, 9.0, 9.0), (1, 3, "98765432 x", None, 0.0, 5.0, 9.0, 9.0)], "doc_id long, line_idx int, text string, conf double, x double, y double, width double, height double")
    assert [(r.line_idx, r.text, r.conf, r.place) for r in R.detected(odd).collect()] == [(3, "98765432", None, 1)]
    assert R.shared_words(odd).count() == 4


def test_folded_readings_equal_pointers(spark):
    items = fixture(spark, DIR, "rereads").filter("x is not null and confidence > 0 and doc_id < 300")
    rows = lambda most: {(r.doc_id, r.region, r.item): (r.bucket, r.row) for r in R.bucketed(items, ["doc_id", "region"], most).collect()}
    assert rows(512) == rows(4) and len(rows(512)) > 5000
    assert R.bucketed(items.filter("false"), ["doc_id", "region"]).count() == 0


def test_labels_of_plain_and_other_lines(spark):
    texts = ["", "123.45", "TOTAL 12", "x", *(w for w, _ in D.labels_by_length()), *(f"é {w}1" for w, _ in D.labels_by_length()), None]
    want = [next((g for w, g in D.labels_by_length() if w in t.lower()), None) if t is not None else None for t in texts]
    assert [r.g for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", G.label_group(F.col("t")).alias("g")).orderBy("k").collect()] == want
