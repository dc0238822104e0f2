"""Fields meet lines without a broadcast, without windows over all pairs, and without going over candidates or scores again."""

from pyspark.sql import functions as F

from docloom.operators import claims as C
from docloom.operators import grounding as G
from docloom.operators import profiles as P
from docloom.plans import fields as S
from docloom.plans import grounding as Q

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_and_lines_are_not_broadcast(spark):
    for df in (Q.derived_evidence(spark, DIR), Q.verify_separator_free(spark, DIR), Q.primary(spark, DIR)):
        assert "Broadcast" not in plan(df)
    dates = plan(Q.derived_evidence(spark, DIR))
    assert dates.index("Generate") < dates.index("SortMergeJoin")  # forms are made rows after the join


def test_spans_of_references(spark):
    rows = [("no 12-34 ab", "1234"), ("12 34", "12-34"), ("1234 5", "1234"), ("x 12345", "1234"), ("none", "none"), (None, "12"), ("12", None), ("ab 12 34 cd", "ab1234")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, line string, needle string")
    found = df.select("k", G.separator_free_span(F.split("line", " "), F.col("needle")).alias("s")).orderBy("k").collect()
    assert [r.s and (r.s.start, r.s.end) for r in found] == [(0, 1), (0, 1), (0, 0), None, None, None, None, (0, 2)]


def test_ladder_has_no_window_over_pairs(spark):
    assert "Window" not in plan(S.sx_ladder(spark, DIR))


def test_outranked_reads_scores_once(spark):
    scores = spark.createDataFrame([(1, "a", "x", 0.5), (1, "a", "y", 0.9), (1, "b", "x", 0.7), (1, "b", "y", 0.7)], "doc_id long, id string, type string, score double")
    claimed = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "c", "x"), (1, "a", "unknown"), (1, "a", "z")], "doc_id long, id string, type string")
    df = C.outranked(scores, claimed)
    assert sum("Join" in line for line in plan(df).splitlines()) == 1
    assert [tuple(r) for r in df.collect()] == [(1, "a")]


def test_recovered_values_are_looked_for_where_they_may_be(spark):
    found = spark.createDataFrame([(1, "k", "v1", 0.4, True), (2, "k", "no", 0.4, False), (3, "k", "there", 0.3, False), (3, "k", "there", 0.5, False), (4, "k", "a", 0.4, True), (4, "k", "b", 0.4, False)], "doc_id long, key string, value string, confidence double, own boolean")
    lines = spark.createDataFrame([(1, "x"), (2, "x"), (3, "It is THERE"), (3, "there again"), (4, "a b")], "doc_id long, text string")
    want = [(1, "k", "flagged", "v1", 0.4, ["v1"]), (3, "k", "flagged", "there", 0.5, ["there"]), (4, "k", "ambiguous", None, 0.0, ["a", "b"])]
    assert sorted(map(tuple, P.recovered(found, lines).collect())) == want
    told = P.recovered(found.drop("own"), lines.unionByName(spark.createDataFrame([(1, "v1.")], "doc_id long, text string")))
    assert sorted(map(tuple, told.collect())) == want
