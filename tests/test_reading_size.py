"""Lines are prepared once for schema-driven reading, and meet what their document lacks before any word is looked for."""

from pyspark.sql import functions as F

from docloom.operators import fields as R
from docloom.operators import profiles as P
from docloom.plans import fields as S
from docloom.plans import profiles as Q

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_schema_are_prepared_once(spark):
    # The table of orders is read for what is asked only (four kinds of rows, twice): its lines were rendered and written before.
    for df in (S.sx_best(spark, DIR), S.sx_document(spark, DIR)):
        assert plan(df).count("orders.parquet") <= 8


def test_a_number_without_its_label_tells_of_open_fields_only(spark):
    lines = spark.createDataFrame([(1, 0, "Total : 250", 0.9, 0.0, 0.0, 80.0, 12.0), (1, 1, "77", 0.9, 0.0, 900.0, 16.0, 12.0), (2, 0, "x 77", 0.9, 0.0, 0.0, 32.0, 12.0), (3, 0, "x", 0.9, 0.0, 0.0, 8.0, 12.0)], "doc_id long, line_idx int, text string, conf double, x double, y double, width double, height double")
    asked = spark.createDataFrame([(d, "total_amount", "77") for d in (1, 2, 3)], "doc_id long, key string, expected string")
    got = {r.doc_id: (r.state, r.value, r.reason) for r in R.classified(lines, {"total_amount": ["total"]}, asked).collect()}
    assert got == {1: ("UNCERTAIN", "250", "value_mismatch_expected"), 2: ("UNCERTAIN", "77", "value_without_label"), 3: ("MISSING", None, "")}


def test_only_lacking_fields_are_looked_for(spark):
    text = plan(P.recovery(Q.REGISTRY, Q.lines(spark, DIR), Q.missing(spark, DIR)))
    assert "Generate explode" not in text and "RLIKE" in text.upper()
    lines = spark.createDataFrame([(1, 0, "Date : 01-02-2024 Total 5", None), (1, 1, "Total 7", 0.5), (2, 0, "Total 9", None)], "doc_id long, line_idx int, text string, ocr double")
    wanted = spark.createDataFrame([(1, "total_amount", "currency"), (2, "invoice_date", "date")], "doc_id long, key string, type string")
    got = P.recovery(Q.REGISTRY, lines, wanted).select("doc_id", "key", "line_idx", "value", F.round("confidence", 3)).collect()
    assert sorted(map(tuple, got)) == [(1, "total_amount", 0, "5", 0.49), (1, "total_amount", 1, "7", 0.35)]


def test_terms_of_regions_are_rounded_in_their_array(spark):
    from docloom.plans import layout as L

    shown = next(line for line in plan(L.rc_explain(spark, DIR)).splitlines() if "Generate explode" in line)
    assert "lambdafunction" in shown and "round(" in shown and shown.count("round(") == 1


def test_regions_of_a_page_are_made_once(spark):
    from docloom.plans import rescue as Q

    shown = plan(Q.pr_plan(spark, DIR))
    assert "size(concat(" not in shown and shown.count("full_page") == 1


def test_every_node_has_its_neighbours_in_both_directions(spark):
    from docloom.plans import layout as L

    nodes = L.nodes(spark, DIR).select("doc_id", "id", "parent").cache()
    held = nodes.groupBy("doc_id", F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    want = nodes.join(held, ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("n", F.lit(0)).alias("c"), F.col("parent").isNotNull().cast("long").alias("p"))
    want = want.select("doc_id", "id", (F.col("c") + F.col("p")).alias("neighbors"), (2 * F.col("c")).alias("outgoing"), (2 * F.col("p")).alias("incoming"), F.col("c").alias("children"), F.col("p").alias("parents"))
    got = L.sg_queries(spark, DIR).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_numbers_are_found_with_their_separators(spark):
    from docloom.operators import grounding as G

    fields = spark.createDataFrame([(1, "total_amount", "currency", "1234567"), (1, "tax_rate", "number", "14.0004"), (1, "notes", "text", "9"), (2, "total_amount", "currency", " ")], "doc_id long, key string, type string, raw string")
    lines = spark.createDataFrame([(1, 0, "Total : 1,234,567 EGP", 0.5), (1, 1, "rate 14 and 9", 0.5), (2, 0, "0", 0.5)], "doc_id long, line_idx int, text string, ocr double")
    got = G.printed_numbers(fields, lines).select("key", "line_idx", "start", "end", "role").collect()
    assert sorted(map(tuple, got)) == [("tax_rate", 1, 1, 1, "derived"), ("total_amount", 0, 2, 2, "derived")]
