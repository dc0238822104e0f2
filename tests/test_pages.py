"""Steps that go page by page: what they move, what they find on pages of either size, and what repeated rows don't change."""

import random

import pytest
from pyspark.sql import functions as F

from docloom import registry
from docloom.operators import graphs as V
from docloom.operators import layout as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["blk_density", "hier_build", "hier_order", "lev_evidence", "lr_reader", "sg_derive", "sg_queries", "lay_pipeline", "blk_spacing", "seg_grow"])
def test_pages_are_dealt_twice_at_most(spark, small, name):
    """The boxes once, and the pages as arrays once after their groups are known; no joins."""
    p = plan(registry.queries()[name](spark, small))
    assert p.count("Exchange ") <= 2 and "Join" not in p


def pages(spark):
    rnd = random.Random(5)
    rows = []
    for doc in range(40):
        for line in range(rnd.randrange(1, 9)):
            for word in range(rnd.randrange(1, 5)):
                rows.append((doc, line, word, float(rnd.randrange(300)), float(20 * line + rnd.randrange(9)), float(rnd.randrange(5, 60)), float(rnd.randrange(8, 14))))
    return spark.createDataFrame(rows, "doc_id long, line_idx int, word_idx int, x double, y double, width double, height double")


def test_large_pages_are_grouped_as_small_ones(spark, monkeypatch):
    words = pages(spark)
    whole = {tuple(r) for r in L.blocks(words).collect()}
    of_blocks = L.union_box(L.blocked(words), ["doc_id", "block"]).localCheckpoint()
    near = {tuple(r) for r in L.regions(of_blocks).collect()}
    monkeypatch.setattr(L, "PAGE_BOXES", 6)
    assert {tuple(r) for r in L.blocks(words).collect()} == whole and len(whole) == words.count()
    assert {tuple(r) for r in L.regions(of_blocks).collect()} == near and len({r[:2] for r in near}) == of_blocks.count()


def test_blocks_are_not_made_to_be_counted(spark, monkeypatch):
    """With their words, blocks are not run before they are asked for, unless a page has many words."""
    words = pages(spark)
    of_blocks = L.union_box(L.blocked(words), ["doc_id", "block"]).localCheckpoint()
    near = {tuple(r) for r in L.regions(of_blocks).collect()}
    L.regions(of_blocks.withColumn("x", F.raise_error(F.lit("run too early")).cast("double")), words)
    assert {tuple(r) for r in L.regions(of_blocks, words).collect()} == near
    monkeypatch.setattr(L, "PAGE_BOXES", 6)
    assert {tuple(r) for r in L.regions(of_blocks, words).collect()} == near


def test_pairs_of_a_batch_are_taken_in_parts(spark, monkeypatch):
    words = pages(spark)
    whole = {tuple(r) for r in L.blocks(words).collect()}
    monkeypatch.setattr(L, "MOST_PAIRS", 50)
    assert {tuple(r) for r in L.blocks(words).collect()} == whole


def test_repeated_parents_count_by_their_largest_box(spark):
    """which row of a repeated id counted was left to how rows were dealt."""
    rows = [(1, "w", "w", 1, 0.0, 0.0, 700.0, 9.0), (1, "w", "l", 1, 0.0, 0.0, 30.0, 9.0)]
    for given in (rows, rows[::-1]):
        nodes = spark.createDataFrame(given, "doc_id long, id string, parent string, page int, x double, y double, width double, height double").coalesce(1)
        assert V.outside_parent(nodes).count() == 0


def test_values_are_told_whether_they_match(spark, small):
    """pairs that aren't equal were left out."""
    told = {r["equal"] for r in registry.queries()["sx_values_match"](spark, small).select("equal").distinct().collect()}
    assert told == {True, False}


def test_cycles_pass_to_python_in_batches(spark):
    rows = [(d, a, b, s, o) for d in range(50) for a, b, s, o in (("a", "b", 0.5, 1), ("b", "c", 0.4, 2), ("c", "a", 0.3 if d % 2 else 0.6, 3))]
    e = spark.createDataFrame(rows, "doc_id long, from_id string, to_id string, score double, ord int")
    out = V.cycle_breakers(e, F.lit(None).cast("int"))
    assert "FlatMapGroups" not in plan(out) and "FlatMapGroups" not in plan(V.ordered(e))
    assert {tuple(r) for r in out.collect()} == {(d, "c", "a", 3) if d % 2 else (d, "b", "c", 2) for d in range(50)}
    assert V.cyclic_nodes(e).count() == 150


def test_differing_counts_repeated_rows_of_a_page(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "doc_id long, id string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "q")], "doc_id long, id string")
    assert tuple(V.differing(a, b).first()) == (4, 4) and tuple(V.differing(a, a).first()) == (4, 0)
