"""Candidate joins against all pairs: quotes in texts, labels and values of any height, equal values."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import fields as R
from docloom.operators.quotes import holding

SHEET = "doc_id long, line_idx int, text string, conf double, x double, y double, width double, height double"


def folded(s):
    return " ".join(s.lower().split())


def test_quotes_of_any_length_are_found_in_texts_of_any_form(spark):
    rnd = random.Random(8)
    words = ["ab", "abc", "bca", "cab", "a", "b", "longerword", "é", "x" * 30]
    texts = [(k, rnd.choice([" ", "  ", "\n"]).join(rnd.choices(words, k=rnd.randint(0, 25)))) for k in range(300)]
    texts += [(900, "".join(random.Random(1).choices("abcdefgh", k=100_000))), (901, ""), (902, None), (None, "ab abc"), (5, "Ab  ABC bca a")]
    quotes = []
    for n in range(250):
        t = folded(rnd.choice(texts[:300])[1])
        at = sorted(rnd.choices(range(len(t) + 1), k=2))
        quotes.append((n, t[at[0] : at[1]] if n % 5 else " ".join(rnd.choices(words, k=rnd.randint(1, 9)))))
    quotes += [(900, texts[300][1][50_000:50_020]), (901, texts[300][1][-3:]), (902, ""), (903, None), (904, "  AB   abc ")]
    got = holding(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "q long, quote string"))
    found = sorted((r.doc_id, r.q) for r in got.collect())
    want = sorted((k, q) for k, t in texts for q, s in quotes if k is not None and t is not None and s is not None and folded(s) and folded(s) in folded(t))
    assert found == want and (900, 900) in want and len(want) > 1000
    assert holding(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(quotes, "q long, quote string")).count() == 0
    assert holding(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "q long, quote string")).count() == 0


def level(a, b):
    over = max(0.0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
    return abs(a[5] + a[7] / 2 - b[5] - b[7] / 2) <= 24 or over >= 0.5 * min(a[7], b[7])


@pytest.mark.parametrize("tall", [False, True])
def test_labels_meet_values_of_any_height(spark, tall):
    rnd = random.Random(3)
    lines = []
    for d in range(30):
        for k in range(20):
            label = rnd.random() < 0.4
            height = rnd.choice([5.0, 12.0, 100.0, 400.0, 1000.0]) if tall else 12.0
            lines.append((d, k, "Total due" if label else f"{rnd.randint(10, 99999)} x", 0.9, float(rnd.randint(0, 300)), float(rnd.randint(0, 2000)), 80.0, height))
    asked = spark.createDataFrame([(d, "total", None) for d in range(30)], "doc_id long, key string, expected string")
    got = R.candidates(spark.createDataFrame(lines, SHEET), {"total": ["total"]}, asked)
    found = sorted((r.doc_id, r.label_line, r.value_line, r.alignment) for r in got.filter("alignment <> 'column_below'").collect())
    want = []
    for a in lines:
        for b in lines:
            if a[0] == b[0] and a[2] == "Total due" and b[2] != "Total due":
                below = b[5] - a[5] - a[7]
                want += [(a[0], a[1], b[1], "same_line")] * level(a, b) + [(a[0], a[1], b[1], "adjacent_below")] * (0 <= below <= 48)
    assert found == sorted(want) and len(want) > 50


def test_equal_values_meet_whatever_makes_them_equal(spark):
    values = ["1,200.50", "1200.5", "1200.5000004", "1200.4999996", "999.9999999", "1000", "1000.0000001", "12345678901234567", "12345678901234567.", "abc", "ABC ", "12-3", "123", "", " ", ".", "a1b2", "12"]
    asked = spark.createDataFrame([(1, f"k{n}", v) for n, v in enumerate(values)], "doc_id long, key string, expected string")
    numbers = spark.createDataFrame([(1, n, v) for n, v in enumerate(values)], "doc_id long, line_idx int, token string")
    got = sorted((r.key, r.line_idx) for r in R.matching(asked, numbers).collect())
    every = asked.join(numbers, "doc_id").filter(R.values_match(F.col("expected"), F.col("token")))
    assert got == sorted((r.key, r.line_idx) for r in every.collect()) and len(got) > len(values)


def test_words_known_beforehand_are_normalized_alike(spark):
    words = ["الإجمالي", "المجموع الفرعى", "Ref  No", "٣٤ د.ك", "نهائى", "TAX‎id", "ة ـ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(T.normalize(F.col("w"))).collect()] == [T.plain_normalize(w) for w in words]
    hits = df.select(T.holds_any(T.normalize(F.col("w")), ["a.b", "د.ك", "ref no"]))
    assert [r[0] for r in hits.collect()] == [False, False, True, True, False, False, False]


def page_of(spark, n, seed, wide=0.02):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        big = rnd.random() < wide
        rows.append((1 + k % 2, k, float(rnd.randint(0, 3000)), float(rnd.randint(0, 4000)), float(rnd.choice([0, 20, 40, 60]) if not big else 3000), float(rnd.choice([0, 12, 14]) if not big else rnd.choice([12, 2000]))))
    rows += [(3, 900_001, 5.0, 5.0, 10.0, 10.0), (4, 900_002, 0.0, 0.0, 0.0, 0.0), (4, 900_003, 0.0, 0.0, 0.0, 0.0), (4, 900_004, 50_000.0, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, id long, x double, y double, width double, height double")


@pytest.mark.parametrize("which", ["center", "box"])
def test_nearest_boxes_equal_brute_force(spark, which):
    from docloom.functions import geometry as G
    from docloom.operators import spatial as S

    a, b = G.Box("a_"), G.Box("b_")
    distance = G.center_distance(a, b) if which == "center" else G.box_distance(a, b)
    df = page_of(spark, 900, 4)
    one, two, other = S.named(df, "a_"), S.named(df, "b_"), F.col("a_id") != F.col("b_id")
    got = sorted((r.a_id, r["rank"], r.b_id) for r in S.nearest(one, two, distance, 3, ["a_id"], ["b_id"], other).collect())
    from pyspark.sql import Window

    every = one.join(two, "doc_id").filter(other).withColumn("d", F.round(distance, 6))
    want = every.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("d", "b_id"))).filter("rank <= 3")
    assert got == sorted((r.a_id, r["rank"], r.b_id) for r in want.collect()) and len(got) > 2600


def test_a_page_of_many_boxes_meets_few_candidates(spark):
    from docloom.functions import geometry as G
    from docloom.operators import spatial as S

    a, b = G.Box("a_"), G.Box("b_")
    df = page_of(spark, 4000, 5, wide=0.0)
    one, two = S.named(df, "a_"), S.named(df, "b_")
    met = S.grid_join(one, two, F.lit(True), reach=60.0)
    assert met.count() < 4000 * 60  # all pairs of the two pages are eight million
    every = one.join(two, "doc_id").filter(G.box_distance(a, b) <= 60).count()
    assert met.filter(G.box_distance(a, b) <= 60).count() == every > 0
    assert S.grid_join(one.filter("false"), two, F.lit(True)).count() == 0
