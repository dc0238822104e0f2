import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import mixing, secrets, toxicity


def slow_segments(values):
    """All maximal segments by their recursive definition: the best one (shortest, then first), then both sides."""
    best = None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            key = (sum(values[i:j]), -(j - i), -i)
            if key[0] > 0 and (best is None or key > best[0]):
                best = (key, i, j)
    if best is None:
        return []
    _, i, j = best
    right = [(a + j, b + j) for a, b in slow_segments(values[j:])]
    return [*slow_segments(values[:i]), (i, j), *right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 5).filter(bool), max_size=14))
def test_maximal_segments(values):
    at = [k for k, v in enumerate(values) if v > 0]
    cuts = [0, *[k + 1 for k in at]]
    between = [float(sum(values[a:b])) for a, b in zip(cuts, at, strict=False)]
    found = toxicity.maximal_segments(at, [float(values[k]) for k in at], between)
    assert sorted(s.score for s in found) == pytest.approx(sorted(float(sum(values[a:b])) for a, b in slow_segments(values)))


def corpus(spark, n=600):
    rnd = random.Random(2)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    bad = ["vilex", "grubon", "snarkel", "moldac"]
    docs, labels = [], []
    for k in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        toxic = k % 6 == 0
        for _ in range(rnd.randint(3, 6) if toxic else 0):
            text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        docs.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    rows = toxicity.toxicity(docs.withColumn("toxic_score", F.lit("clash")), labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 150 and all((r.toxic_score >= 0.7) == bool(r.label) == r.toxic for r in rows)
    assert all(0 <= r.toxic_score <= 1 for r in rows) and all(len(r.toxic_passages) > 0 for r in rows if r.label)


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_odd_rows(spark):
    docs, labels = corpus(spark, 200)
    odd = docs.unionByName(spark.createDataFrame([(None, "vilex grubon"), (900, None), (901, ""), (901, ""), (902, "vilex " * 50000)], docs.schema))
    rows = toxicity.toxicity(odd, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (12, 1), (12, 0)], labels.schema))).collect()
    assert len(rows) == 205 and all(0 <= r.toxic_score <= 1 for r in rows)
    assert len({r.toxic_score for r in rows if not r.text}) == 1
    none = toxicity.toxicity(docs, labels.filter("false")).select("toxic_score").distinct().collect()
    assert [r.toxic_score for r in none] == [pytest.approx(0.5)]
    assert toxicity.toxicity(docs.filter("false"), labels).count() == 0


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        left -= sum(most * sizes[s] for s in full)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mix_comes_to_its_targets(spark, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "é", "Z", None][: 2 + seed]
    rows = [(k, rnd.choice(names[:1] * 3 + names), " ".join(["x"] * rnd.choice([0, 1, 5, 40, 900 if k % 50 == 0 else 3]))) for k in range(800)]
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(900, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df, ["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in out)
    sizes, taken, goal = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = r.target
    want = slow_targets(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - goal[s]) <= 5
    assert sorted(map(str, mixing.mix(df, ["doc_id"]).collect())) == sorted(map(str, out))
    assert mixing.mix(df.filter("false"), ["doc_id"]).count() == 0


def test_mixed_repeats_rows(spark):
    rows = [(k, "a" if k < 50 else "b", "word " * 10) for k in range(100)]
    names = ("target", "threshold", "_size", "_hash", "copies", "extra", "whole", "budget", "rest", "inside", "source_size", "_s", "_row", "taken")
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({n: F.lit(n) for n in names})
    out = mixing.mixed(df, ["doc_id"])
    assert out.columns == df.columns and all(r[n] == n for r in out.collect() for n in names)
    counts = {r.source: r["count"] for r in mixing.mixed(df, ["doc_id"]).groupBy("source").count().collect()}
    assert counts["a"] == pytest.approx(100 * 5 / 7, abs=1) and counts["b"] == pytest.approx(100 * 2 / 7, abs=1)


def test_secrets(spark):
    rnd = random.Random(1)
    hexes = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows, planted = [], {}
    for k in range(300):
        kind = k % 5
        if kind == 0:
            planted[k] = hexes()
            rows.append((k, f'some prose token = "{planted[k]}" more prose', "app/config.py"))
        else:
            rows.append((k, ["", f"call {rnd.randrange(10**15, 10**16)} now", f"mail {rnd.randrange(100)}@mail3.example.com to", f"commit {hexes()} landed", "just prose of ordinary words here"][kind], None))
    odd = [(None, None, None), (500, "", ""), (501, "word " * 60000 + f'secret: "{hexes()}"', "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, source string").withColumn("redacted", F.lit(1)).withColumn("value", F.lit(1))
    out = {r.doc_id: r for r in secrets.secrets(df, secrets.fit(df)).collect()}
    assert len(out) == len(rows) + 3
    for k, text, _ in rows:
        found = [text[f.start : f.end] for f in out[k].findings]
        assert found == ([planted[k]] if k in planted else []), text
        assert out[k].redacted == text.replace(planted.get(k, "\0"), secrets.REDACTED)
    assert len(out[501].findings) == 1 and out[None].redacted is None
    assert secrets.secrets(df.filter("false"), secrets.fit(df.filter("false"))).count() == 0
    none = secrets.train(spark.createDataFrame([], "value string, before string, after string, path string, label int"), frozenset())
    assert none.vote(np.zeros((2, len(secrets.FEATURES)))).tolist() == [0.0, 0.0]


def test_query_finds_planted_secrets(spark, small, tmp_path):
    """op5 over a whole table with secrets and look-alikes of many kinds planted in it."""
    from docloom.llm.common import read
    from docloom.llm.queries import op5_secrets

    rnd = random.Random(5)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    low, mixed = "abcdefghijklmnopqrstuvwxyz", "abcdefghijkmnopqrstuvwxyzABCDEFGHIJKLMNPQRSTUVWXYZ0123456789"
    kinds = {
        "assigned": lambda: ('api_key = "', pick(mixed, 32), '"'), "short": lambda: ('password = "', pick(low, 6) + "2" + pick(low, 6) + "2", '"'), "marks": lambda: ("password: ", "Tr0" + pick(low, 5) + "&3", ""),
        "letters": lambda: ("token=", pick(low, 26), ""), "address": lambda: ("postgres://u:", "s3" + pick(low, 7), "@db/x"), "vendor": lambda: ("use ", "ghp_" + pick(mixed, 36), " here"),
    }
    harmless = {"mail": lambda: f"{pick(low, 7)}.12@mail3.example.com", "number": lambda: pick("0123456789", 16), "path": lambda: f"{pick(low, 5)}/{pick(low, 6)}/{pick(low, 4)}-{rnd.randrange(99)}", "commit": lambda: f"commit {pick('0123456789abcdef', 40)}"}
    docs = read(spark, small, "documents").orderBy("doc_id").collect()
    rows, planted, clean = [], {}, {}
    for k, r in enumerate(docs):
        cut = (len(r.text or "") // 2) if r.text else 0
        head, tail = (r.text or "")[:cut] + "\n", "\n" + (r.text or "")[cut:]
        if k % 2:
            kind = list(kinds)[k // 2 % len(kinds)]
            before, value, after = kinds[kind]()
            planted[r.doc_id] = (kind, len(head + before), len(head + before) + len(value))
            rows.append((r.doc_id, head + before + value + after + tail, r.source))
        else:
            kind = list(harmless)[k // 2 % len(harmless)]
            text = harmless[kind]()
            clean[r.doc_id] = (kind, len(head), len(head) + len(text))
            rows.append((r.doc_id, head + text + tail, r.source))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s] for r in op5_secrets(spark, str(tmp_path)).collect()}
    assert set(out) == {r.doc_id for r in docs}
    missed = [kind for k, (kind, a, b) in planted.items() if (a, b) not in out[k]]
    wrong = [kind for k, (kind, a, b) in clean.items() if any(x < b and a < y for x, y in out[k])]
    assert len(missed) <= 0.05 * len(planted), missed
    assert len(wrong) <= 0.05 * len(clean), wrong


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p
    from docloom.llm.common import durable, read
    from tests.llm.test_similarity import shingle_sets, similar_sets, union_find

    docs = read(spark, small, "documents")
    sizes = [docs.count()]
    for name, stage in p.STAGES:
        before, docs = docs, durable(stage(spark, docs, small), f"test-{name}")
        sizes.append(docs.count())
        if name != p.STAGES[-1][0]:
            assert tuple(docs.columns) == p.COLUMNS
        if name == "near_duplicates":
            sets = shingle_sets(dict(before.select("doc_id", "text").collect()))
            edges = [(a, b) for a in sets for b in sets if a < b and similar_sets(sets[a], sets[b])]
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(set(union_find(sets, edges).values()))
    assert docs.filter("NOT lossless").count() == 0 and sizes[1] > 0.8 * sizes[0]
    rows = [(1, None, None, None, None), (None, "a", "en", "s", 1), (1, None, None, None, None), (3, "word other " * 40_000, "en", "s", 1), (4, "", "en", None, 0)]
    odd = spark.createDataFrame(rows, read(spark, small, "documents").schema)
    clash = ("toxic_score", "redacted", "findings", "target", "threshold", "ids", "trip", "component_id", "n", "row", "node", "fp")
    odd = odd.withColumns({c: F.lit(c) for c in clash})
    for name, stage in p.STAGES:
        out = stage(spark, odd, small).collect()
        assert {r.doc_id for r in out} <= {1, 3, 4, None}
        if name in ("toxicity", "secret_scan"):
            assert len(out) == len(rows)
        if name == "near_duplicates":
            assert sorted((r.doc_id for r in out), key=str) == [1, 3, None]
        stage(spark, odd.filter("false"), small).collect()
