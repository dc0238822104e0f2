"""Golden cases of the operators, negatives, and streaming forms."""

import datetime
import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.udf import normalize_arabic
from docloom.operators import chunks, grounding, replies
from docloom.operators import layout as L
from docloom.streaming import limits


def one(spark, column, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string")
    return [r.v for r in df.select("k", column(F.col("s")).alias("v")).orderBy("k").collect()]


def test_numbers_and_dates(spark):
    assert one(spark, T.to_number, "1,234.50 USD", "٣٨٫٤", "- ١٢", "abc", None) == [1234.5, 38.0, -12.0, None, None]
    assert one(spark, T.to_date, "02-07-2028 18:30:12", "13/45/2028", "2028-07-02", "2028/7/2", "soon", "7/2/28") == ["2028-07-02", "2028-45-13", "2028-07-02", "2028-07-02", None, None]


def test_mobile_numbers(spark):
    given_ = ["01012345678", "+20 1012345678", "06012345678", "0123456789", "none", "Tel ٠١٠١٢٣٤٥٦٧٨"]
    assert one(spark, T.sanitize_mobile, *given_) == ["01012345678", "01012345678", "01012345678", "0123456789", "none", "01012345678"]


def test_noise(spark):
    noise = one(spark, T.noise_score, "AL RABIH SUPERMARKET", "متجر الرحيم التجاري", "Hostinger;Description…)0123456788(", "© oe", "")
    assert noise[0] < 0.1 and noise[1] < 0.1 and noise[2] == noise[3] == 1.0 and noise[4] == 0.0


def test_arabic_normal_form(spark):
    got = one(spark, normalize_arabic, "ﷺ أحمد", "١٢٫٥", None)
    assert got[1] == "12.5" and got[2] is None and got[0].startswith(unicodedata.normalize("NFKC", "ﷺ")[:2])


def test_never_invents_a_value(spark):
    lines = spark.createDataFrame([(1, 0, "Total $1000", 0.9), (1, 1, "Total 38.40", 0.9)], "doc_id long, line_idx int, text string, ocr double")
    fields = spark.createDataFrame([(1, "a_amount", "currency", "100", 0.9), (1, "b_amount", "currency", "38.4", 0.9), (1, "invoice_date", "date", "2928-07-02", 0.9)], "doc_id long, key string, type string, raw string, confidence double")
    found = {(r.key, r.line_idx) for r in grounding.evidence_of(fields, lines).collect()}
    assert found == {("b_amount", 1)}
    out = {r.key: r.dropped for r in grounding.ground(fields, lines).collect()}
    assert out == {"a_amount": "not found in source text", "b_amount": None, "invoice_date": "not found in source text"}


def test_a_value_is_never_taken_from_another_label(spark):
    lines = spark.createDataFrame([(1, 0, "Reference 2013439351", 0.9)], "doc_id long, line_idx int, text string, ocr double")
    fields = spark.createDataFrame([(1, "total_amount", "currency", "2013439351", 0.9), (1, "ref_number", "string", "2013-439351", 0.9)], "doc_id long, key string, type string, raw string, confidence double")
    out = {r.key: (r.dropped, r.n_evidence) for r in grounding.ground(fields, lines).collect()}
    assert out == {"total_amount": ("value labeled for a different field", 1), "ref_number": (None, 1)}


def plain_chunks(text):
    text = text.replace("\r\n", "\n").strip()
    if not text:
        return []
    if len(text) <= 800:
        return [text]
    out, now = [], ""
    for p in [q.strip() for q in __import__("re").split(r"\n{2,}", text) if q.strip()]:
        if len(now) + len(p) + 2 > 800 and now:
            out.append(now.strip(" "))
            now = now[-150:] + "\n\n" + p
        else:
            now = now + "\n\n" + p if now else p
        while len(now) > 1200:
            region = now[700:900]
            m = __import__("re").search(r"[.!?]\s", region)
            at = 700 + m.start() + 2 if m else 700 + region.index("\n") + 1 if "\n" in region else 700 + region.rindex(" ") + 1 if " " in region else 800
            out.append(now[:at].strip(" "))
            now = now[max(0, at - 150) :]
    if now.strip():
        out.append(now.strip(" "))
    return out


def test_chunks_equal_a_plain_loop(spark):
    import random

    rnd = random.Random(5)
    texts = ["", "short", "a" * 5000]
    for _ in range(60):
        texts.append("\n\n".join(" ".join(rnd.choice(["word", "longer.", "x", "end!", "y" * 90]) for _ in range(rnd.randint(1, 400))) for _ in range(rnd.randint(1, 6))))
    assert one(spark, chunks.chunks, *texts) == [plain_chunks(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet='a"\\{}[], ', max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), st.text(alphabet="ab ", max_size=5))
def test_balanced_finds_the_outer_value(value, around):
    import json

    body = json.dumps({"v": value})
    assert replies.balanced(around + body + around) == body


def test_blocks_of_two_columns(spark):
    words = [(1, k, 0, 0.0, 20.0 * k, 40.0, 12.0) for k in range(4)] + [(1, k, 1, 45.0, 20.0 * k, 40.0, 12.0) for k in range(4)] + [(1, k, 2, 500.0, 20.0 * k, 40.0, 12.0) for k in range(4)]
    df = spark.createDataFrame(words, "doc_id long, line_idx int, word_idx int, x double, y double, width double, height double")
    found = {(r.line_idx, r.word_idx): r.block for r in L.blocks(df).collect()}
    assert len({found[k, 0] for k in range(4)} | {found[k, 1] for k in range(4)}) == 1
    bad = df.union(spark.createDataFrame([(2, 0, 0, math.nan, 0.0, 1.0, 1.0)], df.schema))
    assert L.finite(bad).filter("doc_id = 2").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 5), st.integers(1, 20))
def test_limiter_never_allows_more_than_the_limit(times, limit, seconds):
    count, reset, window = 0, 0.0, []
    for t in sorted(times):
        fresh = count == 0 or reset < t
        count, reset, ok = limits.limit_step(count, reset, float(t), limit, seconds)
        window = [t] if fresh else window + [t] if ok else window
        assert len(window) <= limit and (ok or not fresh)


def test_stream_limiter_equals_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(k % 3, base + datetime.timedelta(seconds=7 * k), k) for k in range(200)]
    df = spark.createDataFrame(rows, "user long, at timestamp, n long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limits.rate_limit_stream(stream, "user", "at", 2, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {(r.user, r["at"]): r.allowed for r in spark.table("limited").collect()}
    batch = {(r.user, r["at"]): r.allowed for r in limits.rate_limit(df, "user", "at", "n", 2, 60).collect()}
    assert live == batch and len(live) == 200 and not all(live.values())


def test_long_chains_have_no_cycle_and_cycles_are_broken(spark):
    from docloom.operators import graphs as V

    chain = [(1, f"n{k:03}", f"n{k + 1:03}", 0.5, k) for k in range(100)]
    rings = [(2, f"n{k:03}", f"n{(k + 1) % 90:03}", 0.2 + (k % 7) / 10, k) for k in range(90)] + [(2, "n003", "n003", 0.1, 90), (3, "a", "b", 0.5, 0), (3, "b", "a", 0.5, 1)]
    e = spark.createDataFrame(chain + rings, "doc_id long, from_id string, to_id string, score double, ord int")
    found = {(r.doc_id, r.id): r.round for r in V.ordered(e).collect()}
    assert all(found[1, f"n{k:03}"] == k for k in range(101)) and all(v is None for (d, _), v in found.items() if d != 1)
    out = {(r.doc_id, r.from_id, r.to_id) for r in V.cycle_breakers(e, F.when(F.col("from_id") == "a", 1).otherwise(2)).collect()}
    assert out == {(2, "n000", "n001"), (2, "n003", "n003"), (3, "b", "a")}
    left = e.join(spark.createDataFrame(list(out), "doc_id long, from_id string, to_id string"), ["doc_id", "from_id", "to_id"], "left_anti")
    assert V.cyclic_nodes(left).count() == 0


def test_quotes_of_every_length(spark):
    import random

    from docloom.operators.quotes import holding

    rnd = random.Random(3)
    texts = [(k, " ".join(rnd.choice(["ab", "abc", "b", "cab", "bca"]) for _ in range(rnd.randint(0, 12)))) for k in range(40)]
    quotes = [(k, " ".join(rnd.choice(["ab", "b", "ca", "abc"]) for _ in range(rnd.randint(0, 8)))) for k in range(60)]
    got = {(r.t, r.q) for r in holding(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(quotes, "q long, quote string")).collect()}
    assert got == {(t, q) for t, x in texts for q, y in quotes if y and y in x}


def covered(words, quote):
    """(start, end, cover) of the run that spells most of the quote's beginning, as a loop from every start."""
    target, best = " ".join(quote.split()), None
    for s in range(len(words)):
        acc, first, last = "", -1, -1
        for k in range(s, len(words)):
            w = " ".join(words[k].split())
            if w == "":
                break
            joined = f"{acc} {w}" if acc else w
            if target.startswith(joined):
                first, last, acc = (k if first < 0 else first), k, joined
                if len(acc) >= len(target):
                    break
        if first >= 0:
            key = (-min(1.0, len(acc) / len(target)), first, last)
            best = key if best is None or key < best else best
    return None if best is None or best[0] > -0.6 else (best[1], best[2], -best[0])


def test_quotes_are_matched_to_words_as_a_loop_does(spark):
    from docloom.plans.fields import quote_span

    cases = [("a b c d", "b c"), ("a b c d", "b x"), ("total due total 12", "total 12"), ("x y", "zz"), ("alpha beta gamma", "alpha beta gam"), ("a  b", "a b"), ("a b a b c", "a b c"), ("a b", ""), ("one two three", "two  three")]
    df = spark.createDataFrame([(k, t, q) for k, (t, q) in enumerate(cases)], "k int, t string, q string")
    got = {r.k: r.s for r in df.select("k", quote_span(F.split("t", " "), F.col("q")).alias("s")).collect()}
    for k, (t, q) in enumerate(cases):
        want = covered(t.split(" "), q) if q else None
        assert (got[k] is None) == (want is None) and (want is None or (got[k].start, got[k].end, round(got[k].cover, 9)) == (want[0], want[1], round(want[2], 9))), (t, q, got[k], want)


def test_a_signal_makes_only_what_it_is_made_of(spark, small, monkeypatch):
    """Signals of fields or of rules alone equal those of all together, and neither makes the other's parts."""
    from docloom.plans import extraction as X

    every = {r.doc_id: r for r in X.signals(spark, small).collect()}

    def fail(*_):
        raise AssertionError("not needed")

    for names, other in ((("consistency", "extraction", "evidence"), "checks"), (("validation", "missing", "ocr"), "grounded_signals")):
        with monkeypatch.context() as m:
            m.setattr(X, other, fail)
            found = X.signals(spark, small, names).collect()
        assert len(found) == len(every) and all(abs(r[n] - every[r.doc_id][n]) < 1e-9 for r in found for n in names)
