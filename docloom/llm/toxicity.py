"""Toxic passages as maximal scoring segments over token log-odds.

Fitting, on a bounded sample of labelled rows: for every word and word beginning, how many toxic and how many
clean texts hold it gives a log-odds ratio with an informative Dirichlet prior (the sample's own rates); those
whose ratio is significant are the model, as many as the labelled rows bear. Every other word costs DRIFT, so that
the expected score of clean text is negative.

Scoring, linear in the text: each word takes the score of the most specific entry it has; all maximal scoring
segments are found in one scan. Under the scores' distribution in clean text, the best segment of n words
follows an extreme-value law with parameters lambda and K, which gives each segment a normalized score and an
E-value. A text's segments are aggregated (best, sum and number of the significant ones), beside its
number of strong words and its size, and a logistic curve fitted on the sample turns them into the probability of
label 1. Copies of a text count once in the sample.

Cases: null and empty texts have no segments and get the curve's value for none; without labelled rows of
both kinds there is no token and every score is the smoothed base rate; a word's k-th repeat counts 1/k, so
that one repeated word is no passage; conflicting labels of one id count as toxic; texts of any length are read
whole; repeated rows have equal scores; an empty table gives an empty result; columns of docs named like an output
(toxic, toxic_score, toxic_passages) are replaced by it, all others stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, frugal
from .sentencepiece_codec import slices

#: Labelled rows that the fit uses at most, chosen by a hash of their id.
LABELLED_ROWS = 16_000
PREFIXES = (4, 5, 6, 7)
PRIOR = 10.0
LEAST_Z = 2.6
#: Words of this score or more count as strong.
STRONG = 3.0
DRIFT = 1.0
MOST_SCORE = 8.0
E_VALUE = 0.05
#: Normalized score of a text without a segment.
NO_SEGMENT = -10.0
#: Best segments from this score on count towards K.
LEAST_BEST = 1.0
THRESHOLD = 0.7
#: Words whose scores a task keeps before it starts anew.
TABLE_SIZE = 200_000

words_of = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def entries(word: str) -> list[str]:
    """The word and its beginnings, most specific first; beginnings end in "*"."""
    return [word] + [word[:k] + "*" for k in reversed(PREFIXES) if len(word) > k]


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    score: float


def maximal_segments(at: list[int], score: list[float], between: list[float]) -> list[Segment]:
    """All maximal scoring segments (Ruzzo and Tompa) of a sequence given by its positive scores at `at`;
    between[k] is the sum of the other scores from the one before (or the start) to at[k]. end is exclusive."""
    done: list[tuple[int, int, float, float]] = []
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
    lower: list[int] = []  # of each kept one, the nearest before it with a smaller sum before it
    total = 0.0
    for position, value, gap in zip(at, score, between, strict=True):
        total += gap
        new = (position, position + 1, total, total + value)
        total += value
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = lower[j]
            if j < 0:  # no later one can reach back over this sum: all kept ones are final
                done += kept
                kept, lower = [new], [-1]
                break
            if kept[j][3] >= new[3]:
                kept.append(new)
                lower.append(j)
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:], lower[j:]
    return [Segment(a, b, high - low) for a, b, low, high in done + kept]


@dataclass
class Model:
    """All that scoring needs; its entries come from LABELLED_ROWS rows at most and are significant in them."""

    scores: dict[str, float]
    rate: float = 0.1
    scale: float = 1.0  # lambda of the extreme-value law
    size: float = 0.1  # its K
    weights: tuple[float, ...] = (0.0,) * 6

    def word_score(self, word: str) -> float:
        for entry in entries(word):
            if (found := self.scores.get(entry)) is not None:
                return found
        return -DRIFT

    def segments(self, words: list[str], known: dict[str, float]) -> list[Segment]:
        for w in {w for w in words if w not in known}:
            known[w] = self.word_score(w)
        values = np.fromiter((known[w] for w in words), dtype=np.float64, count=len(words))
        at = np.flatnonzero(values > 0).tolist()
        if not at:
            return []
        seen: dict[str, int] = {}
        score = []
        for k in at:
            n = seen[words[k]] = seen.get(words[k], 0) + 1
            score.append(float(values[k]) / n)
        rest = np.concatenate([[0.0], np.cumsum(np.where(values > 0, 0.0, values))])
        marks = rest[at]
        return maximal_segments(at, score, np.diff(marks, prepend=0.0).tolist())

    def normalized(self, segment: Segment, n_words: int) -> float:
        """The score in nats above what chance gives: minus the logarithm of the E-value."""
        return self.scale * segment.score - math.log(self.size * max(n_words, 1))

    def features(self, segments: list[Segment], n_words: int, strong: int) -> tuple[float, ...]:
        """Best segment, sum and number of the significant ones, number of strong words, size."""
        level = [self.normalized(s, n_words) for s in segments]
        found = [x for x in level if x >= -math.log(E_VALUE)]
        return (max(level, default=NO_SEGMENT), math.log1p(sum(found)), math.log1p(len(found)), math.log1p(strong), math.log1p(n_words))

    def probability(self, features: tuple[float, ...]) -> float:
        b, *w = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(x * y for x, y in zip(w, features, strict=True))))))


RESULT = "struct<score:double,n_words:long,passages:array<struct<start:int,end:int,score:double,e_value:double>>>"


def score_texts(text: Column, model: Model) -> Column:
    """score, n_words and the significant passages (in words) of each text."""

    @F.arrow_udf(RESULT)
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for part in slices(batch):
                for text in part:
                    if len(known) > TABLE_SIZE:
                        known = {}
                    words = words_of(text.lower())
                    found = model.segments(words, known)
                    strong = sum(known[w] >= STRONG for w in set(words))
                    p = model.probability(model.features(found, len(words), strong))
                    each = [{"start": s.start, "end": s.end, "score": s.score, "e_value": e} for s in found if (e := math.exp(min(0.0, -model.normalized(s, len(words))))) <= E_VALUE]
                    out.append({"score": p, "n_words": len(words), "passages": each})
            passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])
            yield pa.array(out, type=pa.struct([("score", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(passage))]))

    return run(text)


def _entry_sets(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array([sorted({e for w in set(words_of(t.lower())) for e in entries(w)}) for t in part], type=pa.list_(pa.string())) for part in slices(batch, 200_000)]
            yield pa.concat_arrays([pa.array([], type=pa.list_(pa.string())), *parts])

    return run(text)


def log_odds(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(entry, score, z) from (entry, in_toxic, in_clean): log-odds ratios with the overall rates as prior."""
    p = (F.col("in_toxic") + F.col("in_clean")) / F.lit(float(toxic + clean))
    a = PRIOR * p
    high = (F.col("in_toxic") + a) / (toxic + PRIOR - F.col("in_toxic") - a)
    low = (F.col("in_clean") + a) / (clean + PRIOR - F.col("in_clean") - a)
    deviation = F.sqrt(1 / (F.col("in_toxic") + a) + 1 / (F.col("in_clean") + a))
    ratio = F.log((F.col("in_toxic") + a) / (toxic + PRIOR)) - F.log((F.col("in_clean") + a) / (clean + PRIOR))
    return counts.select("entry", ratio.alias("score"), ((F.log(high) - F.log(low)) / deviation).alias("z"))


def _solve_scale(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1, for scores of negative mean."""
    p = counts / counts.sum()
    excess = lambda x: float((p * np.exp(x * values)).sum()) - 1
    low, high = 1e-3, 3.0
    if excess(low) > 0 or excess(high) < 0:
        return low if excess(low) > 0 else high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Constant and weights of a ridge logistic curve, by Newton steps of bounded length on standardized columns."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    penalty = np.array([1e-3] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    slope = w[1:] / spread
    return np.concatenate([[w[0] - (slope * mean).sum()], slope])


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most most_rows labelled rows that aren't held out. Collected: the model's entries, their scores' counts, and six numbers a sample row."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") != 0).cast("int").alias("toxic"))
    # Copies of one text would count as so many witnesses: each text counts once, by the majority of its labels.
    rows = durable(rows.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    rate = (toxic + 0.5) / (toxic + clean + 1)
    base = Model({}, rate, weights=(math.log(rate / (1 - rate)), *(0.0,) * 5))
    if not toxic or not clean:
        return base
    held = rows.select((F.col("toxic") != 0).alias("t"), F.explode(_entry_sets(F.col("text"))).alias("entry"))
    counts = held.groupBy("entry").agg(F.count_if("t").alias("in_toxic"), F.count_if(~F.col("t")).alias("in_clean")).filter("in_toxic > 1")
    best = log_odds(counts, toxic, clean).filter(F.col("z") >= LEAST_Z)
    model = Model({r["entry"]: min(r["score"], MOST_SCORE) for r in best.collect() if r["score"] > 0}, rate)

    measured = rows.select((F.col("toxic") != 0).cast("int").alias("toxic"), _measure(F.col("text"), model).alias("m")).select("toxic", "m.*")
    measured = durable(measured, "toxicity-measured")
    quiet = measured.filter("toxic = 0")
    # Scores of clean words: the model's positive ones as met, half a word more for what wasn't, and -DRIFT.
    met = quiet.select(F.explode("positive").alias("s")).groupBy("s").agg(F.count("*").alias("n")).orderBy("s").collect()
    n_words, loud = quiet.agg(F.sum("n_words"), F.count_if(F.col("best") >= LEAST_BEST)).first()
    n_met = sum(r.n for r in met)
    values = np.array([*(r.s for r in met), np.mean(list(model.scores.values()) or [1.0]), -DRIFT])
    model.scale = _solve_scale(values, np.array([*(r.n for r in met), 0.5, max(1.0, n_words - n_met)]))
    model.size = (loud + 0.5) / max(1.0, n_words * math.exp(-model.scale * LEAST_BEST))

    level = F.transform("segments", lambda s: s * model.scale - F.log(F.lit(model.size) * F.greatest(F.col("n_words"), F.lit(1))))
    found = F.filter(level, lambda x: x >= -math.log(E_VALUE))
    features = [F.coalesce(F.array_max(level), F.lit(NO_SEGMENT)), F.log1p(F.aggregate(found, F.lit(0.0), lambda a, x: a + x)), F.log1p(F.size(found)), F.log1p("strong"), F.log1p("n_words")]
    x = np.array([tuple(r) for r in measured.select("toxic", *features).collect()], dtype=float).reshape(-1, 6)
    model.weights = tuple(_logistic(x[:, 1:], x[:, 0]))
    return model


MEASURE = "struct<n_words:long,strong:long,best:double,positive:array<double>,segments:array<double>>"


def _measure(text: Column, model: Model) -> Column:
    @F.arrow_udf(MEASURE)
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for batch in batches:
            out = []
            for part in slices(batch):
                for text in part:
                    words = words_of(text.lower())
                    found = [s.score for s in model.segments(words, known)]
                    out.append({"n_words": len(words), "strong": sum(known[w] >= STRONG for w in set(words)), "best": max(found, default=0.0), "positive": [x for w in set(words) if (x := known[w]) > 0], "segments": found})
            yield pa.array(out, type=pa.struct([("n_words", pa.int64()), ("strong", pa.int64()), ("best", pa.float64()), ("positive", pa.list_(pa.float64())), ("segments", pa.list_(pa.float64()))]))

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with toxic_score, toxic (score >= threshold) and toxic_passages."""
    model = fit(docs, labels)
    scored = docs.withColumn("_toxicity", score_texts(F.col("text"), model))
    return scored.withColumns({"toxic_score": F.col("_toxicity.score"), "toxic": F.col("_toxicity.score") >= threshold, "toxic_passages": F.col("_toxicity.passages")}).drop("_toxicity")
