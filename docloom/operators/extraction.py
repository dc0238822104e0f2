"""Stages after grounding: classification, cleaning, recovery, validation, confidence. Each maps DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import grounding as G
from docloom.sources import dimensions as D

HEAD = 3000


def occurrences(s: Column, word: str) -> Column:
    return F.size(F.split(s, literal(word))) - 1


def literal(word: str) -> str:
    """The word as a literal Java pattern."""
    return r"\Q" + word + r"\E"


def alias_hits(text: Column, profile: str) -> Column:
    """How many of the profile's names the head of a text holds."""
    head = F.lower(F.left(text, F.lit(HEAD)))
    return sum((F.when(head.contains(a.lower()), 1).otherwise(0) for a in D.ALIASES[profile]), F.lit(0))


def alias_score(text: Column, profile: str) -> Column:
    """How often the profile's names of three letters or more occur in the head."""
    head = F.lower(F.left(text, F.lit(HEAD)))
    return sum((occurrences(head, a.lower()) for a in D.ALIASES[profile] if len(a) >= 3), F.lit(0))


def classify_by_rules(docs: DataFrame) -> DataFrame:
    """docs with rule_type and rule_score: the first profile of the highest score, null without a hit."""
    scored = docs.withColumns({f"_{p}": alias_score(F.col("text"), p) for p in D.ALIASES})
    best = F.greatest(*(F.col(f"_{p}") for p in D.ALIASES))
    kind = F.coalesce(*(F.when((F.col(f"_{p}") == best) & (best > 0), p) for p in D.ALIASES))
    return scored.withColumns({"rule_type": kind, "rule_score": F.when(best > 0, best)}).drop(*(f"_{p}" for p in D.ALIASES))


def resolve_type(df: DataFrame) -> DataFrame:
    """df (pinned, ai_type, ai_conf, ai_hits, rule_type, rule_score) with profile, source and confidence.

    Pinned first; the model's answer unless the text names another type and never its own, or it is unsure and
    the text names none; an unknown answer is upgraded by the rules.
    """
    c = F.col
    rule_conf = F.least(F.lit(1.0), 0.4 + 0.15 * c("rule_score"))
    known = c("ai_type").isNotNull() & (c("ai_type") != "unknown")
    no_marks = known & (c("ai_hits") <= 0)
    overruled = no_marks & c("rule_type").isNotNull() & (c("rule_type") != c("ai_type"))
    discarded = no_marks & c("rule_type").isNull() & (c("ai_conf") < 0.5)
    kept = known & ~overruled & ~discarded
    upgraded = ~known & c("rule_type").isNotNull()
    both = F.least(F.lit(1.0), F.greatest(rule_conf, F.coalesce("ai_conf", F.lit(0.0))))
    profile = F.when(c("pinned").isNotNull(), c("pinned")).when(overruled | upgraded, c("rule_type")).when(kept, c("ai_type")).otherwise("unknown")
    source = F.when(c("pinned").isNotNull(), "rule").when(overruled | upgraded, "rule").when(kept, "ai").when(~discarded & c("ai_type").isNotNull(), "ai").otherwise("fallback")
    confidence = F.when(c("pinned").isNotNull(), 1.0).when(overruled | upgraded, both).when(kept, c("ai_conf")).when(~discarded & c("ai_type").isNotNull(), c("ai_conf")).otherwise(0.0)
    return df.withColumns({"profile": profile, "source": source, "confidence": confidence})


def clean_value(s: Column) -> Column:
    """White space and repeated punctuation collapsed, loose edges stripped."""
    flat = F.trim(F.regexp_replace(T.strip_bidi(s), f"{T.SPACE}+", " "))
    flat = F.regexp_replace(flat, r"([.,:;!?*#])\1+", "$1")
    flat = F.regexp_replace(flat, "-{2,}", "-")
    return F.regexp_replace(flat, r"^[\s.,:;*#|\-]+|[\s.,:;*#|\-]+$", "")


def regrounded(fields: DataFrame, lines: DataFrame, value: str) -> DataFrame:
    """Fields whose value is still a part of a line of their document."""
    wanted = fields.withColumn("needle", T.normalize(F.col(value))).filter("needle <> ''")
    met = G.contains_join(wanted, lines, F.col("nline").contains(F.col("needle")))
    return fields.join(met.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi")


def label_words(label: str, group: str) -> list[str]:
    """Words that announce a field: its category's and its whole label, longest first."""
    found = {w.lower() for w in D.LABELS.get(group, [])} | {label.lower()}
    return sorted(found, key=lambda w: (-len(w), w))


def label_word(norm: Column, words: list[str]) -> Column:
    """The first of the words that a normal form holds, ASCII ones as words of their own. Every test is a literal pattern, compiled once."""
    tests = [(w, rf"\b{literal(w)}\b" if w.isascii() else literal(w)) for w in words]
    any_ = "|".join(p for _, p in tests)
    return F.when(norm.rlike(any_), F.transform(F.array(norm), lambda n: F.coalesce(*(F.when(n.rlike(p), w) for w, p in tests)))[0])


def recovery_candidates(lines: DataFrame, key: str, kind: str, label: str, group: str) -> DataFrame:
    """(doc_id, key, line_idx, raw, value, confidence): what follows a label word of the field on its line."""
    found = lines.withColumn("norm", T.normalize(F.col("text")))
    found = found.withColumn("word", label_word(F.col("norm"), label_words(label, group))).filter("word IS NOT NULL")
    after = F.trim(F.regexp_replace(F.split_part(F.col("norm"), F.col("word"), F.lit(-1)), r"^[\s:：.\-#]+", ""))
    dates = F.regexp_extract_all("norm", F.lit(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), F.lit(0))
    numbers = F.regexp_extract_all(after, F.lit(r"[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(0))
    raw = F.try_element_at(dates, F.lit(-1)) if kind == "date" else F.try_element_at(numbers, F.lit(-1)) if kind in ("number", "currency") else F.nullif(after, F.lit(""))
    value = T.to_date(F.regexp_replace("raw", r"\.", "-")) if kind == "date" else F.replace("raw", F.lit(","), F.lit("")) if kind in ("number", "currency") else F.col("raw")
    base = F.coalesce("ocr", F.lit(0.7))
    out = found.withColumn("raw", raw).filter("raw IS NOT NULL").withColumn("value", value).filter("value IS NOT NULL")
    return out.select("doc_id", F.lit(key).alias("key"), "line_idx", "raw", "value", F.least(F.lit(0.5), base * 0.7).alias("confidence"))


def decide_recovery(candidates: DataFrame) -> DataFrame:
    """(doc_id, key, status, value, confidence, n_values): one distinct value is flagged, several are ambiguous."""
    per = candidates.groupBy("doc_id", "key").agg(F.count_distinct("value").alias("n_values"), F.min("value").alias("v"), F.max("confidence").alias("c"))
    one = F.col("n_values") == 1
    return per.select("doc_id", "key", F.when(one, "flagged").otherwise("ambiguous").alias("status"), F.when(one, F.col("v")).alias("value"), F.when(one, F.col("c")).otherwise(0.0).alias("confidence"), "n_values")


def rule_results(fields: DataFrame, docs: DataFrame, rules: list[tuple], lenient: bool = False) -> DataFrame:
    """(doc_id, rule, key, ok, weight) for every rule of every document. Fields of a document are gathered by one pivot on its few keys."""
    keys = sorted({r[0] for r in rules})
    wide = fields.groupBy("doc_id").pivot("key", keys).agg(F.first("value"))
    every = docs.select("doc_id").join(wide, "doc_id", "left")
    outcomes = []
    for n, (key, kind, required, pattern, low, high, listed) in enumerate(rules):
        v = F.nullif(F.trim(F.col(key)), F.lit(""))
        number = v.try_cast("double")
        if listed:
            test = F.upper(v).isin(*D.CURRENCIES)
        elif pattern:
            test = v.rlike(pattern)
        elif kind == "date":
            test = v.rlike(r"^\d{4}-\d{2}-\d{2}$")
        elif kind in ("number", "currency"):
            test = number.isNotNull() & (F.lit(True) if low is None else number >= low) & (F.lit(True) if high is None else number <= high)
        else:
            test = F.lit(True)
        must = required and not lenient
        ok = F.when(v.isNull(), F.lit(not must)).otherwise(F.coalesce(test, F.lit(False)))
        outcomes.append(F.struct(F.lit(n).alias("rule"), F.lit(key).alias("key"), ok.alias("ok"), F.lit(1.0 if must else 0.5).alias("weight"), F.when(v.isNull() & F.lit(must), F.lit(key)).alias("missing")))
    return every.select("doc_id", F.explode(F.array(*outcomes)).alias("r")).select("doc_id", "r.*")


def overall(signals: dict[str, Column]) -> Column:
    weights = {"validation": 0.3, "consistency": 0.1, "ocr": 0.1, "extraction": 0.3, "evidence": 0.1, "uncertainty": 0.05, "missing": 0.05}
    total = sum((signals[n] * w for n, w in weights.items()), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
