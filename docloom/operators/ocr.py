"""OCR quality: document metrics, collapse signals, candidate scores, recovery choice, numeric verification, spatial label reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# Thresholds and weights.
COVERAGE_SHORT, CONFIDENT, BOTTOM_GAP, NUMERIC_SHARE, NOISE_SHARE, DUPLICATE_SHARE, DIVERSITY, DENSITY = 0.6, 0.7, 0.35, 0.4, 0.4, 0.3, 0.3, 0.5
SMALL_INK, WIN_MARGIN, MOST_ATTEMPTS = 0.25, 0.08, 3
WEIGHTS = {"coverage": 0.25, "density": 0.1, "words": 0.1, "conf": 0.2, "numeric": 0.1, "noise": 0.1, "duplicates": 0.05, "diversity": 0.05, "fragmentation": 0.05}


def normal_line(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(T.strip_bidi(s)), r"[^\p{L}\p{N}]+", " "))


def duplicates(lines: DataFrame) -> DataFrame:
    """(doc_id, duplicate): 1 / n where two of a document's n >= 4 lines are equal or share 90 % of their words, else 0.

    The count stops at the first pair, as the inventory fixes it.
    """
    n = lines.withColumn("norm", normal_line(F.col("text"))).filter("norm <> ''").withColumn("words", F.array_distinct(F.split("norm", " ")))
    size = n.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("norm").alias("k"))
    a = n.select("doc_id", F.col("line_idx").alias("i"), F.col("norm").alias("an"), F.col("words").alias("aw"))
    b = n.select("doc_id", F.col("line_idx").alias("j"), F.col("norm").alias("bn"), F.col("words").alias("bw"))
    # Lines that share 90 % of their words share a word; the join is on it.
    share = a.withColumn("w", F.explode("aw")).join(b.withColumn("w", F.explode("bw")), ["doc_id", "w"]).filter("i < j")
    both = share.groupBy("doc_id", "i", "j").agg(F.count("*").alias("common"), F.first(F.size("aw") + F.size("bw")).alias("total"))
    near = both.filter(F.col("common") / (F.col("total") - F.col("common")) >= 0.9).select("doc_id").distinct().withColumn("near", F.lit(True))
    out = size.join(near, "doc_id", "left")
    return out.select("doc_id", F.when((F.col("n") >= 4) & F.coalesce("near", F.lit(False)), 1 / F.col("n")).otherwise(0.0).alias("duplicate"))


def document_metrics(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_idx, text, ocr, y, height) to the metrics of each document."""
    solid = F.regexp_replace("text", r"\s+", "")
    d = lines.withColumns({"solid": solid, "noise": T.noise_score(F.col("text"))})
    per = d.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.char_length("solid")).alias("chars"), F.sum(F.size(T.tokens(F.col("text")))).alias("words"), F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"),
        F.median("height").alias("line_height"), F.avg("ocr").alias("mean_conf"), F.avg(F.col("text").rlike("[0-9]").cast("double")).alias("numeric"), F.avg((F.col("noise") > T.NOISE_THRESHOLD).cast("double")).alias("noise"),
        F.avg((F.char_length("solid") <= 2).cast("double")).alias("fragmentation"), F.size(F.array_distinct(F.split(F.array_join(F.collect_list("solid"), ""), ""))).alias("unique"),
    )
    return per.join(duplicates(lines), "doc_id", "left").fillna(0.0, ["duplicate"]).withColumn("diversity", F.when(F.col("chars") > 0, F.col("unique") / F.col("chars")).otherwise(0.0)).drop("unique")


def with_image(metrics: DataFrame, ink_top: Column, ink_bottom: Column, height: Column) -> DataFrame:
    ink = F.greatest(F.lit(1.0), ink_bottom - ink_top)
    span = F.col("bottom") - F.col("top")
    expected = F.greatest(F.lit(1), F.floor(ink / (F.col("line_height") * 1.8)))
    return metrics.withColumns({"coverage": span / height, "relative": span / ink, "bottom_gap": F.greatest(F.lit(0.0), (ink_bottom - F.col("bottom")) / ink), "density": F.col("lines") / expected, "ink_ratio": ink / height})


def collapse(m: DataFrame) -> DataFrame:
    """m with signals and suspicious: two strong signals, or a strongest one on small content."""
    c = F.col
    strong = {
        "lines": (c("lines") <= 2) | (c("chars") < 25),
        "truncation": (c("relative") < COVERAGE_SHORT) & F.coalesce(c("mean_conf") >= CONFIDENT, F.lit(False)),
        "bottom": (c("bottom_gap") > BOTTOM_GAP) & (c("numeric") >= NUMERIC_SHARE),
        "noise": c("noise") > NOISE_SHARE,
        "duplicates": (c("duplicate") > DUPLICATE_SHARE) & (c("lines") >= 5),
        "garbage": (c("diversity") < DIVERSITY) & (c("chars") >= 40),
    }
    all_signals = F.array_compact(F.array(*(F.when(v, k) for k, v in strong.items()), F.when(c("density") < DENSITY, "lowDensity")))
    strongest = strong["lines"] | strong["noise"] | strong["garbage"]
    n = sum((v.cast("int") for v in strong.values()), F.lit(0))
    small = c("ink_ratio") < SMALL_INK
    return m.withColumns({"signals": F.when(small & ~strongest, F.array().cast("array<string>")).otherwise(all_signals), "suspicious": F.when(small, strongest).otherwise(n >= 2)})


def score(m: DataFrame) -> Column:
    c, one = F.col, F.lit(1.0)
    total = (
        WEIGHTS["coverage"] * c("coverage") + WEIGHTS["density"] * F.least(one, c("density")) + WEIGHTS["words"] * F.least(one, c("words") / 40) + WEIGHTS["conf"] * F.coalesce("mean_conf", F.lit(0.0)) + WEIGHTS["numeric"] * c("numeric")
        + WEIGHTS["noise"] * (1 - c("noise")) + WEIGHTS["duplicates"] * (1 - c("duplicate")) + WEIGHTS["diversity"] * c("diversity") + WEIGHTS["fragmentation"] * (1 - c("fragmentation"))
    )
    return F.least(one, F.greatest(F.lit(0.0), total))


def plan(signals: Column) -> Column:
    """At most three recovery variants, in order of the failure's class."""
    want = lambda *names: F.arrays_overlap(signals, F.array(*map(F.lit, names)))
    steps = [F.when(want("vertical"), v) for v in ("rotate90", "rotate270")] + [F.when(want("lowContrast"), v) for v in ("binary", "sharpen")]
    steps += [F.when(want("lowDensity", "truncation", "lines", "bottom"), v) for v in ("psm11", "psm6")]
    return F.slice(F.array_compact(F.array(*steps)), 1, MOST_ATTEMPTS)


def select_attempt(attempts: DataFrame) -> DataFrame:
    """(doc_id, winner, score): the best of the first attempts if it beats attempt 0 by the margin, else 0."""
    primary = attempts.filter("ord = 0").select("doc_id", F.col("score").alias("base"))
    tried = attempts.filter(F.col("ord").between(1, MOST_ATTEMPTS)).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("best"))
    both = primary.join(tried, "doc_id", "left")
    wins = F.coalesce(F.col("best.score") >= F.col("base") + WIN_MARGIN, F.lit(False))
    return both.select("doc_id", F.when(wins, -F.col("best.o")).otherwise(0).alias("winner"), F.when(wins, F.col("best.score")).otherwise(F.col("base")).alias("score"))


def number_status(kind: Column, text: Column) -> Column:
    """valid, invalid or ambiguous by the form of an identifier, amount or date."""
    s = F.regexp_replace(text, r"\s+", "")
    n = F.char_length(s)
    ident = F.when(s.rlike("[^0-9]"), "invalid").when(n.between(6, 20), "valid").when(n.between(3, 5) | n.between(21, 25), "ambiguous").otherwise("invalid")
    amount = F.when(s.rlike("[A-Za-z]"), "invalid").when(s.rlike(r"^\d{1,9}([.,]\d{1,2})?$") | s.rlike(r"^\d{1,3}([.,]\d{3})+([.,]\d{1,2})?$"), "valid").when(s.rlike("[0-9]"), "ambiguous").otherwise("invalid")
    part = lambda k: F.regexp_extract(s, r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})", k)
    date = F.when(part(1) == "", "ambiguous").when(part(1).cast("int").between(1, 31) & part(2).cast("int").between(1, 12), "valid").otherwise("invalid")
    return F.when(s == "", "invalid").when(kind.isin("transaction", "reference", "account", "customer", "number"), ident).when(kind == "amount", amount).when(kind == "date", date).otherwise("ambiguous")


def verify(first: Column, first_conf: Column, first_status: Column, second: Column, second_conf: Column, second_status: Column) -> Column:
    """Reason of the decision between two readings; only the last two of USED take the second one."""
    both = (first_status == "valid") & (second_status == "valid")
    return (
        F.when(second.isNull(), "verifier_unusable").when(second_status == "invalid", "verifier_invalid")
        .when(both & (T.digits_only(first) == T.digits_only(second)), "primary_valid_verifier_agrees").when(second_status == "ambiguous", "verifier_ambiguous")
        .when(second_conf < 0.5, "verifier_low_confidence").when((first_status == "invalid") & (second_status == "valid"), "primary_invalid_verifier_valid")
        .when(both & (second_conf >= 0.85) & (second_conf >= F.coalesce(first_conf, F.lit(0.0)) + 0.2), "verifier_clearly_stronger_evidence").when(both, "no_decisive_evidence")
        .when(first_status == "ambiguous", "primary_ambiguous_no_replacement").otherwise("no_decision")
    )


USED = ("primary_invalid_verifier_valid", "verifier_clearly_stronger_evidence")
