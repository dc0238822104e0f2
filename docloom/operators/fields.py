"""Schema-driven reading: a field's label is found in the lines, its value beside or below it, and a verdict follows.

Labels and numbers of a document meet in bands of its height: a label is in every band from just above its top to the end of what the tiers
reach below it, a number in every band it stands in, and a pair counts in the first band that both are in. So only what is near meets, and boxes of any
height lose nothing. Values without a label near them are found by equal numbers, digits or texts. The label words of the few schema fields are bound into expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.sources import dimensions as D
from docloom.sources.cut import cut

# Tolerances in px, tiers, floors.
SAME_LINE, COLUMN_GAP, COLUMN_OVERLAP, PAIR_GAP, LEAST_CONF = 24, 120, 0.35, 48, 0.6
TIERS = {"inline_label": 30, "same_line": 20, "column_below": 15, "adjacent_below": 10}
EXPECTED, UNCERTAIN_CONF, MISMATCH_CAP = 100, 0.35, 0.3
#: Height of a band.
BAND = 200


def label_tokens(key: str, label: str, group: str | None) -> list[str]:
    """Words that name a field: its category's, its label's and its key's, of two letters or more."""
    words = [*D.LABELS.get(group or "", []), *label.split(), *key.replace("_", " ").split()]
    return sorted({w.lower() for w in words if len(w) >= 2})


def labelled(lines: DataFrame, schema: dict[str, list[str]]) -> DataFrame:
    """lines with the keys that they name, one row each."""
    return _keyed(lines.withColumn("norm", T.normalize(F.col("text"))).withColumn("keys", _keys(schema)))


def _keys(schema: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*(F.when(T.holds_any(F.col("norm"), words), k) for k, words in schema.items())))


def _keyed(read: DataFrame) -> DataFrame:
    return read.filter(F.size("keys") > 0).select(*(c for c in read.columns if c != "keys"), F.explode("keys").alias("key"))


def prepared(lines: DataFrame, schema: dict[str, list[str]]) -> DataFrame:
    """lines with their normal form (norm), the keys that they name and their number (token), written once: labels, numbers and words of a document are read from it."""
    return cut(lines.withColumns({"norm": T.normalize(F.col("text")), "token": number_token(F.col("text"))}).withColumn("keys", _keys(schema)))


def matching(asked: DataFrame, numbers: DataFrame) -> DataFrame:
    """Pairs of an asked value (doc_id, key, expected) and a number (doc_id, line_idx, token) of its document that values_match().

    They meet on what makes them equal: the whole part of the number (that of either end of the tolerance), the digits, the normal form."""
    digits = lambda c: F.concat(F.lit("d"), T.digits_only(c))
    text = lambda c: F.concat(F.lit("t"), T.normalize(c))
    whole = lambda x: F.concat(F.lit("n"), F.floor(x).cast("string"))
    own = as_number(F.col("expected"))
    wanted = F.array(digits(F.col("expected")), text(F.col("expected")), whole(own - 1e-6), whole(own + 1e-6))
    given = F.array(digits(F.col("token")), text(F.col("token")), whole(as_number(F.col("token"))))
    a = asked.withColumn("_meet", F.explode(F.array_distinct(F.array_compact(wanted))))
    b = numbers.withColumn("_meet", F.explode(F.array_distinct(F.array_compact(given))))
    return a.join(b, ["doc_id", "_meet"]).drop("_meet").distinct().filter(values_match(F.col("expected"), F.col("token")))


def number_token(s: Column) -> Column:
    return F.nullif(T.token_with_most_digits(T.unify_digits(s)), F.lit(""))


def values_match(a: Column, b: Column) -> Column:
    """Equal as numbers within 1e-6 up to 14 digits, else by digits or normal form."""
    short = as_number(a).isNotNull() & as_number(b).isNotNull() & (F.char_length(F.regexp_replace(a, "[^0-9.]", "")) <= 14)
    return F.when(F.trim(a) == "", False).when(short, F.abs(as_number(a) - as_number(b)) < 1e-6).otherwise((T.digits_only(a) == T.digits_only(b)) | (T.normalize(a) == T.normalize(b)))


def as_number(s: Column) -> Column:
    bare = F.regexp_replace(s, "[^0-9.]", "")
    return F.when(bare == "", 0.0).otherwise(bare.try_cast("double"))


def expected_length(expected: Column) -> Column:
    """Digits that a value must have where the expected one is eight digits or more."""
    return F.when(expected.rlike("^[0-9]{8,}$"), F.char_length(expected))


def words_of(lines: DataFrame) -> DataFrame:
    """Word boxes of the lines, each as wide as its share of the characters."""
    # The cut text is an element, so that it is made once and not for every word.
    before = lambda words, k: F.when(k == 0, 0).otherwise(F.char_length(F.array_join(F.slice(words, F.lit(1), k), " ")) + 1)
    parts = F.transform(F.array(F.split("text", " ")), lambda words: F.transform(words, lambda w, k: F.struct(w.alias("word"), F.char_length(w).alias("n"), before(words, k).alias("before"))))[0]
    w = lines.select("*", F.posexplode(parts).alias("k", "w"))
    before, each = F.col("w.before"), F.col("width") / F.char_length("text")
    return w.select("doc_id", "line_idx", *(c for c in ("conf",) if c in lines.columns), "k", F.col("w.word").alias("word"), (F.col("x") + each * before).alias("x"), "y", (each * F.col("w.n")).alias("width"), "height")


def _banded(boxes: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """boxes once for each band from top to bottom, with band and the first of them."""
    at = lambda y: F.floor(y / BAND).cast("int")
    return boxes.withColumn("first", at(top)).withColumn("band", F.explode(F.sequence("first", F.greatest(F.col("first"), at(bottom)))))


def candidates(lines: DataFrame, schema: dict[str, list[str]], asked: DataFrame) -> DataFrame:
    """(doc_id, key, expected, label_line, value, value_line, value_word, alignment, conf, score) for each value that a tier attaches to a label."""
    return _candidates(prepared(lines, schema), schema, asked)


def _candidates(read: DataFrame, schema: dict[str, list[str]], asked: DataFrame) -> DataFrame:
    """candidates() of prepared() lines."""
    token = read.filter("token IS NOT NULL")
    label = _keyed(read).join(asked, ["doc_id", "key"])
    sides = lambda df, prefix: df.select("doc_id", *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != "doc_id"))
    a, b = G.Box("a_"), G.Box("b_")
    # Above a label a value's centre may lie SAME_LINE higher, below it a value may begin COLUMN_GAP lower.
    reach = lambda df: _banded(df, F.col("y") - SAME_LINE, F.col("y") + F.col("height") + COLUMN_GAP)
    stand = lambda df: _banded(df, F.col("y"), F.col("y") + F.col("height"))
    near = lambda left, right: sides(reach(left), "a_").join(sides(stand(right), "b_").withColumnRenamed("b_band", "a_band"), ["doc_id", "a_band"]).filter(F.col("a_band") == F.greatest("a_first", "b_first"))
    met = near(label, token)
    same = F.col("a_line_idx") == F.col("b_line_idx")
    level = (F.abs(a.center_y - b.center_y) <= SAME_LINE) | (G.overlap_y(a, b) >= 0.5 * F.least(a.height, b.height))
    below = b.y - a.bottom
    kinds = F.array_compact(F.array(F.when(same, "inline_label"), F.when(~same & level, "same_line"), F.when(~same & below.between(0, PAIR_GAP), "adjacent_below")))
    out = ["doc_id", F.col("a_key").alias("key"), F.col("a_expected").alias("expected"), F.col("a_line_idx").alias("label_line")]
    whole = met.select(*out, F.col("b_token").alias("value"), F.col("b_line_idx").alias("value_line"), F.lit(-1).alias("value_word"), F.explode(kinds).alias("alignment"), F.col("b_conf").alias("conf"))

    w = words_of(read)
    named = F.lit(False)
    for k, words in schema.items():
        named = F.when(F.col("key") == k, T.holds_any(F.col("nword"), words)).otherwise(named)
    anchors = label.select("doc_id", "key", "expected", "line_idx").join(w.withColumn("nword", T.normalize(F.col("word"))), ["doc_id", "line_idx"]).filter(named)
    plain = T.unify_digits(F.col("word"))
    cells = w.withColumn("word", plain).filter((T.count(plain, "[0-9]") > 0) & (T.count(plain, "[0-9.,:/-]") / F.char_length(plain) >= 0.6))
    column = near(anchors, cells).filter((F.col("a_line_idx") != F.col("b_line_idx")) & below.between(0, COLUMN_GAP) & (G.overlap_x(a, b) / F.greatest(F.lit(1.0), F.least(a.width, b.width)) >= COLUMN_OVERLAP))
    column = column.select(*out, F.col("b_word").alias("value"), F.col("b_line_idx").alias("value_line"), F.col("b_k").alias("value_word"), F.lit("column_below").alias("alignment"), F.col("b_conf").alias("conf")).distinct()
    every = whole.unionByName(column)
    need = expected_length(F.col("expected"))
    tier = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))[F.col("alignment")]
    every = every.filter(need.isNull() | (T.count(F.col("value"), "[0-9]") == need))
    return every.withColumn("score", tier + F.when(F.coalesce(values_match(F.col("expected"), F.col("value")), F.lit(False)), EXPECTED).otherwise(0))


def best(found: DataFrame) -> DataFrame:
    """The strongest candidate of each field: score, then alignment by name, then place."""
    order = Window.partitionBy("doc_id", "key").orderBy(F.desc("score"), F.desc("alignment"), "label_line", "value_line", "value_word")
    return found.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def classified(lines: DataFrame, schema: dict[str, list[str]], asked: DataFrame) -> DataFrame:
    """(doc_id, key, state, value, reason, conf) of every asked field."""
    read = prepared(lines, schema)
    top = best(_candidates(read, schema, asked)).select("doc_id", "key", "value", "conf", F.lit(True).alias("aligned"))
    labels = _keyed(read).groupBy("doc_id", "key").agg(F.count("*").alias("labels"))
    numbers = read.select("doc_id", "line_idx", "token").filter("token IS NOT NULL")
    need = expected_length(F.col("expected"))
    f = cut(asked.join(top, ["doc_id", "key"], "left").join(labels, ["doc_id", "key"], "left"))
    # A number without its label tells only of fields that no label gave one.
    open_ = f.filter("expected IS NOT NULL AND aligned IS NULL").select(*asked.columns)
    bare = matching(open_, numbers).filter(need.isNull() | (T.count(F.col("token"), "[0-9]") == need))
    bare = bare.groupBy("doc_id", "key").agg(F.min_by("token", "line_idx").alias("bare"))
    f = f.join(bare, ["doc_id", "key"], "left")
    off = F.col("expected").isNotNull() & ~F.coalesce(values_match(F.col("expected"), F.col("value")), F.lit(True))
    named = F.coalesce("labels", F.lit(0)) > 0
    reason = (
        F.when(F.col("aligned") & off, "value_mismatch_expected").when(F.col("aligned") & (F.col("conf") < LEAST_CONF), "low_confidence").when(F.col("aligned"), "")
        .when(F.col("bare").isNotNull(), F.when(named, "label_value_gap_too_large").otherwise("value_without_label")).when(named & need.isNotNull(), "no_valid_length_value").otherwise("")
    )
    state = F.when(F.col("aligned") & (F.col("reason") == ""), "VERIFIED").when(F.col("aligned") | F.col("bare").isNotNull(), "UNCERTAIN").otherwise("MISSING")
    return f.withColumn("reason", reason).select("doc_id", "key", state.alias("state"), F.coalesce("value", "bare").alias("value"), "reason", F.when(F.col("aligned"), F.col("conf")).alias("conf"), named.alias("named"))


def document_verdict(fields: DataFrame) -> DataFrame:
    """(doc_id, verified, uncertain, missing, coverage, overall, reasons): counts, the overall confidence and whether the schema fits."""
    n = lambda s: F.count_if(F.col("state") == s)
    part = F.when(F.col("state") == "VERIFIED", F.coalesce("conf", F.lit(1.0))).when(F.col("state") == "UNCERTAIN", UNCERTAIN_CONF).otherwise(0.0)
    d = fields.groupBy("doc_id").agg(n("VERIFIED").alias("verified"), n("UNCERTAIN").alias("uncertain"), n("MISSING").alias("missing"), F.avg(F.col("named").cast("double")).alias("coverage"), F.avg(part).alias("mean"), F.count("*").alias("total"))
    reasons = F.array_compact(F.array(F.when((F.col("coverage") == 0) & (F.col("verified") == 0), "no_schema_labels_in_document"), F.when((F.col("missing") / F.col("total") >= 0.75) & (F.col("coverage") < 0.5), "most_fields_missing_without_labels")))
    overall = F.floor(F.col("mean") * 100 + 0.5 + 1e-9) / 100
    d = d.withColumn("reasons", F.array_join(reasons, ","))
    return d.withColumn("overall", F.when(F.col("reasons") == "", overall).otherwise(F.least(overall, F.lit(MISMATCH_CAP)))).drop("mean", "total")
