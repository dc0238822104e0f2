"""Grounding of field values in lines: evidence rows, label verdicts, primary reading, composed confidence.

Fields and lines meet on the document, with the substring or numeric test as a residual of that hash join;
nothing is compared across documents. Label words are bound into one expression, longest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources import dimensions as D

DEFAULT_CONFIDENCE, LEAST_CONFIDENCE = 0.85, 0.3
NEUTRAL, NO_EVIDENCE, LOW_OCR, LABEL_BONUS = 0.92, 0.9, 0.6, 10


def label_text(s: Column) -> Column:
    wide = F.regexp_replace(F.regexp_replace(s, T.BIDI, ""), f"{T.SPACE}+", " ")
    return F.lower(F.trim(F.when(T.is_ascii(s), F.regexp_replace(s, T.ASCII_RUN, " ")).otherwise(wide)))


def label_group(s: Column) -> Column:
    """Category of the longest label word in a line; the first category among equals.

    The normal form goes through a one-element array, so that it is made once and not for every word. Every label has a letter, and a line
    of ASCII alone can hold no other label than one of ASCII: only labels that a line may hold are looked for."""
    labels = D.labels_by_length()
    longest = lambda n, found: F.coalesce(*(F.when(n.contains(w), g) for w, g in found), F.lit(None).cast("string"))
    plain = [x for x in labels if x[0].isascii()]
    return F.transform(F.array(label_text(s)), lambda n: F.when(F.octet_length(n) == F.char_length(n), F.when(n.rlike("[a-z]"), longest(n, plain))).otherwise(longest(n, labels)))[0]


def group_for_key(key: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in D.GROUP_OF_KEY.items() for x in pair))
    rest = (
        F.when(key.startswith("mobile") | key.contains("phone"), "phone")
        .when(key.endswith("_date") | (key == "date"), "date")
        .when(key.endswith("_number") | (key == "number") | key.endswith("_no"), "number")
    )
    return F.coalesce(known[key], rest)


def spans(words: Column, most: Column) -> Column:
    """Arrays (length - 1, start, end, text) of every run of at most `most` words."""
    n = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda s: F.transform(F.sequence(s, F.least(n - 1, s + most - 1)), lambda e: F.struct((e - s).alias("length"), s.alias("start"), e.alias("end"), F.array_join(F.slice(words, s + 1, e - s + 1), " ").alias("text"))),
    )
    return F.when(n > 0, F.flatten(runs))


def normal_words(s: Column) -> Column:
    return F.filter(F.split(T.normalize(s), " "), lambda w: w != "")


def word_span(words: Column, needle: Column) -> Column:
    """The shortest, then first, run of normalized words that holds the normalized needle."""
    most = F.size(F.split(needle, " ")) + 2
    return F.array_min(F.filter(spans(words, most), lambda x: x["text"].contains(needle)))


def numeric_span(words: Column, target: Column) -> Column:
    """The shortest, then first, run of words whose number equals the target."""
    return F.array_min(F.filter(spans(words, F.lit(3)), lambda x: T.number_key(x["text"]) == target))


def separator_free_span(words: Column, needle: Column) -> Column:
    """The first run whose letters and digits alone hold the needle's, with as many digits. The needle's go through a one-element array, so that they are made once and not for every run."""

    def first(t: Column) -> Column:
        fits = F.filter(spans(words, F.lit(4)), lambda x: (T.count(x["text"], "[0-9]") == t["n"]) & solid(x["text"]).contains(t["target"]))
        return F.when(t["n"] > 0, F.array_min(F.transform(fits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))))

    target = F.transform(F.array(solid(T.normalize(needle))), lambda s: F.struct(s.alias("target"), T.count(s, "[0-9]").alias("n")))
    return F.transform(target, first)[0]


def is_numeric(kind: Column) -> Column:
    return kind.isin("number", "currency")


def contains_join(fields: DataFrame, lines: DataFrame, test: Column, key: str = "doc_id") -> DataFrame:
    """Pairs of a field and a line of the same document that pass the test.

    Lines are normalized once, below the join: nline is the normalized text, nwords its words. Both sides are dealt by document: what a plan
    takes a few fields for may be millions, which a broadcast would gather on the driver.
    """
    ready = lines.withColumnRenamed("text", "line").withColumn("nline", T.normalize(F.col("line")))
    ready = ready.withColumn("nwords", F.filter(F.split("nline", " "), lambda w: w != ""))
    return fields.join(ready.hint("merge"), key).filter(test)


def forms_in_lines(dates: DataFrame, lines: DataFrame, forms: Column) -> DataFrame:
    """Rows of a date, a line of its document and a form (needle) that the line holds: dates meet lines once, whatever their number of forms."""
    holds = lambda v: F.col("nline").contains(v)
    met = contains_join(dates.withColumn("_forms", forms), lines, F.exists("_forms", holds))
    return met.withColumn("needle", F.explode(F.filter("_forms", holds))).drop("_forms")


def direct_evidence(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Evidence (doc_id, key, line_idx, start, end) of values as they are: by number for numeric fields, else by text."""
    raw = fields.filter(T.trim_space(F.col("raw")) != "").withColumn("needle", T.normalize(F.col("raw")))
    columns = [*fields.columns, "line_idx", "line", "ocr", "span.start", "span.end", F.lit("value-match").alias("role")]
    numbers = raw.filter(is_numeric(F.col("type"))).withColumn("target", T.number_key(F.col("needle")))
    equal = contains_join(numbers, lines, F.col("nline").rlike("[0-9]")).withColumn("span", numeric_span(F.col("nwords"), F.col("target"))).filter("span IS NOT NULL")
    texts = contains_join(raw.filter(~is_numeric(F.col("type"))), lines, F.col("nline").contains(F.col("needle")))
    texts = texts.withColumn("span", word_span(F.col("nwords"), F.col("needle")))
    return texts.select(*columns).unionByName(equal.select(*columns))


def derived_evidence(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Evidence of dates in their printed forms."""
    dates = fields.filter((F.col("type") == "date") & F.col("raw").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    met = forms_in_lines(dates, lines, T.date_variants(F.col("raw")))
    met = met.withColumn("span", word_span(F.col("nwords"), F.col("needle")))
    return met.select(*fields.columns, "line_idx", "line", "ocr", "span.start", "span.end", F.lit("derived").alias("role"))


def printed_numbers(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Evidence of numbers in their printed form, which may have thousands separators and has three decimals at most."""
    numbers = fields.filter(is_numeric(F.col("type")) & (T.trim_space(F.col("raw")) != "")).withColumn("target", F.round(T.number_key(T.normalize(F.col("raw"))), 3))
    met = contains_join(numbers, lines, F.col("nline").rlike("[0-9]")).withColumn("span", numeric_span(F.col("nwords"), F.col("target"))).filter("span IS NOT NULL")
    return met.select(*fields.columns, "line_idx", "line", "ocr", "span.start", "span.end", F.lit("derived").alias("role"))


def verified_evidence(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Evidence of reference numbers by their letters and digits alone."""
    refs = fields.filter(group_for_key(F.col("key")).isin("number", "tax") & F.col("type").isin("string", "text") & F.col("raw").rlike("[0-9]"))
    # A run's letters and digits stand side by side in the line's: only lines that hold the number's are cut into runs.
    whole = F.col("nline").rlike("[0-9]") & solid(F.col("nline")).contains(F.col("_solid"))
    met = contains_join(refs.withColumn("_solid", solid(T.normalize(F.col("raw")))), lines, whole).withColumn("span", separator_free_span(F.col("nwords"), F.col("raw"))).filter("span IS NOT NULL")
    return met.select(*fields.columns, "line_idx", "line", "ocr", "span.start", "span.end", F.lit("derived").alias("role"))


def iso_evidence(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """Evidence of dates in other ISO layouts."""
    dates = fields.filter((F.col("type") == "date") & F.col("raw").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    met = forms_in_lines(dates, lines, T.iso_variants(F.col("raw"))).withColumn("span", word_span(F.col("nwords"), F.col("needle")))
    return met.select(*fields.columns, "line_idx", "line", "ocr", "span.start", "span.end", F.lit("derived").alias("role"))


def dedupe(evidence: DataFrame) -> DataFrame:
    """One row for each line, role and first word."""
    first = Window.partitionBy("doc_id", "key", "line_idx", "role", "start").orderBy("end")
    return evidence.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _asked(fields: DataFrame) -> DataFrame:
    """fields with what is looked for: _needle, _target and _whole (of numbers, and the digits before their point), _printed and _isos (of dates), _bare and _solid (of references), _want (category)."""
    raw, kind = F.col("raw"), F.col("type")
    is_date = (kind == "date") & raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    want = group_for_key(F.col("key"))
    is_reference = want.isin("number", "tax") & kind.isin("string", "text") & raw.rlike("[0-9]")
    none = F.array().cast("array<string>")
    f = fields.withColumns({"_needle": F.when(T.trim_space(raw) != "", T.normalize(raw)), "_want": want})
    target = F.when(is_numeric(kind), T.number_key(F.col("_needle")))
    # A number below one may be printed without a digit before its point.
    whole = F.when(F.abs(target) < 1, "").otherwise(F.floor(F.abs(target)).cast("string"))
    return f.withColumns({"_target": target, "_whole": whole, "_solid": F.when(is_reference, solid(T.normalize(raw))), "_printed": F.when(is_date, T.date_variants(raw)).otherwise(none), "_isos": F.when(is_date, T.iso_variants(raw)).otherwise(none), "_bare": F.when(is_reference, raw)})


def solid(s: Column) -> Column:
    """Letters and digits of a normal form alone."""
    return F.regexp_replace(s, "[^a-z0-9]+", "")


def _ready(lines: DataFrame) -> DataFrame:
    """lines with their normal form, words, digits, letters and digits, and label category, each made once."""
    r = lines.withColumnRenamed("text", "line").withColumns({"nline": T.normalize(F.col("line")), "has": label_group(F.col("line"))})
    return r.withColumns({"nwords": F.filter(F.split("nline", " "), lambda w: w != ""), "ndigits": T.digits_only(F.col("nline")), "nsolid": solid(F.col("nline"))})


EVIDENCE = "array<struct<role:string,start:int,end:int,stage:int>>"


def _met(fields: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """One join of fields with the lines of their document that may hold them; found: all evidence of the pair.

    Stage 0 is the value as it is or a date's printed forms, stage 1 the forms that count only without those."""
    holds = lambda x: F.col("nline").contains(x)
    numeric = is_numeric(F.col("type"))
    # Words of a run stand side by side, so their digits, or letters and digits, do so in the line's: only lines that hold these are cut into runs.
    digits = (F.col("ndigits") != "") & F.coalesce(F.col("ndigits").contains(F.col("_whole")), F.lit(False))
    solid_ = (F.col("ndigits") != "") & F.coalesce(F.col("nsolid").contains(F.col("_solid")), F.lit(False))
    may = (numeric & digits & F.col("_needle").isNotNull()) | (~numeric & F.coalesce(holds(F.col("_needle")), F.lit(False))) | F.exists("_printed", holds) | F.exists("_isos", holds) | (F.col("_bare").isNotNull() & solid_)
    own = _ready(lines).withColumnRenamed("doc_id", "_doc")
    met = _asked(fields).join(own.hint("merge"), (F.col("doc_id") == F.col("_doc")) & may, how).drop("_doc")

    none = F.array().cast(EVIDENCE)
    item = lambda span, role, stage: F.struct(F.lit(role).alias("role"), span["start"].cast("int").alias("start"), span["end"].cast("int").alias("end"), F.lit(stage).alias("stage"))
    one = lambda test, span, role, stage: F.when(test, F.filter(F.array(span), lambda x: x.isNotNull())).otherwise(F.array().cast(SPAN if stage == 0 else PLACE))
    words = F.col("nwords")
    direct = one(numeric & digits, numeric_span(words, F.col("_target")), "value-match", 0)
    texts = one(~numeric & holds(F.col("_needle")), word_span(words, F.col("_needle")), "value-match", 0)
    forms = lambda column: F.transform(F.filter(column, holds), lambda v: word_span(words, v))
    bare = one(F.col("_bare").isNotNull() & solid_, separator_free_span(words, F.col("_bare")), "derived", 1)
    parts = [F.transform(x, lambda sp: item(sp, "value-match", 0)) for x in (direct, texts)]
    parts += [F.transform(forms("_printed"), lambda sp: item(sp, "derived", 0)), F.transform(bare, lambda sp: item(sp, "derived", 1)), F.transform(forms("_isos"), lambda sp: item(sp, "derived", 1))]
    return met.withColumn("found", F.when(words.isNull(), none).otherwise(F.flatten(F.array(*parts))))


SPAN = "array<struct<length:int,start:int,end:int,text:string>>"
PLACE = "array<struct<start:int,end:int>>"


def _chosen(fields: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """Evidence rows with `own`: true for those that count. With how = left, every field keeps a row at least."""
    met = _met(fields, lines, how)
    kept = [*fields.columns, "_want", "line_idx", "line", "ocr", "has"]
    rows = met.select(*kept, (F.explode_outer if how == "left" else F.explode)("found").alias("e")).select(*kept, "e.*")
    rows = rows.withColumn("_stage", F.min("stage").over(Window.partitionBy("doc_id", "key")))
    first = Window.partitionBy("doc_id", "key", "line_idx", "role", "start", "stage").orderBy("end")
    return rows.withColumn("_n", F.row_number().over(first)).withColumn("own", F.coalesce((F.col("stage") == F.col("_stage")) & (F.col("_n") == 1), F.lit(False)))


def evidence_of(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """All evidence: direct; dates also derived; without any, the verified forms. has: the line's label category."""
    return _chosen(fields, lines, "inner").filter("own").select(*fields.columns, "line_idx", "line", "ocr", "start", "end", "role", "has")


def _verdict(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, and verdict, factor, ocr and n_evidence of the rows that count: whether a line names the field's own category, another one, or none."""
    own = F.col("own")
    seen = rows.groupBy(*by, "_want").agg(
        F.coalesce(F.bool_or(own & (F.col("has") == F.col("_want"))), F.lit(False)).alias("_named"), F.coalesce(F.bool_or(own & F.col("has").isNotNull()), F.lit(False)).alias("_any"),
        F.avg(F.when(own, F.col("ocr"))).alias("ocr"), F.count_if(own).alias("n_evidence"),
    )
    free = F.col("_want").isNull() | F.col("_named")
    verdict = F.when(F.col("n_evidence") == 0, None).when(free, "ok").when(F.col("_any"), "conflict").otherwise("neutral")
    return seen.withColumns({"verdict": verdict, "factor": F.when(F.col("n_evidence") > 0, F.when(free, 1.0).otherwise(NEUTRAL))}).drop("_want", "_named", "_any")


def verdicts(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, key, verdict, factor, ocr, n_evidence) of the fields with evidence."""
    return _verdict(_chosen(fields, lines, "inner"), ["doc_id", "key"]).filter("n_evidence > 0")


def primary(evidence: DataFrame) -> DataFrame:
    """Every evidence row with its rank: own label first, then OCR confidence, then document order."""
    own = (F.col("has") == group_for_key(F.col("key"))).cast("int")
    score = F.coalesce(own, F.lit(0)) * LABEL_BONUS + F.coalesce("ocr", F.lit(0.0))
    best = Window.partitionBy("doc_id", "key").orderBy(F.desc("_score"), "line_idx", "start")
    return evidence.withColumn("_score", score).withColumn("rank", F.row_number().over(best)).drop("_score")


def composed_confidence(ai: Column, ocr: Column, factor: Column, has_evidence: Column) -> Column:
    raw = F.coalesce(ai, F.lit(DEFAULT_CONFIDENCE)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(ocr, F.lit(1.0)))) * factor * F.when(has_evidence, 1.0).otherwise(NO_EVIDENCE)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def ground(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """fields with n_evidence, verdict, confidence, reasons and dropped (why a field isn't kept, else null)."""
    out = _verdict(_chosen(fields, lines, "left"), fields.columns).withColumnRenamed("confidence", "ai")
    marked = lines.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(r"(?i)\b(egp|usd|sar|eur)\b")).alias("has_currency"), F.bool_or(F.lower("text").rlike("tax|vat|ضريب")).alias("has_tax"))
    out = out.join(marked, "doc_id", "left")
    n = F.coalesce("n_evidence", F.lit(0))
    is_currency = F.col("key") == "currency"
    confidence = F.when(is_currency, composed_confidence(F.col("ai"), F.lit(None).cast("double"), F.lit(NEUTRAL), F.lit(False))).otherwise(composed_confidence(F.col("ai"), F.col("ocr"), F.coalesce("factor", F.lit(1.0)), n > 0))
    out = out.withColumn("confidence", confidence)
    dropped = (
        F.when(T.trim_space(F.col("raw")) == "", "empty value")
        .when(is_currency & ~F.coalesce("has_currency", F.lit(False)), "currency not stated in document")
        .when(F.col("key").endswith("_tax_id") & ~F.coalesce("has_tax", F.lit(False)), "no tax identifier in document")
        .when((F.col("type") == "text") & (T.noise_score(F.col("raw")) > T.NOISE_THRESHOLD), "not clean text")
        .when(~is_currency & (n == 0), "not found in source text")
        .when(~is_currency & (F.col("verdict") == "conflict"), "value labeled for a different field")
        .when(F.col("confidence") < LEAST_CONFIDENCE, "confidence below threshold")
    )
    reasons = F.array_compact(F.array(F.when(n == 0, "no_direct_evidence"), F.when(F.coalesce("ocr", F.lit(1.0)) < LOW_OCR, "ocr_confidence_low"), F.when(F.coalesce("factor", F.lit(1.0)) < 1, "label_not_matched")))
    return out.withColumns({"dropped": dropped, "reasons": reasons, "n_evidence": n}).drop("has_currency", "has_tax")
