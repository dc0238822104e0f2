"""Queries of schema-driven reading (2.7 sx_*), of the inspector (ui_*) and of confidence components (2.9 cp_*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import fields as R
from docloom.plans.text import DIG, NORMAL
from docloom.registry import query
from docloom.sources.tables import fixture, with_fixtures

SCHEMA = {
    "invoice_number": R.label_tokens("invoice_number", "Invoice number", "number"), "total_amount": R.label_tokens("total_amount", "Total amount", "total"),
    "buyer_name": R.label_tokens("buyer_name", "Buyer / customer name", "buyer"), "payment_method": R.label_tokens("payment_method", "Payment method", "payment"),
}


def norm(x: str) -> str:
    return NORMAL.replace("translate(s,", f"translate({x},")


def q(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def has(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {norm(q(w))})" for w in words) + ")"


KEYS = "list_filter([" + ", ".join(f"CASE WHEN {has('nt', w)} THEN '{k}' END" for k, w in SCHEMA.items()) + "], lambda k: k IS NOT NULL)"
PIECE = "list_transform(regexp_split_to_array({}, '\\s+'), lambda t: regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))"
DIGITS = "len(regexp_extract_all({}, '[0-9]'))"
TOKEN = f"(SELECT arg_max(t, (n, -i)) FROM (SELECT unnest(pc) AS t, generate_subscripts(pc, 1) AS i, {DIGITS.format('unnest(pc)')} AS n) WHERE n > 1)"
BARE = "regexp_replace({}, '[^0-9.]', '', 'g')"
AS_NUMBER = "CASE WHEN " + BARE + " = '' THEN 0.0 ELSE TRY_CAST(" + BARE + " AS DOUBLE) END"


def match(a: str, b: str) -> str:
    na, nb = AS_NUMBER.format(a, a), AS_NUMBER.format(b, b)
    return f"CASE WHEN trim({a}) = '' THEN false WHEN ({na}) IS NOT NULL AND ({nb}) IS NOT NULL AND length({BARE.format(a)}) <= 14 THEN abs(({na}) - ({nb})) < 1e-6 ELSE regexp_replace({a}, '[^0-9]', '', 'g') = regexp_replace({b}, '[^0-9]', '', 'g') OR {norm(a)} = {norm(b)} END"


NEED = "CASE WHEN regexp_full_match(expected, '[0-9]{8,}') THEN length(expected) END"
WORD_HIT = "CASE key " + " ".join(f"WHEN '{k}' THEN {has('nw', w)}" for k, w in SCHEMA.items()) + " END"
BASE = f"""{with_fixtures('sheet', 'asked')}, s0 AS (SELECT *, {norm('text')} AS nt, {PIECE.format(DIG.format('text'))} AS pc FROM sheet),
s AS (SELECT * EXCLUDE (pc), {TOKEN} AS token FROM s0), lab0 AS (SELECT *, unnest({KEYS}) AS key FROM s), lab AS (SELECT l.*, a.expected FROM lab0 l JOIN asked a USING (doc_id, key)),
wd0 AS (SELECT doc_id, line_idx, text, conf, x, y, width, height, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM sheet),
wd AS (SELECT doc_id, line_idx, conf, k, word, x + width / length(text) * coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, y, width / length(text) * length(word) AS width, height FROM wd0),
anc AS (SELECT l.doc_id, l.key, l.expected, l.line_idx, w.x, w.y, w.width, w.height FROM lab l JOIN (SELECT *, {norm('word')} AS nw FROM wd) w USING (doc_id, line_idx) WHERE {WORD_HIT}),
cel AS (SELECT * FROM (SELECT * REPLACE ({DIG.format('word')} AS word) FROM wd) WHERE {DIGITS.format('word')} > 0 AND len(regexp_extract_all(word, '[0-9.,:/-]')) / length(word) >= 0.6),
m AS (SELECT a.doc_id, a.key, a.expected, a.line_idx AS label_line, b.token AS value, b.line_idx AS value_line, -1 AS value_word, b.conf, a.line_idx = b.line_idx AS same, abs(a.y + a.height / 2 - b.y - b.height / 2) <= 24 OR greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) >= 0.5 * least(a.height, b.height) AS lev, b.y - a.y - a.height AS below FROM lab a JOIN s b USING (doc_id) WHERE b.token IS NOT NULL),
every AS (SELECT * EXCLUDE (same, lev, below), 'inline_label' AS alignment, 30 AS tier FROM m WHERE same UNION ALL SELECT * EXCLUDE (same, lev, below), 'same_line', 20 FROM m WHERE NOT same AND lev UNION ALL SELECT * EXCLUDE (same, lev, below), 'adjacent_below', 10 FROM m WHERE NOT same AND below BETWEEN 0 AND 48
  UNION ALL SELECT DISTINCT a.doc_id, a.key, a.expected, a.line_idx, b.word, b.line_idx, b.k, b.conf, 'column_below', 15 FROM anc a JOIN cel b USING (doc_id) WHERE a.line_idx <> b.line_idx AND b.y - a.y - a.height BETWEEN 0 AND 120 AND greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) / greatest(1.0, least(a.width, b.width)) >= 0.35),
cand AS (SELECT *, tier + CASE WHEN coalesce({match('expected', 'value')}, false) THEN 100 ELSE 0 END AS score FROM every WHERE ({NEED}) IS NULL OR {DIGITS.format('value')} = ({NEED})),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY score DESC, alignment DESC, label_line, value_line, value_word) AS n FROM cand) WHERE n = 1),
nl AS (SELECT doc_id, key, count(*) AS labels FROM lab0 GROUP BY 1, 2),
br AS (SELECT a.doc_id, a.key, arg_min(s.token, s.line_idx) AS bare FROM asked a JOIN s USING (doc_id) WHERE a.expected IS NOT NULL AND s.token IS NOT NULL AND (({NEED}) IS NULL OR {DIGITS.format('token')} = ({NEED})) AND {match('expected', 'token')} GROUP BY 1, 2),
cf AS (SELECT a.doc_id, a.key, a.expected, t.value, t.conf, t.n IS NOT NULL AS aligned, coalesce(labels, 0) > 0 AS named, bare FROM asked a LEFT JOIN top t USING (doc_id, key) LEFT JOIN nl USING (doc_id, key) LEFT JOIN br USING (doc_id, key)),
cr AS (SELECT *, CASE WHEN aligned AND expected IS NOT NULL AND NOT coalesce({match('expected', 'value')}, true) THEN 'value_mismatch_expected' WHEN aligned AND conf < 0.6 THEN 'low_confidence' WHEN aligned THEN '' WHEN bare IS NOT NULL THEN CASE WHEN named THEN 'label_value_gap_too_large' ELSE 'value_without_label' END WHEN named AND ({NEED}) IS NOT NULL THEN 'no_valid_length_value' ELSE '' END AS reason FROM cf),
cs AS (SELECT *, CASE WHEN aligned AND reason = '' THEN 'VERIFIED' WHEN aligned OR bare IS NOT NULL THEN 'UNCERTAIN' ELSE 'MISSING' END AS state FROM cr),
dv0 AS (SELECT doc_id, count(*) FILTER (state = 'VERIFIED') AS verified, count(*) FILTER (state = 'UNCERTAIN') AS uncertain, count(*) FILTER (state = 'MISSING') AS missing, avg(named::INT) AS coverage, avg(CASE state WHEN 'VERIFIED' THEN coalesce(conf, 1.0) WHEN 'UNCERTAIN' THEN 0.35 ELSE 0.0 END) AS mean, count(*) AS total FROM cs GROUP BY 1),
dv AS (SELECT *, concat_ws(',', CASE WHEN coverage = 0 AND verified = 0 THEN 'no_schema_labels_in_document' END, CASE WHEN missing / total >= 0.75 AND coverage < 0.5 THEN 'most_fields_missing_without_labels' END) AS reasons FROM dv0)"""


def parts(spark, sf_dir):
    return fixture(spark, sf_dir, "sheet"), fixture(spark, sf_dir, "asked")


@query("sx_label_tokens", f"{BASE} SELECT doc_id, line_idx, key FROM lab0")
def sx_label_tokens(spark, sf_dir):
    """Lines that hold a label word of a schema field."""
    return R.labelled(parts(spark, sf_dir)[0], SCHEMA).select("doc_id", "line_idx", "key")


@query("sx_expected_length", f"{BASE} SELECT doc_id, key, ({NEED})::INTEGER AS digits FROM asked")
def sx_expected_length(spark, sf_dir):
    return parts(spark, sf_dir)[1].select("doc_id", "key", R.expected_length(F.col("expected")).alias("digits"))


@query("sx_values_match", f"{BASE} SELECT doc_id, key, line_idx, token, {match('expected', 'token')} AS equal FROM asked JOIN s USING (doc_id) WHERE expected IS NOT NULL AND token IS NOT NULL")
def sx_values_match(spark, sf_dir):
    """Asked values and the numbers of their documents: whether they are equal."""
    lines, asked = parts(spark, sf_dir)
    numbers = lines.select("doc_id", "line_idx", R.number_token(F.col("text")).alias("token")).filter("token IS NOT NULL")
    return asked.filter("expected IS NOT NULL").join(numbers, "doc_id").select("doc_id", "key", "line_idx", "token", R.values_match(F.col("expected"), F.col("token")).alias("equal"))


def tier_query(name: str, alignment: str):
    @query(name, f"{BASE} SELECT doc_id, key, label_line, value, value_line, value_word::INTEGER AS value_word FROM cand WHERE alignment = '{alignment}'")
    def run(spark, sf_dir):
        lines, asked = parts(spark, sf_dir)
        return R.candidates(lines, SCHEMA, asked).filter(F.col("alignment") == alignment).select("doc_id", "key", "label_line", "value", "value_line", "value_word")


for _name, _alignment in (("sx_inline", "inline_label"), ("sx_same_line", "same_line"), ("sx_column_below", "column_below"), ("sx_adjacent_below", "adjacent_below")):
    tier_query(_name, _alignment)


@query("sx_best", f"{BASE} SELECT doc_id, key, label_line, value, value_line, alignment, score::INTEGER AS score FROM top")
def sx_best(spark, sf_dir):
    lines, asked = parts(spark, sf_dir)
    return R.best(R.candidates(lines, SCHEMA, asked)).select("doc_id", "key", "label_line", "value", "value_line", "alignment", "score")


@query("sx_classify", f"{BASE} SELECT doc_id, key, state, coalesce(value, bare) AS value, reason FROM cs")
def sx_classify(spark, sf_dir):
    lines, asked = parts(spark, sf_dir)
    return R.classified(lines, SCHEMA, asked).select("doc_id", "key", "state", "value", "reason")


def verdicts(spark, sf_dir):
    lines, asked = parts(spark, sf_dir)
    return R.document_verdict(R.classified(lines, SCHEMA, asked))


@query("sx_document", f"{BASE} SELECT doc_id, verified::BIGINT AS verified, uncertain::BIGINT AS uncertain, missing::BIGINT AS missing, round(coverage, 6)::DOUBLE AS coverage FROM dv")
def sx_document(spark, sf_dir):
    return verdicts(spark, sf_dir).select("doc_id", "verified", "uncertain", "missing", F.round("coverage", 6).alias("coverage"))


@query("sx_schema_fit", f"{BASE} SELECT doc_id, reasons = '' AS matched, reasons FROM dv")
def sx_schema_fit(spark, sf_dir):
    return verdicts(spark, sf_dir).select("doc_id", (F.col("reasons") == "").alias("matched"), "reasons")


@query("sx_final", f"{BASE} SELECT doc_id, verified::BIGINT AS committed, (uncertain + missing)::BIGINT AS issues, (CASE WHEN reasons = '' THEN floor(mean * 100 + 0.5 + 1e-9) / 100 ELSE least(0.3, floor(mean * 100 + 0.5 + 1e-9) / 100) END)::DOUBLE AS overall FROM dv")
def sx_final(spark, sf_dir):
    return verdicts(spark, sf_dir).select("doc_id", F.col("verified").alias("committed"), (F.col("uncertain") + F.col("missing")).alias("issues"), "overall")


# Region types to search first, by a pattern of the key; the first match counts.
KEY_RULES = [
    (r"(invoice_number|receipt_number|document_number|transaction|reference|_no$|_number|_date|issue_date|due_date|merchant|seller|vendor|supplier|buyer|customer|client|company|address|tax_id|vat)", ["header", "form_field"]),
    (r"(line_items|^items$|line_item|product|item)", ["body", "table"]),
    (r"(total|subtotal|amount|tax_amount|discount|shipping|grand|balance|due)", ["footer", "table"]),
    (r"(payment|iban|bank|account|pay_|pos_|terminal)", ["footer"]),
    (r"(notes|terms|remarks|comment|conditions)", ["body"]),
    (r"(signature|signed|authori[sz]e|stamp)", ["signature_zone"]),
]
RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(key, '{p}') THEN '{','.join(t)}'" for p, t in KEY_RULES) + " ELSE '' END"


def region_types():
    out = F.lit("")
    for pattern, types in reversed(KEY_RULES):
        out = F.when(F.col("key").rlike(pattern), ",".join(types)).otherwise(out)
    return out


@query("sx_scope_rules", f"{with_fixtures('candidates')} SELECT doc_id, key, {RULES_SQL} AS types, CASE WHEN {RULES_SQL} = '' THEN 1 ELSE 5 END::INTEGER AS scopes FROM candidates")
def sx_scope_rules(spark, sf_dir):
    f = fixture(spark, sf_dir, "candidates").select("doc_id", "key", region_types().alias("types"))
    return f.withColumn("scopes", F.when(F.col("types") == "", 1).otherwise(5))


LADDER = f"""{with_fixtures('sheet', 'candidates')}, f AS (SELECT doc_id, key, {norm('raw')} AS needle, {RULES_SQL} AS types FROM candidates WHERE trim(raw) <> ''),
an AS (SELECT f.doc_id, f.key, min(s.line_idx) AS lo, max(s.line_idx) AS hi, list(DISTINCT s.block) AS blocks, list(DISTINCT s.page) AS pages FROM f JOIN sheet s ON s.doc_id = f.doc_id AND list_contains(string_split(f.types, ','), s.region) GROUP BY 1, 2),
mt AS (SELECT f.doc_id, f.key, CASE WHEN f.types = '' THEN 4 WHEN list_contains(string_split(f.types, ','), s.region) THEN 0 WHEN s.line_idx BETWEEN an.lo - 3 AND an.hi + 3 THEN 1 WHEN list_contains(an.blocks, s.block) THEN 2 WHEN list_contains(an.pages, s.page) THEN 3 ELSE 4 END AS rank FROM f JOIN sheet s ON s.doc_id = f.doc_id AND contains({norm('s.text')}, f.needle) LEFT JOIN an ON an.doc_id = f.doc_id AND an.key = f.key)"""


@query("sx_ladder", f"{LADDER} SELECT doc_id, key, min(rank)::INTEGER AS rank, count(*) FILTER (rank = least_)::BIGINT AS n FROM (SELECT *, min(rank) OVER (PARTITION BY doc_id, key) AS least_ FROM mt) GROUP BY 1, 2")
def sx_ladder(spark, sf_dir):
    """The first scope with a matching line: the field's regions, lines near them, their blocks, their pages, the document."""
    lines = fixture(spark, sf_dir, "sheet").withColumn("nt", T.normalize(F.col("text")))
    f = fixture(spark, sf_dir, "candidates").filter(F.trim("raw") != "").select("doc_id", "key", T.normalize(F.col("raw")).alias("needle"), region_types().alias("types"))
    inside = F.coalesce(F.array_contains(F.split("types", ","), F.col("region")), F.lit(False))
    hits = F.col("nt").contains(F.col("needle"))
    anchor = lambda c: F.when(F.col("_in"), F.col(c))
    # Only lines of a field's regions and lines that hold it tell anything, so no other pair goes on; a field's are gathered without ordering them.
    met = f.join(lines.select("doc_id", "line_idx", "nt", "region", "block", "page").hint("merge"), "doc_id").withColumns({"_in": inside, "_hit": hits}).filter("_in or _hit")
    line = F.when(F.col("_hit"), F.struct("line_idx", "block", "page", "_in"))
    of = met.groupBy("doc_id", "key", "types").agg(F.min(anchor("line_idx")).alias("lo"), F.max(anchor("line_idx")).alias("hi"), F.collect_set(anchor("block")).alias("blocks"), F.collect_set(anchor("page")).alias("pages"), F.collect_list(line).alias("_lines"))
    near = lambda s: s["line_idx"].between(F.col("lo") - 3, F.col("hi") + 3)
    rank = lambda s: F.when(F.col("types") == "", 4).when(s["_in"], 0).when(near(s), 1).when(F.array_contains("blocks", s["block"]), 2).when(F.array_contains("pages", s["page"]), 3).otherwise(4)
    ranks = of.filter(F.size("_lines") > 0).select("doc_id", "key", F.transform("_lines", rank).alias("_ranks")).withColumn("rank", F.array_min("_ranks"))
    return ranks.select("doc_id", "key", "rank", F.size(F.filter("_ranks", lambda r: r == F.col("rank"))).cast("long").alias("n"))


@query("sx_document_text", f"{with_fixtures('sheet')}, g AS (SELECT *, CASE WHEN region IS NULL THEN 1000000 ELSE min(line_idx) OVER (PARTITION BY doc_id, region) END AS first_ FROM sheet) SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY first_, line_idx)) AS digest FROM g WHERE text <> '' GROUP BY 1")
def sx_document_text(spark, sf_dir):
    """A document's text by region in reading order; lines without a region come last."""
    first = F.when(F.col("region").isNull(), 1000000).otherwise(F.min("line_idx").over(Window.partitionBy("doc_id", "region")))
    g = fixture(spark, sf_dir, "sheet").filter("text <> ''").withColumn("first", first)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "line_idx", "text"))), lambda s: s["text"])
    return g.groupBy("doc_id").agg(F.md5(F.array_join(ordered, "\n")).alias("digest"))


# Components of a word's confidence and whether each was measured.
PARTS = {"ocr": ("confidence", "true"), "geometric": ("least(1.0, width / 100)", "word_idx % 2 = 0"), "placed": ("1.0 / line_idx", "line_idx > 1"), "boundary": ("least(1.0, x / 500)", "width > 40")}
COMPONENTS = "SELECT doc_id, line_idx, word_idx, width * height AS weight, " + ", ".join(f"CAST(CASE WHEN {m} THEN {v} ELSE 0.0 END AS DOUBLE) AS {n}, {m} AS has_{n}" for n, (v, m) in PARTS.items()) + " FROM {boxes}"
COMP = f"{with_fixtures('boxes')}, c AS ({COMPONENTS.replace('{boxes}', 'boxes')})"


def components(spark, sf_dir):
    return spark.sql(COMPONENTS, boxes=fixture(spark, sf_dir, "boxes"))


def stats_sql(keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS component, count(*)::BIGINT AS n, round(avg({n}), 9) AS mean, round(var_pop({n}), 9) AS variance, min({n}) AS least, max({n}) AS most, bool_or(has_{n}) AS measured FROM c GROUP BY {keys}" for n in PARTS)


@query("cp_distribution", f"{COMP} {stats_sql('doc_id')}")
def cp_distribution(spark, sf_dir):
    """Distribution of every component over a document's words, and whether any of them measured it."""
    long = components(spark, sf_dir).select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("component"), F.col(n).alias("v"), F.col(f"has_{n}").alias("has")) for n in PARTS))).alias("p")).select("doc_id", "p.*")
    return long.groupBy("doc_id", "component").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.var_pop("v"), 9).alias("variance"), F.min("v").alias("least"), F.max("v").alias("most"), F.bool_or("has").alias("measured"))


@query("cp_aggregate", f"{COMP} SELECT doc_id, line_idx, {', '.join(f'round(sum({n} * weight) / sum(weight), 9) AS {n}, bool_or(has_{n}) AS has_{n}' for n in PARTS)} FROM c GROUP BY 1, 2")
def cp_aggregate(spark, sf_dir):
    """Components of a line: means of its words', weighted by area; measured where any word's was."""
    aggs = [x for n in PARTS for x in (F.round(F.sum(F.col(n) * F.col("weight")) / F.sum("weight"), 9).alias(n), F.bool_or(f"has_{n}").alias(f"has_{n}"))]
    return components(spark, sf_dir).groupBy("doc_id", "line_idx").agg(*aggs)


MEAN_SQL = " + ".join(f"CASE WHEN has_{n} THEN {n} ELSE 0 END" for n in PARTS), " + ".join(f"has_{n}::INT" for n in PARTS)


def measured_mean():
    """Mean of the measured components only, 0 where none is."""
    total = sum((F.when(F.col(f"has_{n}"), F.col(n)).otherwise(0.0) for n in PARTS), F.lit(0.0))
    count = sum((F.col(f"has_{n}").cast("int") for n in PARTS), F.lit(0))
    return F.when(count == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / count)))


@query("cp_composite", f"{COMP} SELECT doc_id, line_idx, word_idx, round(CASE WHEN ({MEAN_SQL[1]}) = 0 THEN 0 ELSE ({MEAN_SQL[0]}) / ({MEAN_SQL[1]}) END, 6)::DOUBLE AS score FROM c")
def cp_composite(spark, sf_dir):
    return components(spark, sf_dir).select("doc_id", "line_idx", "word_idx", F.round(measured_mean(), 6).alias("score"))


@query("sx_combine_conf", f"{COMP}, d AS (SELECT doc_id, {', '.join(f'avg({n}) AS {n}, bool_or(has_{n}) AS has_{n}' for n in PARTS)} FROM c GROUP BY 1) SELECT doc_id, round(({MEAN_SQL[0]}) / ({MEAN_SQL[1]}) + 1e-9, 6)::DOUBLE AS confidence FROM d")
def sx_combine_conf(spark, sf_dir):
    d = components(spark, sf_dir).groupBy("doc_id").agg(*(x for n in PARTS for x in (F.avg(n).alias(n), F.bool_or(f"has_{n}").alias(f"has_{n}"))))
    return d.select("doc_id", F.round(measured_mean() + 1e-9, 6).alias("confidence"))


NORMED = f"{with_fixtures('boxes')}, nb AS (SELECT doc_id, line_idx, word_idx, round(y / 400 * 1000, 6)::DOUBLE AS ymin, round(x / 600 * 1000, 6)::DOUBLE AS xmin, round((y + height) / 400 * 1000, 6)::DOUBLE AS ymax, round((x + width) / 600 * 1000, 6)::DOUBLE AS xmax FROM boxes)"


def normed(spark, sf_dir):
    part = lambda v, size: F.round(v / size * 1000, 6)
    c = F.col
    return fixture(spark, sf_dir, "boxes").select("doc_id", "line_idx", "word_idx", part(c("y"), 400).alias("ymin"), part(c("x"), 600).alias("xmin"), part(c("y") + c("height"), 400).alias("ymax"), part(c("x") + c("width"), 600).alias("xmax"), "text")


@query("ui_norm_box", f"{NORMED} SELECT * FROM nb")
def ui_norm_box(spark, sf_dir):
    """Boxes of a page of 600 by 400 px in the space of 0 to 1000."""
    return normed(spark, sf_dir).drop("text")


@query("ui_find_box", f"{NORMED} SELECT doc_id, min((line_idx, word_idx))[1]::INTEGER AS line_idx, min((line_idx, word_idx))[2]::INTEGER AS word_idx FROM nb WHERE doc_id * 37 % 1000 BETWEEN xmin AND xmax AND doc_id * 11 % 400 BETWEEN ymin AND ymax GROUP BY 1")
def ui_find_box(spark, sf_dir):
    """The first box of each document, in overlay order, that holds the point asked for."""
    x, y = F.col("doc_id") * 37 % 1000, F.col("doc_id") * 11 % 400
    hit = normed(spark, sf_dir).filter(x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax")))
    return hit.groupBy("doc_id").agg(F.min(F.struct("line_idx", "word_idx")).alias("b")).select("doc_id", "b.*")


def quote_span(words, quote):
    """(start, end, cover): the words that spell the beginning of the quote, from the start that covers most of it; null below 60 %.

    From each start, words that go on with the quote are taken and others passed over; an empty word ends the run."""
    flat = lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))
    target = flat(quote)

    def step(a, w):
        joined = F.when(a["acc"] == "", w["t"]).otherwise(F.concat(a["acc"], F.lit(" "), w["t"]))
        stop = a["stop"] | (w["t"] == "")
        take = ~stop & target.startswith(joined)
        return F.struct(F.when(take, joined).otherwise(a["acc"]).alias("acc"), F.when(take & (a["acc"] == ""), w["k"]).otherwise(a["start"]).alias("start"), F.when(take, w["k"]).otherwise(a["end"]).alias("end"), (stop | (take & (F.char_length(joined) >= F.char_length(target)))).alias("stop"))

    numbered = F.transform(words, lambda w, k: F.struct(flat(w).alias("t"), k.alias("k")))
    begin = F.struct(F.lit("").alias("acc"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(False).alias("stop"))
    runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda s: F.aggregate(F.slice(numbered, s, F.size(words)), begin, step, lambda a: F.struct((-F.least(F.lit(1.0), F.char_length(a["acc"]) / F.char_length(target))).alias("cover"), a["start"].alias("start"), a["end"].alias("end"))))
    best = F.array_min(F.filter(runs, lambda r: r["start"] >= 0))
    return F.when((F.size(words) > 0) & (target != "") & (best["cover"] <= -0.6), F.struct(best["start"].alias("start"), best["end"].alias("end"), (-best["cover"]).alias("cover")))


@query("ui_match_quote")
def ui_match_quote(spark, sf_dir):
    """Words of each rendered line that a quote cut from it covers; tested against a plain loop."""
    s = fixture(spark, sf_dir, "sheet").withColumn("quote", F.expr("substring(text, 1 + CAST(doc_id % 5 AS INT), 12)"))
    return s.select("doc_id", "line_idx", quote_span(F.split("text", " "), F.col("quote")).alias("m")).filter("m IS NOT NULL").select("doc_id", "line_idx", "m.*")
