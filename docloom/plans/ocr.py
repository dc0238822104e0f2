"""Queries of OCR quality and numeric verification (inventory 2.10) and of spatial label reading (2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import ocr as O
from docloom.operators.quotes import holding
from docloom.plans.grounding import OCR, label_sql
from docloom.plans.text import GARBAGE, CONSISTENT, PRINTABLE, QUALITY, REPEATED
from docloom.registry import query
from docloom.sources.tables import fixture, table, with_fixtures

NOISE = f"CASE WHEN {GARBAGE} IS NOT NULL THEN 1.0 ELSE least(1.0, greatest(0.0, (1 - {PRINTABLE}) * 0.3 + (1 - {CONSISTENT}) * 0.25 + (1 - {QUALITY}) * 0.25 + {REPEATED} * 0.1)) END".replace("TXT", "text")
NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
DUP = f"""{with_fixtures('rendered')}, lines AS (SELECT doc_id, line_idx, text, {OCR} AS ocr, (20 * line_idx)::DOUBLE AS y, (10 + line_idx % 3)::DOUBLE AS height FROM rendered),
nl AS (SELECT doc_id, line_idx, norm, list_distinct(string_split(norm, ' ')) AS ws FROM (SELECT doc_id, line_idx, {NORM} AS norm FROM lines) WHERE norm <> ''),
near AS (SELECT DISTINCT a.doc_id FROM nl a JOIN nl b ON a.doc_id = b.doc_id AND a.line_idx < b.line_idx WHERE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.9),
dup AS (SELECT doc_id, CASE WHEN count(*) >= 4 AND bool_or(doc_id IN (SELECT doc_id FROM near)) THEN 1.0 / count(*) ELSE 0.0 END AS duplicate FROM nl GROUP BY 1)"""
METRICS = f"""{DUP}, m0 AS (SELECT doc_id, count(*) AS lines, sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS chars, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))) AS words, min(y) AS top, max(y + height) AS bottom, median(height) AS line_height, avg(ocr) AS mean_conf,
  avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0 END) AS numeric_, avg(CASE WHEN {NOISE} > 0.55 THEN 1.0 ELSE 0 END) AS noise, avg(CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) <= 2 THEN 1.0 ELSE 0 END) AS fragmentation,
  len(list_distinct(regexp_extract_all(string_agg(regexp_replace(text, '\\s+', '', 'g'), ''), '.'))) AS uniq FROM lines GROUP BY 1),
m AS (SELECT m0.*, duplicate, uniq / chars AS diversity, (bottom - top) / (300.0 + doc_id % 7 * 100) AS coverage, (bottom - top) / greatest(1.0, 100.0 + doc_id % 9 * 30) AS relative, greatest(0.0, (100.0 + doc_id % 9 * 30 - bottom) / greatest(1.0, 100.0 + doc_id % 9 * 30)) AS bottom_gap,
  lines / greatest(1, floor(greatest(1.0, 100.0 + doc_id % 9 * 30) / (line_height * 1.8))) AS density, greatest(1.0, 100.0 + doc_id % 9 * 30) / (300.0 + doc_id % 7 * 100) AS ink_ratio FROM m0 JOIN dup USING (doc_id)),
sg AS (SELECT *, lines <= 2 OR chars < 25 AS s1, relative < 0.6 AND coalesce(mean_conf >= 0.7, false) AS s2, bottom_gap > 0.35 AND numeric_ >= 0.4 AS s3, noise > 0.4 AS s4, duplicate > 0.3 AND lines >= 5 AS s5, diversity < 0.3 AND chars >= 40 AS s6, density < 0.5 AS s7 FROM m),
cl AS (SELECT *, CASE WHEN ink_ratio < 0.25 THEN s1 OR s4 OR s6 ELSE s1::INT + s2::INT + s3::INT + s4::INT + s5::INT + s6::INT >= 2 END AS suspicious,
  CASE WHEN ink_ratio < 0.25 AND NOT (s1 OR s4 OR s6) THEN '' ELSE concat_ws(',', CASE WHEN s1 THEN 'lines' END, CASE WHEN s2 THEN 'truncation' END, CASE WHEN s3 THEN 'bottom' END, CASE WHEN s4 THEN 'noise' END, CASE WHEN s5 THEN 'duplicates' END, CASE WHEN s6 THEN 'garbage' END, CASE WHEN s7 THEN 'lowDensity' END) END AS signals FROM sg)"""


def lines(spark, sf_dir):
    ocr = F.when(F.col("doc_id") % 3 != 0, ((F.col("line_idx") * 7 + F.col("doc_id")) % 10) / 10)
    return fixture(spark, sf_dir, "rendered").withColumns({"ocr": ocr, "y": (20 * F.col("line_idx")).cast("double"), "height": (10 + F.col("line_idx") % 3).cast("double")})


def metrics(spark, sf_dir):
    k = F.col("doc_id")
    return O.with_image(O.document_metrics(lines(spark, sf_dir)), F.lit(0.0), (100 + k % 9 * 30).cast("double"), (300 + k % 7 * 100).cast("double"))


@query("oq_duplicate_ratio", f"{DUP} SELECT doc_id, round(duplicate::DOUBLE, 6) AS duplicate FROM dup")
def oq_duplicate_ratio(spark, sf_dir):
    return O.duplicates(lines(spark, sf_dir)).select("doc_id", F.round("duplicate", 6).alias("duplicate"))


@query("oq_doc_metrics", f"{METRICS} SELECT doc_id, lines::BIGINT AS lines, chars::BIGINT AS chars, words::BIGINT AS words, round(coverage::DOUBLE, 9) AS coverage, round(relative::DOUBLE, 9) AS relative, round(bottom_gap::DOUBLE, 9) AS bottom_gap, round(density::DOUBLE, 9) AS density, round(mean_conf::DOUBLE, 9) AS mean_conf, round(noise::DOUBLE, 9) AS noise, round(diversity::DOUBLE, 9) AS diversity, round(fragmentation::DOUBLE, 9) AS fragmentation FROM m")
def oq_doc_metrics(spark, sf_dir):
    names = ("coverage", "relative", "bottom_gap", "density", "mean_conf", "noise", "diversity", "fragmentation")
    return metrics(spark, sf_dir).select("doc_id", "lines", "chars", "words", *(F.round(F.col(n).cast("double"), 9).alias(n) for n in names))


@query("oq_collapse", f"{METRICS} SELECT doc_id, signals, suspicious FROM cl")
def oq_collapse(spark, sf_dir):
    return O.collapse(metrics(spark, sf_dir)).select("doc_id", F.array_join("signals", ",").alias("signals"), "suspicious")


@query("oq_score", f"{METRICS} SELECT doc_id, round(least(1.0, greatest(0.0, 0.25 * coverage + 0.1 * least(1.0, density) + 0.1 * least(1.0, words / 40) + 0.2 * coalesce(mean_conf, 0.0) + 0.1 * numeric_ + 0.1 * (1 - noise) + 0.05 * (1 - duplicate) + 0.05 * diversity + 0.05 * (1 - fragmentation)))::DOUBLE, 6) AS score FROM m")
def oq_score(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return m.select("doc_id", F.round(O.score(m), 6).alias("score"))


@query("oq_plan", f"{METRICS} SELECT doc_id, CASE WHEN signals LIKE '%lowDensity%' OR signals LIKE '%truncation%' OR signals LIKE '%lines%' OR signals LIKE '%bottom%' THEN 'psm11,psm6' ELSE '' END AS plan FROM cl")
def oq_plan(spark, sf_dir):
    return O.collapse(metrics(spark, sf_dir)).select("doc_id", F.array_join(O.plan(F.col("signals")), ",").alias("plan"))


ATTEMPTS = "SELECT l_orderkey AS doc_id, l_linenumber - 1 AS ord, max(l_discount * 10) AS score, max(l_quantity) * 40 AS cost FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


def attempts(spark, sf_dir):
    return spark.sql(ATTEMPTS, lineitem=table(spark, sf_dir, "lineitem"))


TRIED = f"WITH a AS ({ATTEMPTS.replace('{lineitem}', 'lineitem')})"


@query("oq_select", f"{TRIED}, b AS (SELECT doc_id, score AS base FROM a WHERE ord = 0), t AS (SELECT doc_id, max((score, -ord)) AS best FROM a WHERE ord BETWEEN 1 AND 3 GROUP BY 1) SELECT doc_id, CASE WHEN coalesce(best[1] >= base + 0.08, false) THEN -best[2] ELSE 0 END::INTEGER AS winner, round(CASE WHEN coalesce(best[1] >= base + 0.08, false) THEN best[1] ELSE base END, 6) AS score FROM b LEFT JOIN t USING (doc_id)")
def oq_select(spark, sf_dir):
    return O.select_attempt(attempts(spark, sf_dir)).select("doc_id", F.col("winner").cast("int").alias("winner"), F.round("score", 6).alias("score"))


@query("oq_better", f"{TRIED} SELECT doc_id, CASE WHEN max(CASE WHEN ord = 1 THEN score END) > max(CASE WHEN ord = 0 THEN score END) THEN 'preprocessed' ELSE 'raw' END AS better FROM a GROUP BY 1")
def oq_better(spark, sf_dir):
    of = lambda k: F.max(F.when(F.col("ord") == k, F.col("score")))
    return attempts(spark, sf_dir).groupBy("doc_id").agg(F.when(of(1) > of(0), "preprocessed").otherwise("raw").alias("better"))


BOX = with_fixtures("boxes")
IS_NUMBER = "len(regexp_extract_all(text, '[0-9]')) >= 4 AND len(regexp_extract_all(text, '[0-9]')) / length(text) >= 0.6 AND len(regexp_extract_all(text, '[^0-9.,:/-]')) <= 2"


FRAG = with_fixtures("fragments")
KIND = "CASE k % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'amount' ELSE 'date' END"
S = "regexp_replace(s, '\\s+', '', 'g')"
D3 = "regexp_extract({}, '([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{2,4}})', {})"


def status_sql(kind: str, x: str) -> str:
    return f"""CASE WHEN {x} = '' THEN 'invalid' WHEN {kind} = 'number' THEN CASE WHEN regexp_matches({x}, '[^0-9]') THEN 'invalid' WHEN length({x}) BETWEEN 6 AND 20 THEN 'valid' WHEN length({x}) BETWEEN 3 AND 5 OR length({x}) BETWEEN 21 AND 25 THEN 'ambiguous' ELSE 'invalid' END
WHEN {kind} = 'amount' THEN CASE WHEN regexp_matches({x}, '[A-Za-z]') THEN 'invalid' WHEN regexp_matches({x}, '^[0-9]{{1,9}}([.,][0-9]{{1,2}})?$') OR regexp_matches({x}, '^[0-9]{{1,3}}([.,][0-9]{{3}})+([.,][0-9]{{1,2}})?$') THEN 'valid' WHEN regexp_matches({x}, '[0-9]') THEN 'ambiguous' ELSE 'invalid' END
ELSE CASE WHEN {D3.format(x, 1)} = '' THEN 'ambiguous' WHEN TRY_CAST({D3.format(x, 1)} AS INT) BETWEEN 1 AND 31 AND TRY_CAST({D3.format(x, 2)} AS INT) BETWEEN 1 AND 12 THEN 'valid' ELSE 'invalid' END END"""


def kind_of():
    return F.when(F.col("k") % 3 == 0, "number").when(F.col("k") % 3 == 1, "amount").otherwise("date")


@query("nv_validate", f"{FRAG}, x AS (SELECT k, {S} AS v FROM fragments) SELECT k, {status_sql(KIND, 'v')} AS status FROM x")
def nv_validate(spark, sf_dir):
    return fixture(spark, sf_dir, "fragments").select("k", O.number_status(kind_of(), F.col("s")).alias("status"))


READ = "SELECT l_orderkey AS k, CAST(l_partkey * 1009 AS STRING) AS a, CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 5 = 1 THEN CAST(l_partkey * 1009 AS STRING) WHEN l_suppkey % 5 = 2 THEN '12x' WHEN l_suppkey % 5 = 3 THEN '1234' ELSE CAST(l_partkey * 1013 AS STRING) END AS b, CAST(1 - l_discount * 5 AS DOUBLE) AS ac, CAST(l_quantity / 50 AS DOUBLE) AS bc FROM {lineitem}"
DECIDE = f"""WITH x AS ({READ.replace('{lineitem}', 'lineitem')}), y AS (SELECT *, {status_sql("'number'", 'a')} AS sa, CASE WHEN b IS NOT NULL THEN {status_sql("'number'", 'b')} END AS sb FROM x),
z AS (SELECT *, CASE WHEN b IS NULL THEN 'verifier_unusable' WHEN sb = 'invalid' THEN 'verifier_invalid' WHEN sa = 'valid' AND sb = 'valid' AND a = b THEN 'primary_valid_verifier_agrees' WHEN sb = 'ambiguous' THEN 'verifier_ambiguous' WHEN bc < 0.5 THEN 'verifier_low_confidence'
WHEN sa = 'invalid' AND sb = 'valid' THEN 'primary_invalid_verifier_valid' WHEN sa = 'valid' AND sb = 'valid' AND bc >= 0.85 AND bc >= ac + 0.2 THEN 'verifier_clearly_stronger_evidence' WHEN sa = 'valid' AND sb = 'valid' THEN 'no_decisive_evidence' WHEN sa = 'ambiguous' THEN 'primary_ambiguous_no_replacement' ELSE 'no_decision' END AS reason FROM y)"""


def decided(spark, sf_dir):
    r = spark.sql(READ, lineitem=table(spark, sf_dir, "lineitem"))
    r = r.withColumns({"sa": O.number_status(F.lit("number"), F.col("a")), "sb": O.number_status(F.lit("number"), F.col("b"))})
    return r.withColumn("reason", O.verify(F.col("a"), F.col("ac"), F.col("sa"), F.col("b"), F.col("bc"), F.col("sb")))


@query("nv_decide", f"{DECIDE} SELECT k, reason, count(*)::BIGINT AS n FROM z GROUP BY 1, 2")
def nv_decide(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("k", "reason").agg(F.count("*").alias("n"))


@query("nv_apply", f"{DECIDE} SELECT k, a, CASE WHEN reason IN ('primary_invalid_verifier_valid', 'verifier_clearly_stronger_evidence') THEN b ELSE a END AS v FROM z")
def nv_apply(spark, sf_dir):
    return decided(spark, sf_dir).select("k", "a", F.when(F.col("reason").isin(*O.USED), F.col("b")).otherwise(F.col("a")).alias("v"))


@query("ev_hits", "SELECT b.item_id, count(d.doc_id)::BIGINT AS hits FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def ev_hits(spark, sf_dir):
    """Documents that hold a whole benchmark text; what meets on its inner words is tested as it is."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = holding(table(spark, sf_dir, "documents").select("doc_id", "text"), items).filter(F.col("text").contains(F.col("quote")))
    return items.select("item_id").join(met.groupBy("item_id").agg(F.count("*").alias("hits")), "item_id", "left").fillna(0, ["hits"])


READINGS = "SELECT l_orderkey AS doc_id, l_returnflag AS corpus, l_discount <= 0.05 AS first_ok, l_tax <= 0.05 AS second_ok FROM {lineitem}"


@query("ev_confusion", f"WITH r AS ({READINGS.replace('{lineitem}', 'lineitem')}), c AS (SELECT corpus, count(*) FILTER (first_ok AND second_ok) AS both_ok, count(*) FILTER (NOT first_ok AND second_ok) AS fixed, count(*) FILTER (NOT first_ok AND NOT second_ok) AS both_fail, count(*) FILTER (first_ok AND NOT second_ok) AS first_better FROM r GROUP BY 1) SELECT corpus, both_ok, fixed, both_fail, first_better, round(fixed / nullif(fixed + first_better, 0), 6)::DOUBLE AS precision, round(fixed / nullif(fixed + both_fail, 0), 6)::DOUBLE AS recall FROM c")
def ev_confusion(spark, sf_dir):
    """Two readers of the same fields: precision and recall of letting the second one mend the first."""
    a, b = F.col("first_ok"), F.col("second_ok")
    c = spark.sql(READINGS, lineitem=table(spark, sf_dir, "lineitem")).groupBy("corpus").agg(F.count_if(a & b).alias("both_ok"), F.count_if(~a & b).alias("fixed"), F.count_if(~a & ~b).alias("both_fail"), F.count_if(a & ~b).alias("first_better"))
    share = lambda other: F.round(F.col("fixed") / F.nullif(F.col("fixed") + F.col(other), F.lit(0)), 6)
    return c.withColumns({"precision": share("first_better"), "recall": share("both_fail")})


@query("sx_label_coverage", f"{with_fixtures('rendered')}, l AS (SELECT doc_id, {label_sql('text')} AS grp FROM rendered) SELECT doc_id, round(count(DISTINCT grp) / 4.0, 6)::DOUBLE AS coverage FROM l WHERE grp IN ('number', 'date', 'buyer', 'total') GROUP BY 1")
def sx_label_coverage(spark, sf_dir):
    from docloom.operators.grounding import label_group

    l = fixture(spark, sf_dir, "rendered").select("doc_id", label_group(F.col("text")).alias("grp")).filter(F.col("grp").isin("number", "date", "buyer", "total"))
    return l.groupBy("doc_id").agg(F.round(F.count_distinct("grp") / 4.0, 6).alias("coverage"))


@query("sx_neighbors", f"{BOX}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx, word_idx) AS pos FROM boxes), a AS (SELECT doc_id, min(pos) AS lo, max(pos) AS hi FROM p WHERE {IS_NUMBER} GROUP BY 1) SELECT p.doc_id, p.line_idx, p.word_idx FROM p JOIN a USING (doc_id) WHERE pos BETWEEN lo - 3 AND hi + 3")
def sx_neighbors(spark, sf_dir):
    at = Window.partitionBy("doc_id").orderBy("line_idx", "word_idx")
    p = fixture(spark, sf_dir, "boxes").withColumn("pos", F.row_number().over(at))
    a = p.filter(T.is_numeric_word(F.col("text"))).groupBy("doc_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return p.join(a, "doc_id").filter("pos BETWEEN lo - 3 AND hi + 3").select("doc_id", "line_idx", "word_idx")


HISTOGRAM = "SELECT l_orderkey % 20 AS img, (l_partkey * 7 + l_suppkey) % 256 AS v, count(*) AS n FROM {lineitem} GROUP BY 1, 2"
OTSU = f"""WITH h AS ({HISTOGRAM.replace('{lineitem}', 'lineitem')}), c AS (SELECT img, v, sum(n) OVER (PARTITION BY img ORDER BY v) AS w0, sum(n * v) OVER (PARTITION BY img ORDER BY v) AS s0, sum(n) OVER (PARTITION BY img) AS w, sum(n * v) OVER (PARTITION BY img) AS s FROM h),
b AS (SELECT img, v, CASE WHEN w = w0 THEN 0 ELSE w0::DOUBLE * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) END AS between_ FROM c) SELECT img, arg_max(v, (between_, -v)) AS threshold FROM b GROUP BY 1"""


@query("img_otsu", OTSU)
def img_otsu(spark, sf_dir):
    """Threshold of the largest variance between classes, from running sums of the histogram."""
    h = spark.sql(HISTOGRAM, lineitem=table(spark, sf_dir, "lineitem"))
    run, whole = Window.partitionBy("img").orderBy("v"), Window.partitionBy("img")
    c = h.withColumns({"w0": F.sum("n").over(run), "s0": F.sum(F.col("n") * F.col("v")).over(run), "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("v")).over(whole)})
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(F.col("w") - F.col("w0"), F.lit(0))
    between = F.coalesce(F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * gap * gap, F.lit(0.0))
    return c.groupBy("img").agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


@query("img_gray", "SELECT l_orderkey, l_linenumber, round(0.2125 * (l_partkey % 256) + 0.7154 * (l_suppkey % 256) + 0.0721 * (l_linenumber % 256), 6)::DOUBLE AS gray FROM lineitem")
def img_gray(spark, sf_dir):
    gray = 0.2125 * (F.col("l_partkey") % 256) + 0.7154 * (F.col("l_suppkey") % 256) + 0.0721 * (F.col("l_linenumber") % 256)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(gray, 6).alias("gray"))


@query("img_contrast", f"WITH h AS ({HISTOGRAM.replace('{lineitem}', 'lineitem')}), c AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY v) / sum(n) OVER (PARTITION BY img) AS share FROM h), l AS (SELECT img, min(CASE WHEN share >= 0.005 THEN v END) AS lo, min(CASE WHEN share >= 0.995 THEN v END) AS hi FROM c GROUP BY 1) SELECT h.img, h.v, round(CASE WHEN hi - lo < 15 THEN v ELSE least(255.0, greatest(0.0, (v - lo) * 255.0 / (hi - lo))) END, 6)::DOUBLE AS stretched FROM h JOIN l ON l.img = h.img")
def img_contrast(spark, sf_dir):
    h = spark.sql(HISTOGRAM, lineitem=table(spark, sf_dir, "lineitem"))
    share = F.sum("n").over(Window.partitionBy("img").orderBy("v")) / F.sum("n").over(Window.partitionBy("img"))
    ends = h.withColumn("share", share).groupBy("img").agg(F.min(F.when(F.col("share") >= 0.005, F.col("v"))).alias("lo"), F.min(F.when(F.col("share") >= 0.995, F.col("v"))).alias("hi"))
    flat = F.col("hi") - F.col("lo") < 15
    stretched = F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))))
    return h.join(ends, "img").select("img", "v", F.round(F.when(flat, F.col("v").cast("double")).otherwise(stretched), 6).alias("stretched"))
