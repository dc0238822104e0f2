"""Queries of grounding (inventory 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import context as X
from docloom.operators import grounding as G
from docloom.operators.quotes import holding
from docloom.plans.text import NORMAL
from docloom.registry import query
from docloom.sources import dimensions as D
from docloom.sources.documents import lines as split_lines
from docloom.sources.tables import FIXTURES, derived, fixture, table, with_fixtures

OCR = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ((line_idx * 7 + doc_id) % 10) / 10.0 END"


def norm(x: str) -> str:
    return NORMAL.replace("translate(s,", f"translate({x},")


def words_sql(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


LABEL_CASE = "CASE " + " ".join(f"WHEN contains(LN, '{w}') THEN '{g}'" for w, g in D.labels_by_length()) + " END"


def label_sql(x: str) -> str:
    return LABEL_CASE.replace("LN", f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))")


WANT = "CASE key " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in D.GROUP_OF_KEY.items()) + " ELSE CASE WHEN key LIKE 'mobile%' OR key LIKE '%phone%' THEN 'phone' WHEN key LIKE '%\\_date' ESCAPE '\\' OR key = 'date' THEN 'date' WHEN key LIKE '%\\_number' ESCAPE '\\' OR key = 'number' OR key LIKE '%\\_no' ESCAPE '\\' THEN 'number' END END"
NUM = "TRY_CAST(nullif(regexp_replace({}, '[^0-9.-]', '', 'g'), '') AS DOUBLE)"
BASE = f"""{with_fixtures('rendered', 'candidates')}, lines AS (SELECT doc_id, line_idx, text, {OCR} AS ocr FROM rendered),
w AS (SELECT doc_id, line_idx, text AS line, ocr, {norm('text')} AS nline, {words_sql('text')} AS words FROM lines),
sp AS (SELECT doc_id, line_idx, line, ocr, st, en, array_to_string(words[st + 1:en + 1], ' ') AS span FROM (SELECT *, unnest(range(len(words))) AS st FROM w) a, unnest(range(a.st, least(len(a.words), a.st + 6))) AS t(en)),
f AS (SELECT *, {norm('raw')} AS needle FROM candidates WHERE trim(raw) <> '')"""
EVIDENCE = f"""{BASE},
direct AS (
  SELECT f.*, w.line_idx, w.line, w.ocr, (SELECT min((en - st, st, en)) FROM sp WHERE sp.doc_id = f.doc_id AND sp.line_idx = w.line_idx AND en - st < len(string_split(f.needle, ' ')) + 2 AND contains(span, f.needle)) AS s, 'value-match' AS role
  FROM f JOIN w USING (doc_id) WHERE type NOT IN ('number', 'currency') AND contains(nline, needle)
  UNION ALL
  SELECT * FROM (SELECT f.*, w.line_idx, w.line, w.ocr, (SELECT min((en - st, st, en)) FROM sp WHERE sp.doc_id = f.doc_id AND sp.line_idx = w.line_idx AND en - st < 3 AND {NUM.format('span')} = {NUM.format('f.needle')}) AS s, 'value-match' AS role
  FROM f JOIN w USING (doc_id) WHERE type IN ('number', 'currency')) WHERE s IS NOT NULL
), v AS (
  SELECT doc_id, ord, key, type, raw, confidence, unnest(list_distinct([d || '-' || m || '-' || y, bd || '-' || bm || '-' || y, d || '/' || m || '/' || y, bd || '/' || bm || '/' || y, d || '.' || m || '.' || y, bd || '.' || bm || '.' || y, d || m || y])) AS needle
  FROM (SELECT *, raw[1:4] AS y, raw[6:7] AS m, raw[9:10] AS d, raw[6:7]::INTEGER::VARCHAR AS bm, raw[9:10]::INTEGER::VARCHAR AS bd FROM f WHERE type = 'date')
), derived AS (
  SELECT v.*, w.line_idx, w.line, w.ocr, (SELECT min((en - st, st, en)) FROM sp WHERE sp.doc_id = v.doc_id AND sp.line_idx = w.line_idx AND en - st < 3 AND contains(span, v.needle)) AS s, 'derived' AS role
  FROM v JOIN w USING (doc_id) WHERE contains(nline, needle)
), found AS (SELECT DISTINCT doc_id, ord, key, type, raw, confidence, line_idx, line, ocr, s[2] AS start, s[3] AS "end", role FROM (SELECT * FROM direct UNION ALL SELECT * FROM derived))"""
CHECKED = f"""{EVIDENCE}, missing AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.doc_id = c.doc_id AND x.key = c.key)),
bare AS (SELECT doc_id, ord, key, type, raw, confidence, regexp_replace({norm('raw')}, '[^a-z0-9]+', '', 'g') AS target FROM missing WHERE ({WANT}) IN ('number', 'tax') AND type IN ('string', 'text') AND regexp_matches(raw, '[0-9]')),
refs AS (SELECT b.doc_id, b.ord, b.key, b.type, b.raw, b.confidence, sp.line_idx, any_value(line) AS line, any_value(ocr) AS ocr, min((st, en)) AS s FROM bare b JOIN sp USING (doc_id)
  WHERE en - st < 4 AND contains(regexp_replace(span, '[^a-z0-9]+', '', 'g'), target) AND len(regexp_extract_all(span, '[0-9]')) = len(regexp_extract_all(target, '[0-9]')) GROUP BY ALL),
iso AS (SELECT doc_id, ord, key, type, raw, confidence, unnest([replace(raw, '-', '/'), replace(raw, '-', '.'), replace(raw, '-', '')]) AS needle FROM missing WHERE type = 'date'),
isos AS (SELECT i.doc_id, i.ord, i.key, i.type, i.raw, i.confidence, w.line_idx, w.line, w.ocr, (SELECT min((en - st, st, en)) FROM sp WHERE sp.doc_id = i.doc_id AND sp.line_idx = w.line_idx AND en - st < 3 AND contains(span, i.needle)) AS s FROM iso i JOIN w USING (doc_id) WHERE contains(nline, needle)),
evidence AS (SELECT * FROM found UNION ALL SELECT doc_id, ord, key, type, raw, confidence, line_idx, line, ocr, s[1], s[2], 'derived' FROM refs UNION ALL SELECT doc_id, ord, key, type, raw, confidence, line_idx, line, ocr, s[2], s[3], 'derived' FROM isos),
labelled AS (SELECT *, {WANT} AS want, {label_sql('line')} AS has FROM evidence),
verdicts AS (SELECT doc_id, key, any_value(want) AS want, coalesce(bool_or(has = want), false) AS own, bool_or(has IS NOT NULL) AS hits, avg(ocr) AS ocr, count(*) AS n FROM labelled GROUP BY 1, 2),
verdict AS (SELECT doc_id, key, CASE WHEN want IS NULL OR own THEN 'ok' WHEN hits THEN 'conflict' ELSE 'neutral' END AS verdict, CASE WHEN want IS NULL OR own THEN 1.0 ELSE 0.92 END AS factor, ocr, n FROM verdicts)"""
SPOT = ["doc_id", "key", "line_idx", "start", "end", "role"]
SPOT_SQL = 'doc_id, key, line_idx, "start"::INTEGER AS "start", "end"::INTEGER AS "end", role'


def lines(spark, sf_dir):
    ocr = F.when(F.col("doc_id") % 3 != 0, ((F.col("line_idx") * 7 + F.col("doc_id")) % 10) / 10)
    return fixture(spark, sf_dir, "rendered").withColumn("ocr", ocr)


def fields(spark, sf_dir):
    return fixture(spark, sf_dir, "candidates")


FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
#: The benchmark's passages and, as short quotes, their first one to six words.
QUOTES = "SELECT item_id, 0 AS words, text AS quote FROM benchmark UNION ALL SELECT item_id, n::INTEGER, array_to_string(string_split(text, ' ')[1:n], ' ') FROM benchmark, range(1, 7) AS r(n)"


@query("gr_universal", f"WITH l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1))::INTEGER AS line_idx, unnest(ls) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM documents)), t AS (SELECT doc_id, line_idx, {FOLD.format('text')} AS t FROM l), q AS (SELECT item_id, words, {FOLD.format('quote')} AS t FROM ({QUOTES})) SELECT t.doc_id, t.line_idx, q.item_id, q.words FROM t JOIN q ON q.t <> '' AND contains(t.t, q.t)")
def universal(spark, sf_dir):
    """Quotes, long and short, in the lines of all documents, as they are."""
    lines_ = split_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_idx", "text")
    whole = table(spark, sf_dir, "benchmark").select("item_id", F.lit(0).alias("words"), F.col("text").alias("quote"))
    cut = whole.select("item_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("words"), F.split("quote", " ").alias("w"))
    quotes = whole.unionByName(cut.select("item_id", "words", F.array_join(F.slice("w", F.lit(1), F.col("words")), " ").alias("quote")))
    return holding(lines_, quotes, keys=("doc_id", "line_idx")).select("doc_id", "line_idx", "item_id", "words").distinct()


ITEMS = """SELECT l_orderkey AS k, l_linenumber AS n, concat('[{"description":"Part ', CAST(l_partkey AS STRING), '","amount":3},{"description":" "},{"amount":4}]') AS items, l_partkey AS v FROM {lineitem}"""


@query("gr_needles", f"SELECT k, n, 'Part ' || v AS needle FROM ({ITEMS.replace('{lineitem}', 'lineitem')})")
def needles(spark, sf_dir):
    """Descriptions of line items, as far as there are any."""
    r = derived(spark, sf_dir, ITEMS)
    items = F.from_json("items", "array<struct<description:string,amount:double>>")
    return r.select("k", "n", F.explode(F.transform(items, lambda i: i["description"])).alias("needle")).filter(F.trim("needle") != "")


@query("gr_find_evidence", f"{EVIDENCE} SELECT {SPOT_SQL} FROM (SELECT doc_id, key, line_idx, s[2] AS start, s[3] AS \"end\", role FROM direct)")
def find_evidence(spark, sf_dir):
    return G.direct_evidence(fields(spark, sf_dir), lines(spark, sf_dir)).select(*SPOT)


@query("gr_word_span", f"{BASE} SELECT w.doc_id, w.line_idx, (s).b::INTEGER AS start, (s).c::INTEGER AS \"end\" FROM (SELECT w.doc_id, w.line_idx, (SELECT min({{'a': en - st, 'b': st, 'c': en}}) FROM sp WHERE sp.doc_id = w.doc_id AND sp.line_idx = w.line_idx AND en - st < 3 AND contains(span, 'customer')) AS s FROM w) w WHERE s IS NOT NULL")
def word_span(spark, sf_dir):
    found = lines(spark, sf_dir).withColumn("s", G.word_span(G.normal_words(F.col("text")), F.lit("customer"))).filter("s IS NOT NULL")
    return found.select("doc_id", "line_idx", "s.start", "s.end")


@query("gr_numeric_span", f"{EVIDENCE} SELECT doc_id, key, line_idx, s[2]::INTEGER AS start, s[3]::INTEGER AS \"end\" FROM direct WHERE type IN ('number', 'currency')")
def numeric_span(spark, sf_dir):
    return G.direct_evidence(fields(spark, sf_dir).filter(G.is_numeric(F.col("type"))), lines(spark, sf_dir)).select("doc_id", "key", "line_idx", "start", "end")


@query("gr_derived_evidence", f"""{EVIDENCE}, printed AS (SELECT f.doc_id, w.line_idx, (SELECT min((en - st, st, en)) FROM sp WHERE sp.doc_id = f.doc_id AND sp.line_idx = w.line_idx AND en - st < 3 AND {NUM.format('span')} = round({NUM.format('f.needle')}, 3)) AS s FROM f JOIN w USING (doc_id) WHERE type IN ('number', 'currency'))
SELECT doc_id, line_idx, s[2]::INTEGER AS start, s[3]::INTEGER AS "end" FROM derived UNION ALL SELECT doc_id, line_idx, s[2]::INTEGER, s[3]::INTEGER FROM printed WHERE s IS NOT NULL""")
def derived_evidence(spark, sf_dir):
    """Dates in their printed forms, and numbers with or without thousands separators."""
    f, ln = fields(spark, sf_dir), lines(spark, sf_dir)
    return G.derived_evidence(f, ln).unionByName(G.printed_numbers(f, ln)).select("doc_id", "line_idx", "start", "end")


@query("gr_verify_separator_free", f"{CHECKED.replace('missing AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.doc_id = c.doc_id AND x.key = c.key))', 'missing AS (SELECT * FROM candidates)')} SELECT doc_id, key, line_idx, s[1]::INTEGER AS start, s[2]::INTEGER AS \"end\" FROM refs")
def verify_separator_free(spark, sf_dir):
    return G.verified_evidence(fields(spark, sf_dir), lines(spark, sf_dir)).select("doc_id", "key", "line_idx", "start", "end")


DATES = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN concat('Issued ', replace(iso, '-', '/'), ' noon') WHEN 1 THEN concat('on ', replace(iso, '-', '')) WHEN 2 THEN replace(iso, '-', '.') WHEN 3 THEN concat(substr(iso, 9, 2), '/', substr(iso, 6, 2), '/', substr(iso, 1, 4)) ELSE concat('2', substr(iso, 3, 8), 'x') END AS text, iso AS raw
FROM (SELECT o_orderkey, concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) AS iso FROM {orders}) AS o"""


@query("gr_verify_dates", f"SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE 1 END::INTEGER AS start, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE 1 END::INTEGER AS \"end\" FROM ({DATES.replace('{orders}', 'orders')}) WHERE doc_id % 5 < 3")
def verify_dates(spark, sf_dir):
    d = spark.sql(DATES, orders=table(spark, sf_dir, "orders"))
    f = d.select("doc_id", F.lit("invoice_date").alias("key"), F.lit("date").alias("type"), "raw")
    return G.iso_evidence(f, d.select("doc_id", F.lit(0).alias("line_idx"), "text", F.lit(1.0).alias("ocr"))).select("doc_id", "start", "end")


@query("gr_quote_hint", f"{BASE} SELECT f.doc_id, f.key, min(w.line_idx)::INTEGER AS line_idx FROM f JOIN w USING (doc_id) WHERE f.key = 'buyer_name' AND contains(w.nline, 'customer : ' || f.needle) GROUP BY 1, 2")
def quote_hint(spark, sf_dir):
    hints = fields(spark, sf_dir).filter("key = 'buyer_name'").withColumn("quote", F.concat(F.lit("Customer : "), "raw"))
    met = G.contains_join(hints, lines(spark, sf_dir), F.col("nline").contains(T.normalize(F.col("quote"))))
    return met.groupBy("doc_id", "key").agg(F.min("line_idx").alias("line_idx"))


@query("gr_make_evidence", f"{with_fixtures('boxes')} SELECT doc_id, line_idx, string_agg(text, ' ' ORDER BY word_idx) AS quote, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, round(avg(confidence), 6) AS confidence FROM boxes GROUP BY 1, 2")
def make_evidence(spark, sf_dir):
    b = fixture(spark, sf_dir, "boxes")
    quote = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda s: s["text"]), " ")
    return b.groupBy("doc_id", "line_idx").agg(
        quote.alias("quote"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"), F.round(F.avg("confidence"), 6).alias("confidence")
    )


@query("gr_dedupe_evidence", f"{EVIDENCE} SELECT {SPOT_SQL} FROM found")
def dedupe_evidence(spark, sf_dir):
    f, ln = fields(spark, sf_dir), lines(spark, sf_dir)
    return G.dedupe(G.direct_evidence(f, ln).unionByName(G.derived_evidence(f, ln))).select(*SPOT)


@query("gr_label_group", f"{with_fixtures('rendered')} SELECT doc_id, line_idx, {label_sql('text')} AS grp FROM rendered")
def label_group(spark, sf_dir):
    return fixture(spark, sf_dir, "rendered").select("doc_id", "line_idx", G.label_group(F.col("text")).alias("grp"))


KEYS = "SELECT doc_id, ord, CASE (doc_id + ord) % 9 WHEN 0 THEN concat('mobile', key) WHEN 1 THEN 'home_phone' WHEN 2 THEN 'date' WHEN 3 THEN 'ref_no' WHEN 4 THEN 'number' WHEN 5 THEN 'qty' WHEN 6 THEN concat(key, '_date') ELSE key END AS key FROM (__CANDIDATES__) AS c".replace("__CANDIDATES__", FIXTURES["candidates"].strip())


@query("gr_group_for_field", f"SELECT doc_id, ord, {WANT} AS grp FROM ({KEYS.replace('{orders}', 'orders')})")
def group_for_field(spark, sf_dir):
    return derived(spark, sf_dir, KEYS).select("doc_id", "ord", G.group_for_key(F.col("key")).alias("grp"))


@query("gr_label_verdict", f"{CHECKED} SELECT doc_id, key, verdict, n::BIGINT AS n_evidence FROM verdict")
def label_verdict(spark, sf_dir):
    return G.verdicts(fields(spark, sf_dir), lines(spark, sf_dir)).select("doc_id", "key", "verdict", "n_evidence")


@query("gr_primary", f"{CHECKED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY CASE WHEN has = want THEN 10 ELSE 0 END + coalesce(ocr, 0) DESC, line_idx, start) AS rank FROM labelled) SELECT doc_id, key, line_idx, rank::INTEGER AS rank FROM r")
def primary(spark, sf_dir):
    return G.primary(G.evidence_of(fields(spark, sf_dir), lines(spark, sf_dir))).select("doc_id", "key", "line_idx", "rank")


@query("gr_semantic_currency", f"{with_fixtures('rendered')} SELECT doc_id, bool_or(regexp_matches(text, '(?i)\\b(egp|usd|sar|eur)\\b')) AS stated FROM rendered GROUP BY 1")
def semantic_currency(spark, sf_dir):
    return fixture(spark, sf_dir, "rendered").groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(r"(?i)\b(egp|usd|sar|eur)\b")).alias("stated"))


@query("gr_semantic_tax", f"{with_fixtures('rendered')} SELECT doc_id, bool_or(regexp_matches(lower(text), 'tax|vat|ضريب')) AS stated FROM rendered GROUP BY 1")
def semantic_tax(spark, sf_dir):
    return fixture(spark, sf_dir, "rendered").groupBy("doc_id").agg(F.bool_or(F.lower("text").rlike("tax|vat|ضريب")).alias("stated"))


@query(
    "gr_semantic_items",
    "SELECT l_orderkey, count(*) >= 2 OR abs(sum(l_extendedprice) - any_value(o_totalprice)) >= 0.005 AS itemized FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
)
def semantic_items(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("amount"))
    both = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", ((F.col("n") >= 2) | (F.abs(F.col("amount") - F.col("o_totalprice")) >= 0.005)).alias("itemized"))


@query("gr_semantic_noise", f"{with_fixtures('candidates')} SELECT doc_id, raw <> '' AS noisy FROM candidates WHERE type = 'text'")
def semantic_noise(spark, sf_dir):
    """The only notes of the fixture are noise or empty."""
    return fields(spark, sf_dir).filter("type = 'text'").select("doc_id", (T.noise_score(F.col("raw")) > T.NOISE_THRESHOLD).alias("noisy"))


@query("gr_attach_bbox", f"{with_fixtures('boxes')}, q AS (SELECT doc_id, line_idx, word_idx, text FROM boxes WHERE word_idx = 0 AND line_idx = 1) SELECT q.doc_id, q.text, min(b.line_idx)::INTEGER AS line_idx FROM q JOIN boxes b ON b.doc_id = q.doc_id AND (contains(b.text, q.text) OR contains(q.text, b.text)) GROUP BY 1, 2")
def attach_bbox(spark, sf_dir):
    b = fixture(spark, sf_dir, "boxes")
    q = b.filter("word_idx = 0 AND line_idx = 1").select("doc_id", F.col("text").alias("q"))
    met = q.join(b, "doc_id").filter(F.col("text").contains(F.col("q")) | F.col("q").contains(F.col("text")))
    return met.groupBy("doc_id", F.col("q").alias("text")).agg(F.min("line_idx").alias("line_idx"))


FACTS = "SELECT doc_id, ord, CASE WHEN (doc_id + ord) % 5 > 0 THEN confidence END AS ai, CASE WHEN (doc_id + ord) % 4 > 0 THEN CAST((doc_id * 7 + ord) % 17 - 2 AS DOUBLE) / 10 END AS ocr, CAST(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.92 END AS DOUBLE) AS factor, doc_id % 3 > 0 AS has FROM (__CANDIDATES__) AS c".replace("__CANDIDATES__", FIXTURES["candidates"].strip())


@query("gr_compose_conf", f"SELECT doc_id, ord, round(least(1.0, greatest(0.0, coalesce(ai, 0.85) * least(1.0, greatest(0.0, coalesce(ocr, 1.0))) * factor * CASE WHEN has THEN 1.0 ELSE 0.9 END)), 6) AS confidence FROM ({FACTS.replace('{orders}', 'orders')})")
def compose_conf(spark, sf_dir):
    c = G.composed_confidence(F.col("ai"), F.col("ocr"), F.col("factor"), F.col("has"))
    return derived(spark, sf_dir, FACTS).select("doc_id", "ord", F.round(c, 6).alias("confidence"))


GROUND = f"""{CHECKED}, marked AS (SELECT doc_id, bool_or(regexp_matches(text, '(?i)\\b(egp|usd|sar|eur)\\b')) AS cur, bool_or(regexp_matches(lower(text), 'tax|vat|ضريب')) AS tax FROM lines GROUP BY 1),
g AS (SELECT c.doc_id, c.key, c.type, c.raw, coalesce(v.n, 0)::BIGINT AS n_evidence, v.verdict, v.ocr, coalesce(v.factor, 1.0) AS factor, m.cur, m.tax,
  CASE WHEN c.key = 'currency' THEN c.confidence * 0.92 * 0.9 ELSE c.confidence * coalesce(v.ocr, 1.0) * coalesce(v.factor, 1.0) * CASE WHEN coalesce(v.n, 0) > 0 THEN 1.0 ELSE 0.9 END END AS conf
  FROM candidates c LEFT JOIN verdict v ON v.doc_id = c.doc_id AND v.key = c.key LEFT JOIN marked m ON m.doc_id = c.doc_id),
out AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'empty value' WHEN key = 'currency' AND NOT cur THEN 'currency not stated in document' WHEN key LIKE '%\\_tax\\_id' ESCAPE '\\' AND NOT tax THEN 'no tax identifier in document'
  WHEN type = 'text' THEN 'not clean text' WHEN key <> 'currency' AND n_evidence = 0 THEN 'not found in source text' WHEN key <> 'currency' AND verdict = 'conflict' THEN 'value labeled for a different field' WHEN conf < 0.3 THEN 'confidence below threshold' END AS dropped FROM g)"""


@query("gr_drop_reasons", f"{GROUND} SELECT doc_id, key, dropped FROM out WHERE dropped IS NOT NULL")
def drop_reasons(spark, sf_dir):
    return G.ground(fields(spark, sf_dir), lines(spark, sf_dir)).filter("dropped IS NOT NULL").select("doc_id", "key", "dropped")


@query("gr_pipeline", f"{GROUND} SELECT doc_id, key, n_evidence, round(conf, 6) AS confidence, concat_ws(',', CASE WHEN n_evidence = 0 THEN 'no_direct_evidence' END, CASE WHEN coalesce(ocr, 1.0) < 0.6 THEN 'ocr_confidence_low' END, CASE WHEN factor < 1 THEN 'label_not_matched' END) AS reasons, dropped FROM out")
def pipeline(spark, sf_dir):
    g = G.ground(fields(spark, sf_dir), lines(spark, sf_dir))
    return g.select("doc_id", "key", "n_evidence", F.round("confidence", 6).alias("confidence"), F.array_join("reasons", ",").alias("reasons"), "dropped")


ENUMERATED = "SELECT key, ord FROM (VALUES " + ", ".join(f"('{f[0]}', {k})" for k, f in enumerate(D.INVOICE_FIELDS)) + ") AS s(key, ord)"


@query("gr_enumerate", f"WITH s AS ({ENUMERATED}), c AS ({'SELECT DISTINCT doc_id, key FROM candidates'.replace('candidates', 'cand')}) SELECT c.doc_id, c.key, coalesce(s.ord, 100)::INTEGER AS ord FROM c LEFT JOIN s ON s.key = c.key".replace("WITH s", with_fixtures("candidates") + ", cand AS (SELECT * FROM candidates UNION ALL SELECT doc_id, 0, 'found_' || key, type, raw, confidence FROM candidates WHERE key = 'notes'), s"))
def enumerate_fields(spark, sf_dir):
    f = fields(spark, sf_dir).select("doc_id", "key")
    every = f.unionByName(f.filter("key = 'notes'").select("doc_id", F.concat(F.lit("found_"), "key").alias("key"))).distinct()
    known = F.create_map(*(F.lit(x) for k, row in enumerate(D.INVOICE_FIELDS) for x in (row[0], k)))
    return every.select("doc_id", "key", F.coalesce(known[F.col("key")], F.lit(100)).alias("ord"))


# Documents whose extraction is not complete have no structured form.
SHOWN = f"""{GROUND}, page AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_idx) AS text, max(CASE WHEN line_idx = 3 THEN text END) AS quote FROM rendered GROUP BY 1),
said AS (SELECT *, floor(conf * 10000 + 0.5 + 1e-9)::BIGINT AS c4, concat_ws('; ', CASE WHEN n_evidence = 0 THEN '{D.UNCERTAINTY["no_direct_evidence"]}' END, CASE WHEN coalesce(ocr, 1.0) < 0.6 THEN '{D.UNCERTAINTY["ocr_confidence_low"]}' END, CASE WHEN factor < 1 THEN '{D.UNCERTAINTY["label_not_matched"]}' END) AS why FROM out)"""


def documents_shown(spark, sf_dir):
    """(structured documents, their pages)"""
    ln = lines(spark, sf_dir)
    page = ln.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max(F.when(F.col("line_idx") == 3, F.col("text"))).alias("_q"))
    page = page.select("doc_id", F.concat(F.lit("Order "), F.col("doc_id").cast("string")).alias("title"), "text", F.create_map(F.lit("buyer_name"), "_q").alias("quotes"))
    return X.structured_documents(G.ground(fields(spark, sf_dir), ln), page.select("doc_id", (F.col("doc_id") % 5 != 0).alias("complete"))), page


@query("sink_structured_doc", f"{SHOWN}, st AS (SELECT doc_id, coalesce(string_agg(key || '=' || raw || '@' || c4, ';' ORDER BY key) FILTER (dropped IS NULL), '') AS fields, coalesce(string_agg(key || '=' || dropped, ';' ORDER BY key) FILTER (dropped IS NOT NULL), '') AS dropped FROM said GROUP BY 1) SELECT p.doc_id, CASE WHEN p.doc_id % 5 <> 0 THEN fields END AS fields, CASE WHEN p.doc_id % 5 <> 0 THEN dropped END AS dropped FROM page p LEFT JOIN st USING (doc_id)")
def structured_doc(spark, sf_dir):
    s = documents_shown(spark, sf_dir)[0]
    field = lambda f: F.concat(f["key"], F.lit("="), f["value"], F.lit("@"), F.round(f["confidence"] * 10000).cast("long").cast("string"))
    return s.select("doc_id", F.array_join(F.transform("fields", field), ";").alias("fields"), F.array_join(F.transform("dropped", lambda d: F.concat(d["key"], F.lit("="), d["reason"])), ";").alias("dropped"))


@query("sink_agent_context", f"""{SHOWN}, fl AS (SELECT doc_id, string_agg('- ' || key || ': ' || raw[:120] || ' (' || floor(c4 / 100.0 + 0.5 + 1e-9)::BIGINT || '%)' || CASE WHEN why <> '' THEN ' [' || why || ']' ELSE '' END || CASE WHEN key = 'buyer_name' AND quote IS NOT NULL THEN ' — "' || quote[:200] || '"' ELSE '' END, chr(10) ORDER BY key) FILTER (dropped IS NULL) AS shown, string_agg('- ' || key || ': ' || dropped, chr(10) ORDER BY key) FILTER (dropped IS NOT NULL) AS lost, true AS has FROM said JOIN page USING (doc_id) GROUP BY 1)
SELECT p.doc_id, '### Document: Order ' || p.doc_id || CASE WHEN has AND p.doc_id % 5 <> 0 THEN chr(10) || 'Extracted fields:' || chr(10) || coalesce(shown, '- (none)') || CASE WHEN lost IS NULL THEN '' ELSE chr(10) || chr(10) || 'Not confirmed:' || chr(10) || lost END || chr(10) || chr(10) || 'Raw text:' || chr(10) || text[:30000] ELSE chr(10) || 'Raw text:' || chr(10) || text[:30000] END AS context, CASE WHEN has AND p.doc_id % 5 <> 0 THEN 'structured' ELSE 'raw' END AS source FROM page p LEFT JOIN fl USING (doc_id)""")
def agent_context(spark, sf_dir):
    return X.agent_context(*documents_shown(spark, sf_dir))
