"""Queries of classification, extraction, cleaning, recovery, validation and confidence (inventory 2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import extraction as E
from docloom.operators import grounding as G
from docloom.plans.grounding import BASE, GROUND, fields, lines, norm
from docloom.operators.replies import outer, repair, strip_fences
from docloom.registry import query
from docloom.sources import dimensions as D
from docloom.sources.tables import FIXTURES, derived, fixture, table, with_fixtures

#: A rendered document as one text.
TEXTS = "SELECT doc_id, string_agg(text, chr(10) ORDER BY line_idx) AS text FROM rendered GROUP BY 1"
BOTH = f"{with_fixtures('rendered')}, texts AS ({TEXTS}), docs AS (SELECT * FROM texts UNION ALL SELECT -1 - doc_id, text FROM documents)"


def texts(spark, sf_dir):
    r = fixture(spark, sf_dir, "rendered")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), "\n")
    return r.groupBy("doc_id").agg(joined.alias("text"))


def docs(spark, sf_dir):
    return texts(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))


def hits_sql(p: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text[:3000]), '{a.lower()}') THEN 1 ELSE 0 END" for a in D.ALIASES[p])


def score_sql(p: str) -> str:
    return " + ".join(f"len(string_split(lower(text[:3000]), '{a.lower()}')) - 1" for a in D.ALIASES[p] if len(a) >= 3)


@query("cls_alias_score", f"{BOTH} SELECT doc_id, {', '.join(f'({hits_sql(p)})::INTEGER AS {p}' for p in D.ALIASES)} FROM docs")
def cls_alias_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(E.alias_hits(F.col("text"), p).alias(p) for p in D.ALIASES))


RULED = f"s AS (SELECT doc_id, text, {', '.join(f'{score_sql(p)} AS {p}' for p in D.ALIASES)} FROM docs), b AS (SELECT *, greatest({', '.join(D.ALIASES)}) AS best FROM s), ruled AS (SELECT doc_id, text, CASE WHEN best = 0 THEN NULL {' '.join(f"WHEN {p} = best THEN '{p}'" for p in D.ALIASES)} END AS rule_type, nullif(best, 0) AS rule_score FROM b)"


@query("cls_rule", f"{BOTH}, {RULED} SELECT doc_id, rule_type, rule_score::BIGINT AS rule_score, round(least(1.0, 0.4 + 0.15 * rule_score), 6)::DOUBLE AS confidence FROM ruled")
def cls_rule(spark, sf_dir):
    ruled = E.classify_by_rules(docs(spark, sf_dir))
    return ruled.select("doc_id", "rule_type", F.col("rule_score").cast("long").alias("rule_score"), F.round(F.least(F.lit(1.0), 0.4 + 0.15 * F.col("rule_score")), 6).alias("confidence"))


AI = "CASE abs(doc_id) % 5 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'contract' END"
RESOLVED = f"""{BOTH}, {RULED}, a AS (SELECT *, {AI} AS ai_type, (abs(doc_id) % 10) / 10.0 AS ai_conf, CASE WHEN doc_id % 41 = 0 THEN 'resume' END AS pinned,
CASE {AI} WHEN 'invoice' THEN {hits_sql('invoice')} WHEN 'receipt' THEN {hits_sql('receipt')} WHEN 'contract' THEN {hits_sql('contract')} ELSE 0 END AS ai_hits FROM ruled),
t AS (SELECT *, coalesce(ai_type <> 'unknown', false) AS known, least(1.0, 0.4 + 0.15 * rule_score) AS rc FROM a),
u AS (SELECT *, known AND ai_hits = 0 AND rule_type IS NOT NULL AND rule_type <> ai_type AS over_, known AND ai_hits = 0 AND rule_type IS NULL AND ai_conf < 0.5 AS gone FROM t)
SELECT doc_id, CASE WHEN pinned IS NOT NULL THEN pinned WHEN over_ OR (NOT known AND rule_type IS NOT NULL) THEN rule_type WHEN known AND NOT gone THEN ai_type ELSE 'unknown' END AS profile,
CASE WHEN pinned IS NOT NULL THEN 'rule' WHEN over_ OR (NOT known AND rule_type IS NOT NULL) THEN 'rule' WHEN NOT gone AND ai_type IS NOT NULL THEN 'ai' ELSE 'fallback' END AS source,
round(CASE WHEN pinned IS NOT NULL THEN 1.0 WHEN over_ OR (NOT known AND rule_type IS NOT NULL) THEN least(1.0, greatest(rc, CASE WHEN ai_type IS NULL THEN 0 ELSE ai_conf END)) WHEN NOT gone AND ai_type IS NOT NULL THEN ai_conf ELSE 0 END, 6)::DOUBLE AS confidence FROM u"""


@query("cls_resolve", RESOLVED)
def cls_resolve(spark, sf_dir):
    k = F.abs("doc_id")
    ai = F.get(F.array(F.lit("invoice"), F.lit("receipt"), F.lit("unknown"), F.lit(None).cast("string"), F.lit("contract")), (k % 5).cast("int"))
    d = E.classify_by_rules(docs(spark, sf_dir)).withColumn("ai_type", ai)
    hits = F.coalesce(*(F.when(F.col("ai_type") == p, E.alias_hits(F.col("text"), p)) for p in ("invoice", "receipt", "contract")), F.lit(0))
    d = d.withColumns({"ai_hits": hits, "ai_conf": F.when(F.col("ai_type").isNotNull(), (k % 10) / 10), "pinned": F.when(F.col("doc_id") % 41 == 0, "resume")})
    return E.resolve_type(d).select("doc_id", "profile", "source", F.round("confidence", 6).alias("confidence"))


CAND = with_fixtures("candidates")
NUMBER = "TRY_CAST(replace(nullif(regexp_extract(raw, '[-+]?[0-9][0-9,]*(\\.[0-9]+)?'), ''), ',', '') AS DOUBLE)"
TYPED = f"CASE WHEN type IN ('number', 'currency') THEN ({NUMBER})::VARCHAR WHEN type = 'enum' THEN CASE WHEN upper(trim(raw)) IN ({', '.join(f"'{c}'" for c in D.CURRENCIES)}) THEN upper(trim(raw)) END ELSE nullif(trim(raw), '') END"


def normalized(spark, sf_dir):
    from docloom.operators.coerce import coerce

    return coerce(fields(spark, sf_dir), "raw", "type", D.CURRENCIES)


@query("ext_normalize", f"{CAND} SELECT doc_id, key, CASE WHEN type IN ('number', 'currency') THEN {NUMBER} END AS number, CASE WHEN type = 'enum' THEN CASE WHEN upper(trim(raw)) IN ({', '.join(f"'{c}'" for c in D.CURRENCIES)}) THEN upper(trim(raw)) END WHEN type NOT IN ('number', 'currency') THEN nullif(trim(raw), '') END AS string, confidence FROM candidates")
def ext_normalize(spark, sf_dir):
    return normalized(spark, sf_dir).select("doc_id", "key", "number", "string", "confidence")


# A model's free reply about each order: envelopes and bare entries, keys that clean to nothing, nulls, and replies that are no object.
RAW_JSON = """SELECT o_orderkey AS k, CASE o_orderkey % 4
    WHEN 0 THEN concat('{"Invoice No":{"raw":"A-', CAST(o_orderkey AS STRING), '","value":"A-', CAST(o_orderkey AS STRING), '","type":"string","confidence":0.', CAST(1 + o_custkey % 9 AS STRING), '},"totalAmount":', CAST(o_custkey AS STRING), '.5,"paid":', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"tags":["a","', CAST(o_custkey AS STRING), '"],"x":null}')
    WHEN 1 THEN concat('{"constructor":"bad","vat rate":{"value":', CAST(o_custkey % 30 AS STRING), ',"confidence":2},"nested":{"a":', CAST(o_orderkey AS STRING), '}}')
    WHEN 2 THEN concat('not json ', CAST(o_custkey AS STRING)) ELSE concat('{"Buyer Name":{"raw":"Customer ', CAST(o_custkey AS STRING), '"},"count":', CAST(o_custkey AS STRING), '}') END AS json FROM {orders}"""
ENTRIES = f"""WITH raw AS (SELECT k, json FROM ({RAW_JSON.replace('{orders}', 'orders')}) AS r WHERE json_valid(json)), en AS (SELECT k, name, json_extract(json, '$."' || name || '"') AS entry FROM (SELECT k, json, unnest(json_keys(json)) AS name FROM raw)),
ev AS (SELECT *, json_type(entry) = 'OBJECT' AND (list_contains(json_keys(entry), 'value') OR list_contains(json_keys(entry), 'raw')) AS is_envelope FROM en WHERE json_type(entry) <> 'NULL'),
vl AS (SELECT *, CASE WHEN is_envelope THEN coalesce(json_extract(entry, '$.value'), json_extract(entry, '$.raw')) ELSE entry END AS value, CASE json_type(entry) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS shape FROM ev)"""
CLEAN = "lower(regexp_replace(regexp_replace(regexp_replace(trim(name), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'))"


def entries(spark, sf_dir):
    raw = derived(spark, sf_dir, RAW_JSON).withColumn("v", F.try_parse_json("json"))
    parts = F.expr("variant_get(v, '$', 'map<string, variant>')")
    return raw.filter("v IS NOT NULL").select("k", F.explode(F.map_entries(parts)).alias("e")).select("k", F.col("e.key").alias("name"), F.col("e.value").alias("entry"))


def envelopes(spark, sf_dir):
    """(k, name, entry, is_envelope, value, confidence, declared): bare entries are their own value."""
    e = entries(spark, sf_dir).filter("entry IS NOT NULL AND NOT is_variant_null(entry)").withColumn("shape", F.schema_of_variant("entry"))
    is_env = F.col("shape").startswith("OBJECT") & F.col("shape").rlike(r"[<, ](value|raw):")
    value = F.when(is_env, F.coalesce(F.expr("try_variant_get(entry, '$.value', 'variant')"), F.expr("try_variant_get(entry, '$.raw', 'variant')"))).otherwise(F.col("entry"))
    return e.withColumns({"is_envelope": is_env, "value": value, "conf": F.when(is_env, F.expr("try_variant_get(entry, '$.confidence', 'double')")), "declared": F.when(is_env, F.expr("try_variant_get(entry, '$.type', 'string')"))})


def inferred(shape):
    return F.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").when(shape == "BOOLEAN", "boolean").when(shape.isin("STRING", "VOID"), "string").otherwise("number")


@query("ext_normalize_dynamic", f"{ENTRIES}, kd AS (SELECT *, {CLEAN} AS key FROM vl) SELECT k, key, CASE WHEN is_envelope THEN coalesce(json_extract_string(entry, '$.type'), 'string') ELSE shape END AS type, CASE WHEN json_type(value) = 'VARCHAR' THEN json_extract_string(value, '$') ELSE value::VARCHAR END AS value, least(1.0, greatest(0.0, coalesce(CASE WHEN is_envelope THEN json_extract(entry, '$.confidence')::DOUBLE END, 0.85)))::DOUBLE AS confidence FROM kd WHERE key <> '' AND key NOT IN ({', '.join(f"'{b}'" for b in T.BLOCKED_KEYS)})")
def ext_normalize_dynamic(spark, sf_dir):
    e = envelopes(spark, sf_dir).withColumn("key", T.safe_key(F.col("name"))).filter("key <> ''")
    kind = F.when(F.col("is_envelope"), F.coalesce("declared", F.lit("string"))).otherwise(inferred(F.col("shape")))
    shown = F.when(F.schema_of_variant("value").isin("STRING"), F.expr("variant_get(value, '$', 'string')")).otherwise(F.to_json("value"))
    return e.select("k", "key", kind.alias("type"), shown.alias("value"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("conf", F.lit(0.85)))).alias("confidence"))


@query("json_infer_type", f"{ENTRIES} SELECT k, name, shape AS type FROM vl")
def json_infer_type(spark, sf_dir):
    return envelopes(spark, sf_dir).select("k", "name", inferred(F.col("shape")).alias("type"))


@query("json_envelope", f"{ENTRIES} SELECT k, name, is_envelope, value::VARCHAR AS value FROM vl")
def json_envelope(spark, sf_dir):
    return envelopes(spark, sf_dir).select("k", "name", "is_envelope", F.to_json("value").alias("value"))


REPLY = with_fixtures("replies")


def by_kind(*parts: str | None) -> str:
    """What the reply of each kind holds; V stands for the order's number in it."""
    whens = " ".join(f"WHEN {k} THEN " + ("NULL" if p is None else "replace('" + p + "', 'V', v::VARCHAR)") for k, p in enumerate(parts))
    return f"CASE k % {len(parts)} {whens} END"


@query("json_strip_fences", f"{REPLY} SELECT k, trim(regexp_replace(regexp_replace(reply, '^```(json)?\\s*', ''), '\\s*```$', '')) AS body FROM replies")
def json_strip_fences(spark, sf_dir):
    return fixture(spark, sf_dir, "replies").select("k", strip_fences(F.col("reply")).alias("body"))


@query("json_outer", f"""{REPLY} SELECT k, {by_kind('{"data": {"a": V}}', '{"fields": {"b": [V, 2,], "c": "x}"}}', '{"d": V, "confidence": {"d": 0.5}}', None, '{"e": V}', '[V, 2, 3,]')} AS body FROM replies""")
def json_outer(spark, sf_dir):
    return fixture(spark, sf_dir, "replies").select("k", outer(strip_fences(F.col("reply"))).alias("body"))


@query("json_repair", f"""{REPLY} SELECT k, {by_kind('{"data":{"a":V}}', '{"fields":{"b":[V,2],"c":"x}"}}', '{"confidence":{"d":0.5},"d":V}', None, '{"e":V}', '[V,2,3]')} AS json FROM replies""")
def json_repair(spark, sf_dir):
    return fixture(spark, sf_dir, "replies").select("k", F.to_json(repair(F.col("reply"))).alias("json"))


@query("json_parse_raw", f"""{REPLY} SELECT k, {by_kind('{"a":V}', '{"b":[V,2],"c":"x}"}', '{"confidence":{"d":0.5},"d":V}', None, '{"e":V}', None)} AS data FROM replies WHERE k % 6 NOT IN (3, 5)""")
def json_parse_raw(spark, sf_dir):
    v = fixture(spark, sf_dir, "replies").select("k", repair(F.col("reply")).alias("v")).filter("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    data = F.coalesce(F.expr("try_variant_get(v, '$.data', 'variant')"), F.expr("try_variant_get(v, '$.fields', 'variant')"), F.col("v"))
    return v.select("k", F.to_json(data).alias("data"))


@query("json_classification", f"{with_fixtures('verdicts')} SELECT k, CASE k % 4 WHEN 0 THEN 'invoice' WHEN 3 THEN 'receipt' ELSE 'unknown' END AS type, CASE k % 4 WHEN 0 THEN least(1.0, v % 3 + 0.25) WHEN 3 THEN (1 + v % 9) / 10.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN k % 4 = 0 THEN 5 ELSE 0 END::INTEGER AS n_reasons FROM verdicts")
def json_classification(spark, sf_dir):
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    v = fixture(spark, sf_dir, "verdicts").select("k", F.try_parse_json(body).alias("v"))
    kind = F.lower(F.trim(F.expr("try_variant_get(v, '$.type', 'string')")))
    known = F.when(kind.isin(*D.ALIASES), kind).otherwise("unknown")
    numeric = F.expr("schema_of_variant(try_variant_get(v, '$.confidence', 'variant'))") != "STRING"
    conf = F.when(numeric, F.expr("try_variant_get(v, '$.confidence', 'double')"))
    n = F.size(F.slice(F.expr("try_variant_get(v, '$.reasons', 'array<string>')"), 1, 5))
    return v.select("k", F.coalesce(known, F.lit("unknown")).alias("type"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)), F.lit(0.0)).alias("confidence"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias("n_reasons"))


EMPTY = "SELECT doc_id, ord, CASE (doc_id + ord) % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN '[]' WHEN 4 THEN '{}' WHEN 5 THEN '0' ELSE raw END AS v FROM (__CANDIDATES__) AS c".replace("__CANDIDATES__", FIXTURES["candidates"].strip())


@query("arr_is_empty", f"SELECT doc_id, ord, coalesce(trim(v) IN ('', '[]', '{{}}'), true) AS is_empty FROM ({EMPTY.replace('{orders}', 'orders')})")
def arr_is_empty(spark, sf_dir):
    return derived(spark, sf_dir, EMPTY).select("doc_id", "ord", F.coalesce(F.trim("v").isin("", "[]", "{}"), F.lit(True)).alias("is_empty"))


@query("hash_ocr", f"{with_fixtures('rendered')} SELECT doc_id, sha256(string_agg(line_idx::VARCHAR || ':' || text, chr(10) ORDER BY line_idx)) AS digest FROM rendered GROUP BY 1")
def hash_ocr(spark, sf_dir):
    r = fixture(spark, sf_dir, "rendered")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: F.concat(s["line_idx"].cast("string"), F.lit(":"), s["text"])), "\n")
    return r.groupBy("doc_id").agg(F.sha2(body, 256).alias("digest"))


VISION = "SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'رقم العملية' WHEN 1 THEN 'Total' WHEN 2 THEN ' merchant' WHEN 3 THEN concat('color ', CAST(o_custkey AS STRING)) WHEN 4 THEN 'Date ' WHEN 5 THEN 'GRAND total' ELSE '' END AS label FROM {orders}"
SYNONYMS = {"total": "total_amount", "grand total": "total_amount", "date": "receipt_date", "merchant": "merchant_name", "رقم العملية": "transaction_id"}


@query("map_vision_field", f"SELECT k, CASE lower(trim(label)) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in SYNONYMS.items())} ELSE 'extra' END AS property FROM ({VISION.replace('{orders}', 'orders')})")
def map_vision_field(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return derived(spark, sf_dir, VISION).select("k", F.coalesce(known[F.lower(F.trim("label"))], F.lit("extra")).alias("property"))


PIECES = "SELECT doc_id, line_idx, text AS evidence, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN 'EGP' ELSE ':' END AS value FROM (__RENDERED__) AS r".replace("__RENDERED__", FIXTURES["rendered"].strip())


@query("ext_dynamic_gate", f"SELECT doc_id, line_idx, len(string_split_regex(evidence, '[:：]')) = 2 AND len(list_filter(string_split_regex(evidence, '[:：]'), lambda s: contains(s, value))) > 0 AS clear FROM ({PIECES.replace('{orders}', 'orders')})")
def ext_dynamic_gate(spark, sf_dir):
    """Whether a line has one label and its value on one side of it."""
    sides = F.split("evidence", "[:：]")
    return derived(spark, sf_dir, PIECES).select("doc_id", "line_idx", ((F.size(sides) == 2) & F.exists(sides, lambda s: s.contains(F.col("value")))).alias("clear"))


@query("ext_vision_fastpath", f"{CAND} SELECT doc_id, bool_or(trim(raw) <> '' AND doc_id % 3 = 0) AS fast, CASE WHEN bool_or(trim(raw) <> '' AND doc_id % 3 = 0) THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM candidates GROUP BY 1")
def ext_vision_fastpath(spark, sf_dir):
    fast = F.bool_or((F.trim("raw") != "") & (F.col("doc_id") % 3 == 0))
    return fields(spark, sf_dir).groupBy("doc_id").agg(fast.alias("fast"), F.when(fast, 0.95).otherwise(0.85).alias("confidence"))


@query("ext_candidates", f"{CAND} SELECT doc_id, count(*)::BIGINT AS n, string_agg(key, ',' ORDER BY ord) AS keys FROM candidates WHERE {TYPED} IS NOT NULL GROUP BY 1")
def ext_candidates(spark, sf_dir):
    kept = normalized(spark, sf_dir).filter("number IS NOT NULL OR string IS NOT NULL OR flag IS NOT NULL")
    keys = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda s: s["key"]), ",")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), keys.alias("keys"))


POST = "WITH d AS (SELECT DISTINCT doc_id FROM candidates), k AS (SELECT unnest([{keys}]) AS key)"
POST_KEYS = ("invoice_number", "invoice_date", "buyer_name", "currency", "total_amount", "notes")


@query("ext_postprocess", f"{CAND}, d AS (SELECT DISTINCT doc_id FROM candidates), k AS (SELECT unnest({list(POST_KEYS)}) AS key) SELECT d.doc_id, k.key, CASE WHEN c.key IS NULL THEN 'not found in document' WHEN {TYPED} IS NULL THEN 'empty value' ELSE 'confidence below threshold' END AS reason FROM d CROSS JOIN k LEFT JOIN candidates c ON c.doc_id = d.doc_id AND c.key = k.key WHERE c.key IS NULL OR {TYPED} IS NULL OR c.confidence < 0.3")
def ext_postprocess(spark, sf_dir):
    """Every document has a row for each of the profile's few keys."""
    n = normalized(spark, sf_dir)
    wanted = n.select("doc_id").distinct().withColumn("key", F.explode(F.array(*map(F.lit, POST_KEYS))))
    both = wanted.join(n.select("doc_id", "key", "number", "string", "confidence"), ["doc_id", "key"], "left")
    empty = F.col("number").isNull() & F.col("string").isNull()
    reason = F.when(F.col("confidence").isNull(), "not found in document").when(empty, "empty value").when(F.col("confidence") < 0.3, "confidence below threshold")
    return both.withColumn("reason", reason).filter("reason IS NOT NULL").select("doc_id", "key", "reason")


CLEAN_SQL = "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(V, '\\s+', ' ', 'g')), '\\.\\.+', '.', 'g'), '-{2,}', '-', 'g'), '^[\\s.,:;*#|\\-]+|[\\s.,:;*#|\\-]+$', '', 'g')"
DIRTY = "SELECT doc_id, key, concat(' -- ', raw, '  ..  ', CAST(ord AS STRING), '... ') AS v FROM candidates"


def dirty(spark, sf_dir):
    return fields(spark, sf_dir).select("doc_id", "key", F.concat(F.lit(" -- "), "raw", F.lit("  ..  "), F.col("ord").cast("string"), F.lit("... ")).alias("v"))


@query("cln_text", f"{CAND}, d AS ({DIRTY}) SELECT doc_id, key, {CLEAN_SQL.replace('V', 'v')} AS v FROM d")
def cln_text(spark, sf_dir):
    return dirty(spark, sf_dir).select("doc_id", "key", E.clean_value(F.col("v")).alias("v"))


@query("cln_free_text", f"{CAND} SELECT doc_id FROM candidates WHERE type = 'text' AND trim(raw) = ''")
def cln_free_text(spark, sf_dir):
    """Noisy notes go; what stays of this fixture are the empty ones."""
    return fields(spark, sf_dir).filter("type = 'text'").filter(T.noise_score(F.col("raw")) <= T.NOISE_THRESHOLD).select("doc_id")


@query("cln_line_items", "SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, p_name) AS items FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 10 AND length(p_name) > 3 GROUP BY 1")
def cln_line_items(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").join(table(spark, sf_dir, "part").filter(F.char_length("p_name") > 3), F.col("l_partkey") == F.col("p_partkey"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda s: s["p_name"]), "|")
    return both.groupBy("l_orderkey").agg(items.alias("items"))


@query("cln_reground", f"{BASE} SELECT DISTINCT f.doc_id, f.key FROM f JOIN w USING (doc_id) WHERE contains(w.nline, f.needle)")
def cln_reground(spark, sf_dir):
    return E.regrounded(fields(spark, sf_dir), lines(spark, sf_dir), "raw").select("doc_id", "key")


@query("cln_stage", f"{CAND}, d AS ({DIRTY}), c AS (SELECT *, {CLEAN_SQL.replace('V', 'v')} AS clean FROM d) SELECT key, count(*)::BIGINT AS n, count(*) FILTER (clean <> v)::BIGINT AS changed, sum(length(v) - length(clean))::BIGINT AS removed FROM c GROUP BY 1")
def cln_stage(spark, sf_dir):
    c = dirty(spark, sf_dir).withColumn("clean", E.clean_value(F.col("v")))
    return c.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("clean") != F.col("v")).alias("changed"), F.sum(F.char_length("v") - F.char_length("clean")).alias("removed"))


WORDS = [(w,) for w in E.label_words("Total amount", "total")]


TOTALS = f"""{BASE}, hit AS (SELECT doc_id, line_idx, ocr, nline, CASE {' '.join(f"WHEN {f"regexp_matches(nline, '\\b{w}\\b')" if w.isascii() else f"contains(nline, '{w}')"} THEN '{w}'" for (w,) in WORDS)} END AS word FROM w),
aft AS (SELECT *, trim(regexp_replace(list_last(string_split(nline, word)), '^[\\s:：.\\-#]+', '')) AS a FROM hit WHERE word IS NOT NULL),
cand AS (SELECT doc_id, line_idx, replace(list_last(regexp_extract_all(a, '[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?')), ',', '') AS value, least(0.5, coalesce(ocr, 0.7) * 0.7) AS confidence FROM aft WHERE regexp_matches(a, '[0-9]')),
decided AS (SELECT doc_id, count(DISTINCT value) AS n, min(value) AS v, max(confidence) AS c FROM cand GROUP BY 1)"""


@query("rec_label_words", f"{TOTALS} SELECT doc_id, line_idx, word FROM hit WHERE word IS NOT NULL")
def rec_label_words(spark, sf_dir):
    """The longest word of a field's label that each line holds."""
    norm = T.normalize(F.col("text"))
    return lines(spark, sf_dir).select("doc_id", "line_idx", E.label_word(norm, E.label_words("Total amount", "total")).alias("word")).filter("word IS NOT NULL")


def totals(spark, sf_dir):
    return E.recovery_candidates(lines(spark, sf_dir), "total_amount", "currency", "Total amount", "total")


@query("rec_candidates", f"{TOTALS} SELECT doc_id, line_idx, value, round(confidence, 6)::DOUBLE AS confidence FROM cand")
def rec_candidates(spark, sf_dir):
    return totals(spark, sf_dir).select("doc_id", "line_idx", "value", F.round("confidence", 6).alias("confidence"))


@query("rec_confidence", f"{BASE} SELECT doc_id, line_idx, round(least(0.5, coalesce(ocr, 0.7) * 0.7), 6)::DOUBLE AS confidence FROM lines")
def rec_confidence(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_idx", F.round(F.least(F.lit(0.5), F.coalesce("ocr", F.lit(0.7)) * 0.7), 6).alias("confidence"))


@query("rec_decide", f"{TOTALS} SELECT doc_id, CASE WHEN n = 1 THEN 'flagged' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN v END AS value, round(CASE WHEN n = 1 THEN c ELSE 0 END, 6)::DOUBLE AS confidence FROM decided")
def rec_decide(spark, sf_dir):
    return E.decide_recovery(totals(spark, sf_dir)).select("doc_id", "status", "value", F.round("confidence", 6).alias("confidence"))


@query("rec_dedupe", f"{TOTALS} SELECT doc_id, value, round(max(confidence), 6)::DOUBLE AS confidence, count(*)::BIGINT AS n_evidence FROM cand GROUP BY 1, 2")
def rec_dedupe(spark, sf_dir):
    return totals(spark, sf_dir).groupBy("doc_id", "value").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.count("*").alias("n_evidence"))


@query("rec_verdict", f"{TOTALS} SELECT DISTINCT d.doc_id FROM decided d JOIN w ON w.doc_id = d.doc_id AND contains(w.nline, d.v) WHERE n = 1")
def rec_verdict(spark, sf_dir):
    flagged = E.decide_recovery(totals(spark, sf_dir)).filter("status = 'flagged'")
    return E.regrounded(flagged, lines(spark, sf_dir), "value").select("doc_id")


MISSING = f"{TOTALS}, lack AS (SELECT DISTINCT doc_id FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM candidates WHERE key = 'total_amount'))"


@query("rec_apply", f"{MISSING} SELECT l.doc_id, d.v AS value FROM lack l JOIN decided d USING (doc_id) WHERE n = 1")
def rec_apply(spark, sf_dir):
    have = fields(spark, sf_dir).filter("key = 'total_amount'").select("doc_id")
    return E.decide_recovery(totals(spark, sf_dir)).filter("status = 'flagged'").join(have, "doc_id", "left_anti").select("doc_id", "value")


@query("rec_merge_retry", f"{TOTALS} SELECT coalesce(c.doc_id, d.doc_id) AS doc_id, coalesce(c.raw, CASE WHEN d.n = 1 THEN d.v END) AS value FROM (SELECT * FROM candidates WHERE key = 'total_amount') c FULL JOIN decided d ON d.doc_id = c.doc_id")
def rec_merge_retry(spark, sf_dir):
    own = fields(spark, sf_dir).filter("key = 'total_amount'").select("doc_id", "raw")
    return own.join(E.decide_recovery(totals(spark, sf_dir)).select("doc_id", "value"), "doc_id", "full").select("doc_id", F.coalesce("raw", "value").alias("value"))


@query("rec_reorder", f"{CAND} SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::INTEGER AS position FROM candidates")
def rec_reorder(spark, sf_dir):
    return fields(spark, sf_dir).select("doc_id", "key", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("position"))


def valued(spark, sf_dir):
    n = normalized(spark, sf_dir)
    number = F.col("number")
    return n.select("doc_id", "key", F.coalesce(number.cast("decimal(18,2)").cast("string"), F.col("string")).alias("value"), "confidence")


VALUES = f"{CAND}, vals AS (SELECT doc_id, key, CASE WHEN type IN ('number', 'currency') THEN (({NUMBER})::DECIMAL(18, 2))::VARCHAR ELSE {TYPED} END AS value, confidence FROM candidates), ds AS (SELECT DISTINCT doc_id FROM candidates)"


def rule_sql(n: int, r: tuple) -> str:
    key, kind, required, pattern, low, high, listed = r
    test = f"upper(v.value) IN ({', '.join(f"'{c}'" for c in D.CURRENCIES)})" if listed else f"regexp_matches(v.value, '{pattern}')" if pattern else "regexp_matches(v.value, '^\\d{4}-\\d{2}-\\d{2}$')" if kind == "date" else f"TRY_CAST(v.value AS DOUBLE) IS NOT NULL{f' AND v.value::DOUBLE >= {low}' if low is not None else ''}{f' AND v.value::DOUBLE <= {high}' if high is not None else ''}" if kind in ("number", "currency") else "true"
    return f"SELECT ds.doc_id, {n} AS rule, '{key}' AS key, CASE WHEN v.value IS NULL THEN {str(not required).lower()} ELSE {test} END AS ok, {1.0 if required else 0.5}::DOUBLE AS weight, CASE WHEN v.value IS NULL AND {str(required).lower()} THEN '{key}' END AS missing FROM ds LEFT JOIN vals v ON v.doc_id = ds.doc_id AND v.key = '{key}'"


CHECKS = f"{VALUES}, checks AS ({' UNION ALL '.join(rule_sql(n, r) for n, r in enumerate(D.INVOICE_RULES))})"


def checks(spark, sf_dir):
    return E.rule_results(valued(spark, sf_dir), fields(spark, sf_dir).select("doc_id").distinct(), D.INVOICE_RULES)


def one_rule(name: str, where: str):
    @query(name, f"{CHECKS} SELECT doc_id, rule::INTEGER AS rule, ok FROM checks WHERE {where}")
    def run(spark, sf_dir):
        return checks(spark, sf_dir).filter(where).select("doc_id", "rule", "ok")


one_rule("val_enum", "rule = 5")
one_rule("val_pattern", "rule = 6")
one_rule("val_date", "rule = 1")
one_rule("val_range", "rule IN (4, 7)")


@query("val_required", f"{CHECKS} SELECT doc_id, key FROM checks WHERE missing IS NOT NULL")
def val_required(spark, sf_dir):
    return checks(spark, sf_dir).filter("missing IS NOT NULL").select("doc_id", "key")


@query("val_outcome", f"{CHECKS} SELECT doc_id, bool_and(ok) AND count(missing) = 0 AS ok, count(missing)::BIGINT AS n_missing FROM checks GROUP BY 1")
def val_outcome(spark, sf_dir):
    return checks(spark, sf_dir).groupBy("doc_id").agg((F.bool_and("ok") & (F.count("missing") == 0)).alias("ok"), F.count("missing").alias("n_missing"))


@query("val_reconcile", "SELECT o_orderkey, abs(s - o_totalprice) / greatest(abs(o_totalprice), 1) < 0.02 AS ok FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def val_reconcile(spark, sf_dir):
    net = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("s"))
    both = table(spark, sf_dir, "orders").join(net, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", (F.abs(F.col("s") - F.col("o_totalprice")) / F.greatest(F.abs("o_totalprice"), F.lit(1.0)) < 0.02).alias("ok"))


SIGNALS = f"""{GROUND}, vals AS (SELECT doc_id, key, CASE WHEN type IN ('number', 'currency') THEN (({NUMBER})::DECIMAL(18, 2))::VARCHAR ELSE {TYPED} END AS value, confidence FROM candidates), ds AS (SELECT DISTINCT doc_id FROM candidates),
checks AS ({' UNION ALL '.join(rule_sql(n, r) for n, r in enumerate(D.INVOICE_RULES))}),
vs AS (SELECT doc_id, sum(CASE WHEN ok THEN weight ELSE 0 END) / sum(weight) AS validation, greatest(0.0, 1 - 0.2 * count(DISTINCT missing)) AS missing FROM checks GROUP BY 1),
o AS (SELECT doc_id, coalesce(avg(ocr), CASE WHEN sum(length(text)) < 100 THEN 0.4 WHEN sum(length(text)) < 1000 THEN 0.7 ELSE 0.95 END) AS ocr FROM lines GROUP BY 1),
e AS (SELECT doc_id, sum(conf * CASE WHEN key IN ('invoice_number', 'invoice_date', 'buyer_name', 'total_amount') THEN 2 ELSE 1 END) / sum(CASE WHEN key IN ('invoice_number', 'invoice_date', 'buyer_name', 'total_amount') THEN 2 ELSE 1 END) AS extraction,
  coalesce(avg(conf) FILTER (key IN ('seller_tax_id', 'total_amount', 'tax_rate')), 1.0) AS consistency, avg(CASE WHEN n_evidence > 0 THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN n_evidence = 0 OR coalesce(ocr, 1.0) < 0.6 OR factor < 1 THEN 0.0 ELSE 1.0 END) AS uncertainty,
  sum(ocr * n_evidence) / sum(CASE WHEN ocr IS NOT NULL THEN n_evidence END) AS quality FROM out WHERE dropped IS NULL GROUP BY 1),
signals AS (SELECT vs.doc_id, vs.validation, coalesce(e.consistency, 1.0) AS consistency, o.ocr, coalesce(e.extraction, 0.0) AS extraction, coalesce(CASE WHEN e.quality IS NULL THEN e.coverage ELSE 0.5 * e.coverage + 0.5 * e.quality END, 0.0) AS evidence, coalesce(e.uncertainty, 0.0) AS uncertainty, vs.missing FROM vs JOIN o USING (doc_id) LEFT JOIN e USING (doc_id))"""
NAMES = ("validation", "consistency", "ocr", "extraction", "evidence", "uncertainty", "missing")


#: Signals by what they are made of: grounded fields, rules, lines.
GROUNDED, RULED, READ = ("consistency", "extraction", "evidence", "uncertainty"), ("validation", "missing"), ("ocr",)


def grounded_signals(spark, sf_dir):
    """Signals of every document with fields by those that are kept: cross-checked fields, fields, evidence, certainty."""
    g = G.ground(fields(spark, sf_dir), lines(spark, sf_dir)).filter("dropped IS NULL")
    required = [f[0] for f in D.INVOICE_FIELDS if f[3]]
    cross = [f[0] for f in D.INVOICE_FIELDS if f[4]]
    weight = F.when(F.col("key").isin(*required), 2).otherwise(1)
    e = g.groupBy("doc_id").agg(
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("extraction"),
        F.avg(F.when(F.col("key").isin(*cross), F.col("confidence"))).alias("consistency"),
        F.avg((F.col("n_evidence") > 0).cast("double")).alias("coverage"),
        F.avg((F.size("reasons") == 0).cast("double")).alias("uncertainty"),
        (F.sum(F.col("ocr") * F.col("n_evidence")) / F.sum(F.when(F.col("ocr").isNotNull(), F.col("n_evidence")))).alias("quality"),
    )
    e = fields(spark, sf_dir).select("doc_id").distinct().join(e, "doc_id", "left")
    evidence = F.when(F.col("quality").isNull(), F.col("coverage")).otherwise(0.5 * F.col("coverage") + 0.5 * F.col("quality"))
    return e.select("doc_id", F.coalesce("consistency", F.lit(1.0)).alias("consistency"), F.coalesce("extraction", F.lit(0.0)).alias("extraction"), F.coalesce(evidence, F.lit(0.0)).alias("evidence"), F.coalesce("uncertainty", F.lit(0.0)).alias("uncertainty"))


def signals(spark, sf_dir, names=NAMES):
    """The named signals of every document with fields and lines: rules, cross-checked fields, OCR, fields, evidence, certainty, completeness. Only what they are made of is."""
    made = []
    if set(names) & set(GROUNDED):
        made.append(grounded_signals(spark, sf_dir))
    if set(names) & set(RULED):
        made.append(checks(spark, sf_dir).groupBy("doc_id").agg((F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("validation"), F.greatest(F.lit(0.0), 1 - 0.2 * F.count_distinct("missing")).alias("missing")))
    if not made:
        made.append(fields(spark, sf_dir).select("doc_id").distinct())
    if set(names) & set(READ):
        size = F.sum(F.char_length("text"))
        made.append(lines(spark, sf_dir).groupBy("doc_id").agg(F.coalesce(F.avg("ocr"), F.when(size < 100, 0.4).when(size < 1000, 0.7).otherwise(0.95)).alias("ocr")))
    else:
        made.append(lines(spark, sf_dir).select("doc_id").distinct())
    both = made[0]
    for part in made[1:]:
        both = both.join(part, "doc_id")
    return both.select("doc_id", *names)


def signal(name: str, column: str):
    @query(name, f"{SIGNALS} SELECT doc_id, round({column}, 6)::DOUBLE AS value FROM signals")
    def run(spark, sf_dir):
        return signals(spark, sf_dir, (column,)).select("doc_id", F.round(column, 6).alias("value"))


for part, column in {"validation": "validation", "consistency": "consistency", "ocr": "ocr", "extraction": "extraction", "missing": "missing", "evidence": "evidence", "uncertainty": "uncertainty"}.items():
    signal(f"cnf_{part}", column)


@query("cnf_combine", f"{SIGNALS} SELECT doc_id, round(validation * 0.3 + consistency * 0.1 + ocr * 0.1 + extraction * 0.3 + evidence * 0.1 + uncertainty * 0.05 + missing * 0.05, 6)::DOUBLE AS confidence FROM signals")
def cnf_combine(spark, sf_dir):
    return signals(spark, sf_dir).select("doc_id", F.round(E.overall({n: F.col(n) for n in NAMES}), 6).alias("confidence"))


@query("cnf_validation_adjust", f"{CHECKS} SELECT v.doc_id, v.key, round(v.confidence * CASE WHEN bool_or(NOT c.ok) THEN 0.85 ELSE 1 END, 6)::DOUBLE AS confidence FROM vals v LEFT JOIN checks c ON c.doc_id = v.doc_id AND c.key = v.key GROUP BY v.doc_id, v.key, v.confidence")
def cnf_validation_adjust(spark, sf_dir):
    failed = checks(spark, sf_dir).filter("NOT ok").select("doc_id", "key").distinct().withColumn("failed", F.lit(True))
    both = valued(spark, sf_dir).join(failed, ["doc_id", "key"], "left")
    return both.select("doc_id", "key", F.round(F.col("confidence") * F.when(F.col("failed"), 0.85).otherwise(1.0), 6).alias("confidence"))


@query("cnf_tone", f"{with_fixtures('boxes')} SELECT doc_id, line_idx, word_idx, CASE WHEN confidence >= 0.85 THEN 'verified' WHEN confidence >= 0.5 THEN 'amber' ELSE 'red' END AS tone FROM boxes")
def cnf_tone(spark, sf_dir):
    c = F.col("confidence")
    return fixture(spark, sf_dir, "boxes").select("doc_id", "line_idx", "word_idx", F.when(c >= 0.85, "verified").when(c >= 0.5, "amber").otherwise("red").alias("tone"))


@query("trc_ground_summary", f"{GROUND} SELECT doc_id, round(avg(CASE WHEN n_evidence > 0 THEN 1.0 ELSE 0 END), 3)::DOUBLE AS coverage, count(*) FILTER (dropped IS NOT NULL)::BIGINT AS n_dropped FROM out GROUP BY 1")
def trc_ground_summary(spark, sf_dir):
    g = G.ground(fields(spark, sf_dir), lines(spark, sf_dir))
    return g.groupBy("doc_id").agg(F.round(F.avg((F.col("n_evidence") > 0).cast("double")), 3).alias("coverage"), F.count_if(F.col("dropped").isNotNull()).alias("n_dropped"))


CODES = [*D.ERRORS, "OTHER"]


@query("err_map", f"{with_fixtures('jobs')}, c AS (SELECT job_id, {CODES}[job_id % {len(CODES)} + 1] AS code FROM jobs WHERE status = 'error') SELECT job_id, code, CASE code {' '.join(f"WHEN '{k}' THEN {v}" for k, v in D.ERRORS.items())} ELSE 500 END::INTEGER AS http FROM c")
def err_map(spark, sf_dir):
    """The status of each failed job's error."""
    status = F.create_map(*(F.lit(x) for pair in D.ERRORS.items() for x in pair))
    code = F.get(F.array(*map(F.lit, CODES)), (F.col("job_id") % len(CODES)).cast("int"))
    failed = fixture(spark, sf_dir, "jobs").filter("status = 'error'").select("job_id", code.alias("code"))
    return failed.select("job_id", "code", F.coalesce(status[F.col("code")], F.lit(500)).alias("http"))
