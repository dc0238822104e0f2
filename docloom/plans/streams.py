"""Queries of sources, sinks, chunks and streams (inventory 2.1, 2.2, 2.5, 2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import chunks as C
from docloom.registry import query
from docloom.sources import dimensions as D
from docloom.sources.documents import lines as split_lines
from docloom.sources.documents import words as split_words
from docloom.sources.tables import derived, fixture, table, with_fixtures
from docloom.streaming import limits as L

LINES = "SELECT doc_id, unnest(generate_series(0, len(l) - 1))::INTEGER AS line_idx, unnest(l) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents)"


@query("src_ocr_from_text", f"WITH l AS ({LINES}), w AS (SELECT doc_id, line_idx, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS ws FROM l) SELECT doc_id, line_idx, unnest(generate_series(0, len(ws) - 1))::INTEGER AS word_idx, unnest(ws) AS text FROM w WHERE len(ws) > 0")
def ocr_from_text(spark, sf_dir):
    return split_words(split_lines(table(spark, sf_dir, "documents"))).select("doc_id", "line_idx", "word_idx", "text")


@query("rag_paragraphs", "SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n{2,}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')) AS p FROM documents")
def rag_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return d.select("doc_id", F.explode(C.paragraphs(F.col("text"))).alias("p"))


PREPARED = "regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g')"


@query("rag_chunk_short", f"SELECT conv_id, turn, {PREPARED} AS chunk FROM conversations WHERE length({PREPARED}) BETWEEN 1 AND 800")
def rag_chunk_short(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.char_length(C.prepared(F.col("text"))).between(1, C.SIZE))
    return c.select("conv_id", "turn", F.explode(C.chunks(F.col("text"))).alias("chunk"))


def point_sql(x: str) -> str:
    r = f"{x}[701:900]"
    return f"CASE WHEN regexp_matches({r}, '[.!?]\\s') THEN 700 + length(regexp_extract({r}, '(?s)^(.*?)[.!?]\\s', 1)) + 2 WHEN contains({r}, chr(10)) THEN 700 + strpos({r}, chr(10)) WHEN contains({r}, ' ') THEN 700 + length(regexp_extract({r}, '(?s)^(.*) ', 1)) + 1 ELSE 800 END"


@query("rag_split_point", f"SELECT doc_id, ({point_sql('text')})::INTEGER AS at FROM documents WHERE length(text) > 1200")
def rag_split_point(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.char_length("text") > 1200)
    return d.select("doc_id", C.split_point(F.col("text")).cast("int").alias("at"))


DOUBLED = PREPARED.replace("(text,", "(replace(text, chr(10), chr(10) || chr(10)),")
# State of the fold: paragraphs, the next one, the text carried, the chunks so far and the one just given.
FOLD = f"""WITH RECURSIVE d AS (SELECT doc_id, {DOUBLED} AS whole FROM documents WHERE {DOUBLED} <> ''),
t AS (SELECT doc_id, CASE WHEN length(whole) <= 800 THEN [whole] ELSE list_filter(list_transform(regexp_split_to_array(whole, '\\n{{2,}}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') END AS ps, 1 AS i, '' AS now, 0 AS n, NULL::VARCHAR AS chunk FROM d
UNION ALL SELECT doc_id, ps, CASE WHEN length(now) > 1200 OR i > len(ps) THEN i ELSE i + 1 END,
  CASE WHEN length(now) > 1200 THEN now[greatest(0, p - 150) + 1:] WHEN i > len(ps) THEN NULL WHEN now <> '' AND length(now) + length(ps[i]) + 2 > 800 THEN right(now, 150) || chr(10) || chr(10) || ps[i] WHEN now <> '' THEN now || chr(10) || chr(10) || ps[i] ELSE ps[i] END,
  n + CASE WHEN chunk IS NULL THEN 0 ELSE 1 END,
  CASE WHEN length(now) > 1200 THEN trim(now[:p]) WHEN i > len(ps) THEN nullif(trim(now), '') WHEN now <> '' AND length(now) + length(ps[i]) + 2 > 800 THEN trim(now) END
  FROM (SELECT *, {point_sql('now')} AS p FROM t WHERE now IS NOT NULL))
SELECT doc_id, n::INTEGER AS n, md5(chunk) AS digest FROM t WHERE chunk IS NOT NULL"""


@query("rag_chunk_fold", FOLD)
def rag_chunk_fold(spark, sf_dir):
    """All documents, each line a paragraph: folded to the size with overlap, long ones cut."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return d.select("doc_id", F.posexplode(C.chunks(F.col("text"))).alias("n", "chunk")).select("doc_id", "n", F.md5("chunk").alias("digest"))


MIME = "CASE event_type WHEN 'view' THEN 'application/pdf' WHEN 'click' THEN 'text/plain' WHEN 'signup' THEN 'image/png' WHEN 'purchase' THEN 'audio/mpeg' ELSE 'application/octet-stream' END"
ROUTES = [("application/pdf", "pdf"), ("image/", "image"), ("audio/", "audio"), ("video/", "video"), ("text/", "text")]


@query("src_parse_dispatch", f"WITH m AS (SELECT event_id, {MIME} AS mime FROM events) SELECT event_id, CASE {' '.join(f"WHEN starts_with(mime, '{p}') THEN '{r}'" for p, r in ROUTES)} ELSE 'binary' END AS route FROM m")
def parse_dispatch(spark, sf_dir):
    mime = F.expr(MIME)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(*(F.when(mime.startswith(p), r) for p, r in ROUTES), F.lit("binary")).alias("route"))


@query("src_binary_sniff", "SELECT page_id, length(regexp_replace(html, '[^\\x01-\\x08\\x0e-\\x1f]', '', 'g')) / greatest(length(html), 1) < 0.1 AS is_text FROM pages")
def binary_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.regexp_count("html", F.lit(r"[\x01-\x08\x0e-\x1f]")) / F.greatest(F.char_length("html"), F.lit(1)) < 0.1).alias("is_text"))


MAGIC = "SELECT page_id AS k, concat(CASE page_id % 5 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FF' WHEN 2 THEN '25504446' WHEN 3 THEN '' ELSE '8950' END, hex(substr(html, 1, 20))) AS hex FROM {pages}"
SNIFF = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("25504446", "application/pdf")]


@query("src_mime_sniff", f"SELECT k, CASE {' '.join(f"WHEN starts_with(hex, '{h}') THEN '{m}'" for h, m in SNIFF)} END AS mime FROM ({MAGIC.replace('{pages}', 'pages')})")
def mime_sniff(spark, sf_dir):
    content = F.unhex("hex")
    return derived(spark, sf_dir, MAGIC).select("k", F.coalesce(*(F.when(F.startswith(content, F.unhex(F.lit(h))), m) for h, m in SNIFF)).alias("mime"))


READ = f"{with_fixtures('pages_read')}, l AS (SELECT k, 'total ' || v AS text, 0.9::DOUBLE AS confidence FROM pages_read WHERE k % 3 = 0 UNION ALL SELECT k, 'end', NULL FROM pages_read WHERE k % 3 = 0 UNION ALL SELECT k, unnest(string_split(reply, chr(10))), NULL FROM pages_read WHERE k % 3 = 1)"


@query("src_ocr_json", f"{READ} SELECT k, text, confidence FROM l")
def ocr_json(spark, sf_dir):
    """Lines of a reader's replies, JSON or plain text."""
    r = fixture(spark, sf_dir, "pages_read").withColumn("p", F.from_json("reply", "lines array<struct<text:string,confidence:double>>"))
    plain = F.transform(F.split("reply", r"\r?\n"), lambda t: F.struct(t.alias("text"), F.lit(None).cast("double").alias("confidence")))
    found = F.when(F.trim("reply").startswith("{"), F.col("p.lines")).otherwise(plain)
    return r.select("k", F.explode(found).alias("l")).select("k", "l.text", "l.confidence")


@query("src_image", f"{READ} SELECT k, unnest(string_split(text, ' ')) AS word, confidence FROM l")
def image(spark, sf_dir):
    """Line confidence goes to each of its words."""
    return ocr_json(spark, sf_dir).select("k", F.explode(F.split("text", " ")).alias("word"), "confidence")


ATTEMPTS = "SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_suppkey % 4 = 0 AS ok, l_partkey AS score FROM {lineitem}"


def attempts(spark, sf_dir):
    return spark.sql(ATTEMPTS, lineitem=table(spark, sf_dir, "lineitem")).groupBy("doc_id", "ord").agg(F.bool_or("ok").alias("ok"), F.max("score").alias("score"))


TRIED = f"WITH a AS (SELECT doc_id, ord, bool_or(ok) AS ok, max(score) AS score FROM ({ATTEMPTS.replace('{lineitem}', 'lineitem')}) GROUP BY 1, 2)"


@query("src_ocr_fallback_models", f"{TRIED} SELECT doc_id, ord AS model, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM a WHERE ok) WHERE n = 1")
def ocr_fallback_models(spark, sf_dir):
    return L.first_success(attempts(spark, sf_dir), "doc_id").select("doc_id", F.col("ord").alias("model"), "score")


# What each provider would say to each order's request, attempt by attempt.
SAID = """SELECT o_custkey AS run, o_orderkey AS seq, CAST(p AS INTEGER) AS provider, CAST(t AS INTEGER) AS attempt, CASE (o_orderkey * 7 + p * 5 + t * 3 + o_custkey) % 29
    WHEN 0 THEN '402 payment required' WHEN 1 THEN 'HTTP 404' WHEN 2 THEN '413 too large' WHEN 3 THEN '401 denied' WHEN 4 THEN 'RESOURCE_EXHAUSTED: limit: 0' WHEN 5 THEN 'RESOURCE_EXHAUSTED' WHEN 6 THEN '429 slow down' WHEN 7 THEN 'port 4040 closed'
    ELSE CASE WHEN (o_orderkey + p + t) % 3 < 2 THEN 'timeout' END END AS message
FROM {orders} JOIN (VALUES (0), (1), (2)) AS ps(p) ON o_orderkey >= 0 JOIN (VALUES (0), (1), (2)) AS ts(t) ON o_orderkey >= 0"""
FAILOVER = f"""WITH RECURSIVE said AS ({SAID.replace('{orders}', 'orders WHERE_')}), k AS (SELECT *, CASE WHEN message IS NULL THEN 'ok' WHEN regexp_matches(message, '\\b(402|404)\\b') THEN 'permanent' WHEN regexp_matches(message, '\\b(413|401)\\b') OR (contains(message, 'RESOURCE_EXHAUSTED') AND contains(message, 'limit: 0')) THEN 'final' END AS kind FROM said),
pr AS (SELECT run, seq, provider, coalesce(arg_min(kind, attempt), 'failed') AS result, coalesce(min(attempt) FILTER (kind IS NOT NULL) + 1, count(*)) AS n FROM (SELECT * FROM k) GROUP BY 1, 2, 3),
q AS (SELECT run, seq, list(result ORDER BY provider) AS res, list(n ORDER BY provider) AS ns, row_number() OVER (PARTITION BY run ORDER BY seq) AS pos FROM pr GROUP BY 1, 2),
s AS (SELECT *, []::INTEGER[] AS lost FROM q WHERE pos = 1 UNION ALL SELECT q.*, list_concat(s.lost, list_filter([0, 1, 2], lambda p: NOT list_contains(s.lost, p) AND s.res[p + 1] = 'permanent' AND p < coalesce(list_filter([0, 1, 2], lambda o: NOT list_contains(s.lost, o) AND s.res[o + 1] = 'ok')[1], 3))) FROM s JOIN q ON q.run = s.run AND q.pos = s.pos + 1),
u AS (SELECT *, list_filter([0, 1, 2], lambda o: NOT list_contains(lost, o) AND res[o + 1] = 'ok')[1] AS provider FROM s)
SELECT run, seq, provider, len(list_filter([0, 1, 2], lambda p: NOT list_contains(lost, p) AND p <= coalesce(provider, 2)))::INTEGER AS tried, coalesce(list_sum(list_transform(list_filter([0, 1, 2], lambda p: NOT list_contains(lost, p) AND p <= coalesce(provider, 2)), lambda p: ns[p + 1])), 0)::INTEGER AS attempts FROM u""".replace("orders WHERE_", "orders")


def provider_outcomes(spark, sf_dir):
    return L.provider_results(derived(spark, sf_dir, SAID), ["run", "seq", "provider"])


@query("st_provider_failover", FAILOVER)
def provider_failover(spark, sf_dir):
    """The provider that answers each request of a customer; one that fails for good is not asked again."""
    return L.failover(provider_outcomes(spark, sf_dir), "run", "seq", [0, 1, 2])


@query("src_pdf_pages", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w <= 100 AS done FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def pdf_pages(spark, sf_dir):
    """Pages are read while their running cost stays within the budget."""
    run = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.sum("l_quantity").over(run) <= 100).alias("done"))


@query("src_pdf", "SELECT doc_id, CASE WHEN n_chars < 50 THEN 'image' WHEN n_chars < 500 AND doc_id % 2 = 0 THEN 'ocr' ELSE 'text' END AS way FROM documents")
def pdf(spark, sf_dir):
    longer = F.col("doc_id") % 2 == 0
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 50, "image").when((F.col("n_chars") < 500) & longer, "ocr").otherwise("text").alias("way"))


@query("src_xlsx", "SELECT n_regionkey, string_agg('--- Sheet: ' || n_name || ' ---' || chr(10) || n_nationkey::VARCHAR, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def xlsx(spark, sf_dir):
    sheet = F.concat(F.lit("--- Sheet: "), "n_name", F.lit(" ---\n"), F.col("n_nationkey").cast("string"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", sheet.alias("s")))), lambda x: x["s"])
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(parts, "\n").alias("text"))


@query("src_relational", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def relational(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


CAND = with_fixtures("candidates")


@query("sink_json", f"{CAND} SELECT doc_id, '{{' || string_agg('\"' || key || '\":\"' || raw || '\"', ',' ORDER BY ord) || '}}' AS json FROM candidates WHERE raw <> '' GROUP BY 1")
def sink_json(spark, sf_dir):
    f = fixture(spark, sf_dir, "candidates").filter("raw <> ''")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "raw"))), lambda s: F.struct(s["key"].alias("key"), s["raw"].alias("value")))
    return f.groupBy("doc_id").agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


CSV = ("invoice_number", "invoice_date", "buyer_name", "currency", "total_amount", "notes")


@query("sink_csv", f"{CAND} SELECT doc_id, {' || chr(44) || '.join(f"coalesce(max(CASE WHEN key = '{k}' THEN raw END), '')" for k in CSV)} AS line FROM candidates GROUP BY 1")
def sink_csv(spark, sf_dir):
    from docloom.functions.text import csv_escape

    wide = fixture(spark, sf_dir, "candidates").groupBy("doc_id").pivot("key", list(CSV)).agg(F.max("raw"))
    return wide.select("doc_id", F.concat_ws(",", *(F.coalesce(csv_escape(F.col(k)), F.lit("")) for k in CSV)).alias("line"))


@query("sink_filename", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name || ' #' || p_size::VARCHAR || '!', '[^a-zA-Z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document') AS name FROM part")
def sink_filename(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string"), F.lit("!"))
    clean = F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "-"), "^-+|-+$", "")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.nullif(clean, F.lit("")), F.lit("document")).alias("name"))


@query("sink_skip_rule", "SELECT conv_id, turn FROM conversations WHERE length(text) >= 30 AND NOT regexp_matches(text, '^\\[(Audio|Video|Could not extract|No text found)')")
def sink_skip_rule(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter((F.char_length("text") >= 30) & ~F.col("text").rlike(r"^\[(Audio|Video|Could not extract|No text found)")).select("conv_id", "turn")


@query("sink_rag_context", "WITH c AS (SELECT conv_id, role, min(turn) AS first_turn, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1, 2) SELECT conv_id, md5(string_agg('[' || role || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY first_turn, role)) AS digest FROM c GROUP BY 1")
def sink_rag_context(spark, sf_dir):
    joined = lambda order, text, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), sep)
    groups = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), joined(["turn"], "text", "\n---\n").alias("body"))
    groups = groups.withColumn("block", F.concat(F.lit("["), "role", F.lit("]\n"), "body"))
    return groups.groupBy("conv_id").agg(F.md5(joined(["first_turn", "role"], "block", "\n\n")).alias("digest"))


@query("sink_dto", "SELECT doc_id, lang, md5(text[:4000]) AS preview FROM documents")
def sink_dto(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.left("text", F.lit(4000))).alias("preview"))


CODES = list(D.UNCERTAINTY)


@query("sink_uncertainty_label", f"{with_fixtures('candidates')}, c AS (SELECT doc_id, key, {CODES}[(doc_id + ord) % {len(CODES)} + 1] AS code FROM candidates) SELECT doc_id, key, code, CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in D.UNCERTAINTY.items())} END AS phrase FROM c")
def sink_uncertainty_label(spark, sf_dir):
    phrase = F.create_map(*(F.lit(x) for pair in D.UNCERTAINTY.items() for x in pair))
    code = F.get(F.array(*map(F.lit, CODES)), ((F.col("doc_id") + F.col("ord")) % len(CODES)).cast("int"))
    return fixture(spark, sf_dir, "candidates").select("doc_id", "key", code.alias("code")).withColumn("phrase", phrase[F.col("code")])


JOBS = with_fixtures("jobs")


@query("sink_persist_extraction", f"{JOBS} SELECT user_id, arg_max(job_id, (updated_at, job_id)) AS job_id FROM jobs WHERE status IN ('complete', 'error') GROUP BY 1")
def sink_persist_extraction(spark, sf_dir):
    ended = fixture(spark, sf_dir, "jobs").filter(F.col("status").isin("complete", "error"))
    return ended.groupBy("user_id").agg(F.max_by("job_id", F.struct("updated_at", "job_id")).alias("job_id"))


LIMITED = """WITH RECURSIVE q AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, t, n, 1 AS c, t + 900 AS reset, true AS allowed FROM q WHERE n = 1
UNION ALL SELECT q.user_id, q.event_id, q.t, q.n, CASE WHEN s.reset < q.t THEN 1 WHEN s.c >= 10 THEN s.c ELSE s.c + 1 END, CASE WHEN s.reset < q.t THEN q.t + 900 ELSE s.reset END, s.reset < q.t OR s.c < 10 FROM s JOIN q ON q.user_id = s.user_id AND q.n = s.n + 1)
SELECT user_id, event_id, allowed FROM s"""


@query("st_rate_limit", LIMITED)
def rate_limit(spark, sf_dir):
    limit, seconds = L.PRESETS["auth"]
    return L.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit, seconds).select("user_id", "event_id", "allowed")


@query("st_rate_gc", "SELECT user_id, max(ts) + INTERVAL 900 SECOND < (SELECT max(ts) FROM events) AS expired FROM events GROUP BY 1")
def rate_gc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now))
    return last.select("user_id", (F.col("last") + F.expr("INTERVAL 900 SECOND") < F.col("now")).alias("expired"))


HEADERS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(' 1.2.3.', CAST(user_id AS STRING), ' , 5.6.7.8') WHEN 1 THEN '' END AS fwd, CASE WHEN event_id % 3 = 0 THEN concat('9.9.9.', CAST(user_id AS STRING)) END AS ip FROM {events}"


@query("st_client_id", f"WITH h AS ({HEADERS.replace('{events}', 'events')}) SELECT event_id, CASE WHEN trim(split_part(fwd, ',', 1)) <> '' THEN trim(split_part(fwd, ',', 1)) WHEN trim(ip) <> '' THEN trim(ip) ELSE 'unknown' END AS client FROM h")
def client_id(spark, sf_dir):
    h = spark.sql(HEADERS, events=table(spark, sf_dir, "events"))
    return h.select("event_id", L.client_id(F.col("fwd"), F.col("ip")).alias("client"))


FRAME = "concat('event: token', chr(10), 'data: ', replace(text, chr(10), ' '), chr(10), chr(10))"


@query("st_sse_emit", f"SELECT conv_id, turn, md5({FRAME}) AS frame FROM conversations")
def sse_emit(spark, sf_dir):
    frame = F.concat(F.lit("event: token\ndata: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(frame).alias("frame"))


@query("st_sse_parse", "SELECT conv_id, md5(string_agg(replace(text, chr(10), ' '), '' ORDER BY turn)) AS content, count(*)::INTEGER AS n_events FROM conversations GROUP BY 1")
def sse_parse(spark, sf_dir):
    """Frames cut into pieces at arbitrary places come together again."""
    frame = F.concat(F.lit("event: token\ndata: "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n\n"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", frame.alias("f"))
    pieces = c.select("conv_id", "turn", F.posexplode(F.array(F.left("f", F.lit(9)), F.substring("f", 10, 1 << 30))).alias("part", "text"))
    open_tail = c.groupBy("conv_id").agg(F.lit(1 << 30).cast("long").alias("turn"), F.lit(0).alias("part"), F.lit("event: tok").alias("text"))
    whole = pieces.unionByName(open_tail).withColumn("seq", F.struct("turn", "part"))
    return L.assemble_events(whole, "conv_id", "seq", "text").select("conv_id", F.md5("content").alias("content"), "n_events")


# Conversations as requests to a provider each, some of them long.
REQUESTS = "SELECT conv_id, turn, role, repeat(text, CAST(1 + conv_id % 60 AS INT)) AS content, CASE conv_id % 4 WHEN 0 THEN 'groq' WHEN 1 THEN 'cerebras' WHEN 2 THEN 'huggingface' ELSE 'other' END AS provider FROM {conversations}"


@query("st_truncate_for_provider", f"WITH r AS ({REQUESTS.replace('{conversations}', 'conversations')}), o AS (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id) - CASE WHEN provider <> 'other' THEN 20000 END AS over FROM r), c AS (SELECT *, CASE WHEN over > 0 AND role IN ('system', 'user') AND length(content) > 1000 THEN least(length(content) - 500, over) ELSE 0 END::INTEGER AS cut FROM o) SELECT conv_id, turn, length(content[cut + 1:])::INTEGER AS n, md5(content[cut + 1:]) AS digest FROM c")
def truncate_for_provider(spark, sf_dir):
    out = L.truncated(derived(spark, sf_dir, REQUESTS), "conv_id")
    return out.select("conv_id", "turn", F.char_length("content").alias("n"), F.md5("content").alias("digest"))


@query("st_job_state", f"{JOBS}, r AS (SELECT *, CASE status WHEN 'queued' THEN 0 WHEN 'extracting' THEN 2 WHEN 'validating' THEN 3 ELSE 4 END AS rank FROM jobs), f AS (SELECT user_id, arg_min(status, (updated_at, job_id)) AS final FROM r WHERE rank = 4 GROUP BY 1), o AS (SELECT user_id, arg_max(status, (rank, updated_at, job_id)) AS open FROM r GROUP BY 1) SELECT o.user_id, coalesce(final, open) AS status FROM o LEFT JOIN f USING (user_id)")
def job_state(spark, sf_dir):
    return L.job_state(fixture(spark, sf_dir, "jobs"), "user_id", "updated_at", "job_id")


@query("st_stale_timeout", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 60 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def stale_timeout(spark, sf_dir):
    return L.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "60 minutes").select("user_id", "start", "n")
