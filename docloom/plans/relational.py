"""Queries of the relational store (inventory 2.3) and retrieval scoring (2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.vectors import cosine
from docloom.operators import relational as R
from docloom.operators.search import top_cosine
from docloom.registry import query
from docloom.sources.tables import fixture, table, with_fixtures

NOW = "timestamp '2024-01-02 00:00:00'"


def query_vector(spark, sf_dir):
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 1").first().embedding]


TOPK = "SELECT e.vec_id, d.source, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE {w} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) DESC, e.vec_id LIMIT 8"


@query("rel_vector_topk", TOPK.format(w="e.label = 3 AND e.embedding IS NOT NULL"))
def vector_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    top = R.vector_top_k(table(spark, sf_dir, "embeddings"), docs, query_vector(spark, sf_dir), F.col("label") == 3, 8)
    return top.select("vec_id", "source", F.round("score", 6).alias("score"))


@query("rel_vector_topk_raw", TOPK.format(w="e.label = 5 AND e.embedding IS NOT NULL"))
def vector_topk_raw(spark, sf_dir):
    """The query vector arrives as text and is read as an array."""
    text = "[" + ",".join(map(repr, query_vector(spark, sf_dir))) + "]"
    chunks = table(spark, sf_dir, "embeddings").filter((F.col("label") == 5) & F.col("embedding").isNotNull())
    scored = chunks.withColumn("score", cosine(F.col("embedding"), F.from_json(F.lit(text), "array<double>")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return scored.join(docs, "vec_id").orderBy(F.desc("score"), "vec_id").limit(8).select("vec_id", "source", F.round("score", 6).alias("score"))


@query("rel_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7) LIMIT 1")
def point_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    owner = orders.filter("o_orderkey = 7").select(F.col("o_custkey").alias("owner"))
    return orders.filter("o_orderkey = 7").join(owner, F.col("o_custkey") == F.col("owner"), "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus").limit(1)


@query("rel_list_page", "SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return R.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 40)


HISTORY = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n FROM conversations"


@query("rel_history_lastn", f"SELECT conv_id, turn, role, n::INTEGER AS newest FROM ({HISTORY}) WHERE n <= 3 ORDER BY conv_id, turn")
def history_lastn(spark, sf_dir):
    last = R.last_n(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn"), F.col("role")], 3)
    return last.select("conv_id", "turn", "role", "newest").orderBy("conv_id", "turn")


@query("rel_chat_list", "SELECT event_id, user_id, ts FROM events WHERE user_id < 20 AND (event_type = 'click' OR value IS NULL) ORDER BY ts DESC, event_id LIMIT 100")
def chat_list(spark, sf_dir):
    own = table(spark, sf_dir, "events").filter((F.col("user_id") < 20) & ((F.col("event_type") == "click") | F.col("value").isNull()))
    return own.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@query("rel_messages_asc", "SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') o ON c.conv_id = o.conv_id ORDER BY c.conv_id, c.turn")
def messages_asc(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    own = c.filter("role = 'system'").select("conv_id").distinct()
    return c.join(own, "conv_id").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


FEED = """WITH a AS (SELECT o_orderkey AS id, 'order' AS kind, o_orderdate AS at, o_custkey AS who FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8),
b AS (SELECT event_id AS id, 'event' AS kind, ts AS at, user_id AS who FROM events ORDER BY ts DESC, event_id LIMIT 8)
SELECT u.id, u.kind, u.at, c.c_name AS who FROM (SELECT * FROM a UNION SELECT * FROM b) u LEFT JOIN customer c ON c.c_custkey = u.who ORDER BY u.at DESC, u.kind, u.id LIMIT 10"""


@query("rel_activity_feed", FEED)
def activity_feed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("by"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("ts").alias("at"), F.col("user_id").alias("by"))
    newest = [x.orderBy(F.desc("at"), "id").limit(8) for x in (orders, events)]
    both = newest[0].unionByName(newest[1]).distinct()
    named = both.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("by"), F.col("c_name").alias("who")), "by", "left")
    return named.orderBy(F.desc("at"), "kind", "id").limit(10).select("id", "kind", "at", "who")


@query("rel_in_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def in_filter(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("rel_rls_owner", "SELECT event_id, value FROM events WHERE user_id = 11")
def rls_owner(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("user_id = 11").select("event_id", "value")


@query("rel_rls_exists", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey % 50 = 7)")
def rls_exists(spark, sf_dir):
    own = R.visible(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", F.col("o_custkey") % 50 == 7)
    return own.select("l_orderkey", "l_linenumber", "l_partkey")


@query("rel_rls_enabled", "SELECT p_partkey, p_brand FROM part WHERE p_size > 25")
def rls_enabled(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey", "p_brand")


JOBS = with_fixtures("jobs")


@query(
    "rel_idempotent_insert",
    f"""{JOBS}, target AS (SELECT * FROM jobs WHERE job_id % 2 = 0), fresh AS (SELECT * FROM jobs WHERE job_id % 2 = 1),
r AS (SELECT f.*, row_number() OVER (PARTITION BY user_id, idempotency_key ORDER BY job_id) AS n FROM fresh f WHERE idempotency_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM target t WHERE t.user_id = f.user_id AND t.idempotency_key = f.idempotency_key))
SELECT job_id, user_id, idempotency_key FROM r WHERE n = 1 UNION ALL SELECT job_id, user_id, idempotency_key FROM fresh WHERE idempotency_key IS NULL""",
)
def idempotent_insert(spark, sf_dir):
    jobs = fixture(spark, sf_dir, "jobs").select("job_id", "user_id", "idempotency_key")
    return R.insert_new(jobs.filter("job_id % 2 = 0"), jobs.filter("job_id % 2 = 1"), ["user_id", "idempotency_key"], [F.col("job_id")])


@query("rel_seed_upsert", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def seed_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    target = c.filter("c_custkey % 3 = 0")
    return target.unionByName(R.insert_new(target, c.filter("c_custkey % 2 = 0"), ["c_custkey"], [F.col("c_custkey")]))


CASCADE = """WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3), gone_orders AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT o.o_orderstatus AS grp, count(*)::BIGINT AS orders_left, sum(coalesce(n, 0))::BIGINT AS items_left, greatest(5 - count(*), 0)::BIGINT AS counter
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM gone_orders) GROUP BY 1"""


@query("rel_cascade_delete", CASCADE)
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("o_custkey"))
    left = table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    counts = left.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderstatus").alias("grp"))
    return counts.agg(F.count("*").alias("orders_left"), F.sum(F.coalesce("n", F.lit(0))).alias("items_left"), F.greatest(5 - F.count("*"), F.lit(0).cast("long")).alias("counter"))


@query("rel_counter_update", "SELECT c_custkey, count(o_orderkey)::BIGINT + 1 AS files_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counter_update(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", (F.coalesce("n", F.lit(0)) + 1).alias("files_count"))


@query("rel_updated_at_trigger", f"{JOBS} SELECT job_id, CASE WHEN status = 'error' THEN {NOW} ELSE updated_at END AS updated_at FROM jobs")
def updated_at_trigger(spark, sf_dir):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    return fixture(spark, sf_dir, "jobs").select("job_id", F.when(F.col("status") == "error", now).otherwise(F.col("updated_at")).alias("updated_at"))


@query("rel_new_user_trigger", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, split_part(concat('user', c_custkey::VARCHAR, '@mail.example.com'), '@', 1)) AS name FROM customer")
def new_user_trigger(spark, sf_dir):
    email = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example.com"))
    meta = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(meta, F.split_part(email, F.lit("@"), F.lit(1))).alias("name"))


@query("rel_stale_sweep", f"{JOBS}, m AS (SELECT max(updated_at) AS now FROM jobs), s AS (SELECT j.*, status IN ('queued', 'extracting', 'validating') AND updated_at < now - INTERVAL 60 MINUTE AS idle FROM jobs j, m) SELECT job_id, CASE WHEN idle THEN 'error' ELSE status END AS status, CASE WHEN idle THEN 'PIPELINE_INTERRUPTED' END AS error FROM s")
def stale_sweep(spark, sf_dir):
    jobs = fixture(spark, sf_dir, "jobs")
    now = F.lit(jobs.agg(F.max("updated_at")).first()[0]).cast("timestamp_ntz")
    return R.stale(jobs, now, 60, ("queued", "extracting", "validating")).select("job_id", "status", "error")


STAGES = ("load", "ocr", "classify", "extract", "ground", "validate", "score")
STATUS = ("classifying", "classifying", "classifying", "extracting", "extracting", "validating", "validating")


@query("rel_status_map", f"SELECT event_id, {list(STAGES)}[(event_id % 7 + 1)::INTEGER] AS stage, {list(STATUS)}[(event_id % 7 + 1)::INTEGER] AS status FROM events")
def status_map(spark, sf_dir):
    mapping = F.create_map(*(F.lit(x) for pair in zip(STAGES, STATUS, strict=True) for x in pair))
    stage = F.get(F.array(*map(F.lit, STAGES)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", stage.alias("stage")).withColumn("status", mapping[F.col("stage")])


@query(
    "rel_edit_overlay",
    "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 = 0 THEN 'edited ' || p_name END, p_name) AS value, CASE WHEN p_partkey % 4 = 0 THEN 1.0 ELSE round(p_size / 50.0, 6) END::DOUBLE AS confidence, CASE WHEN p_partkey % 4 = 0 THEN 'edited' ELSE 'extracted' END AS status FROM part",
)
def edit_overlay(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    edits = part.filter("p_partkey % 4 = 0").select("p_partkey", F.concat(F.lit("edited "), "p_name").alias("edit"))
    unknown = edits.withColumn("p_partkey", -1 - F.col("p_partkey"))
    allowed = edits.unionByName(unknown).join(part.select("p_partkey"), "p_partkey", "left_semi")
    both = part.join(allowed, "p_partkey", "left")
    edited = F.col("edit").isNotNull()
    return both.select("p_partkey", F.coalesce("edit", "p_name").alias("value"), F.when(edited, 1.0).otherwise(F.round(F.col("p_size") / 50, 6)).alias("confidence"), F.when(edited, "edited").otherwise("extracted").alias("status"))


@query("rel_title_default", "SELECT conv_id, replace(text[:80], chr(10), ' ') AS title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1")
def title_default(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.replace(F.left("text", F.lit(80)), F.lit("\n"), F.lit(" ")).alias("title"))


@query("rel_file_edit_lookup", "SELECT p.p_partkey, CASE WHEN s.s_suppkey IS NULL THEN 'insert' ELSE 'update' END AS action FROM part p LEFT JOIN (SELECT min(s_suppkey) AS s_suppkey, s_nationkey FROM supplier GROUP BY 2) s ON s.s_nationkey = p.p_size")
def file_edit_lookup(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "part").join(known, F.col("p_size") == F.col("s_nationkey"), "left").select("p_partkey", F.when(F.col("s_suppkey").isNull(), "insert").otherwise("update").alias("action"))


@query("rag_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings")
def rag_cosine(spark, sf_dir):
    q = query_vector(spark, sf_dir)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), F.array(*(F.lit(x) for x in q))), 6).alias("score"))


ANN = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id) SELECT query_id, vec_id, score, n::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5"


@query("rag_ann_index", ANN)
def ann_index(spark, sf_dir):
    """Exact top 5 of every fiftieth vector against all rows."""
    e = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("v"))
    return top_cosine(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 5)


@query("rag_null_guard", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND label < 4")
def null_guard(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND label < 4").select("vec_id")


@query("src_vector_literal")
def vector_literal(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]")).alias("literal"))
