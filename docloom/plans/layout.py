"""Queries of layout construction (2.9), the node queries of 2.8 and the graph checks of 2.11."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import claims as C
from docloom.operators import graphs as V
from docloom.operators import layout as L
from docloom.registry import query
from docloom.sources.cut import cut
from docloom.sources.tables import fixture, with_fixtures

BOXES = with_fixtures("boxes")
KEY = "doc_id, line_idx, word_idx"
OX = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x))"
OY = "greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"
GX = "greatest(0, greatest(a.x, b.x) - least(a.x + a.width, b.x + b.width))"
GY = "greatest(0, greatest(a.y, b.y) - least(a.y + a.height, b.y + b.height))"
GAPS = f"""{BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_idx ORDER BY x, word_idx) AS n FROM boxes),
hg AS (SELECT b.doc_id, b.line_idx, b.word_idx, {GX} AS gap FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.line_idx = b.line_idx AND b.n = a.n + 1 WHERE {OY} > 0),
cap AS (SELECT doc_id, median(height) * 10 AS cap FROM boxes GROUP BY 1),
vg AS (SELECT a.doc_id, a.line_idx AS a_line, a.word_idx AS a_word, min({GY}) AS gap FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND (a.line_idx, a.word_idx) <> (b.line_idx, b.word_idx) JOIN cap ON cap.doc_id = a.doc_id WHERE {OX} > 0 AND {GY} > 0 AND sqrt(pow({GX}, 2) + pow({GY}, 2)) <= cap GROUP BY 1, 2, 3)"""


def limit_sql(name: str) -> str:
    return f"{name}m AS (SELECT doc_id, median(gap) AS m FROM {name} GROUP BY 1), {name}t AS (SELECT doc_id, CASE WHEN median(abs(gap - m)) = 0 THEN any_value(m) ELSE any_value(m) + 3 * median(abs(gap - m)) END AS t FROM {name} JOIN {name}m USING (doc_id) GROUP BY 1)"


BLOCKS = f"""{GAPS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {limit_sql('hg')}, {limit_sql('vg')},
e AS (SELECT DISTINCT a.doc_id, a.line_idx * 1000 + a.word_idx AS a, b.line_idx * 1000 + b.word_idx AS b FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND (a.line_idx, a.word_idx) <> (b.line_idx, b.word_idx) LEFT JOIN hgt ON hgt.doc_id = a.doc_id LEFT JOIN vgt ON vgt.doc_id = a.doc_id
  WHERE ({OY} > 0 AND {GX} <= coalesce(hgt.t, 0)) OR ({OX} > 0 AND {GY} <= coalesce(vgt.t, 0))),
reach AS (SELECT doc_id, line_idx * 1000 + word_idx AS a, line_idx * 1000 + word_idx AS b FROM boxes UNION SELECT r.doc_id, r.a, e.b FROM reach r JOIN e ON e.doc_id = r.doc_id AND e.a = r.b),
roots AS (SELECT doc_id, a, min(b) AS root FROM reach GROUP BY 1, 2),
bl AS (SELECT doc_id, (a // 1000)::INTEGER AS line_idx, (a % 1000)::INTEGER AS word_idx, (dense_rank() OVER (PARTITION BY doc_id ORDER BY root) - 1)::INTEGER AS block FROM roots)"""


def boxes(spark, sf_dir):
    """Word boxes, dealt by document once: what goes on page by page moves them no more."""
    return fixture(spark, sf_dir, "boxes", {"lineitem": "l_orderkey"})


def blocked(spark, sf_dir, *more: str):
    """Words with their boxes, blocks and `more` columns."""
    return L.blocked(boxes(spark, sf_dir).select(*L.WORD, *L.BOX, *more))


@query("lay_clean", f"{BOXES} SELECT doc_id, count(*) FILTER (confidence >= 0.6)::BIGINT AS kept, count(*) FILTER (confidence < 0.6)::BIGINT AS skipped FROM boxes GROUP BY 1")
def lay_clean(spark, sf_dir):
    """Boxes of weak words are taken away here, so that some words have none."""
    b = boxes(spark, sf_dir).withColumn("x", F.when(F.col("confidence") >= 0.6, F.col("x")))
    kept = L.finite(b).groupBy("doc_id").agg(F.count("*").alias("kept"))
    return b.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("skipped"))


@query("lay_project", f"{BOXES} SELECT doc_id, line_idx, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*)::BIGINT AS n FROM boxes GROUP BY 1, 2")
def lay_project(spark, sf_dir):
    return L.union_box(boxes(spark, sf_dir), ["doc_id", "line_idx"], F.count("*").alias("n"))


@query("seg_hgap_samples", f"{GAPS} SELECT {KEY}, gap::DOUBLE AS gap FROM hg")
def seg_hgap_samples(spark, sf_dir):
    return L.horizontal_gaps(boxes(spark, sf_dir))


@query("seg_vgap_samples", f"{GAPS} SELECT doc_id, a_line, a_word, gap::DOUBLE AS gap FROM vg")
def seg_vgap_samples(spark, sf_dir):
    return L.vertical_gaps(boxes(spark, sf_dir))


@query("seg_grow", f"{BLOCKS} SELECT * FROM bl")
def seg_grow(spark, sf_dir):
    return L.blocks(boxes(spark, sf_dir))


OF = f"{BLOCKS}, w AS (SELECT * FROM boxes JOIN bl USING (doc_id, line_idx, word_idx))"
UNION = "min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height"


@query("blk_geometry", f"{OF} SELECT doc_id, block, {UNION}, round((max(x + width) - min(x)) / (max(y + height) - min(y)), 6) AS aspect FROM w GROUP BY 1, 2")
def blk_geometry(spark, sf_dir):
    u = L.union_box(blocked(spark, sf_dir), ["doc_id", "block"])
    return u.withColumn("aspect", F.round(F.col("width") / F.col("height"), 6))


@query("blk_density", f"{OF}, u AS (SELECT doc_id, block, count(*) AS n, count(DISTINCT line_idx) AS lines, sum(length(text)) AS chars, (max(x + width) - min(x)) * (max(y + height) - min(y)) AS area FROM w GROUP BY 1, 2) SELECT doc_id, block, n::BIGINT AS n, lines::BIGINT AS lines, chars::BIGINT AS chars, round(n / area, 9) AS density FROM u")
def blk_density(spark, sf_dir):
    u = L.union_box(blocked(spark, sf_dir, "text"), ["doc_id", "block"], F.count("*").alias("n"), F.count_distinct("line_idx").alias("lines"), F.sum(F.char_length("text")).alias("chars"))
    return u.select("doc_id", "block", "n", "lines", "chars", F.round(F.col("n") / (F.col("width") * F.col("height")), 9).alias("density"))


@query("blk_confidence", f"{OF} SELECT doc_id, block, round(avg(confidence), 6) AS mean, round(var_pop(confidence), 6) AS variance, min(confidence) AS least, max(confidence) AS most FROM w GROUP BY 1, 2")
def blk_confidence(spark, sf_dir):
    c = "confidence"
    return blocked(spark, sf_dir, c).groupBy("doc_id", "block").agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.var_pop(c), 6).alias("variance"), F.min(c).alias("least"), F.max(c).alias("most"))


@query("blk_spacing", f"{OF}, o2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block, line_idx ORDER BY x, word_idx) AS n FROM w), g AS (SELECT b.doc_id, b.block, {GX} AS gap FROM o2 a JOIN o2 b ON a.doc_id = b.doc_id AND a.block = b.block AND a.line_idx = b.line_idx AND b.n = a.n + 1 WHERE {OY} > 0) SELECT doc_id, block, round(avg(gap), 6) AS mean_gap, round(var_pop(gap), 6) AS variance, max(gap)::DOUBLE AS most FROM g GROUP BY 1, 2")
def blk_spacing(spark, sf_dir):
    # A line's words of one block are a line of their own for its gaps.
    g = L.horizontal_gaps(blocked(spark, sf_dir), "block")
    return g.groupBy("doc_id", "block").agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.var_pop("gap"), 6).alias("variance"), F.max("gap").alias("most"))


NODES = f"""{OF}, nodes AS (SELECT doc_id, 'word' AS level, 'w-' || line_idx || '-' || word_idx AS id, 'l-' || block || '-' || line_idx AS parent, x, y, width, height, 1::BIGINT AS n, confidence FROM w
UNION ALL SELECT doc_id, 'line', 'l-' || block || '-' || line_idx, 'b-' || block, {UNION}, count(*), avg(confidence) FROM w GROUP BY doc_id, block, line_idx
UNION ALL SELECT doc_id, 'block', 'b-' || block, 'd', {UNION}, count(*), NULL FROM w GROUP BY doc_id, block
UNION ALL SELECT doc_id, 'document', 'd', NULL, {UNION}, count(*), NULL FROM w GROUP BY doc_id)"""


def nodes(spark, sf_dir):
    return L.hierarchy(blocked(spark, sf_dir)).drop("path")


@query("hier_build", f"{NODES} SELECT doc_id, level, id, parent, x, y, width, height, n FROM nodes")
def hier_build(spark, sf_dir):
    return nodes(spark, sf_dir)


@query("hier_order", f"{NODES} SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id, parent ORDER BY y, x, id)::INTEGER AS ord FROM nodes WHERE level IN ('line', 'block')")
def hier_order(spark, sf_dir):
    at = Window.partitionBy("doc_id", "parent").orderBy("y", "x", "id")
    return nodes(spark, sf_dir).filter(F.col("level").isin("line", "block")).select("doc_id", "id", F.row_number().over(at).alias("ord"))


# Blocks of a page as words are blocks: gaps to the nearest block beside and below, thresholds, links, what they reach.
GROUPED = f"""{OF}, ub AS (SELECT doc_id, block, {UNION} FROM w GROUP BY 1, 2), ucap AS (SELECT doc_id, median(height) * 10 AS cap FROM ub GROUP BY 1),
bp AS (SELECT a.doc_id, a.block AS ab, b.block AS bb, {OX} AS ox, {OY} AS oy, {GX} AS gx, {GY} AS gy, cap FROM ub a JOIN ub b ON a.doc_id = b.doc_id AND a.block <> b.block JOIN ucap ON ucap.doc_id = a.doc_id),
bh AS (SELECT doc_id, ab, min(gx) AS gap FROM bp WHERE oy > 0 AND gx > 0 AND sqrt(gx * gx + gy * gy) <= cap GROUP BY 1, 2), bv AS (SELECT doc_id, ab, min(gy) AS gap FROM bp WHERE ox > 0 AND gy > 0 AND sqrt(gx * gx + gy * gy) <= cap GROUP BY 1, 2),
{limit_sql('bh')}, {limit_sql('bv')}, be AS (SELECT bp.doc_id, ab, bb FROM bp LEFT JOIN bht ON bht.doc_id = bp.doc_id LEFT JOIN bvt ON bvt.doc_id = bp.doc_id WHERE (oy > 0 AND gx <= coalesce(bht.t, 0)) OR (ox > 0 AND gy <= coalesce(bvt.t, 0))),
breach AS (SELECT doc_id, block AS a, block AS b FROM ub UNION SELECT r.doc_id, r.a, be.bb FROM breach r JOIN be ON be.doc_id = r.doc_id AND be.ab = r.b), broots AS (SELECT doc_id, a AS block, min(b) AS root FROM breach GROUP BY 1, 2)"""


@query("hier_region_group", f"{GROUPED} SELECT doc_id, block, (dense_rank() OVER (PARTITION BY doc_id ORDER BY root) - 1)::INTEGER AS region FROM broots")
def hier_region_group(spark, sf_dir):
    """The region of each block: blocks near each other, by the page's own gaps."""
    return L.regions(L.union_box(blocked(spark, sf_dir), ["doc_id", "block"]), boxes(spark, sf_dir))


@query("hier_agg_conf", f"{OF}, l AS (SELECT doc_id, block, line_idx, avg(confidence) AS c FROM w GROUP BY 1, 2, 3) SELECT doc_id, block, round(avg(c), 6) AS mean FROM l GROUP BY 1, 2")
def hier_agg_conf(spark, sf_dir):
    lines = blocked(spark, sf_dir, "confidence").groupBy("doc_id", "block", "line_idx").agg(F.avg("confidence").alias("c"))
    return lines.groupBy("doc_id", "block").agg(F.round(F.avg("c"), 6).alias("mean"))


READER = f"""{NODES}, kin AS (SELECT doc_id, level, id, parent, CASE level WHEN 'document' THEN 0 WHEN 'block' THEN 1 WHEN 'line' THEN 2 ELSE 3 END AS depth, row_number() OVER k AS position, lead(id) OVER k AS next_id, lag(id) OVER k AS prev_id, count(*) OVER (PARTITION BY doc_id, parent) - 1 AS siblings FROM nodes WINDOW k AS (PARTITION BY doc_id, parent ORDER BY y, x, id)),
ch AS (SELECT doc_id, parent AS id, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY 1, 2)"""


@query("lr_reader", f"{READER} SELECT k.doc_id, k.id, k.depth, k.position::INTEGER AS position, k.next_id, k.prev_id, k.siblings::BIGINT AS siblings, coalesce(children, 0)::BIGINT AS children, concat_ws('>', p.id, g.id, r.id) AS ancestors FROM kin k LEFT JOIN ch USING (doc_id, id) LEFT JOIN nodes p ON p.doc_id = k.doc_id AND p.id = k.parent LEFT JOIN nodes g ON g.doc_id = k.doc_id AND g.id = p.parent LEFT JOIN nodes r ON r.doc_id = k.doc_id AND r.id = g.parent")
def lr_reader(spark, sf_dir):
    """Every node's depth, place among its siblings, neighbours, children and ancestors."""
    return L.readable(L.hierarchy(blocked(spark, sf_dir))).select("doc_id", "id", "depth", "position", "next_id", "prev_id", "siblings", "children", "ancestors")


@query("lq_descendants", f"{NODES} SELECT doc_id, parent AS id, count(*)::BIGINT AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1, 2")
def lq_descendants(spark, sf_dir):
    return nodes(spark, sf_dir).filter("parent IS NOT NULL").groupBy("doc_id", F.col("parent").alias("id")).agg(F.count("*").alias("n"))


@query("lq_find_regions", f"{NODES} SELECT doc_id, id FROM nodes WHERE level = 'block' AND n >= 2")
def lq_find_regions(spark, sf_dir):
    return nodes(spark, sf_dir).filter("level = 'block' AND n >= 2").select("doc_id", "id")


@query("lq_words_in_reading_order", f"{OF} SELECT doc_id, block, string_agg(text, ' ' ORDER BY line_idx, word_idx) AS text FROM w GROUP BY 1, 2")
def lq_words_in_reading_order(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "word_idx", "text"))), lambda s: s["text"])
    return blocked(spark, sf_dir, "text").groupBy("doc_id", "block").agg(F.array_join(parts, " ").alias("text"))


@query("lev_evidence", f"{OF} SELECT doc_id, block, string_agg(text, ' ' ORDER BY line_idx, word_idx) AS text, count(*)::BIGINT AS refs, round(avg(confidence), 6) AS confidence FROM w GROUP BY 1, 2")
def lev_evidence(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "word_idx", "text"))), lambda s: s["text"])
    return blocked(spark, sf_dir, "text", "confidence").groupBy("doc_id", "block").agg(F.array_join(parts, " ").alias("text"), F.count("*").alias("refs"), F.round(F.avg("confidence"), 6).alias("confidence"))


CHAIN = f"{BOXES}, r AS (SELECT doc_id, 'w-' || line_idx || '-' || word_idx AS id, row_number() OVER o AS position, lead('w-' || line_idx || '-' || word_idx) OVER o AS next_id, lag('w-' || line_idx || '-' || word_idx) OVER o AS prev_id FROM boxes WINDOW o AS (PARTITION BY doc_id ORDER BY line_idx, word_idx, y, x))"


def chain(spark, sf_dir):
    return L.reading_order(L.word_nodes(boxes(spark, sf_dir)), ["line_idx", "word_idx", "y", "x", "id"])


@query("ro_build", f"{CHAIN} SELECT doc_id, id, position::INTEGER AS position, next_id, prev_id FROM r")
def ro_build(spark, sf_dir):
    return chain(spark, sf_dir).select("doc_id", "id", "position", "next_id", "prev_id")


@query("ro_queries", f"{CHAIN} SELECT doc_id, max(CASE WHEN prev_id IS NULL THEN id END) AS first_id, max(CASE WHEN next_id IS NULL THEN id END) AS last_id, count(*)::BIGINT AS n FROM r GROUP BY 1")
def ro_queries(spark, sf_dir):
    c = chain(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.max(F.when(F.col("prev_id").isNull(), F.col("id"))).alias("first_id"), F.max(F.when(F.col("next_id").isNull(), F.col("id"))).alias("last_id"), F.count("*").alias("n"))


def weighted(name: str, weight: str, column):
    @query(name, f"{BOXES}, s AS (SELECT *, {weight} AS w FROM boxes), t AS (SELECT *, w / sum(w) OVER (PARTITION BY doc_id, line_idx) AS share FROM s), m AS (SELECT doc_id, line_idx, sum(confidence * share) AS mean FROM t GROUP BY 1, 2) SELECT t.doc_id, t.line_idx, round(m.mean, 9) AS mean, round(sum(pow(confidence - mean, 2) * share), 9) AS variance, count(*)::BIGINT AS n FROM t JOIN m ON m.doc_id = t.doc_id AND m.line_idx = t.line_idx GROUP BY t.doc_id, t.line_idx, m.mean")
    def run(spark, sf_dir):
        p = L.propagate(boxes(spark, sf_dir).withColumnRenamed("confidence", "mean"), ["doc_id", "line_idx"], column())
        return p.select("doc_id", "line_idx", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"), "n")


weighted("cp_propagate", "1.0", lambda: F.lit(1.0))
weighted("cp_weights", "width * height", lambda: F.col("width") * F.col("height"))


@query("cp_profile", f"{BOXES} SELECT doc_id, count(*)::BIGINT AS n, round(avg(confidence), 6) AS mean, round(var_pop(confidence), 6) AS variance, min(confidence) AS least, max(confidence) AS most FROM boxes GROUP BY 1")
def cp_profile(spark, sf_dir):
    c = "confidence"
    return boxes(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.var_pop(c), 6).alias("variance"), F.min(c).alias("least"), F.max(c).alias("most"))


REGIONS = f"{BOXES}, regions AS (SELECT doc_id, 'r-' || line_idx AS id, {UNION}, count(*)::BIGINT AS words, count(*)::BIGINT AS children, sum(width * height) AS content_area FROM boxes GROUP BY doc_id, line_idx)"
FEATURES = f"""{REGIONS}, pg AS (SELECT doc_id, max(x + width) - min(x) AS pw, max(y + height) - min(y) AS ph, min(x) AS px, min(y) AS py, greatest(median(width), median(height)) AS size FROM regions GROUP BY 1),
pr AS (SELECT a.doc_id, a.id, pg.size, abs(a.x - b.x) <= greatest(size * 0.15, 1e-9) OR abs(a.x + a.width - b.x - b.width) <= greatest(size * 0.15, 1e-9) OR abs(a.x + a.width / 2 - b.x - b.width / 2) <= greatest(size * 0.15, 1e-9) AS al,
  abs(a.y - b.y) <= greatest(size * 0.15, 1e-9) OR abs(a.y + a.height - b.y - b.height) <= greatest(size * 0.15, 1e-9) AS gr, sqrt(pow(a.x + a.width / 2 - b.x - b.width / 2, 2) + pow(a.y + a.height / 2 - b.y - b.height / 2, 2)) AS cd, {OX} * {OY} AS io
  FROM regions a JOIN regions b ON a.doc_id = b.doc_id AND a.id <> b.id JOIN pg ON pg.doc_id = a.doc_id),
sb AS (SELECT doc_id, id, avg(CASE WHEN al THEN 1.0 ELSE 0 END) AS alignment, avg(CASE WHEN gr THEN 1.0 ELSE 0 END) AS grid, count(*) FILTER (cd <= greatest(size * 1.5, 1e-9)) AS neighbors, min(cd) AS nn, sum(io) AS covered FROM pr GROUP BY 1, 2),
md AS (SELECT doc_id, median(nn) AS mid_nn FROM sb GROUP BY 1),
features AS (SELECT r.doc_id, r.id, (x + width / 2 - px) / pw AS center_x, (y + height / 2 - py) / ph AS center_y, abs((x + width / 2 - px) / pw - 0.5) AS offset_x, width * height / (pw * ph) AS area_ratio, width / pw AS width_ratio, height / ph AS height_ratio, width / height AS aspect,
  words / (width * height) AS density, least(1.0, greatest(0.0, 1 - content_area / (width * height))) AS whitespace, coalesce(alignment, 0.0) AS alignment, coalesce(grid, 0.0) AS grid, coalesce(neighbors, 0)::BIGINT AS neighbors,
  coalesce(least(1.0, greatest(0.0, nn / greatest(mid_nn * 2, 1e-9))), 1.0) AS isolation, least(1.0, greatest(0.0, coalesce(covered, 0.0) / (width * height))) AS containment, least(1.0, greatest(0.0, content_area / (pw * ph))) AS coverage, children, width * height AS area, width, height
  FROM regions r JOIN pg USING (doc_id) LEFT JOIN sb ON sb.doc_id = r.doc_id AND sb.id = r.id LEFT JOIN md ON md.doc_id = r.doc_id)"""
QUARTERS = ", ".join(f"quantile_cont({c}, 0.25) AS q25_{c}, median({c}) AS mid_{c}, quantile_cont({c}, 0.75) AS q75_{c}, max({c}) AS max_{c}" for c in L.STATISTICS)
STATS = f"{FEATURES}, q AS (SELECT doc_id, {QUARTERS} FROM features GROUP BY 1), md2 AS (SELECT f.doc_id, {', '.join(f'median(abs({c} - mid_{c})) AS mad_{c}' for c in L.STATISTICS)} FROM features f JOIN q ON q.doc_id = f.doc_id GROUP BY 1), stats AS (SELECT * FROM q JOIN md2 USING (doc_id))"
SCORES = f"{STATS}, wide AS (SELECT * FROM features JOIN stats USING (doc_id)), scores AS ({' UNION ALL '.join(f"SELECT doc_id, id, '{k}' AS type, ({L.score_sql(k)})::DOUBLE AS score FROM wide" for k in L.SCORERS)})"
NUMBERS = ("center_x", "center_y", "offset_x", "area_ratio", "width_ratio", "height_ratio", "aspect", "density", "whitespace", "alignment", "grid", "isolation", "containment", "coverage")


def features(spark, sf_dir):
    b = boxes(spark, sf_dir)
    r = L.union_box(b, ["doc_id", "line_idx"], F.count("*").alias("words"), F.count("*").alias("children"), F.sum(F.col("width") * F.col("height")).alias("content_area"))
    return L.region_features(r.withColumn("id", F.concat(F.lit("r-"), F.col("line_idx").cast("string"))).drop("line_idx"))


@query("rf_features", f"{FEATURES} SELECT doc_id, id, {', '.join(f'round({c}::DOUBLE, 8) AS {c}' for c in NUMBERS)}, neighbors FROM features")
def rf_features(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", "id", *(F.round(c, 8).alias(c) for c in NUMBERS), "neighbors")


@query("rc_page_stats", f"{STATS} SELECT doc_id, {', '.join(f'round({p}_{c}::DOUBLE, 8) AS {p}_{c}' for c in L.STATISTICS for p in ('q25', 'mid', 'q75', 'mad'))} FROM stats")
def rc_page_stats(spark, sf_dir):
    s = L.page_statistics(features(spark, sf_dir))
    return s.select("doc_id", *(F.round(F.col(f"{p}_{c}").cast("double"), 8).alias(f"{p}_{c}") for c in L.STATISTICS for p in ("q25", "mid", "q75", "mad")))


@query("rc_scores", f"{SCORES} SELECT doc_id, id, type, round(score, 9) AS score FROM scores")
def rc_scores(spark, sf_dir):
    return L.region_scores(features(spark, sf_dir)).select("doc_id", "id", "type", F.round("score", 9).alias("score"))


RANKED = f"{SCORES}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY round(score, 9) DESC, type) AS n FROM scores), best AS (SELECT * FROM top WHERE n = 1), fl AS (SELECT doc_id, greatest(0.35, median(score) * 0.5) AS floor_ FROM best GROUP BY 1)"


@query("rc_rank", f"{RANKED} SELECT doc_id, id, CASE WHEN score < floor_ THEN 'unknown' ELSE type END AS type, round(score, 6) AS score FROM best JOIN fl USING (doc_id)")
def rc_rank(spark, sf_dir):
    return L.classify_regions(features(spark, sf_dir)).select("doc_id", "id", "type", F.round("score", 6).alias("score"))


EVERY_TERM = [(kind, k, w, t) for kind, (terms, _) in L.SCORERS.items() for k, (w, t) in enumerate(terms)]


@query("rc_explain", f"{STATS}, wide AS (SELECT * FROM features JOIN stats USING (doc_id)) {' UNION ALL '.join(f"SELECT doc_id, id, '{kind}' AS type, {k} AS term, {w}::DOUBLE AS weight, round(({t})::DOUBLE, 6) AS value FROM wide" for kind, k, w, t in EVERY_TERM)}")
def rc_explain(spark, sf_dir):
    """The weighted terms of every type's score of every region."""
    f = features(spark, sf_dir)
    known = F.array(*(F.struct(F.lit(kind).alias("type"), F.lit(k).alias("term"), F.lit(w).alias("weight")) for kind, k, w, _ in EVERY_TERM))
    values = F.array(*(F.expr(t).cast("double") for *_, t in EVERY_TERM))
    # Rounded inside the array: as one long row of rounded terms they make a method too large to be compiled.
    terms = F.transform(values, lambda v, k: F.struct(F.get(known, k).alias("of"), F.round(v, 6).alias("value")))
    return f.join(L.page_statistics(f), "doc_id").select("doc_id", "id", F.explode(terms).alias("t")).select("doc_id", "id", "t.of.*", "t.value")


EDGES = f"{NODES}, edges AS (SELECT doc_id, 'CONTAINS' AS type, parent AS from_id, id AS to_id FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT doc_id, 'CHILD_OF', parent, id FROM nodes WHERE parent IS NOT NULL)"


def edges(spark, sf_dir):
    n = nodes(spark, sf_dir).filter("parent IS NOT NULL")
    return n.select("doc_id", F.explode(F.array(F.lit("CONTAINS"), F.lit("CHILD_OF"))).alias("type"), F.col("parent").alias("from_id"), F.col("id").alias("to_id"))


@query("sg_derive", f"{EDGES} SELECT doc_id, type, from_id, to_id FROM edges")
def sg_derive(spark, sf_dir):
    return edges(spark, sf_dir)


@query("sg_queries", f"""{EDGES}, ends AS (SELECT doc_id, from_id AS id, to_id AS other, type, true AS leaves FROM edges UNION ALL SELECT doc_id, to_id, from_id, type, false FROM edges)
SELECT doc_id, id, count(DISTINCT other)::BIGINT AS neighbors, count(*) FILTER (leaves)::BIGINT AS outgoing, count(*) FILTER (NOT leaves)::BIGINT AS incoming, count(*) FILTER (leaves AND type = 'CHILD_OF')::BIGINT AS children, count(*) FILTER (NOT leaves AND type = 'CHILD_OF')::BIGINT AS parents FROM ends GROUP BY 1, 2""")
def sg_queries(spark, sf_dir):
    """Every node's neighbours over edges of any type in either direction, its edges out and in, and of these its children and parents."""
    end = lambda id_, other, leaves: F.struct(F.col(id_).alias("id"), F.col(other).alias("other"), F.lit(leaves).alias("leaves"))
    ends = edges(spark, sf_dir).select("doc_id", "type", F.explode(F.array(end("from_id", "to_id", True), end("to_id", "from_id", False))).alias("e")).select("doc_id", "type", "e.*")
    leaves, structural = F.col("leaves"), F.col("type") == "CHILD_OF"
    counts = {"outgoing": leaves, "incoming": ~leaves, "children": leaves & structural, "parents": ~leaves & structural}
    return ends.groupBy("doc_id", "id").agg(F.count_distinct("other").alias("neighbors"), *(F.count_if(test).alias(name) for name, test in counts.items()))


@query("lay_pipeline", f"{EDGES} SELECT n.doc_id, n.nodes, e.edges, b.blocks FROM (SELECT doc_id, count(*)::BIGINT AS nodes FROM nodes GROUP BY 1) n JOIN (SELECT doc_id, count(*)::BIGINT AS edges FROM edges GROUP BY 1) e USING (doc_id) JOIN (SELECT doc_id, count(*)::BIGINT AS blocks FROM nodes WHERE level = 'block' GROUP BY 1) b USING (doc_id)")
def lay_pipeline(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return n.groupBy("doc_id").agg(F.count("*").alias("nodes"), (2 * F.count("parent")).alias("edges"), F.count_if(F.col("level") == "block").alias("blocks"))


@query("lay_cache", f"{with_fixtures('rendered')}, h AS (SELECT doc_id, sha256(string_agg(line_idx::VARCHAR || text, '|' ORDER BY line_idx)) AS digest FROM rendered GROUP BY 1) SELECT digest, min(doc_id) AS first_doc, count(*)::BIGINT AS n FROM h GROUP BY 1")
def lay_cache(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: F.concat(s["line_idx"].cast("string"), s["text"]))
    h = fixture(spark, sf_dir, "rendered").groupBy("doc_id").agg(F.sha2(F.array_join(parts, "|"), 256).alias("digest"))
    return h.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


# The derived graph with faults by key; every check finds some of them.
FAULTY = with_fixtures("faulty_nodes", "faulty_edges").replace("faulty_nodes AS", "n AS").replace("faulty_edges AS", "e AS")
RECURSIVE = FAULTY.replace("WITH ", "WITH RECURSIVE ", 1)
CYCLES = f"""{RECURSIVE}, x AS (SELECT DISTINCT doc_id, from_id AS a, to_id AS b FROM e WHERE type = 'READING_NEXT'),
r AS (SELECT doc_id, a, b FROM x UNION SELECT r.doc_id, r.a, x.b FROM r JOIN x ON x.doc_id = r.doc_id AND x.a = r.b),
cy AS (SELECT DISTINCT r.doc_id, r.b AS id FROM r WHERE EXISTS (SELECT 1 FROM r s WHERE s.doc_id = r.doc_id AND s.a = r.a AND s.b = r.a))"""


def faulty(spark, sf_dir):
    return tuple(fixture(spark, sf_dir, name, {"lineitem": "l_orderkey"}) for name in ("faulty_nodes", "faulty_edges"))


def reading(spark, sf_dir):
    return faulty(spark, sf_dir)[1].filter("type = 'READING_NEXT'")


DOUBLE_SQL = "SELECT doc_id, id, count(*) AS n FROM n GROUP BY 1, 2 HAVING count(*) > 1"
DANGLING_SQL = "SELECT DISTINCT doc_id, id FROM (SELECT doc_id, unnest([from_id, to_id]) AS id FROM e) z WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = z.doc_id AND n.id = z.id)"
PARENTS_SQL = "SELECT doc_id, to_id AS id, count(DISTINCT from_id)::BIGINT AS n FROM e WHERE type = 'CONTAINS' GROUP BY 1, 2 HAVING count(DISTINCT from_id) > 1"
PAIRED_SQL = "SELECT c.doc_id, c.id FROM n c JOIN (SELECT DISTINCT ON (doc_id, id) * FROM n) p ON p.doc_id = c.doc_id AND p.id = c.parent"
OUTSIDE_SQL = f"{PAIRED_SQL} WHERE NOT (p.x <= c.x + 1e-6 AND p.y <= c.y + 1e-6 AND p.x + p.width >= c.x + c.width - 1e-6 AND p.y + p.height >= c.y + c.height - 1e-6)"
MIRROR_SQL = """SELECT DISTINCT type, doc_id, from_id, to_id FROM e WHERE (type = 'READING_NEXT' AND NOT EXISTS (SELECT 1 FROM e m WHERE m.type = 'READING_PREVIOUS' AND m.doc_id = e.doc_id AND m.from_id = e.to_id AND m.to_id = e.from_id))
 OR (type = 'READING_PREVIOUS' AND NOT EXISTS (SELECT 1 FROM e m WHERE m.type = 'READING_NEXT' AND m.doc_id = e.doc_id AND m.from_id = e.to_id AND m.to_id = e.from_id))"""
TOPOLOGY_SQL = "SELECT DISTINCT doc_id, from_id, to_id FROM e WHERE type = 'READING_NEXT' AND (NOT EXISTS (SELECT 1 FROM n WHERE level = 'word' AND n.doc_id = e.doc_id AND n.id = e.from_id) OR NOT EXISTS (SELECT 1 FROM n WHERE level = 'word' AND n.doc_id = e.doc_id AND n.id = e.to_id))"


def side_sql(side: str) -> str:
    return f"SELECT doc_id, {side} AS id, count(*) AS n FROM e WHERE type = 'READING_NEXT' GROUP BY 1, 2 HAVING count(*) > 1"


REPEATED_SQL = "SELECT doc_id, type, from_id, to_id, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1"
#: up: every ancestor of every node, as far as its chain goes on to new ones.
LOOPS = ", par AS (SELECT doc_id, id, min(parent) AS parent FROM n GROUP BY 1, 2), up AS (SELECT doc_id, id, parent AS at FROM par WHERE parent IS NOT NULL UNION SELECT u.doc_id, u.id, p.parent FROM up u JOIN par p ON p.doc_id = u.doc_id AND p.id = u.at WHERE p.parent IS NOT NULL)"
LOOP_SQL = "SELECT DISTINCT u.doc_id, u.id FROM up u JOIN up s ON s.doc_id = u.doc_id AND s.id = u.at AND s.at = u.at"
OWNED_SQL = "SELECT doc_id, to_id AS id, count(*) AS listed, count(DISTINCT from_id) AS owners FROM e WHERE type = 'CONTAINS' GROUP BY 1, 2 HAVING count(*) > 1"
ORPHANS_SQL = f"SELECT DISTINCT c.doc_id, c.id, 'unknown parent' AS fault FROM n c ANTI JOIN n p ON p.doc_id = c.doc_id AND p.id = c.parent WHERE c.parent IS NOT NULL UNION ALL SELECT doc_id, id, 'unending' FROM ({LOOP_SQL}) UNION ALL SELECT doc_id, NULL, 'roots' FROM n GROUP BY 1 HAVING count(*) FILTER (parent IS NULL) <> 1"
UNCOVERED_SQL = "SELECT b.doc_id, 'w-' || b.line_idx || '-' || b.word_idx AS id FROM boxes b ANTI JOIN (SELECT doc_id, id FROM n WHERE level = 'word') h ON h.doc_id = b.doc_id AND h.id = 'w-' || b.line_idx || '-' || b.word_idx"
UNREAD_SQL = "SELECT w.doc_id, w.id FROM (SELECT doc_id, id, count(*) OVER (PARTITION BY doc_id) AS k FROM (SELECT DISTINCT doc_id, id FROM n WHERE level = 'word')) w ANTI JOIN (SELECT doc_id, unnest([from_id, to_id]) AS id FROM e WHERE type IN ('READING_NEXT', 'READING_PREVIOUS')) r ON r.doc_id = w.doc_id AND r.id = w.id WHERE k > 1"
MEANING_SQL = "SELECT doc_id, id, coalesce(k, 0) AS n FROM (SELECT DISTINCT doc_id, id, level = 'document' AS top FROM n) x LEFT JOIN (SELECT doc_id, to_id AS id, count(DISTINCT from_id) AS k FROM e WHERE type = 'CONTAINS' GROUP BY 1, 2) USING (doc_id, id) WHERE coalesce(k, 0) <> CASE WHEN top THEN 0 ELSE 1 END"
CONTAINED = ", x2 AS (SELECT DISTINCT doc_id, from_id AS a, to_id AS b FROM e WHERE type = 'CONTAINS'), r2 AS (SELECT doc_id, a, b FROM x2 UNION SELECT r.doc_id, r.a, x.b FROM r2 r JOIN x2 x ON x.doc_id = r.doc_id AND x.a = r.b)"
CONTAINED_SQL = "SELECT DISTINCT r.doc_id, r.b AS id FROM r2 r JOIN r2 s ON s.doc_id = r.doc_id AND s.a = r.a AND s.b = r.a"
VOCABULARY_SQL = "SELECT doc_id, id FROM n WHERE level NOT IN ('word', 'line', 'document')"
BOUNDS_SQL = "SELECT doc_id, id FROM n WHERE confidence < 0 OR confidence > 1"
UNMEASURED_SQL = "SELECT doc_id, id FROM n WHERE confidence IS NULL OR isnan(confidence)"
POLICY_SQL = "SELECT p.doc_id, p.id FROM n p JOIN (SELECT doc_id, parent, avg(confidence) AS mean FROM (SELECT DISTINCT doc_id, id, parent, confidence FROM n WHERE level = 'word') GROUP BY 1, 2) c ON c.doc_id = p.doc_id AND c.parent = p.id WHERE p.level = 'line' AND abs(p.confidence - c.mean) > 1e-6"


def out_of_bounds(n):
    return n.filter((F.col("confidence") < 0) | (F.col("confidence") > 1)).select("doc_id", "id")


def unmeasured(n):
    return n.filter(F.col("confidence").isNull() | F.isnan("confidence")).select("doc_id", "id")


def off_policy(n):
    """Lines whose confidence isn't the mean of their words' (the default child policy)."""
    words = n.filter("level = 'word'").select("doc_id", "id", "parent", "confidence").distinct().groupBy("doc_id", F.col("parent").alias("id")).agg(F.avg("confidence").alias("mean"))
    return n.filter("level = 'line'").join(words, ["doc_id", "id"]).filter(F.abs(F.col("confidence") - F.col("mean")) > 1e-6).select("doc_id", "id")


#: name, check over (nodes, edges), its SQL over n and e
CHECKS = [
    ("unique_ids", lambda n, e: V.duplicate_ids(n), DOUBLE_SQL), ("self_loops", lambda n, e: V.self_loops(e), "SELECT * FROM e WHERE from_id = to_id"),
    ("edge_kinds", lambda n, e: V.unknown_kinds(e), f"SELECT * FROM e WHERE type NOT IN {V.KINDS}"), ("dangling", lambda n, e: V.dangling(e, n), DANGLING_SQL), ("single_parent", lambda n, e: V.several_parents(e), PARENTS_SQL),
    ("containment", lambda n, e: V.outside_parent(n), OUTSIDE_SQL), ("page_ownership", lambda n, e: V.off_page(n), f"{PAIRED_SQL} WHERE p.page <> c.page"), ("parent_chain", lambda n, e: V.broken_chains(n), ORPHANS_SQL), ("no_parent_cycles", lambda n, e: V.unending(n), LOOP_SQL), ("unique_ownership", lambda n, e: V.claimed_twice(e), OWNED_SQL),
    ("meaning_single_parent", lambda n, e: V.parents_of_meaning(e, n), MEANING_SQL), ("reading_coverage", lambda n, e: V.unread(e, n), UNREAD_SQL), ("contained_acyclic", lambda n, e: V.cyclic_nodes(e.filter("type = 'CONTAINS'")), CONTAINED_SQL),
    ("level_vocabulary", lambda n, e: n.filter(~F.col("level").isin("word", "line", "document")), VOCABULARY_SQL),
    ("bidirectional", lambda n, e: V.unmirrored(e), MIRROR_SQL), ("single_successor", lambda n, e: V.several_neighbours(e, "from_id"), side_sql("from_id")), ("single_predecessor", lambda n, e: V.several_neighbours(e, "to_id"), side_sql("to_id")),
    ("no_duplicate_edges", lambda n, e: V.repeated_edges(e), REPEATED_SQL), ("topology", lambda n, e: V.wrong_topology(e, n), TOPOLOGY_SQL), ("confidence_bounds", lambda n, e: out_of_bounds(n), BOUNDS_SQL),
    ("confidence_coverage", lambda n, e: unmeasured(n), UNMEASURED_SQL), ("confidence_policy", lambda n, e: off_policy(n), POLICY_SQL),
]


def check_query(name: str, check: str, columns: str = "doc_id, id"):
    of, sql = next((f, q) for c, f, q in CHECKS if c == check)

    loops = " up " in sql

    @query(name, f"{RECURSIVE if loops else FAULTY}{LOOPS if loops else ''} SELECT {columns} FROM ({sql}) AS v")
    def run(spark, sf_dir):
        return of(*faulty(spark, sf_dir)).select(*columns.split(", "))


for _name, _check in (("vh_single_parent", "single_parent"), ("vh_containment", "containment"), ("vh_page_ownership", "page_ownership"), ("vr_single_successor", "single_successor"), ("vr_single_predecessor", "single_predecessor"), ("vc_bounds", "confidence_bounds"), ("vc_coverage", "confidence_coverage"), ("vc_policy", "confidence_policy"), ("vh_no_cycles", "no_parent_cycles")):
    check_query(_name, _check)
check_query("vh_unique_ownership", "unique_ownership", "doc_id, id, listed, owners")
check_query("vh_parent_chain", "parent_chain", "doc_id, id, fault")
check_query("vr_bidirectional", "bidirectional", "type, doc_id, from_id, to_id")
check_query("vr_no_duplicates", "no_duplicate_edges", "doc_id, type, from_id, to_id")
check_query("vr_topology", "topology", "doc_id, from_id, to_id")


@query("vg_basic", f"{FAULTY} SELECT 'duplicate' AS fault, doc_id, id AS place FROM ({DOUBLE_SQL}) UNION ALL SELECT 'loop', doc_id, from_id FROM e WHERE from_id = to_id UNION ALL SELECT 'kind', doc_id, from_id FROM e WHERE type NOT IN {V.KINDS} UNION ALL SELECT 'dangling', doc_id, id FROM ({DANGLING_SQL})")
def vg_basic(spark, sf_dir):
    n, e = faulty(spark, sf_dir)
    part = lambda name, df, place: df.select(F.lit(name).alias("fault"), "doc_id", F.col(place).alias("place"))
    return part("duplicate", V.duplicate_ids(n), "id").unionByName(part("loop", V.self_loops(e), "from_id")).unionByName(part("kind", V.unknown_kinds(e), "from_id")).unionByName(part("dangling", V.dangling(e, n), "id"))


@query("vc_finite", f"{FAULTY} SELECT doc_id, count(*) FILTER (confidence IS NULL OR isnan(confidence) OR isinf(confidence))::BIGINT AS faults FROM n GROUP BY 1")
def vc_finite(spark, sf_dir):
    c = F.col("confidence")
    return faulty(spark, sf_dir)[0].groupBy("doc_id").agg(F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias("faults"))


@query("vc_determinism", f"{BOXES} SELECT count(*)::BIGINT AS rows, 0::BIGINT AS differing FROM (SELECT DISTINCT doc_id, line_idx FROM boxes)")
def vc_determinism(spark, sf_dir):
    """Propagation run twice, once over rows dealt anew."""
    b = boxes(spark, sf_dir).withColumnRenamed("confidence", "mean")
    a = L.propagate(b, ["doc_id", "line_idx"], F.lit(1.0)).select("doc_id", "line_idx", F.round("mean", 9), "n")
    again = L.propagate(b.repartition(3, "x"), ["doc_id", "line_idx"], F.lit(1.0)).select("doc_id", "line_idx", F.round("mean", 9), "n")
    return V.differing(a, again)


@query("vh_coverage", f"{FAULTY}, {BOXES.replace('WITH ', '')} SELECT b.doc_id, count(*)::BIGINT AS uncovered FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = b.doc_id AND n.level = 'word' AND n.id = 'w-' || b.line_idx || '-' || b.word_idx AND n.parent <> 'l-ghost') GROUP BY 1")
def vh_coverage(spark, sf_dir):
    """Words of the source that no line of the hierarchy holds."""
    held = faulty(spark, sf_dir)[0].filter("level = 'word' AND parent <> 'l-ghost'").select("doc_id", "id")
    return L.word_nodes(boxes(spark, sf_dir)).join(held, ["doc_id", "id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("uncovered"))


@query("vh_determinism", f"{NODES} SELECT count(*)::BIGINT AS rows, 0::BIGINT AS differing FROM nodes")
def vh_determinism(spark, sf_dir):
    """The hierarchy built twice, once over rows dealt anew."""
    b = boxes(spark, sf_dir)
    b = b.select(*L.WORD, *L.BOX)
    again = b.repartition("x")
    return V.differing(L.hierarchy(L.blocked(b)).drop("path"), L.hierarchy(L.blocked(again)).drop("path"))


@query("vr_acyclic", f"{CYCLES} SELECT doc_id, count(*)::BIGINT AS n_cyclic FROM cy GROUP BY 1")
def vr_acyclic(spark, sf_dir):
    return V.cyclic_nodes(reading(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_cyclic"))


@query("gv_toposort", f"""{CYCLES}, o AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM cy WHERE cy.doc_id = x.doc_id AND cy.id = x.b)), z AS (SELECT DISTINCT doc_id, unnest([a, b]) AS id FROM x),
l AS (SELECT doc_id, id, 0 AS n FROM z UNION SELECT o.doc_id, o.b, l.n + 1 FROM l JOIN o ON o.doc_id = l.doc_id AND o.a = l.id)
SELECT z.doc_id, z.id, CASE WHEN cy.id IS NULL THEN max(l.n) END::INTEGER AS round FROM z JOIN l ON l.doc_id = z.doc_id AND l.id = z.id LEFT JOIN cy ON cy.doc_id = z.doc_id AND cy.id = z.id GROUP BY z.doc_id, z.id, cy.id""")
def gv_toposort(spark, sf_dir):
    return V.ordered(reading(spark, sf_dir))


ENDS_SQL = "SELECT w.doc_id, count(*) FILTER (i.id IS NULL)::BIGINT AS firsts, count(*) FILTER (o.id IS NULL)::BIGINT AS lasts, CASE WHEN count(*) > 1 THEN count(*) FILTER (i.id IS NULL AND o.id IS NULL) ELSE 0 END::BIGINT AS untouched FROM (SELECT DISTINCT doc_id, id FROM n WHERE level = 'word') w LEFT JOIN (SELECT DISTINCT doc_id, from_id AS id FROM e WHERE type = 'READING_NEXT') o USING (doc_id, id) LEFT JOIN (SELECT DISTINCT doc_id, to_id AS id FROM e WHERE type = 'READING_NEXT') i USING (doc_id, id) GROUP BY 1"


@query("vr_connectivity", f"{FAULTY} {ENDS_SQL}")
def vr_connectivity(spark, sf_dir):
    n, e = faulty(spark, sf_dir)
    return V.reading_ends(e, n)


@query("vr_coverage", f"{CHAIN} SELECT doc_id, count(DISTINCT position)::BIGINT AS n, max(position)::INTEGER AS last FROM r GROUP BY 1")
def vr_coverage(spark, sf_dir):
    return chain(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("position").alias("n"), F.max("position").alias("last"))


@query("vr_determinism", f"{BOXES} SELECT count(*)::BIGINT AS rows, 0::BIGINT AS differing FROM boxes")
def vr_determinism(spark, sf_dir):
    b = boxes(spark, sf_dir).repartition(3, "x")
    again = L.reading_order(L.word_nodes(b), ["line_idx", "word_idx", "y", "x", "id"])
    return V.differing(chain(spark, sf_dir).select("doc_id", "id", "position"), again.select("doc_id", "id", "position"))


# Claimed blocks with faults by key: a word without a place, one with two, an empty block, a negative, moved or endless box.
CLAIM = f"""{OF}, cl AS (SELECT doc_id, line_idx, word_idx, block FROM bl WHERE NOT (doc_id % 7 = 0 AND line_idx = 1 AND word_idx = 0) UNION ALL SELECT doc_id, line_idx, word_idx, block + 1 FROM bl WHERE doc_id % 11 = 0 AND line_idx = 1 AND word_idx = 0),
ls AS (SELECT doc_id, block, x + CASE WHEN doc_id % 19 = 0 THEN 5 ELSE 0 END AS x, y, CASE WHEN doc_id % 17 = 0 AND block = 0 THEN -width ELSE width END AS width, CASE WHEN doc_id % 23 = 0 THEN 'nan'::DOUBLE ELSE height END AS height FROM (SELECT doc_id, block, {UNION} FROM w GROUP BY 1, 2) UNION ALL SELECT DISTINCT doc_id, 99, 0, 0, 0, 0 FROM bl WHERE doc_id % 13 = 0)"""


def claimed(spark, sf_dir):
    """(words, claimed places, claimed blocks)"""
    b = boxes(spark, sf_dir)
    w = blocked(spark, sf_dir)
    of = w.select(*L.WORD, "block")
    d, first = F.col("doc_id"), (F.col("line_idx") == 1) & (F.col("word_idx") == 0)
    places = of.filter(~((d % 7 == 0) & first)).unionByName(of.filter((d % 11 == 0) & first).withColumn("block", F.col("block") + 1))
    u = L.union_box(w, ["doc_id", "block"])
    u = u.withColumns({"x": F.col("x") + F.when(d % 19 == 0, 5).otherwise(0), "width": F.when((d % 17 == 0) & (F.col("block") == 0), -F.col("width")).otherwise(F.col("width")), "height": F.when(d % 23 == 0, float("nan")).otherwise(F.col("height"))})
    empty = of.filter(d % 13 == 0).select("doc_id").distinct().select("doc_id", F.lit(99).alias("block"), *(F.lit(0.0).alias(c) for c in ("x", "y", "width", "height")))
    return b, places, u.unionByName(empty)


@query("vs_assignments", f"{CLAIM} SELECT doc_id, line_idx, word_idx, count(*) AS n FROM cl GROUP BY 1, 2, 3 HAVING count(*) > 1")
def vs_assignments(spark, sf_dir):
    return C.misassigned(claimed(spark, sf_dir)[1])


@query("vs_empty_blocks", f"{CLAIM} SELECT DISTINCT ls.doc_id, ls.block FROM ls ANTI JOIN cl ON cl.doc_id = ls.doc_id AND cl.block = ls.block")
def vs_empty_blocks(spark, sf_dir):
    _, places, listed = claimed(spark, sf_dir)
    return C.empty_blocks(places, listed)


@query("vs_boxes", f"""{CLAIM}, own AS (SELECT doc_id, block, {UNION} FROM boxes JOIN cl USING (doc_id, line_idx, word_idx) GROUP BY 1, 2), f AS (SELECT ls.doc_id, ls.block, CASE WHEN NOT isfinite(ls.x) OR NOT isfinite(ls.y) OR NOT isfinite(ls.width) OR NOT isfinite(ls.height) THEN 'not finite' WHEN ls.width < 0 OR ls.height < 0 THEN 'negative'
  WHEN abs(ls.x - own.x) + abs(ls.y - own.y) + abs(ls.width - own.width) + abs(ls.height - own.height) > 1e-6 THEN 'not of its words' END AS fault FROM ls LEFT JOIN own USING (doc_id, block)) SELECT * FROM f WHERE fault IS NOT NULL""")
def vs_boxes(spark, sf_dir):
    return C.wrong_boxes(*claimed(spark, sf_dir))


@query("vs_coverage", f"{CLAIM} SELECT doc_id, line_idx, word_idx, 'unassigned' AS side FROM boxes b ANTI JOIN cl ON cl.doc_id = b.doc_id AND cl.line_idx = b.line_idx AND cl.word_idx = b.word_idx")
def vs_coverage(spark, sf_dir):
    b, places, _ = claimed(spark, sf_dir)
    return C.unassigned(b, places)


@query("vs_determinism", f"{BOXES} SELECT count(*)::BIGINT AS rows, 0::BIGINT AS differing FROM boxes")
def vs_determinism(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return V.differing(L.blocks(b), L.blocks(b.repartition("x")))


TYPED = f"{RANKED}, ty AS (SELECT doc_id, id, CASE WHEN score < floor_ THEN 'unknown' ELSE type END AS type, type AS best, score, floor_ FROM best JOIN fl USING (doc_id))"
# Claimed types with faults by key: no type of the vocabulary, a score beyond its bounds, a region left out, one named twice, a type that isn't the best, a needless and a lacking fallback.
TYPES = f"""{TYPED}, ct AS (SELECT doc_id, id, CASE WHEN id <> 'r-1' THEN type WHEN doc_id % 7 = 0 THEN 'banner' WHEN doc_id % 17 = 0 THEN 'stamp' WHEN doc_id % 19 = 0 THEN 'unknown' ELSE type END AS type, score + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS score FROM ty WHERE NOT (doc_id % 13 = 0 AND id = 'r-1') UNION ALL SELECT doc_id, id, best, 'nan'::DOUBLE FROM ty WHERE doc_id % 31 = 0 AND id = 'r-1'),
tops AS (SELECT doc_id, id, max(score) AS top FROM scores GROUP BY 1, 2)"""


def typed(spark, sf_dir):
    return L.classify_regions(features(spark, sf_dir))


def claimed_types(spark, sf_dir):
    """(regions' features, their scores, claimed types). The features are made once: claims and scores read them several times."""
    f = cut(features(spark, sf_dir))
    t, scores = L.classify_regions(f), L.region_scores(f)
    d, one = F.col("doc_id"), F.col("id") == "r-1"
    kind = F.when(~one, F.col("type")).when(d % 7 == 0, "banner").when(d % 17 == 0, "stamp").when(d % 19 == 0, "unknown").otherwise(F.col("type"))
    bent = t.filter(~((d % 13 == 0) & one)).withColumns({"type": kind, "score": F.col("score") + F.when(d % 11 == 0, 1).otherwise(0)})
    best = scores.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc(F.round("score", 9)), "type"))).filter("_n = 1").drop("_n")
    return f, scores, bent.unionByName(best.filter((d % 31 == 0) & one).withColumn("score", F.lit(float("nan"))))


@query("vrc_types", f"{TYPED} SELECT type, count(*)::BIGINT AS n FROM ty GROUP BY 1")
def vrc_types(spark, sf_dir):
    return typed(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query("vrc_vocabulary", f"{TYPES} SELECT doc_id, id, type FROM ct WHERE type NOT IN {(*L.SCORERS, 'unknown')}")
def vrc_vocabulary(spark, sf_dir):
    return C.unknown_types(claimed_types(spark, sf_dir)[2])


@query("vrc_bounds", f"{TYPES} SELECT doc_id, id FROM ct WHERE score < -1e-9 OR score > 1 + 1e-9 OR isnan(score)")
def vrc_bounds(spark, sf_dir):
    return C.scores_out_of_bounds(claimed_types(spark, sf_dir)[2])


@query("vrc_coverage", f"{TYPES} SELECT doc_id, id, coalesce(k, 0) AS n FROM regions LEFT JOIN (SELECT doc_id, id, count(*) AS k FROM ct GROUP BY 1, 2) USING (doc_id, id) WHERE coalesce(k, 0) <> 1")
def vrc_coverage(spark, sf_dir):
    f, _, types = claimed_types(spark, sf_dir)
    return C.unclassified(f, types)


@query("vrc_thresholds", f"""{STATS}, cs AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN q75_area + 1 ELSE q25_area END AS q25, mid_area + CASE WHEN doc_id % 29 = 0 THEN 0.5 ELSE 0 END AS mid, q75_area + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS q75, max_area + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS most FROM stats)
SELECT doc_id, CASE WHEN q25 > mid + 1e-9 OR mid > q75 + 1e-9 OR q75 > most + 1e-9 THEN 'order' ELSE 'value' END AS fault FROM cs WHERE doc_id % 23 = 0 OR doc_id % 29 = 0""")
def vrc_thresholds(spark, sf_dir):
    """Claimed quartiles of the areas: some out of order, some moved."""
    f = features(spark, sf_dir)
    d, s = F.col("doc_id"), L.page_statistics(f)
    moved = lambda by: F.when(d % 29 == 0, by).otherwise(0.0)
    claim = s.select("doc_id", F.when(d % 23 == 0, F.col("q75_area") + 1).otherwise(F.col("q25_area")).alias("q25"), (F.col("mid_area") + moved(0.5)).alias("mid"), (F.col("q75_area") + moved(1.0)).alias("q75"), (F.col("max_area") + moved(1.0)).alias("max"))
    return C.wrong_thresholds(f, claim)


@query("vrc_ranking", f"{TYPES} SELECT ct.doc_id, ct.id FROM ct JOIN scores s USING (doc_id, id) JOIN tops USING (doc_id, id) WHERE s.type = ct.type AND s.score < top - 1e-9")
def vrc_ranking(spark, sf_dir):
    _, scores, types = claimed_types(spark, sf_dir)
    return C.outranked(scores, types)


@query("vrc_fallbacks", f"{TYPES} SELECT ct.doc_id, ct.id, ct.type FROM ct JOIN tops USING (doc_id, id) JOIN fl USING (doc_id) WHERE (ct.type = 'unknown' AND top >= floor_ + 1e-9) OR (ct.type <> 'unknown' AND top < floor_ - 1e-9)")
def vrc_fallbacks(spark, sf_dir):
    _, scores, types = claimed_types(spark, sf_dir)
    return C.wrong_fallbacks(scores, types)


@query("vrc_reachability", f"{SCORES} SELECT type, count(*) FILTER (score >= 0.35)::BIGINT AS reached FROM scores GROUP BY 1")
def vrc_reachability(spark, sf_dir):
    return L.region_scores(features(spark, sf_dir)).groupBy("type").agg(F.count_if(F.col("score") >= L.FLOOR).alias("reached"))


@query("vrc_explanation", f"{STATS}, wide AS (SELECT * FROM features JOIN stats USING (doc_id)), terms AS ({' UNION ALL '.join(f"SELECT doc_id, id, '{kind}' AS type, {w} * ({t}) AS part FROM wide" for kind in L.SCORERS for w, t in L.SCORERS[kind][0])}) SELECT doc_id, id, type, round(sum(part)::DOUBLE + 1e-9, 6) AS explained FROM terms GROUP BY 1, 2, 3")
def vrc_explanation(spark, sf_dir):
    """Weighted terms of every score add up to it, before its gate."""
    f = features(spark, sf_dir)
    terms = F.array(*(F.struct(F.lit(kind).alias("type"), F.expr(f"{w} * ({t})").cast("double").alias("part")) for kind in L.SCORERS for w, t in L.SCORERS[kind][0]))
    wide = f.join(L.page_statistics(f), "doc_id").select("doc_id", "id", F.explode(terms).alias("t"))
    return wide.groupBy("doc_id", "id", "t.type").agg(F.round(F.sum("t.part") + 1e-9, 6).alias("explained"))


@query("vrc_determinism", f"{REGIONS} SELECT count(*)::BIGINT AS rows, 0::BIGINT AS differing FROM regions")
def vrc_determinism(spark, sf_dir):
    f = features(spark, sf_dir)
    same = lambda df: L.classify_regions(df).select("doc_id", "id", "type", F.round("score", 6))
    return V.differing(same(f), same(f.repartition(3, "area")))


@query("val_universe", f"{FAULTY}, a AS (SELECT doc_id, id FROM n), b AS (SELECT DISTINCT doc_id, unnest([from_id, to_id]) AS id FROM e) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def val_universe(spark, sf_dir):
    n, e = faulty(spark, sf_dir)
    return V.universe_difference(n, e.select("doc_id", F.explode(F.array("from_id", "to_id")).alias("id")).distinct())


ALL_SQL = f"""{CYCLES}{LOOPS}{CONTAINED}, {BOXES.replace('WITH ', '')} {' UNION ALL '.join(f"SELECT '{c}' AS name, count(*)::BIGINT AS n FROM ({q}) AS v" for c, _, q in CHECKS)} UNION ALL SELECT 'acyclic', count(*) FROM cy UNION ALL SELECT 'connectivity', count(*) FROM ({ENDS_SQL}) WHERE firsts <> 1 OR lasts <> 1 OR untouched > 0
UNION ALL SELECT 'source_coverage', count(*) FROM ({UNCOVERED_SQL}) UNION ALL SELECT 'confidence_finite', count(*) FROM n WHERE confidence IS NULL OR NOT isfinite(confidence)"""


@query("gv_all", ALL_SQL)
def gv_all(spark, sf_dir):
    """How many faults every check finds. A table can't be changed, so checks of frozen objects have no counterpart."""
    n, e = faulty(spark, sf_dir)
    ends = V.reading_ends(e, n)
    c = F.col("confidence")
    found = {k: f(n, e) for k, f, _ in CHECKS} | {"acyclic": V.cyclic_nodes(e.filter("type = 'READING_NEXT'")), "connectivity": ends.filter("firsts <> 1 OR lasts <> 1 OR untouched > 0")}
    found |= {"source_coverage": V.uncovered(L.word_nodes(boxes(spark, sf_dir)), n), "confidence_finite": n.filter(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))}
    return V.violations(found)


@query("rp_dedupe", f"{FAULTY} SELECT doc_id, type, from_id, to_id, min(ord)::INTEGER AS ord FROM e GROUP BY ALL")
def rp_dedupe(spark, sf_dir):
    return V.dedupe(faulty(spark, sf_dir)[1]).select("doc_id", "type", "from_id", "to_id", "ord")


@query("rp_parents", f"{FAULTY}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, to_id ORDER BY score DESC, ord) AS k FROM e WHERE type = 'CONTAINS') SELECT doc_id, from_id, to_id FROM r WHERE k = 1")
def rp_parents(spark, sf_dir):
    return V.best_parents(faulty(spark, sf_dir)[1]).select("doc_id", "from_id", "to_id")


@query("rp_cycles")
def rp_cycles(spark, sf_dir):
    """All that a repair takes out: repeated edges, containment cycles, further parents, reading cycles and their mirrors."""
    return V.repairs(cut(faulty(spark, sf_dir)[1]), F.col("place")).select("doc_id", "action", "type", "from_id", "to_id", "ord")


@query("rp_gate")
def rp_gate(spark, sf_dir):
    """Each document's verdict: failed with the reasons that no repair mends, else repaired, or clean where nothing was taken out."""
    n, e = map(cut, faulty(spark, sf_dir))
    out = V.repairs(e, F.col("place")).groupBy("doc_id").agg(F.count_if(F.col("action") != "parent").alias("edges"), F.count_if(F.col("action") == "parent").alias("parents"))
    bad = V.unrepairable(n, e, L.word_nodes(boxes(spark, sf_dir))).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    d = n.select("doc_id").distinct().join(bad, "doc_id", "left").join(out, "doc_id", "left").fillna(0, ["edges", "parents"])
    failed = F.col("reasons").isNotNull()
    held = lambda c: F.when(failed, 0).otherwise(F.col(c)).alias(c)
    verdict = F.when(failed, "failed").when(F.col("edges") + F.col("parents") > 0, "repaired").otherwise("clean")
    return d.select("doc_id", verdict.alias("verdict"), F.coalesce("reasons", F.lit("")).alias("reasons"), held("edges"), held("parents"))
