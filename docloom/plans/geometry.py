"""Queries over boxes (inventory 2.8) and robust statistics (2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators import spatial as S
from docloom.registry import query
from docloom.sources.tables import fixture, with_fixtures

BOXES = with_fixtures("boxes")
KEY = "doc_id, line_idx, word_idx"
KEYS = ["doc_id", "line_idx", "word_idx"]
#: Each box beside the next one of its document in reading order.
NEXT = f"""{BOXES}, p AS (SELECT doc_id, line_idx, word_idx, x AS a_x, y AS a_y, width AS a_width, height AS a_height, lead(x) OVER o AS b_x, lead(y) OVER o AS b_y, lead(width) OVER o AS b_width, lead(height) OVER o AS b_height FROM boxes WINDOW o AS (PARTITION BY doc_id ORDER BY line_idx, word_idx)),
q AS (SELECT *, greatest(0, least(a_x + a_width, b_x + b_width) - greatest(a_x, b_x)) AS ox, greatest(0, least(a_y + a_height, b_y + b_height) - greatest(a_y, b_y)) AS oy,
greatest(0, greatest(a_x, b_x) - least(a_x + a_width, b_x + b_width)) AS gx, greatest(0, greatest(a_y, b_y) - least(a_y + a_height, b_y + b_height)) AS gy FROM p WHERE b_x IS NOT NULL)"""
A, B = G.Box("a_"), G.Box("b_")


def boxes(spark, sf_dir):
    return fixture(spark, sf_dir, "boxes").drop("text")


def neighbours(spark, sf_dir):
    at = Window.partitionBy("doc_id").orderBy("line_idx", "word_idx")
    sides = ("x", "y", "width", "height")
    df = boxes(spark, sf_dir).select(*KEYS, *(F.col(c).alias(f"a_{c}") for c in sides), *(F.lead(c).over(at).alias(f"b_{c}") for c in sides))
    return df.filter("b_x IS NOT NULL")


def r6(c):
    return F.round(c, 6)


def pairwise(name: str, sql: str, **columns):
    @query(name, f"{NEXT} SELECT {KEY}, {sql} FROM q")
    def run(spark, sf_dir):
        return neighbours(spark, sf_dir).select(*KEYS, *(c().alias(n) for n, c in columns.items()))


@query("geo_center", f"{BOXES} SELECT {KEY}, x + width / 2 AS cx, y + height / 2 AS cy FROM boxes")
def center(spark, sf_dir):
    b = G.Box()
    return boxes(spark, sf_dir).select(*KEYS, b.center_x.alias("cx"), b.center_y.alias("cy"))


@query("geo_area", f"{BOXES} SELECT {KEY}, width * height AS area FROM boxes")
def area(spark, sf_dir):
    return boxes(spark, sf_dir).select(*KEYS, G.Box().area.alias("area"))


pairwise(
    "geo_distance",
    "round(sqrt(pow(a_x + a_width / 2 - b_x - b_width / 2, 2) + pow(a_y + a_height / 2 - b_y - b_height / 2, 2)), 6) AS centers, round(sqrt(gx * gx + gy * gy), 6) AS boxes",
    centers=lambda: r6(G.center_distance(A, B)),
    boxes=lambda: r6(G.box_distance(A, B)),
)
pairwise("geo_intersects", "ox > 0 AND oy > 0 AS hit", hit=lambda: G.intersects(A, B))
pairwise("geo_contains", "a_x <= b_x AND a_y <= b_y AND a_x + a_width >= b_x + b_width AND a_y + a_height >= b_y + b_height AS hit", hit=lambda: G.contains(A, B))
pairwise("geo_point_in", "b_x BETWEEN a_x AND a_x + a_width AND b_y BETWEEN a_y AND a_y + a_height AS hit", hit=lambda: G.contains_point(A, B.x, B.y))
pairwise("geo_intersection", "ox * oy AS area", area=lambda: G.intersection_area(A, B))
pairwise("geo_iou", "round(ox * oy / (a_width * a_height + b_width * b_height - ox * oy), 6) AS iou", iou=lambda: r6(G.iou(A, B)))
pairwise("geo_overlap", "ox::DOUBLE AS ox, oy::DOUBLE AS oy", ox=lambda: G.overlap_x(A, B), oy=lambda: G.overlap_y(A, B))
pairwise("geo_gap", "gx::DOUBLE AS gx, gy::DOUBLE AS gy", gx=lambda: G.gap_x(A, B), gy=lambda: G.gap_y(A, B))
pairwise(
    "geo_overlap_ratio",
    "round(ox / least(a_width, b_width), 6) AS rx, round(oy / least(a_height, b_height), 6) AS ry",
    rx=lambda: r6(G.overlap_ratio(G.overlap_x(A, B), A.width, B.width)),
    ry=lambda: r6(G.overlap_ratio(G.overlap_y(A, B), A.height, B.height)),
)

PAGE = f"{BOXES}, g AS (SELECT doc_id, min(x) AS px, min(y) AS py, max(x + width) - min(x) AS pw, max(y + height) - min(y) AS ph FROM boxes GROUP BY 1)"


def union_boxes(spark, sf_dir):
    b = G.Box()
    return boxes(spark, sf_dir).groupBy("doc_id").agg(F.min("x").alias("px"), F.min("y").alias("py"), (F.max(b.right) - F.min("x")).alias("pw"), (F.max(b.bottom) - F.min("y")).alias("ph"))


@query("geo_union", f"{PAGE} SELECT * FROM g")
def union(spark, sf_dir):
    return union_boxes(spark, sf_dir)


@query("geo_normalize", f"{PAGE} SELECT {KEY}, round((x - px) / pw, 6) AS x, round((y - py) / ph, 6) AS y, round(width / pw, 6) AS width, round(height / ph, 6) AS height FROM boxes JOIN g USING (doc_id)")
def normalize(spark, sf_dir):
    df = boxes(spark, sf_dir).join(union_boxes(spark, sf_dir), "doc_id")
    unit = {"x": (F.col("x") - F.col("px")) / F.col("pw"), "y": (F.col("y") - F.col("py")) / F.col("ph"), "width": F.col("width") / F.col("pw"), "height": F.col("height") / F.col("ph")}
    return df.select(*KEYS, *(r6(c).alias(n) for n, c in unit.items()))


@query("geo_denormalize", f"{PAGE} SELECT {KEY}, round((x - px) / pw * pw + px, 6) AS x, round((y - py) / ph * ph + py, 6) AS y FROM boxes JOIN g USING (doc_id)")
def denormalize(spark, sf_dir):
    df = boxes(spark, sf_dir).join(union_boxes(spark, sf_dir), "doc_id")
    return df.select(*KEYS, r6((F.col("x") - F.col("px")) / F.col("pw") * F.col("pw") + F.col("px")).alias("x"), r6((F.col("y") - F.col("py")) / F.col("ph") * F.col("ph") + F.col("py")).alias("y"))


@query("spx_build", f"{BOXES} SELECT doc_id, least(4096.0, greatest(1.0, coalesce(median(CASE WHEN width > 0 AND height > 0 THEN least(width, height) END), 16.0)))::DOUBLE AS cell FROM boxes GROUP BY 1")
def spx_build(spark, sf_dir):
    return S.cell_size(boxes(spark, sf_dir))


SELF = f"""{BOXES}, a AS (SELECT doc_id, line_idx AS a_line, word_idx AS a_word, x AS a_x, y AS a_y, width AS a_width, height AS a_height FROM boxes),
b AS (SELECT doc_id, line_idx AS b_line, word_idx AS b_word, x AS b_x, y AS b_y, width AS b_width, height AS b_height FROM boxes), p AS (SELECT * FROM a JOIN b USING (doc_id) WHERE (a_line, a_word) <> (b_line, b_word))"""
IDS = ["doc_id", "a_line", "a_word", "b_line", "b_word"]


def other():
    return ~((F.col("a_line") == F.col("b_line")) & (F.col("a_word") == F.col("b_word")))



def self_pairs(spark, sf_dir, test, reach=0.0):
    df = boxes(spark, sf_dir).drop("confidence").withColumnsRenamed({"line_idx": "line", "word_idx": "word"})
    return S.grid_join(S.named(df, "a_"), S.named(df, "b_"), other() & test, reach=reach)


def window_query(name: str, sql: str, test, reach=0.0):
    @query(name, f"{SELF} SELECT {', '.join(IDS)} FROM p WHERE {sql}")
    def run(spark, sf_dir):
        return self_pairs(spark, sf_dir, test(), reach).select(*IDS)


OVER = "a_x < b_x + b_width AND b_x < a_x + a_width AND a_y < b_y + b_height AND b_y < a_y + a_height"
HOLDS = "a_x <= b_x AND a_y <= b_y AND a_x + a_width >= b_x + b_width AND a_y + a_height >= b_y + b_height"
NEAR = "sqrt(pow(greatest(0, greatest(a_x, b_x) - least(a_x + a_width, b_x + b_width)), 2) + pow(greatest(0, greatest(a_y, b_y) - least(a_y + a_height, b_y + b_height)), 2))"
CENTERS = "sqrt(pow(a_x + a_width / 2 - b_x - b_width / 2, 2) + pow(a_y + a_height / 2 - b_y - b_height / 2, 2))"
window_query("spx_overlap", OVER, lambda: G.intersects(A, B))
window_query("spx_contained", HOLDS, lambda: G.contains(A, B))
window_query("spx_containing", HOLDS.replace("a_", "#").replace("b_", "a_").replace("#", "b_"), lambda: G.contains(B, A))
window_query("spx_point", "a_x + a_width / 2 BETWEEN b_x AND b_x + b_width AND a_y + a_height / 2 BETWEEN b_y AND b_y + b_height", lambda: G.contains_point(B, A.center_x, A.center_y))
window_query("spx_nearby", f"{NEAR} <= 24", lambda: G.box_distance(A, B) <= 24, reach=24.0)


def ringed(spark, sf_dir, distance, k):
    df = boxes(spark, sf_dir).drop("confidence").withColumnsRenamed({"line_idx": "line", "word_idx": "word"})
    return S.nearest(S.named(df, "a_"), S.named(df, "b_"), distance, k, ["a_line", "a_word"], ["b_line", "b_word"], other())


@query("spx_knn", f"{SELF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a_line, a_word ORDER BY round({CENTERS}, 6), b_line, b_word) AS n FROM p) SELECT {', '.join(IDS)}, n::INTEGER AS rank FROM r WHERE n <= 3")
def spx_knn(spark, sf_dir):
    return ringed(spark, sf_dir, G.center_distance(A, B), 3).select(*IDS, "rank")


@query("lq_nearest", f"{SELF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a_line, a_word ORDER BY round({NEAR}, 6), b_line, b_word) AS n FROM p) SELECT {', '.join(IDS)} FROM r WHERE n = 1")
def lq_nearest(spark, sf_dir):
    return ringed(spark, sf_dir, G.box_distance(A, B), 1).select(*IDS)


@query("lq_containing", f"{BOXES} SELECT {KEY} FROM boxes WHERE x <= 100 AND x + width >= 100 AND y <= 45 AND y + height >= 45")
def lq_containing(spark, sf_dir):
    return boxes(spark, sf_dir).filter(G.contains_point(G.Box(), F.lit(100.0), F.lit(45.0))).select(*KEYS)


@query("lq_contained", f"{BOXES} SELECT {KEY} FROM boxes WHERE x >= 50 AND y >= 10 AND x + width <= 250 AND y + height <= 90")
def lq_contained(spark, sf_dir):
    b = G.Box()
    return boxes(spark, sf_dir).filter((b.x >= 50) & (b.y >= 10) & (b.right <= 250) & (b.bottom <= 90)).select(*KEYS)


@query("lsel_select", f"{BOXES} SELECT {KEY}, confidence FROM boxes WHERE confidence BETWEEN 0.6 AND 0.9 AND x >= 20 AND x + width <= 400 ORDER BY doc_id, y, x, line_idx, word_idx")
def lsel_select(spark, sf_dir):
    b = G.Box()
    picked = boxes(spark, sf_dir).filter(F.col("confidence").between(0.6, 0.9) & (b.x >= 20) & (b.right <= 400))
    return picked.orderBy("doc_id", "y", "x", "line_idx", "word_idx").select(*KEYS, "confidence")


def stat(name: str, sql: str, column):
    @query(name, f"{BOXES} SELECT doc_id, round({sql}, 6) AS value FROM boxes GROUP BY 1")
    def run(spark, sf_dir):
        return boxes(spark, sf_dir).groupBy("doc_id").agg(r6(column()).alias("value"))


stat("sta_median", "median(width)", lambda: F.median("width"))
stat("sta_quantile", "quantile_cont(width, 0.75)", lambda: F.percentile("width", 0.75))
stat("sta_mean", "avg(width)", lambda: F.avg("width"))
MAD = f"{BOXES}, m AS (SELECT doc_id, median(width) AS m FROM boxes GROUP BY 1), d AS (SELECT doc_id, m, median(abs(width - m)) AS mad FROM boxes JOIN m USING (doc_id) GROUP BY 1, 2)"


def deviations(spark, sf_dir):
    b = boxes(spark, sf_dir)
    m = b.groupBy("doc_id").agg(F.median("width").alias("m"))
    return b.join(m, "doc_id").groupBy("doc_id", "m").agg(F.median(F.abs(F.col("width") - F.col("m"))).alias("mad"))


@query("sta_mad", f"{MAD} SELECT doc_id, round(mad, 6) AS value FROM d")
def mad(spark, sf_dir):
    return deviations(spark, sf_dir).select("doc_id", r6("mad").alias("value"))


@query("sta_gap_threshold", f"{MAD} SELECT doc_id, round(CASE WHEN mad = 0 THEN m ELSE m + 3 * mad END, 6) AS value FROM d")
def gap_threshold(spark, sf_dir):
    return deviations(spark, sf_dir).select("doc_id", r6(F.when(F.col("mad") == 0, F.col("m")).otherwise(F.col("m") + 3 * F.col("mad"))).alias("value"))
