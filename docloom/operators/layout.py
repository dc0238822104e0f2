"""Layout: gaps, blocks, hierarchy, reading order, region features and confidence propagation over word boxes.

All joins are within a document. A page's boxes are dealt by doc_id once; groups, hierarchy and reading order are then made where they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.operators.spatial import grid_join, named
from docloom.sources.cut import cut

GAP_SCALE, SEARCH_CAP = 3, 10
WORD, BOX = ["doc_id", "line_idx", "word_idx"], ["x", "y", "width", "height"]


def finite(words: DataFrame) -> DataFrame:
    """Words with a finite box."""
    ok = F.lit(True)
    for c in ("x", "y", "width", "height"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return words.filter(ok)


def _quantile(values: Column, share: float) -> Column:
    """Interpolated quantile of a sorted array."""
    at = (F.size(values) - 1) * share
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.get(values, low) + (F.get(values, high) - F.get(values, low)) * (at - low)


def threshold(samples: DataFrame, gap: str) -> DataFrame:
    """(doc_id, threshold): median, plus GAP_SCALE times the median deviation where there is one. A page's gaps are gathered in order once, as many as it has boxes."""
    held = samples.groupBy("doc_id").agg(F.array_sort(F.collect_list(gap)).alias("v")).withColumn("m", _quantile(F.col("v"), 0.5))
    held = held.withColumn("mad", _quantile(F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("m")))), 0.5))
    return held.select("doc_id", F.when(F.col("mad") == 0, F.col("m")).otherwise(F.col("m") + GAP_SCALE * F.col("mad")).alias("threshold"))


def horizontal_gaps(words: DataFrame, *more: str) -> DataFrame:
    """Gaps between neighbours of a line that overlap vertically; words of a line that differ in `more` columns are no neighbours."""
    at = Window.partitionBy("doc_id", "line_idx", *more).orderBy("x", "word_idx")
    prev = words.select(*WORD, *more, *(F.col(c).alias(f"a_{c}") for c in ("x", "y", "width", "height")), *(F.lag(c).over(at).alias(f"b_{c}") for c in ("x", "y", "width", "height")))
    a, b = G.Box("a_"), G.Box("b_")
    return prev.filter(F.col("b_x").isNotNull() & (G.overlap_y(a, b) > 0)).select(*WORD, *more, G.gap_x(a, b).alias("gap"))


def _near(boxes: DataFrame, ids: list[str], reach: DataFrame, test: Column) -> DataFrame:
    """Pairs of different boxes of a document, as a_ and b_ columns, that pass a test which holds only within the document's reach (doc_id, reach, ...)."""
    b = boxes.select("doc_id", *ids, "x", "y", "width", "height").join(reach, "doc_id")
    other = ~F.lit(True)
    for c in ids:
        other = other | (F.col(f"a_{c}") != F.col(f"b_{c}"))
    return grid_join(named(b, "a_"), named(b, "b_"), other & test, reach=F.col("a_reach"), base=F.greatest(F.median(F.greatest("b_width", "b_height")), F.max("b_reach")) * 2)


def search_cap(boxes: DataFrame) -> DataFrame:
    """(doc_id, reach): how far neighbours are looked for, SEARCH_CAP median heights."""
    return boxes.groupBy("doc_id").agg((F.median("height") * SEARCH_CAP).alias("reach"))


def nearest_gaps(boxes: DataFrame, ids: list[str], axis: str) -> DataFrame:
    """(doc_id, a_<ids>, gap): each box's smallest positive gap along an axis to a box beside it on that axis, within search_cap()."""
    a, b = G.Box("a_"), G.Box("b_")
    gap, shared = (G.gap_y(a, b), G.overlap_x(a, b)) if axis == "y" else (G.gap_x(a, b), G.overlap_y(a, b))
    near = _near(boxes, ids, search_cap(boxes), (shared > 0) & (gap > 0) & (G.box_distance(a, b) <= F.col("a_reach")))
    return near.groupBy("doc_id", *(f"a_{c}" for c in ids)).agg(F.min(gap).alias("gap"))


def vertical_gaps(words: DataFrame) -> DataFrame:
    """Each word's smallest gap to a word above or below it."""
    w = words.withColumnsRenamed({"line_idx": "line", "word_idx": "word"})
    return nearest_gaps(w, ["line", "word"], "y")


def links(boxes: DataFrame, ids: list[str], h_samples: DataFrame, v_samples: DataFrame) -> DataFrame:
    """Pairs of boxes of one group (doc_id, a_<ids>, b_<ids>): beside each other or above each other within the document's thresholds, learnt from its gaps."""
    h = threshold(h_samples, "gap").withColumnRenamed("threshold", "h")
    v = threshold(v_samples, "gap").withColumnRenamed("threshold", "v")
    reach = boxes.select("doc_id").distinct().join(h, "doc_id", "left").join(v, "doc_id", "left").fillna(0.0, ["h", "v"]).withColumn("reach", F.greatest("h", "v"))
    a, b = G.Box("a_"), G.Box("b_")
    beside = (G.overlap_y(a, b) > 0) & (G.gap_x(a, b) <= F.col("a_h"))
    above = (G.overlap_x(a, b) > 0) & (G.gap_y(a, b) <= F.col("a_v"))
    return _near(boxes, ids, reach, beside | above).select("doc_id", *(f"a_{c}" for c in ids), *(f"b_{c}" for c in ids))


def groups(edges: DataFrame) -> DataFrame:
    """(doc_id, node, root) of every node of the edges (doc_id, u, v); root is the smallest node it reaches. A page's edges, as many as its boxes have near ones, are one task's work at a time."""

    def run(table: pa.Table) -> pa.Table:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for u, v in zip(table.column("u").to_pylist(), table.column("v").to_pylist(), strict=True):
            one, two = find(u), find(v)
            up[max(one, two)] = min(one, two)
        nodes = sorted(up)
        return pa.table({"doc_id": pa.array([table.column("doc_id")[0].as_py()] * len(nodes), type=pa.int64()), "node": pa.array(nodes, type=pa.int64()), "root": pa.array([find(n) for n in nodes], type=pa.int64())})

    return edges.select("doc_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).groupBy("doc_id").applyInArrow(run, "doc_id long, node long, root long")


#: Words of a line at most, as far as a word's place in its document goes.
LINE_WORDS = 1 << 20
#: Boxes of a page that is grouped as one array, at most; a page of more is grouped by joins on cells of a grid.
PAGE_BOXES = 512
#: Pairs of boxes that a worker holds at a time.
MOST_PAIRS = 1 << 20


def _medians(page: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Interpolated median of each page's finite values; nan if there is none."""
    held = np.isfinite(values)
    page, values = page[held], values[held]
    values = values[np.lexsort((values, page))]
    sizes = np.bincount(page, minlength=n)
    out, some, first = np.full(n, np.nan), sizes > 0, np.cumsum(sizes) - sizes
    low, high = values[(first + (sizes - 1) // 2)[some]], values[(first + sizes // 2)[some]]
    out[some] = low + (high - low) * 0.5
    return out


def _limits(page: np.ndarray, gaps: np.ndarray, n: int) -> np.ndarray:
    """threshold() of each page's finite gaps, 0 if there is none."""
    mid = _medians(page, gaps, n)
    mad = _medians(page, np.abs(gaps - mid[page]), n)
    return np.nan_to_num(np.where(mad == 0, mid, mid + GAP_SCALE * mad))


def _grouped(sizes: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray, line: np.ndarray | None) -> np.ndarray:
    """Number of each box's group in its page, for pages of `sizes` boxes one after another. Boxes that aren't finite are groups of their own.

    line: lines of words, whose gaps aside are those between neighbours of a line; without lines each box's smallest gap aside counts."""
    n, pages = len(x), len(sizes)
    page, first = np.repeat(np.arange(pages), sizes), np.cumsum(sizes) - sizes
    right, bottom = x + width, y + height
    near = lambda lo, hi, a, b: np.minimum(hi[a], hi[b]) - np.maximum(lo[a], lo[b])
    each = sizes[page]
    start = np.cumsum(each) - each
    a = np.repeat(np.arange(n), each)
    b = np.arange(len(a)) - np.repeat(start - first[page], each)
    dx, dy, of = near(x, right, a, b), near(y, bottom, a, b), page[a]
    ox, oy, gx, gy = (dx > 0) & (a != b), (dy > 0) & (a != b), np.maximum(-dx, 0), np.maximum(-dy, 0)
    close = np.hypot(gx, gy) <= (_medians(page, height, pages) * SEARCH_CAP)[of]
    least = lambda gap, ok: np.minimum.reduceat(np.where(ok & (gap > 0) & close, gap, np.inf), start)
    v = _limits(page, least(gy, ox), pages)
    if line is None:
        h = _limits(page, least(gx, oy), pages)
    else:
        order = np.lexsort((x, line, page))
        one, two = order[:-1], order[1:]
        beside = (page[one] == page[two]) & (line[one] == line[two])
        one, two = one[beside], two[beside]
        shared = near(y, bottom, one, two) > 0
        h = _limits(page[one[shared]], np.maximum(-near(x, right, one, two), 0)[shared], pages)
    linked = (oy & (gx <= h[of])) | (ox & (gy <= v[of]))
    a, b = a[linked], b[linked]
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    count = np.cumsum(root == np.arange(n))
    return count[root] - count[first[page]]


def _page_groups(x: Column, y: Column, width: Column, height: Column, line: Column | None = None) -> Column:
    """Column of arrays: the group of each box of a page, whose boxes are arrays in the order that groups are numbered by."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = batch[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch]
            ends, pairs = np.cumsum(sizes), np.cumsum(sizes * sizes)
            out, at = np.zeros(int(sizes.sum()), dtype=np.int32), 0
            with np.errstate(invalid="ignore"):
                while at < len(sizes):
                    upto = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + MOST_PAIRS)))
                    part = slice(int(ends[at] - sizes[at]), int(ends[upto - 1]))
                    out[part] = _grouped(sizes[at:upto], *(c[part] for c in columns), *(() if len(columns) > 4 else (None,)))
                    at = upto
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))

    return run(x, y, width, height, *(() if line is None else (line,)))


def _in_pages(boxes: DataFrame, ids: list[str], name: str, whole, parted, counted: DataFrame | None = None) -> DataFrame:
    """boxes with the group of each in column `name`, dealt by page: pages of at most PAGE_BOXES boxes as arrays, by whole(array of boxes);
    larger pages by parted(boxes), which gives ids and group. counted: rows of the pages, no fewer than their boxes, where
    these are cheaper to count: the boxes themselves are counted only if that finds a large page."""
    crowded = lambda rows: cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > PAGE_BOXES).select("doc_id"))
    large = counted is None or not crowded(counted).isEmpty()
    many = crowded(boxes) if large else None
    large = large and not many.isEmpty()
    few = boxes.join(many, "doc_id", "left_anti") if large else boxes
    rest = [c for c in boxes.columns if c not in ("doc_id", *ids)]
    held = few.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*ids, *rest))).alias("_boxes")).withColumn("_of", whole(F.col("_boxes")))
    # Spark doesn't know that Python leaves rows where they are: pages are dealt again as arrays, so that what gathers them later needn't.
    held = held.repartition("doc_id")
    out = held.select("doc_id", F.explode(F.arrays_zip("_boxes", "_of")).alias("_z")).select("doc_id", "_z._boxes.*", F.col("_z._of").alias(name)).select(*boxes.columns, name)
    if large:
        big = cut(boxes.join(many, "doc_id", "left_semi"))
        out = out.unionByName(big.join(parted(big), ["doc_id", *ids]).select(*boxes.columns, name))
    return out


def blocked(words: DataFrame) -> DataFrame:
    """words with block: groups of linked words, numbered by their first word."""
    return _in_pages(words, WORD[1:], "block", lambda b: _page_groups(*(b[c] for c in (*BOX, "line_idx"))), _parted_blocks)


def blocks(words: DataFrame) -> DataFrame:
    """(doc_id, line_idx, word_idx, block) of blocked()."""
    return blocked(words.select(*WORD, *BOX)).select(*WORD, "block")


def _parted_blocks(words: DataFrame) -> DataFrame:
    """blocks() by joins on a grid: what meets follows the neighbourhood of a box."""
    w = words.withColumnsRenamed({"line_idx": "line", "word_idx": "word"})
    linked = links(w, ["line", "word"], horizontal_gaps(words), vertical_gaps(words))
    place = lambda line, word: F.col(line).cast("long") * LINE_WORDS + F.col(word)
    edges = linked.select("doc_id", place("a_line", "a_word").alias("u"), place("b_line", "b_word").alias("v"))
    of = groups(edges.filter("u < v").unionByName(w.select("doc_id", place("line", "word").alias("u"), place("line", "word").alias("v"))))
    block = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("root")) - 1
    return of.select("doc_id", F.floor(F.col("node") / LINE_WORDS).cast("int").alias("line_idx"), (F.col("node") % LINE_WORDS).cast("int").alias("word_idx"), block.alias("block"))


def regions(of_blocks: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, block, region): blocks that lie near each other, by gaps that the page's own blocks leave. of_blocks: doc_id, block, box.
    words: those that the blocks are made of, of which a page has no fewer than blocks; with them, blocks aren't made once more to be counted."""
    boxes = of_blocks.select("doc_id", "block", *BOX)
    return _in_pages(boxes, ["block"], "region", lambda b: _page_groups(*(b[c] for c in BOX)), _parted_regions, words).select("doc_id", "block", "region")


def _parted_regions(of_blocks: DataFrame) -> DataFrame:
    linked = links(of_blocks, ["block"], nearest_gaps(of_blocks, ["block"], "x"), nearest_gaps(of_blocks, ["block"], "y"))
    edges = linked.select("doc_id", F.col("a_block").alias("u"), F.col("b_block").alias("v")).filter("u < v")
    of = groups(edges.unionByName(of_blocks.select("doc_id", F.col("block").alias("u"), F.col("block").alias("v"))))
    region = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("root")) - 1
    return of.select("doc_id", F.col("node").cast("int").alias("block"), region.alias("region"))


def union_box(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Enclosing box of each group, and further aggregates."""
    b = G.Box()
    box = df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"), *more)
    return box.withColumns({"width": F.col("_r") - F.col("x"), "height": F.col("_b") - F.col("y")}).drop("_r", "_b")


def reading_order(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with position, next and previous id along their document: line, word, y, x, id."""
    at = Window.partitionBy("doc_id").orderBy(*(F.col(k).asc_nulls_last() for k in keys))
    return nodes.withColumns({"position": F.row_number().over(at), "next_id": F.lead("id").over(at), "prev_id": F.lag("id").over(at)})


def word_nodes(words: DataFrame) -> DataFrame:
    ident = F.concat_ws("-", F.lit("w"), F.col("line_idx").cast("string"), F.col("word_idx").cast("string"))
    return words.withColumn("id", ident)


#: Levels of a hierarchy from its root.
LEVELS = ["document", "block", "line", "word"]


def hierarchy(words: DataFrame) -> DataFrame:
    """(doc_id, level, id, parent, x, y, width, height, n, path): words, lines of a block, blocks, document; path: ids of the ancestors, nearest first.

    words: of blocked(). Each word is told to its four nodes and gathered by page, so rows dealt by page aren't moved."""
    b, none = G.Box(), F.lit(None).cast("int")
    key = lambda depth, *places: F.struct(F.lit(depth).alias("depth"), *(p.cast("int").alias(c) for p, c in zip(places, ("block", "line", "word"), strict=True)))
    places = F.array(key(0, none, none, none), key(1, F.col("block"), none, none), key(2, F.col("block"), F.col("line_idx"), none), key(3, F.col("block"), F.col("line_idx"), F.col("word_idx")))
    told = words.select("doc_id", "x", "y", "width", "height", b.right.alias("_r"), b.bottom.alias("_b"), F.explode(places).alias("k")).select("*", "k.*").drop("k")
    n = told.groupBy("doc_id", "depth", "block", "line", "word").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("_r").alias("_r"), F.max("_b").alias("_b"), F.max("width").alias("_w"), F.max("height").alias("_h"), F.count("*").alias("n"))
    ident = lambda kind, *places: F.concat_ws("-", F.lit(kind), *(F.col(p).cast("string") for p in places))
    line, block, depth, root = ident("l", "block", "line"), ident("b", "block"), F.col("depth"), F.lit("d")
    path = F.when(depth == 3, F.array(line, block, root)).when(depth == 2, F.array(block, root)).when(depth == 1, F.array(root)).otherwise(F.array().cast("array<string>"))
    own = F.when(depth == 3, ident("w", "line", "word")).when(depth == 2, line).when(depth == 1, block).otherwise(root)
    level = F.element_at(F.array(*map(F.lit, LEVELS)), depth + 1)
    size = lambda whole, low, high: F.when(depth == 3, F.col(whole)).otherwise(F.col(high) - F.col(low))
    return n.select("doc_id", level.alias("level"), own.alias("id"), F.get(path, F.lit(0)).alias("parent"), "x", "y", size("_w", "x", "_r").alias("width"), size("_h", "y", "_b").alias("height"), "n", path.alias("path"))


def readable(nodes: DataFrame) -> DataFrame:
    """Nodes of hierarchy() with depth, position among their siblings (by place, then id), next_id, prev_id, siblings, children and ancestors (joined by >, nearest first).

    A node is told to itself and to its parent, which counts its children: windows within a page, no joins."""
    kin = Window.partitionBy("doc_id", "parent").orderBy("y", "x", "id")
    depth = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")).cast("int") - 1
    n = nodes.withColumns({"depth": depth, "position": F.row_number().over(kin), "next_id": F.lead("id").over(kin), "prev_id": F.lag("id").over(kin), "siblings": F.count("*").over(Window.partitionBy("doc_id", "parent")) - 1})
    told = n.withColumn("_to", F.explode(F.array(F.struct(F.col("id").alias("id"), F.lit(True).alias("own")), F.struct(F.col("parent").alias("id"), F.lit(False).alias("own"))))).filter("_to.id IS NOT NULL")
    told = told.withColumn("children", F.count_if(~F.col("_to.own")).over(Window.partitionBy("doc_id", "_to.id"))).filter("_to.own").drop("_to")
    return told.withColumn("ancestors", F.concat_ws(">", "path")).drop("path")


def region_features(regions: DataFrame) -> DataFrame:
    """Features of every region of a page from its siblings. regions: doc_id, id, x, y, width, height, words, children, content_area."""
    page = union_box(regions, ["doc_id"], F.greatest(F.median("width"), F.median("height")).alias("size"), F.count("*").alias("n"))
    page = page.select("doc_id", F.col("width").alias("pw"), F.col("height").alias("ph"), F.col("x").alias("px"), F.col("y").alias("py"), "size", "n")
    slim = regions.select("doc_id", "id", "x", "y", "width", "height")
    a, b = G.Box("a_"), G.Box("b_")
    p = named(slim, "a_").join(named(slim, "b_"), "doc_id").filter("a_id <> b_id").join(page, "doc_id")
    tol = F.greatest(F.col("size") * 0.15, F.lit(1e-9))
    near = F.greatest(F.col("size") * 1.5, F.lit(1e-9))
    aligned = (F.abs(a.x - b.x) <= tol) | (F.abs(a.right - b.right) <= tol) | (F.abs(a.center_x - b.center_x) <= tol)
    grid = (F.abs(a.y - b.y) <= tol) | (F.abs(a.bottom - b.bottom) <= tol)
    sib = p.groupBy("doc_id", F.col("a_id").alias("id")).agg(
        F.avg(aligned.cast("double")).alias("alignment"), F.avg(grid.cast("double")).alias("grid"), F.count_if(G.center_distance(a, b) <= near).alias("neighbors"),
        F.min(G.center_distance(a, b)).alias("nn"), F.sum(G.intersection_area(a, b)).alias("covered"),
    )
    mid = sib.groupBy("doc_id").agg(F.median("nn").alias("mid_nn"))
    r = regions.join(page, "doc_id").join(sib, ["doc_id", "id"], "left").join(mid, "doc_id", "left")
    c, me = F.col, G.Box()
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return r.select(
        "doc_id", "id",
        ((me.center_x - c("px")) / c("pw")).alias("center_x"), ((me.center_y - c("py")) / c("ph")).alias("center_y"),
        F.abs((me.center_x - c("px")) / c("pw") - 0.5).alias("offset_x"),
        (me.area / (c("pw") * c("ph"))).alias("area_ratio"), (c("width") / c("pw")).alias("width_ratio"), (c("height") / c("ph")).alias("height_ratio"),
        F.when((c("width") == 0) | (c("height") == 0), 0.0).otherwise(c("width") / c("height")).alias("aspect"),
        F.when(me.area > 0, c("words") / me.area).otherwise(0.0).alias("density"),
        F.when(me.area > 0, unit(1 - c("content_area") / me.area)).otherwise(1.0).alias("whitespace"),
        F.coalesce("alignment", F.lit(0.0)).alias("alignment"), F.coalesce("grid", F.lit(0.0)).alias("grid"), F.coalesce("neighbors", F.lit(0)).alias("neighbors"),
        F.coalesce(unit(c("nn") / F.greatest(c("mid_nn") * 2, F.lit(1e-9))), F.lit(1.0)).alias("isolation"),
        F.when(me.area > 0, unit(F.coalesce("covered", F.lit(0.0)) / me.area)).otherwise(0.0).alias("containment"),
        unit(c("content_area") / (c("pw") * c("ph"))).alias("coverage"), "children", me.area.alias("area"), "width", "height",
    )


# Weighted terms and gates of the region types, over a region's features and its page's statistics (q25_, mid_, q75_, max_, mad_).
RATIO = "CASE WHEN {1} > 1e-9 THEN least(1.0, greatest(0.0, {0} / {1})) ELSE 0.0 END"


def _ratio(a: str, b: str) -> str:
    return RATIO.format(a, b)


SHORT = f"(1 - {_ratio('height', 'q75_height')})"
SMALL = f"(1 - {_ratio('area', '2 * mid_area')})"
SPARSE = f"(1 - {_ratio('density', 'mid_density')})"
WIDE = "least(1.0, 1.5 * width_ratio)"
SCORERS: dict[str, tuple[list[tuple[float, str]], str]] = {
    "header": ([(0.3, "(1 - center_y)"), (0.3, WIDE), (0.15, SHORT), (0.1, "alignment"), (0.15, _ratio("density", "mid_density"))], "center_y <= q25_center_y AND center_y <= greatest(0.0, mid_center_y - mad_center_y) AND width >= 0.5 * mid_width"),
    "body": ([(0.4, _ratio("area", "max_area")), (0.3, _ratio("density", "mid_density")), (0.2, _ratio("coverage", "mid_coverage")), (0.1, "alignment")], "area >= mid_area AND children <= greatest(2 * mid_children, 2)"),
    "footer": ([(0.3, "center_y"), (0.25, WIDE), (0.15, SHORT), (0.1, "alignment"), (0.2, _ratio("density", "mid_density"))], "center_y >= q75_center_y AND width >= 0.5 * mid_width AND whitespace <= mid_whitespace + mad_whitespace"),
    "sidebar": ([(0.4, "least(1.0, 2 * offset_x)"), (0.35, f"(1 - {_ratio('width', 'mid_width')})"), (0.25, _ratio("height", "mid_height"))], "width <= mid_width AND height >= mid_height"),
    "table": ([(0.3, _ratio("children", "greatest(2 * mid_children, 2)")), (0.25, _ratio("density", "1.25 * mid_density")), (0.2, "alignment"), (0.15, "grid"), (0.1, f"(1 - {_ratio('whitespace', 'q75_whitespace')})")], "children >= 2 AND density >= mid_density"),
    "form_field": ([(0.55, _ratio("whitespace", "max_whitespace")), (0.15, f"(1 - {_ratio('height', 'mid_height')})"), (0.1, SPARSE), (0.1, "alignment"), (0.1, f"(1 - {_ratio('width', 'q75_width')})")], "whitespace >= mid_whitespace AND children <= greatest(mid_children, 1)"),
    "stamp": ([(0.3, "(1 - least(1.0, abs(aspect - 1)))"), (0.25, SMALL), (0.25, "isolation"), (0.2, "(1 - containment)")], "area <= mid_area"),
    "annotation": ([(0.25, "least(1.0, 2 * offset_x)"), (0.15, f"(1 - {_ratio('width', 'q25_width')})"), (0.15, SMALL), (0.15, "isolation"), (0.15, SPARSE), (0.15, "(1 - containment)")], "area <= mid_area AND width <= mid_width AND offset_x >= q75_offset_x"),
    "signature": ([(0.35, "center_y"), (0.25, _ratio("width", "mid_width")), (0.2, f"(1 - {_ratio('height', 'mid_height')})"), (0.2, _ratio("whitespace", "max_whitespace"))], "center_y >= q75_center_y AND whitespace >= q75_whitespace"),
}
GATE, FLOOR, FLOOR_SHARE = 0.25, 0.35, 0.5
STATISTICS = ("center_y", "width", "height", "area", "density", "coverage", "children", "whitespace", "offset_x")


def page_statistics(features: DataFrame) -> DataFrame:
    """Quartiles, maximum and median deviation of the features over each page: one pass gathers a page's values, as many as it has regions, in order."""
    held = features.groupBy("doc_id").agg(*(F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(f"_{c}") for c in STATISTICS))
    parts = []
    for c in STATISTICS:
        v = F.col(f"_{c}")
        parts += [_quantile(v, 0.25).alias(f"q25_{c}"), _quantile(v, 0.5).alias(f"mid_{c}"), _quantile(v, 0.75).alias(f"q75_{c}"), F.array_max(v).alias(f"max_{c}")]
    wide = held.select("doc_id", *(f"_{c}" for c in STATISTICS), *parts)
    return wide.select("*", *map(_deviation, STATISTICS)).drop(*(f"_{c}" for c in STATISTICS))


def _deviation(c: str) -> Column:
    """Median distance of the values of a feature from their median."""
    return _quantile(F.array_sort(F.transform(f"_{c}", lambda x: F.abs(x - F.col(f"mid_{c}")))), 0.5).alias(f"mad_{c}")


def score_sql(kind: str) -> str:
    terms, gate = SCORERS[kind]
    # Quartiles are interpolated: equality holds within rounding.
    gate = re.sub(r"(<=|>=) (.+?)(?= AND |$)", lambda m: f"{m[1]} ({m[2]}) {'+' if m[1] == '<=' else '-'} 1e-9", gate)
    total = " + ".join(f"{w} * {t}" for w, t in terms)
    return f"({total}) * CASE WHEN {gate} THEN 1.0 ELSE {GATE} END"


def _scored(features: DataFrame) -> DataFrame:
    """(doc_id, id, each): an array of the types and scores of every region."""
    wide = features.join(page_statistics(features), "doc_id")
    each = F.array(*(F.struct(F.lit(k).alias("type"), F.expr(score_sql(k)).cast("double").alias("score")) for k in SCORERS))
    return wide.select("doc_id", "id", each.alias("each"))


def region_scores(features: DataFrame) -> DataFrame:
    """(doc_id, id, type, score) for every region and type."""
    return _scored(features).select("doc_id", "id", F.explode("each").alias("s")).select("doc_id", "id", "s.type", "s.score")


def classify_regions(features: DataFrame) -> DataFrame:
    """(doc_id, id, type, score): the best type, the first by name of equal ones, or unknown below the page's floor."""
    best = F.array_min(F.transform("each", lambda s: F.struct((-F.round(s["score"], 9)).alias("order"), s["type"].alias("type"), s["score"].alias("score"))))
    top = _scored(features).select("doc_id", "id", best.alias("b")).select("doc_id", "id", "b.type", "b.score")
    floor = F.greatest(F.lit(FLOOR), F.median("score").over(Window.partitionBy("doc_id")) * FLOOR_SHARE)
    return top.withColumn("_floor", floor).select("doc_id", "id", F.when(F.col("score") < F.col("_floor"), "unknown").otherwise(F.col("type")).alias("type"), "score")


def propagate(children: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """(keys, mean, variance, n): weighted mean and population variance of the children's means; equal weights where none is positive."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    share = F.when(total > 0, weight / total).otherwise(1 / F.count("*").over(Window.partitionBy(*keys)))
    w = children.withColumn("_w", share)
    m = w.groupBy(*keys).agg(F.sum(F.col("mean") * F.col("_w")).alias("_m"))
    return w.join(m, keys).groupBy(*keys, "_m").agg(F.sum((F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m")) * F.col("_w")).alias("variance"), F.count("*").alias("n")).withColumnRenamed("_m", "mean")
