"""Substring dedup by collinear chaining: fuzzy passages that documents share.

Seeds: every text's word k-mers are hashed and the minimizer of each window of W k-mers is kept, so two texts
that share K + W - 1 words in a row share a seed; long stretches of one repeated block have seeds of their own.
Minimizers of LONG words in windows of LONG_W are seeds too: any LEAST_WORDS words in a row hold one, and its
first holder has those LONG words in that order, even where each line of them was first seen in another document.
A seed's occurrences are linked to its first one (smallest document, then position): as many links as
occurrences, whatever a seed's frequency. The first occurrences are found by a pre-aggregated minimum and joined
back; seeds that hold more than a thousandth of all occurrences, at most a thousand of them, are broadcast, so
a seed in a third of all documents stays where its rows are.

Runs: the first holder of a long seed may hold fewer than LEAST_WORDS of the words that later ones share. So where a
long seed has three occurrences or more, each run of LEAST_WORDS words that holds it is linked to its own first
holder. Occurrences whose words around the seed agree are one in that: their runs are hashed once, and what these
meet is joined back to all of them; those inside an exact passage need no more links. So each run that an earlier document
holds lies in a passage with the first one that does, or in an exact one with another that does: the pairs of all its
holders follow from the places in these.

Chains: the links of a pair of documents are points (position here, position there), one at most for each seed
of the later document, so a pair is as large as that document. The best chains of ordered points under linear
gap costs are found by dynamic programming over the points in order, with a Fenwick tree of prefix maxima over
the other document's positions: n log n for n points.

Alignment: for each promising chain, the words around it are fetched from both documents (one join with the
texts) and aligned along the chain, with small edits; what remains is a passage with its number of matched
words. Passages of at least LEAST_WORDS words and an identity of at least LEAST_IDENTITY are returned.

What is found: every exact run of LEAST_WORDS words, whatever stands around it. Fuzzy passages need two exact seeds near each other, so LEAST_IDENTITY is what
is accepted and not what is always met: with one word in 20 replaced at even distances all are found, with one in 10 (an identity of 0.9) 67 % of those of
60 words, 81 % of 100 and 98 % of 200, with one in 8 31, 50 and 79 %, with one in 5 (0.8) none (simulated, 150 passages each).

Cases: words are those of the contract, compared with A-Z lower-cased; null, empty and short texts have no
seeds; texts of any length are read whole; passages that repeat only within one document aren't reported; rows
without a doc_id take no part; repeated rows of a doc_id count once; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, frugal, join_counted

K = 6
W = 14
#: Long seeds: LONG + LONG_W - 1 words in a row, LEAST_WORDS of them, hold one.
LONG = 30
LONG_W = 21
#: Longest block of words whose repetition has seeds of its own.
PERIODS = 8
LEAST_WORDS = 50
LEAST_IDENTITY = 0.8
#: Cost of each word that a link lies further, in either document; a link is worth K.
GAP_COST = 0.08
#: Words around a chain that are fetched for its alignment.
MARGIN = 64
#: Words that an edit may take away from or put into either side.
EDIT = 12
#: Words in a row that must agree after an edit.
AGREE = 4
#: Words between two links over which a passage still goes on.
MOST_GAP = 30
#: Least score of a chain that is aligned: two links or more. LEAST_WORDS words in a row hold three disjoint windows
#: of W k-mers, and so three seeds; a single seed is no passage.
LEAST_CHAIN = K + 1
TABLE_SIZE = 200_000
#: Rows over which the spans wanted of one document are spread.
PARTS = 1024
#: Most bytes of ids that are broadcast, to scan their texts in place; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of cut words that are given on at once.
OUT_BYTES = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class WordHashes:
    """64-bit hashes of words, each computed once for a task."""

    def __init__(self) -> None:
        self.known = _Known()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > TABLE_SIZE:
            self.known = _Known()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(hashes: np.ndarray, starts: range, n: int) -> np.ndarray:
    grams = np.zeros(n, dtype=np.uint64)
    for i in starts:
        grams = (grams ^ hashes[i : i + n]) * _MIX
        grams ^= grams >> np.uint64(29)
    return grams


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    return _mixed(hashes, range(k), len(hashes) - k + 1)


def minimizers(hashes: np.ndarray, k: int = K, w: int = W, stride: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer hash, position) of each window's smallest k-mer, the last one of equals. With a stride that divides k,
    a k-mer's hash is made from those of the k-mers of that many words in it."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    parts, starts = (hashes, range(k)) if stride is None else (_grams(hashes, stride), range(0, k, stride))
    grams = _mixed(parts, starts, n)
    # Equal k-mers are told apart by their place, the later one being smaller, so that a window chooses one.
    ranked = (grams & ~_LOW) | (_LOW - (np.arange(n, dtype=np.uint64) & _LOW))
    least = _slide(ranked, min(w, n), np.minimum)
    # A k-mer is the smallest of some window that holds it if it is as small as the largest of those windows' minima.
    most = _slide(np.concatenate([np.zeros(min(w, n) - 1, dtype=np.uint64), least, np.zeros(min(w, n) - 1, dtype=np.uint64)]), min(w, n), np.maximum)
    at = np.flatnonzero(most == ranked)
    return grams[at], at


_LOW = np.uint64(0xFFF)


def _slide(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every window of w, by doubling."""
    size = 1
    while 2 * size <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def periodic_seeds(hashes: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Two seeds for each stretch of `least` words or more that repeat a block of at most PERIODS words.

    All k-mers of such a stretch are alike, and the first text that holds one may hold only a short stretch.
    These seeds are shared by long stretches of the same block alone, wherever in the block they begin.
    """
    import xxhash

    out = []
    for p in range(1, min(PERIODS, len(hashes) - 1) + 1):
        same = np.concatenate([[False], hashes[p:] == hashes[:-p], [False]])
        if same.sum() + p < least:
            continue
        starts, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            block = hashes[a : a + p].tolist()
            if b - a + p < least or any(p % q == 0 and block == block[:q] * (p // q) for q in range(1, p)):
                continue
            turn = min(range(p), key=lambda t: block[t:] + block[:t])
            name = np.array(block[turn:] + block[:turn], dtype=np.uint64).tobytes()
            out += [(xxhash.xxh64_intdigest(name, k + 1), a + turn + k * p * -(-K // p)) for k in range(2)]
    return out


def seeds_of(hashes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position); the lowest bit of a seed tells the long ones."""
    grams, at = minimizers(hashes, k, w)
    if extra := periodic_seeds(hashes):
        grams = np.concatenate([grams, np.array([g for g, _ in extra], dtype=np.uint64)])
        at = np.concatenate([at, [x for _, x in extra]])
    grams = grams & ~np.uint64(1)
    if len(hashes) >= LONG:
        far, place = minimizers(hashes, LONG, LONG_W, stride=k)
        grams, at = np.concatenate([grams, far | np.uint64(1)]), np.concatenate([at, place])
    return grams, at


def seeds(text: Column, k: int = K, w: int = W) -> Column:
    """Column of arrays (seed, pos)."""

    @F.arrow_udf("array<struct<seed:long,pos:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hash_words = WordHashes()
        for batch in batches:
            found = [seeds_of(hash_words(words_of(x.as_py() or b"")), k, w) for x in batch.cast(pa.binary())]
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
            grams = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.uint64)
            at = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.int64)
            flat = pa.StructArray.from_arrays([pa.array(grams.view(np.int64)), pa.array(at.astype(np.int32))], names=["seed", "pos"])
            yield pa.ListArray.from_arrays(pa.array(offsets), flat)

    return run(text)


class PrefixMaximum:
    """Fenwick tree over ranks 0..n-1: the largest (value, item) among ranks below a bound."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, rank: int, value: float, item: int) -> None:
        at, n = rank + 1, len(self.best)
        while at < n:
            if value > self.best[at][0]:
                self.best[at] = (value, item)
            at += at & -at

    def below(self, rank: int) -> tuple[float, int]:
        at, found = rank, (float("-inf"), -1)
        while at > 0:
            if self.best[at][0] > found[0]:
                found = self.best[at]
            at -= at & -at
        return found


def best_chains(points: list[tuple[int, int]], k: int = K, gap_cost: float = GAP_COST) -> list[tuple[float, list[tuple[int, int]]]]:
    """Chains of points that grow in both coordinates, by falling score; each point is in one at most.

    A chain's score is k for each point less gap_cost for each step between neighbours in either coordinate.
    """
    points = sorted(set(points))
    ys = sorted({y for _, y in points})
    tree = PrefixMaximum(len(ys))
    score, before = [0.0] * len(points), [-1] * len(points)
    i = 0
    while i < len(points):
        j = i
        while j < len(points) and points[j][0] == points[i][0]:  # points of one x can't follow each other
            x, y = points[j]
            value, item = tree.below(bisect_left(ys, y))
            gain = value - gap_cost * (x + y)
            score[j] = k + max(0.0, gain)
            before[j] = item if gain > 0 else -1
            j += 1
        for p in range(i, j):
            x, y = points[p]
            tree.put(bisect_left(ys, y), score[p] + gap_cost * (x + y), p)
        i = j
    used = [False] * len(points)
    out = []
    for end in sorted(range(len(points)), key=lambda p: (-score[p], p)):
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(points[at])
            at = before[at]
        if chain:
            out.append((score[end] - (score[at] if at >= 0 else 0.0), chain[::-1]))
    return out


CHAIN = "array<struct<xs:array<int>,ys:array<int>>>"


def ends(points: list[dict], k: int = K) -> list[tuple[int, int]]:
    """(pos, other_pos) of all points; a long seed is a point at either end."""
    shift = LONG - k
    return [(p["pos"] + d, p["other_pos"] + d) for p in points for d in ((0, shift) if p["long"] else (0,))]


def chain(points: Column, least: float = LEAST_CHAIN) -> Column:
    """Column of the chains of score `least` or more of an array of (pos, other_pos, long)."""

    @F.arrow_udf(CHAIN)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32()))]))
        for batch in batches:
            out = []
            for row in batch:
                found = best_chains(ends(row.as_py() or []))
                out.append([{"xs": [x for x, _ in c], "ys": [y for _, y in c]} for s, c in found if s >= least])
            yield pa.array(out, type=kind)

    return run(points)


WINDOWS = "doc_id long, other_id long, n int, side int, start int, words string"


def windows(wanted: DataFrame, margin: int = MARGIN) -> DataFrame:
    """From (text, rows of (of, span)): a row for each span, with the words of it and `margin` around it.

    Rows are given on as they are cut, OUT_BYTES at a time, so a task holds one text and one such batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "other_id", "n", "side", "start", "words")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        out: list[list] = [[] for _ in names]
        size = 0

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)]
            columns[-1] = columns[-1].cast(pa.string())
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=list(names))

        for batch in batches:
            for text, rows in zip(batch.column("text").cast(pa.binary()), batch.column("rows"), strict=True):
                words = words_of(text.as_py() or b"")
                for row in rows.as_py():
                    start = max(0, row["span"]["from"] - margin)
                    cut = b" ".join(words[start : row["span"]["to"] + margin])
                    for c, v in zip(out, (*(row["of"][n] for n in names[:4]), start, cut), strict=True):
                        c.append(v)
                    size += len(cut)
                    if size > OUT_BYTES:
                        yield emit()
                        size = 0
        if out[0]:
            yield emit()

    return wanted.select("text", "rows").mapInArrow(run, WINDOWS)


def _spots(own: DataFrame, spots: DataFrame, cut: Callable[[list[bytes], dict], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `cut` makes from the words of a document and each of its spots (doc_id, seed, pos, ...)."""
    names = [c for c in spots.columns if c != "doc_id"]
    wanted = spots.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("spots"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, of in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), batch.column("spots"), strict=True):
                words = words_of(text.as_py() or b"")
                rows = [(doc.as_py(), *made) for spot in of.as_py() for made in cut(words, spot)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return own.join(wanted, "doc_id").select("doc_id", "text", "spots").mapInArrow(run, schema)


def _signed(hashed: int) -> int:
    return hashed - (1 << 64) if hashed >> 63 else hashed


def _around(least: int) -> Callable[[list[bytes], dict], Iterator[tuple]]:
    def cut(words: list[bytes], spot: dict) -> Iterator[tuple]:
        """(seed, pos, around): digest of all words of runs that hold the seed, and of its place among them."""
        import xxhash

        begin = max(0, spot["pos"] - (least - LONG))
        yield spot["seed"], spot["pos"], _signed(xxhash.xxh64_intdigest(b" ".join(words[begin : spot["pos"] + least]), spot["pos"] - begin))

    return cut


def _runs(least: int) -> Callable[[list[bytes], dict], Iterator[tuple]]:
    def cut(words: list[bytes], spot: dict) -> Iterator[tuple]:
        """(seed, around, start, ahead, run): where a run that holds the seed starts, the words from there to the seed, its digest."""
        import xxhash

        pos = spot["pos"]
        for start in range(max(0, pos - (least - LONG)), min(pos, len(words) - least) + 1):
            yield spot["seed"], spot["around"], start, pos - start, _signed(xxhash.xxh64_intdigest(b" ".join(words[start : start + least])))

    return cut


def run_links(some: DataFrame, spots: DataFrame, least: int) -> DataFrame:
    """(doc_id, other_id, pos, other_pos, n): runs of n = `least` words around the spots (doc_id, seed, pos) of long seeds,
    and where the first document that holds the run has it."""
    at = durable(_spots(some, spots, _around(least), "doc_id long, seed long, pos long, around long"), "run-spots")
    one = durable(at.groupBy("seed", "around").agg(F.min(F.struct("doc_id", "pos")).alias("one"), F.count("*").alias("n")), "run-ones")
    # Where all words around a seed agree, its first holder is that of its runs.
    one = one.join(one.groupBy("seed").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "seed")
    runs = durable(_spots(some, one.select("one.doc_id", "seed", "one.pos", "around"), _runs(least), "doc_id long, seed long, around long, start long, ahead long, run long"), "runs")
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    met = runs.join(first, "run").select("seed", "around", "ahead", F.col("first.doc_id").alias("other_id"), (F.col("first.start") + F.col("ahead")).alias("other_pos"))
    # Of the runs around one seed that meet the same place, one is enough: alignment finds the others.
    met = met.groupBy("seed", "around", "other_id", "other_pos").agg(F.max("ahead").alias("ahead"))
    met = met.groupBy("seed", "around").agg(F.collect_list(F.struct("other_id", "other_pos", "ahead")).alias("met"))
    met = durable(met.join(one.select("seed", "around", "n"), ["seed", "around"]).select(F.struct("seed", "around").alias("spot"), "met", "n"), "runs-met")
    links = join_counted(at.select("doc_id", "pos", F.struct("seed", "around").alias("spot")), met, "spot")
    links = links.select("doc_id", "pos", F.inline("met")).filter("doc_id <> other_id")
    return links.select("doc_id", "other_id", (F.col("pos") - F.col("ahead")).alias("pos"), (F.col("other_pos") - F.col("ahead")).alias("other_pos"), F.lit(least).alias("n")).distinct()


def _outside(places: DataFrame, found: DataFrame, keys: list[str], begin: Column, end: Column) -> DataFrame:
    """The places whose words from begin to end lie in none of the passages found for their keys."""
    spans = found.groupBy(*keys).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["start_word"] <= begin) & (end <= s["end_word"]))
    return places.join(spans, keys, "left").filter(~F.coalesce(inside, F.lit(False))).drop("spans")


def uncovered(links: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Chains of the links (doc_id, other_id, pos, other_pos, n) of n equal words that lie in no passage found for their
    pair of documents, one for each distance between the places."""
    # A document that repeats what it shares is linked from its first place.
    once = links.groupBy("doc_id", "other_id", "other_pos", "n").agg(F.min("pos").alias("pos"))
    left = _outside(once, found, ["doc_id", "other_id"], F.col("pos"), F.col("pos") + F.col("n"))
    # Both ends of each link.
    ends = F.flatten(F.collect_set(F.array(F.col("pos"), F.col("pos") + F.col("n") - k)))
    lines = left.groupBy("doc_id", "other_id", (F.col("other_pos") - F.col("pos")).alias("by")).agg(F.array_sort(F.array_distinct(ends)).cast("array<int>").alias("xs"))
    lines = lines.withColumn("ys", F.transform("xs", lambda x: (x + F.col("by")).cast("int")))
    several = lines.groupBy("doc_id", "other_id").agg(F.collect_list(F.struct("xs", "ys")).alias("c"))
    return several.select("doc_id", "other_id", F.posexplode("c").alias("n", "c")).select("doc_id", "other_id", "n", "c.xs", "c.ys")


def _of(own: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of own whose doc_id is one of ids. Ids move to the texts, unless they are too many."""
    ids = durable(ids.distinct(), "run-ids")
    return own.join(F.broadcast(ids) if ids.count() * 8 <= BROADCAST_BYTES else ids, "doc_id", "left_semi")


#: Edits by size, the most even first: a replaced word is one word on both sides.
EDITS = [(s, total - s) for total in range(1, 2 * EDIT + 1) for s in sorted(range(max(0, total - EDIT), min(EDIT, total) + 1), key=lambda s, n=total: abs(2 * s - n))]
#: Words that are compared at once where texts agree.
STRETCH = 16


def _run(a: list, b: list, i: int, j: int, a_end: int, b_end: int) -> list[tuple[int, int, int]]:
    """From (i, j) on along equal words and small edits: after each stretch of agreement, the words passed on either side and how many of them matched."""
    matched = 0
    last, begin, out = (i, j), (i, j), []
    while i < a_end and j < b_end:
        if i + STRETCH <= a_end and j + STRETCH <= b_end and a[i : i + STRETCH] == b[j : j + STRETCH]:
            i, j, matched = i + STRETCH, j + STRETCH, matched + STRETCH
            last = (i, j)
            continue
        if a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
            last = (i, j)
            continue
        for s, t in EDITS:
            p, q = i + s, j + t
            if p + AGREE <= a_end and q + AGREE <= b_end and a[p] == b[q] and a[p : p + AGREE] == b[q : q + AGREE]:
                out.append((last[0] - begin[0], last[1] - begin[1], matched))
                i, j = p, q
                break
        else:
            break
    return [*out, (last[0] - begin[0], last[1] - begin[1], matched)]


def _alike(n: int, other_n: int, matched: int, least: float) -> bool:
    return matched >= least * max(n, other_n)


def _furthest(stops: list[tuple[int, int, int]], beside: tuple[int, int, int], least: float) -> tuple[int, int, int]:
    """The last of the stops that is alike enough together with what lies on the other side."""
    return next((s for s in reversed(stops) if _alike(*(x + y for x, y in zip(s, beside, strict=True)), least)), stops[0])


def _extent(back: list[tuple[int, int, int]], ahead: list[tuple[int, int, int]], least: float) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """How far a passage goes back and ahead: all the way, or where that is not alike enough as far as it is.

    The exact words next to the start are in it always."""
    if _alike(*(x + y for x, y in zip(back[-1], ahead[-1], strict=True)), least):
        return back[-1], ahead[-1]
    none = (0, 0, 0)
    far_ahead, far_back = _furthest(ahead, none, least), _furthest(back, none, least)
    ways = [(_furthest(back, far_ahead, least), far_ahead), (far_back, _furthest(ahead, far_back, least))]
    return max(ways, key=lambda w: w[0][0] + w[1][0])


def _joined(runs: list[tuple[int, int, int, int, int]], least: float) -> list[tuple[int, int, int, int, int]]:
    """Neighbouring runs as one passage, or where that is not alike enough as the longest that are."""
    one = lambda r: (r[0][0], r[-1][1], r[0][2], r[-1][3], sum(x[4] for x in r))
    alike = lambda p: _alike(p[1] - p[0], p[3] - p[2], p[4], least)
    whole = one(runs)
    if alike(whole):
        return [whole]
    out, at = [], 0
    while at < len(runs):
        found = next((n for n in range(len(runs), at + 1, -1) if alike(one(runs[at:n]))), at + 1)
        out.append(one(runs[at:found]))
        at = found
    return out


def align(a: list, b: list, xs: list[int], ys: list[int], k: int = K, least: float = LEAST_IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other_start, other_end, matched) along a chain of links between two word lists."""
    near: list[list[tuple[int, int, int, int, int]]] = []
    ra, rb = a[::-1], b[::-1]
    at = 0
    while at < len(xs):
        x, y = xs[at], ys[at]
        floor = near[-1][-1] if near else (0, 0, 0, 0, 0)
        back, ahead = _extent(_run(ra, rb, len(a) - x, len(b) - y, len(a) - floor[1], len(b) - floor[3]), _run(a, b, x, y, len(a), len(b)), least)
        here = (x - back[0], x + ahead[0], y - back[1], y + ahead[1], back[2] + ahead[2])
        if near and here[0] - floor[1] <= MOST_GAP and here[2] - floor[3] <= MOST_GAP:
            near[-1].append(here)
        else:
            near.append([here])
        # A link whose words differ (equal hashes) is no passage.
        at += 1
        while at < len(xs) and (xs[at] < here[1] or ys[at] < here[3]):
            at += 1
    return [p for runs in near for p in _joined(runs, least)]


PASSAGE = "array<struct<start_word:int,end_word:int,other_start:int,other_end:int,matched:int>>"


def _aligned(mine: Column, theirs: Column, my_start: Column, their_start: Column, xs: Column, ys: Column, least: float = LEAST_IDENTITY) -> Column:
    @F.arrow_udf(PASSAGE)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start_word", "end_word", "other_start", "other_end", "matched")]))
        for batch in batches:
            out = []
            for a, b, s, t, x, y in zip(*batch, strict=True):
                s, t = s.as_py(), t.as_py()
                found = align(a.as_py().split(" "), b.as_py().split(" "), [v - s for v in x.as_py()], [v - t for v in y.as_py()], least=least)
                out.append([{"start_word": p[0] + s, "end_word": p[1] + s, "other_start": p[2] + t, "other_end": p[3] + t, "matched": p[4]} for p in found])
            yield pa.array(out, type=kind)

    return run(mine, theirs, my_start, their_start, xs, ys)


def shared_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_identity: float = LEAST_IDENTITY, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, other_id, start_word, end_word, other_start, other_end, matched, identity): passages of a document that
    another one, of smaller id, holds too. Every document with a passage of an earlier one has a row for it."""
    own = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    every = durable(own.select("doc_id", F.explode(seeds(F.col("text"), k, w)).alias("s")).select("doc_id", "s.seed", "s.pos"), "seeds")
    first = every.groupBy("seed").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).filter(F.col("first.doc_id") < F.col("last_doc"))
    first = durable(first.select("seed", F.col("first.doc_id").alias("other_id"), F.col("first.pos").alias("other_pos"), "n"), "first-seeds")
    is_long = F.col("seed").bitwiseAND(F.lit(1)) == 1
    links = durable(join_counted(every, first.withColumn("several", is_long & (F.col("n") > 2)), "seed"), "links")
    point = F.struct("pos", "other_pos", is_long.alias("long"))
    pairs = links.filter("doc_id <> other_id").groupBy("doc_id", "other_id").agg(F.collect_set(point).alias("points"))
    # A single short seed makes no chain.
    pairs = pairs.filter((F.size("points") > 1) | F.exists("points", lambda p: p["long"]))
    chains = pairs.select("doc_id", "other_id", F.posexplode(chain(F.col("points"))).alias("n", "c")).select("doc_id", "other_id", "n", "c.xs", "c.ys")
    found = passages_of(own, durable(chains, "chains"), least_words, least_identity, k)
    if least_words < LONG + LONG_W - 1:  # a run may hold no long seed
        return found
    found = durable(found, "passages")
    # What lies in an exact passage is held by an earlier document, which stands for it; the first of all stays.
    spots = links.filter("several").select("doc_id", "seed", "pos")
    spots = durable(_outside(spots, found.filter("identity = 1"), ["doc_id"], F.greatest(F.lit(0), F.col("pos") - (least_words - LONG)), F.col("pos") + least_words), "run-open")
    some = durable(_of(own, spots.select("doc_id")), "run-texts")
    # Chains may leave out links that lie beside others: these are aligned by themselves.
    beside = links.filter(is_long & F.expr("doc_id <> other_id")).select("doc_id", "other_id", F.col("pos").cast("long").alias("pos"), F.col("other_pos").cast("long").alias("other_pos"), F.lit(LONG).alias("n"))
    more = durable(uncovered(run_links(some, spots, least_words).unionByName(beside), found, k), "run-chains")
    ends = more.select("doc_id").unionByName(more.select(F.col("other_id").alias("doc_id")))
    return found.unionByName(passages_of(_of(own, ends), more, least_words, least_identity, k)).distinct()


def passages_of(own: DataFrame, chains: DataFrame, least_words: int, least_identity: float, k: int) -> DataFrame:
    """The passages along chains (doc_id, other_id, n, xs, ys) of own (doc_id, text)."""
    span = lambda at: F.struct(F.element_at(at, 1).alias("from"), (F.element_at(at, -1) + k).alias("to"))
    here = chains.select(F.col("doc_id").alias("at_id"), F.struct("doc_id", "other_id", "n", F.lit(0).alias("side")).alias("of"), span(F.col("xs")).alias("span"))
    there = chains.select(F.col("other_id").alias("at_id"), F.struct("doc_id", "other_id", "n", F.lit(1).alias("side")).alias("of"), span(F.col("ys")).alias("span"))
    wanted = here.unionByName(there)
    # One row a document and bucket of its spans: a document that many others repeat is fetched in parts.
    wanted = wanted.groupBy("at_id", F.pmod(F.xxhash64("of"), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct("of", "span")).alias("rows"))
    cut = windows(wanted.join(own, F.col("at_id") == own["doc_id"]))
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    both = cut.groupBy("doc_id", "other_id", "n").agg(side(0, "start").alias("s"), side(0, "words").alias("a"), side(1, "start").alias("t"), side(1, "words").alias("b"))
    both = both.join(chains, ["doc_id", "other_id", "n"])
    found = both.select("doc_id", "other_id", F.explode(_aligned(*(F.col(c) for c in ("a", "b", "s", "t", "xs", "ys")), least_identity)).alias("p")).select("doc_id", "other_id", "p.*").distinct()
    identity = F.col("matched") / F.greatest(F.col("end_word") - F.col("start_word"), F.col("other_end") - F.col("other_start"))
    return found.withColumn("identity", identity).filter((F.col("end_word") - F.col("start_word") >= least_words) & (F.col("identity") >= least_identity))
