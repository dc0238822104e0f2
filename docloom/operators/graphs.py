"""Validators and repair of node and edge tables. A violation is a row; a valid graph gives none."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.cut import cut

KINDS = ("CONTAINS", "CHILD_OF", "ADJACENT", "ALIGNED_HORIZONTAL", "ALIGNED_VERTICAL", "READING_NEXT", "READING_PREVIOUS")
NEAR = 1e-6


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "id").agg(F.count("*").alias("n")).filter("n > 1")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("from_id = to_id")


def unknown_kinds(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("type").isin(*KINDS))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id): ends of edges that are no node."""
    ends = edges.select("doc_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    return ends.join(nodes.select("doc_id", "id"), ["doc_id", "id"], "left_anti").distinct()


def claimed_twice(edges: DataFrame) -> DataFrame:
    """(doc_id, id, listed, owners): children that several parents claim, or one parent more than once."""
    claims = edges.filter("type = 'CONTAINS'").groupBy("doc_id", F.col("to_id").alias("id")).agg(F.count("*").alias("listed"), F.count_distinct("from_id").alias("owners"))
    return claims.filter("listed > 1")


def unending(nodes: DataFrame) -> DataFrame:
    """(doc_id, id): nodes whose chain of parents never ends, on a loop or behind one. Of a repeated id the smallest parent counts.

    Ancestors by doubling: after k rounds a row holds a node's 2^k-th ancestor, and nodes whose chain has ended are gone. Ids of a document
    outnumber any chain without a loop, so what is left once 2^k exceeds them never ends: log2 of the depth in rounds, and two of them where all is well."""
    up = nodes.groupBy("doc_id", "id").agg(F.min("parent").alias("to"))
    most = up.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, length = cut(up.filter("to IS NOT NULL")), 1
    while length <= most and not jumps.isEmpty():
        on = jumps.select("doc_id", F.col("id").alias("to"), F.col("to").alias("_on"))
        jumps, length = cut(jumps.join(on, ["doc_id", "to"]).select("doc_id", "id", F.col("_on").alias("to"))), 2 * length
    return jumps.select("doc_id", "id")


def several_parents(edges: DataFrame) -> DataFrame:
    return edges.filter("type = 'CONTAINS'").groupBy("doc_id", F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("n")).filter("n > 1")


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's page and box. Of a repeated id the row with the largest box counts, then the first by page and place, however rows are dealt."""
    parts = ("page", "x", "y", "width", "height")
    best = F.min_by(F.struct(*parts), F.struct(-F.col("width") * F.col("height"), *parts))
    up = nodes.groupBy("doc_id", F.col("id").alias("parent")).agg(best.alias("p")).select("doc_id", "parent", *(F.col(f"p.{c}").alias(f"p_{c}") for c in parts))
    return nodes.filter("parent IS NOT NULL").join(up, ["doc_id", "parent"], "left")


def broken_chains(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, fault): parents that are no node, chains that never end, and documents that have not exactly one root."""
    roots = nodes.groupBy("doc_id").agg(F.count_if(F.col("parent").isNull()).alias("n")).filter("n <> 1").select("doc_id", F.lit(None).cast("string").alias("id"), F.lit("roots").alias("fault"))
    ghosts = orphans(nodes).distinct().withColumn("fault", F.lit("unknown parent"))
    return ghosts.unionByName(unending(nodes).withColumn("fault", F.lit("unending"))).unionByName(roots)


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is no node."""
    return nodes.filter("parent IS NOT NULL").join(nodes.select("doc_id", F.col("id").alias("parent")), ["doc_id", "parent"], "left_anti").select("doc_id", "id")


def outside_parent(nodes: DataFrame) -> DataFrame:
    """Nodes whose box leaves their parent's."""
    left, top = F.col("p_x") <= F.col("x") + NEAR, F.col("p_y") <= F.col("y") + NEAR
    right = F.col("p_x") + F.col("p_width") >= F.col("x") + F.col("width") - NEAR
    bottom = F.col("p_y") + F.col("p_height") >= F.col("y") + F.col("height") - NEAR
    return _with_parent(nodes).filter(~(left & top & right & bottom)).select("doc_id", "id")


def off_page(nodes: DataFrame) -> DataFrame:
    """Nodes on another page than their parent."""
    return _with_parent(nodes).filter(F.col("p_page") != F.col("page")).select("doc_id", "id")


def unmirrored(edges: DataFrame) -> DataFrame:
    """READING_NEXT edges without their READING_PREVIOUS, and the other way."""
    kind = lambda k: edges.filter(F.col("type") == k).select("type", "doc_id", "from_id", "to_id").distinct()
    back = lambda df: df.select("doc_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    ahead, behind = kind("READING_NEXT"), kind("READING_PREVIOUS")
    on = ["doc_id", "from_id", "to_id"]
    one = ahead.join(back(behind), on, "left_anti").select("type", *on)
    return one.unionByName(behind.join(back(ahead), on, "left_anti").select("type", *on))


def several_neighbours(edges: DataFrame, side: str) -> DataFrame:
    """Nodes with several READING_NEXT edges out (side from_id) or in (side to_id)."""
    return edges.filter("type = 'READING_NEXT'").groupBy("doc_id", F.col(side).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("doc_id", "type", "from_id", "to_id").agg(F.count("*").alias("n")).filter("n > 1")


def reading_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, firsts, lasts, untouched): words without a predecessor, without a successor, and without either of several."""
    n = edges.filter("type = 'READING_NEXT'")
    words = nodes.filter("level = 'word'").select("doc_id", "id").distinct()
    out = n.select("doc_id", F.col("from_id").alias("id"), F.lit(True).alias("out")).distinct()
    into = n.select("doc_id", F.col("to_id").alias("id"), F.lit(True).alias("into")).distinct()
    w = words.join(out, ["doc_id", "id"], "left").join(into, ["doc_id", "id"], "left")
    return w.groupBy("doc_id").agg(
        F.count_if(F.col("into").isNull()).alias("firsts"), F.count_if(F.col("out").isNull()).alias("lasts"), F.when(F.count("*") > 1, F.count_if(F.col("into").isNull() & F.col("out").isNull())).otherwise(0).alias("untouched")
    )


def wrong_topology(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """READING_NEXT edges that don't join two words."""
    words = nodes.filter("level = 'word'").select("doc_id", "id").distinct()
    n = edges.filter("type = 'READING_NEXT'").select("doc_id", "from_id", "to_id").distinct()
    good = n.join(words.withColumnRenamed("id", "from_id"), ["doc_id", "from_id"], "left_semi").join(words.withColumnRenamed("id", "to_id"), ["doc_id", "to_id"], "left_semi")
    return n.join(good, ["doc_id", "from_id", "to_id"], "left_anti")


def dedupe(edges: DataFrame) -> DataFrame:
    """The first of equal edges, in order."""
    first = Window.partitionBy("doc_id", "type", "from_id", "to_id").orderBy("ord")
    return edges.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def best_parents(edges: DataFrame) -> DataFrame:
    """CONTAINS edges with one parent a child: the most confident one, then the earliest."""
    best = Window.partitionBy("doc_id", "to_id").orderBy(F.desc("score"), "ord")
    return edges.filter("type = 'CONTAINS'").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def universe_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, id, side): nodes of one table only."""
    ids = ["doc_id", "id"]
    return a.select(*ids).exceptAll(b.select(*ids)).withColumn("side", F.lit("left")).unionByName(b.select(*ids).exceptAll(a.select(*ids)).withColumn("side", F.lit("right")))


def _peel(ids: list[str], edges: list[tuple]) -> dict[str, int]:
    """Round in which each node is peeled: one after the last of its predecessors. Nodes on or behind a cycle have none."""
    waits: dict[str, int] = dict.fromkeys(ids, 0)
    after = defaultdict(list)
    for a, b, *_ in edges:
        waits.setdefault(a, 0)
        waits[b] = waits.get(b, 0) + 1
        after[a].append(b)
    rounds = {x: 0 for x, n in waits.items() if n == 0}
    queue = list(rounds)
    for x in queue:
        for y in after[x]:
            waits[y] -= 1
            if waits[y] == 0:
                rounds[y] = rounds[x] + 1
                queue.append(y)
    return rounds


def _of_documents(edges: DataFrame, columns: list[str], kind: pa.DataType, sql: str, one) -> DataFrame:
    """(doc_id, fields of the struct `kind`): one(rows of `columns`) of every document, whose edges are gathered by Spark; many documents pass to Python in a batch."""

    @F.arrow_udf(f"array<{sql}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, flat = batch.value_lengths().to_pylist(), batch.flatten()
            rows = list(zip(*(flat.field(c).to_pylist() for c in columns), strict=True))
            out, at = [], 0
            for n in sizes:
                out.append(one(rows[at : at + n]))
                at += n
            found = list(zip(*(x for o in out for x in o), strict=True)) or [()] * kind.num_fields
            parts = pa.StructArray.from_arrays([pa.array(v, type=kind.field(k).type) for k, v in enumerate(found)], fields=[kind.field(k) for k in range(kind.num_fields)])
            yield pa.ListArray.from_arrays(pa.array(list(accumulate((len(o) for o in out), initial=0)), type=pa.int32()), parts)

    held = edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_e"))
    return held.select("doc_id", F.explode(run("_e")).alias("_x")).select("doc_id", "_x.*")


def ordered(edges: DataFrame) -> DataFrame:
    """(doc_id, id, round): topological rounds of a document's edges; null on or behind a cycle.

    Chains are as long as documents, so rounds of joins would be too: a document's edges are peeled in one pass
    over them, in the task of their document, and a page is a document's usual size.
    """

    def one(rows: list[tuple]) -> list[tuple]:
        rounds = _peel([], rows)
        return [(x, rounds.get(x)) for x in sorted({x for r in rows for x in r})]

    return _of_documents(edges, ["from_id", "to_id"], pa.struct([("id", pa.string()), ("round", pa.int32())]), "struct<id:string,round:int>", one)


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on or behind a cycle."""
    return ordered(edges).filter("round IS NULL").select("doc_id", "id")


def _weakest(rows: list[tuple], place: dict[str, int]) -> list[tuple]:
    """Edges that are taken out one by one until no cycle is left: of those among nodes on or behind a cycle the least confident, then one that leads back, then the first.

    Taking an edge out only lets more nodes be peeled, so the peeling goes on from where it stood, and an edge that was passed over
    because an end was peeled is never open again: each edge is looked at once, in order of what is taken first."""
    back = lambda r: r[0] in place and r[1] in place and place[r[0]] >= place[r[1]]
    waits: dict[str, int] = {}
    after = defaultdict(list)
    for a, b, *_ in rows:
        waits.setdefault(a, 0)
        waits[b] = waits.get(b, 0) + 1
        after[a].append(b)
    peeled: set[str] = set()

    def peel(queue: list[str]) -> None:
        peeled.update(queue)
        for x in queue:
            for y in after[x]:
                waits[y] -= 1
                if waits[y] == 0 and y not in peeled:
                    peeled.add(y)
                    queue.append(y)

    peel([x for x, n in waits.items() if n == 0])
    out = []
    for r in sorted(rows, key=lambda r: (r[2], not back(r), r[3])):
        a, b = r[:2]
        if a not in peeled and b not in peeled:
            out.append(r)
            after[a].remove(b)
            waits[b] -= 1
            if waits[b] == 0:
                peel([b])
    return out


def cycle_breakers(edges: DataFrame, place: Column) -> DataFrame:
    """(doc_id, from_id, to_id, ord): the edges whose removal leaves no cycle. place: position of from_id in the document."""

    def one(rows: list[tuple]) -> list[tuple]:
        out = _weakest([r[:4] for r in rows], {r[0]: r[4] for r in sorted(rows, key=lambda r: r[3]) if r[4] is not None})
        return [(r[0], r[1], r[3]) for r in out]

    wanted = edges.select("doc_id", "from_id", "to_id", "score", "ord", place.alias("place"))
    kind = pa.struct([("from_id", pa.string()), ("to_id", pa.string()), ("ord", pa.int32())])
    return _of_documents(wanted, ["from_id", "to_id", "score", "ord", "place"], kind, "struct<from_id:string,to_id:string,ord:int>", one)


def unrepairable(nodes: DataFrame, edges: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, reason): documents that no repair mends: ends of edges that are no node, words without a node, confidences that are no number from 0 to 1."""
    bad = nodes.filter(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1))
    parts = [dangling(edges, nodes).select("doc_id", F.lit("universe").alias("reason")), uncovered(words, nodes).select("doc_id", F.lit("coverage").alias("reason")), bad.select("doc_id", F.lit("confidence").alias("reason"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def repairs(edges: DataFrame, place: Column) -> DataFrame:
    """(doc_id, action, type, from_id, to_id, ord): what a repair takes out, in its order: repeated edges, containment cycles, parents beyond the best, reading cycles with their mirrors.

    edges: doc_id, type, from_id, to_id, score, ord. Documents are repaired each by itself."""
    once = cut(dedupe(edges))
    took = lambda df, action: df.select("doc_id", F.lit(action).alias("action"), "type", "from_id", "to_id", "ord")
    key = ["doc_id", "from_id", "to_id", "ord"]
    repeated = took(edges.join(once.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti"), "duplicate")
    contains, ahead = once.filter("type = 'CONTAINS'"), once.filter("type = 'READING_NEXT'")
    rings = cut(cycle_breakers(contains, F.lit(None).cast("int")))
    held = contains.join(rings, key, "left_anti")
    parents = held.join(best_parents(held).select("doc_id", "ord"), ["doc_id", "ord"], "left_anti")
    turns = cut(cycle_breakers(ahead, place))
    mirrors = once.filter("type = 'READING_PREVIOUS'").join(turns.select("doc_id", F.col("from_id").alias("to_id"), F.col("to_id").alias("from_id")), ["doc_id", "from_id", "to_id"], "left_semi")
    out = repeated.unionByName(took(rings.withColumn("type", F.lit("CONTAINS")), "containment")).unionByName(took(parents, "parent"))
    return out.unionByName(took(turns.withColumn("type", F.lit("READING_NEXT")), "reading")).unionByName(took(mirrors, "mirror"))


def uncovered(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id): words of the source that are no word node."""
    return words.select("doc_id", "id").join(nodes.filter("level = 'word'").select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def unread(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id): words of documents of several words that no reading edge touches."""
    words = nodes.filter("level = 'word'").select("doc_id", "id").distinct()
    several = words.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    ends = edges.filter(F.col("type").isin("READING_NEXT", "READING_PREVIOUS")).select("doc_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    return words.join(several, "doc_id", "left_semi").join(ends, ["doc_id", "id"], "left_anti")


def parents_of_meaning(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, id, n): nodes without exactly one containing parent, and roots with any. Repeated edges count once."""
    held = edges.filter("type = 'CONTAINS'").groupBy("doc_id", F.col("to_id").alias("id")).agg(F.count_distinct("from_id").alias("n"))
    n = nodes.select("doc_id", "id", (F.col("level") == "document").alias("top")).distinct().join(held, ["doc_id", "id"], "left").fillna(0, ["n"])
    return n.filter(F.col("n") != F.when(F.col("top"), 0).otherwise(1)).select("doc_id", "id", "n")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (rows, differing): rows of a, and rows that only one of the two has, repeated rows counted. Rows meet page by page, as arrays that are equal or are taken apart."""
    keys = ["doc_id"] if "doc_id" in a.columns else a.columns
    rest = [c for c in a.columns if c not in keys] or [F.lit(0).alias("_")]
    held = lambda df, name: df.select(*a.columns).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    both = held(a, "a").join(held(b, "b"), keys, "full")
    one, two = F.coalesce("a", F.array().cast(both.schema["a"].dataType)), F.coalesce("b", F.array().cast(both.schema["a"].dataType))
    n = lambda rows, r: F.size(F.filter(rows, lambda x: x.eqNullSafe(r)))
    apart = lambda: F.aggregate(F.array_union(one, two), F.lit(0), lambda k, r: k + F.abs(n(one, r) - n(two, r)))
    return both.agg(F.coalesce(F.sum(F.size(one)), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(one == two, 0).otherwise(apart())), F.lit(0)).cast("long").alias("differing"))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, n): how many rows each check found, in one union."""
    parts: Iterator[DataFrame] = (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in checks.items())
    out = next(parts)
    for p in parts:
        out = out.unionByName(p)
    return out
