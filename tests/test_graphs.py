"""Checks and repair of graphs against plain loops."""

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import graphs as V
from docloom.plans import layout as P

DIR = "/root/testdata/sf0.001"


def test_parent_loops_of_any_length_are_found(spark):
    rows = [(1, f"a{k}", f"a{(k + 1) % 1000}") for k in range(1000)] + [(1, "behind", "a3"), (1, "further", "behind"), (1, "root", None), (1, "child", "root"), (1, "lost", "ghost")]
    rows += [(2, "x", "y"), (2, "y", "x"), (2, "self", "self"), (2, "top", None)]
    rows += [(3, f"c{k}", f"c{k + 1}") for k in range(700)] + [(3, "c700", None)]
    rows += [(4, "twice", "top"), (4, "twice", "top"), (4, "top", None)]
    nodes = spark.createDataFrame(rows, "doc_id long, id string, parent string")
    found = {(r.doc_id, r.id) for r in V.unending(nodes).collect()}
    assert found == {(1, f"a{k}") for k in range(1000)} | {(1, "behind"), (1, "further"), (2, "x"), (2, "y"), (2, "self")}
    faults = {(r.doc_id, r.id, r.fault) for r in V.broken_chains(nodes).collect()}
    assert (1, "lost", "unknown parent") in faults and not any(d in (3, 4) for d, *_ in faults)
    assert V.unending(nodes.filter("false")).count() == 0


def test_children_claimed_twice(spark):
    edges = [(1, "CONTAINS", "a", "c"), (1, "CONTAINS", "b", "c"), (1, "CONTAINS", "a", "d"), (1, "CONTAINS", "a", "d"), (1, "CONTAINS", "a", "e"), (1, "NEAR", "b", "e")]
    df = spark.createDataFrame(edges, "doc_id long, type string, from_id string, to_id string")
    assert {tuple(r) for r in V.claimed_twice(df).collect()} == {(1, "c", 2, 2), (1, "d", 2, 1)}


def one_by_one(rows, place):
    """Cycles broken by starting over after every edge."""
    kept, out = sorted(rows, key=lambda r: r[3]), []
    while True:
        rounds = V._peel([], kept)
        open_ = [r for r in kept if r[0] not in rounds and r[1] not in rounds]
        if not open_:
            return out
        back = lambda r: r[0] in place and r[1] in place and place[r[0]] >= place[r[1]]
        worst = min(open_, key=lambda r: (r[2], not back(r), r[3]))
        kept.remove(worst)
        out.append(worst)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(0, 3)), max_size=30), st.booleans())
def test_cycles_are_broken_as_if_started_over_each_time(edges, placed):
    rows = [(f"n{a}", f"n{b}", s / 10, k) for k, (a, b, s) in enumerate(edges)]
    place = {f"n{k}": k for k in range(7)} if placed else {}
    assert V._weakest(rows, place) == one_by_one(rows, place)


def repaired(edges):
    """Plain repair of one document: {(action, ord)} of what goes; edges in order."""
    seen, kept, out = set(), [], []
    for e in edges:
        key = (e.type, e.from_id, e.to_id)
        if key in seen:
            out.append(("duplicate", e.ord))
        else:
            seen.add(key)
            kept.append(e)
    tuples = lambda es: [(e.from_id, e.to_id, e.score, e.ord) for e in es]
    rings = {r[3] for r in one_by_one(tuples(e for e in kept if e.type == "CONTAINS"), {})}
    out += [("containment", o) for o in rings]
    best = {}
    held = [e for e in kept if e.type == "CONTAINS" and e.ord not in rings]
    for e in held:
        if e.to_id not in best or e.score > best[e.to_id].score:
            best[e.to_id] = e
    out += [("parent", e.ord) for e in held if best[e.to_id] is not e]
    ahead = [e for e in kept if e.type == "READING_NEXT"]
    turns = one_by_one(tuples(ahead), {e.from_id: e.place for e in ahead if e.place is not None})
    out += [("reading", r[3]) for r in turns]
    back = {(r[1], r[0]) for r in turns}
    out += [("mirror", e.ord) for e in kept if e.type == "READING_PREVIOUS" and (e.from_id, e.to_id) in back]
    return sorted(out)


def test_repair_of_all_documents(spark):
    nodes, edges = P.faulty(spark, DIR)
    by, words = defaultdict(list), defaultdict(set)
    for e in edges.orderBy("doc_id", "ord").collect():
        by[e.doc_id].append(e)
    for b in P.boxes(spark, DIR).collect():
        words[b.doc_id].add(f"w-{b.line_idx}-{b.word_idx}")
    got = defaultdict(list)
    for r in P.rp_cycles(spark, DIR).collect():
        got[r.doc_id].append((r.action, r.ord))
    want = {d: repaired(es) for d, es in by.items()}
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, x in want.items() if x}
    assert {a for x in want.values() for a, _ in x} == {"duplicate", "containment", "parent", "reading", "mirror"}
    held = defaultdict(list)
    for n in nodes.collect():
        held[n.doc_id].append(n)
    verdicts = {r.doc_id: r for r in P.rp_gate(spark, DIR).collect()}
    assert set(verdicts) == set(held)
    for d, ns in held.items():
        ids, reasons = {n.id for n in ns}, set()
        if any(x not in ids for e in by[d] for x in (e.from_id, e.to_id)):
            reasons.add("universe")
        if not words[d] <= {n.id for n in ns if n.level == "word"}:
            reasons.add("coverage")
        if any(n.confidence is None or not 0 <= n.confidence <= 1 for n in ns):
            reasons.add("confidence")
        v, out = verdicts[d], want.get(d, [])
        assert v.reasons == ",".join(sorted(reasons))
        assert v.verdict == ("failed" if reasons else "repaired" if out else "clean")
        assert (v.edges, v.parents) == ((0, 0) if reasons else (sum(a != "parent" for a, _ in out), sum(a == "parent" for a, _ in out)))
    assert {v.verdict for v in verdicts.values()} == {"failed", "repaired", "clean"}


def test_determinism_sees_either_side(spark):
    a = spark.createDataFrame([(1,), (2,)], "x int")
    assert V.differing(a, a.unionByName(spark.createDataFrame([(3,)], "x int"))).first() == (2, 1)
    assert V.differing(a, a.filter("x = 1")).first() == (2, 1) and V.differing(a, a.select(F.col("x"))).first() == (2, 0)
