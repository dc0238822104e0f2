"""Search, near-duplicates, components and passages against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import knn, passages, simhash
from docloom.llm.components import components

DOC = "doc_id long, text string"


def union_find(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == union_find({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("difference", [1, 2, 3])
def test_near_duplicates_are_whatever_brute_force_links(spark, difference):
    rnd = random.Random(4)
    prints = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        prints.add(x)
        for _ in range(rnd.randint(0, 12)):  # walks of one to three bits
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    hub = rnd.getrandbits(64)
    prints |= {hub ^ (1 << k) ^ (1 << j) for k in range(20) for j in range(20)}  # one key for many
    signed = [simhash._signed(x) for x in sorted(prints)]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = [(r.u, r.v) for r in simhash.links(distinct, difference).collect()]
    every = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= difference]
    assert sorted(found) == sorted(every)


def test_fingerprints_and_odd_rows(spark):
    import xxhash

    assert simhash.fingerprint_of(b"") == simhash.fingerprint_of(b" \n\t ") == 0
    assert simhash.fingerprint_of(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint_of("É a b".encode()) == xxhash.xxh64_intdigest("É a b".encode(), 42)
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (7, "A B c\nd"), (None, "x y z"), (9, "w " * 30000)]
    df = spark.createDataFrame(rows, DOC).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    found = sorted(simhash.near_duplicates(df).collect(), key=str)
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[1].component_id == by[2].component_id == 1 and by[1].fp == 0
    assert by[3].component_id == by[7].component_id == 3 and by[None].component_id is None
    assert simhash.near_duplicates(df.filter("false")).count() == 0


def shingle_sets(texts):
    grams = lambda w: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return {k: grams((v or "").lower().encode().split()) for k, v in texts.items()}


def similar_sets(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_stage_keeps_one_document_of_what_brute_force_jaccard_links(spark):
    import corpus_pipeline

    rnd = random.Random(12)
    texts = {}
    for _ in range(60):
        base = prose(rnd, rnd.choice([4, 5, 9, 20, 60, 150, 400]))
        for _ in range(rnd.randint(1, 5)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = "changed"
            base = copy if rnd.random() < 0.4 else base  # chains of copies as well as stars
            texts[len(texts)] = " ".join(copy)
    group = prose(rnd, 80)
    for _ in range(60):  # one large group; some of its members are far from each other
        texts[len(texts)] = " ".join(group[: rnd.randint(60, 80)])
    line = prose(rnd, 10)
    for k in range(40):  # a common line in short texts
        texts[len(texts)] = " ".join(line + prose(rnd, rnd.randint(1, 6)))
    texts |= {500: None, 501: "", 502: "One two", 503: "one  TWO"}
    sets = shingle_sets(texts)
    edges = [(a, b) for a in texts for b in texts if a < b and similar_sets(sets[a], sets[b])]
    assert sum(sets[a] != sets[b] for a, b in edges) > 100
    rows = [(k, v, "en", "s", 1) for k, v in texts.items()] + [(None, "a", "en", "s", 1)] * 2 + [(7, texts[7], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([*set(union_find(texts, edges).values()), None, None], key=str)


def test_query_equals_brute_force(spark, small):
    from docloom.llm.common import read
    from docloom.llm.queries import op3_simhash

    texts = dict(read(spark, small, "documents").select("doc_id", "text").collect())
    prints = {k: simhash.fingerprint_of(v.encode()) for k, v in texts.items()}
    edges = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    root = union_find(prints, edges)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash(spark, small).collect()} == {k: (f"{prints[k]:016x}", root[k]) for k in texts}


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_top_k_equals_brute_force(spark, spread):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 8))
    rows = [(int(k), [float(x) for x in centres[k % 6] + spread * rnd.normal(size=8)]) for k in range(900)]
    rows += [(5000 + k, [0.5] * 8) for k in range(300)]  # one very common vector
    rows += [(9000, None), (9100, [float("nan")] * 8), (9200, [None] + [1.0] * 7), (9300, [1.0, 2.0]), (9400, []), (9500, [float("inf")] * 8)]
    rows += [(100, rows[100][1])] * 14 + [(200, rows[7][1]), (777, rows[777][1]), (None, rows[0][1])]  # repeated ids, with equal and other vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(3)).withColumn("row", F.lit(1)).withColumn("cell", F.lit(1))
    found = {}
    for r in knn.top_k(df, F.col("id") % 100 == 0, pivots=7, block_rows=50, query_rows=3).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r["id"], r.score))
    usable = [(k, np.floor(np.array(v + [0.0] * (8 - len(v))) * 1024).astype(np.int64)) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for own, (q, v) in enumerate(usable):
        if q % 100 == 0:
            best = sorted((-int(v @ c), k) for at, (k, c) in enumerate(usable) if at != own)[:10]
            want.setdefault(q, []).extend((n + 1, k, -s) for n, (s, k) in enumerate(best))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert knn.top_k(df.filter("false"), F.col("id") % 100 == 0).count() == 0
    assert knn.top_k(df.filter("vec_id = 1"), F.col("id") % 100 == 0).count() == 0


def test_bounds_hold_and_prune_clustered_vectors(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16))
    rows = [(int(k), [float(x) for x in centres[k % 40] * (1 + k % 3) + 0.05 * rnd.normal(size=16)]) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, pairs, every = knn.searched(df, F.col("id") % 50 == 0)
    assert pairs.count() < 0.2 * every
    v = np.floor(np.array([x for _, x in rows]) * 1024).astype(np.int64)
    scores = v @ v.T
    np.fill_diagonal(scores, -(2**62))
    want = {(q, n + 1, int(k), int(scores[q, k])) for q in range(0, 4000, 50) for n, k in enumerate(np.lexsort((np.arange(4000), -scores[q]))[:10])}
    assert {(r.query_id, r["rank"], r["id"], r.score) for r in found.collect()} == want


def chain_scores(points, k, cost):
    points = sorted(set(points))
    best = []
    for i, (x, y) in enumerate(points):
        best.append(k + max([0.0] + [best[j] - cost * (x - a + y - b) for j, (a, b) in enumerate(points[:i]) if a < x and b < y]))
    return max(best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=30))
def test_best_chain_has_the_best_score(points):
    found = passages.best_chains(points, k=6, gap_cost=0.15)
    assert found[0][0] == pytest.approx(chain_scores(points, 6, 0.15))
    assert sorted(p for _, c in found for p in c) == sorted(set(points))
    assert all(a[0] < b[0] and a[1] < b[1] for _, c in found for a, b in zip(c, c[1:], strict=False))


def prose(rnd, n):
    return [rnd.choice("abcdefghij") + str(rnd.randrange(3000)) for _ in range(n)]


def test_planted_passages_are_found(spark):
    rnd = random.Random(9)
    exact, fuzzy = prose(rnd, 60), prose(rnd, 120)
    docs = {k: prose(rnd, 200) for k in range(30)}
    for k in (3, 11, 20):
        docs[k] = docs[k][:50] + exact + docs[k][50:]
    for k in (5, 17):
        edited = list(fuzzy)
        if k == 17:
            for at in (30, 61, 95):
                edited[at] = "changed"
            del edited[75]
        docs[k] = docs[k][:20] + edited + docs[k][20:]
    docs[25] = docs[4] + ["tail"]  # a near copy
    docs[26] = docs[6][:40] + prose(rnd, 100)  # too short to count
    rows = [(k, " ".join(v)) for k, v in docs.items()] + [(40, None), (41, ""), (None, " ".join(exact)), (42, "x " * 500), (43, "x " * 500), (3, " ".join(docs[3]))]
    df = spark.createDataFrame(rows, DOC).withColumn("seed", F.lit(0)).withColumn("pos", F.lit(0))
    found = passages.shared_passages(df).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert pairs == {(11, 3), (20, 3), (17, 5), (25, 4), (43, 42)}
    by = {(r.doc_id, r.other_id): r for r in found}
    assert (by[11, 3].start_word, by[11, 3].end_word, by[11, 3].identity) == (50, 110, 1.0)
    assert by[17, 5].end_word - by[17, 5].start_word >= 115 and by[17, 5].matched == 116
    assert passages.shared_passages(df.filter("false")).count() == 0


def test_every_document_with_50_words_of_an_earlier_one_is_found(spark, small):
    from docloom.llm.common import read
    from docloom.llm.queries import op8_passages

    texts = dict(read(spark, small, "documents").select("doc_id", "text").collect())
    first, need = {}, set()
    for k in sorted(texts):
        words = texts[k].lower().encode().split()
        own = {tuple(words[j : j + 50]) for j in range(len(words) - 49)}
        if any(g in first for g in own):
            need.add(k)
        for g in own:
            first.setdefault(g, k)
    assert need <= {r.doc_id for r in op8_passages(spark, small).collect()}


def test_fingerprints_of_similar_sets_lie_within_the_bound():
    from docloom.llm import shingles

    rnd = np.random.default_rng(7)
    bits = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(shingles.set_fingerprint(a), shingles.set_fingerprint(b), strict=True))
    for n in (5, 6, 10, 30, 200):
        most = 0
        for _ in range(300):
            both = rnd.integers(0, 2**63, size=n, dtype=np.uint64)
            kept = both[: -(-4 * n // 5)]  # a subset of four fifths: similarity 0.8 at least
            most = max(most, bits(np.unique(both), np.unique(kept)))
        assert most <= shingles.BITS
    apart = [bits(np.unique(rnd.integers(0, 2**63, size=50, dtype=np.uint64)), np.unique(rnd.integers(0, 2**63, size=50, dtype=np.uint64))) for _ in range(300)]
    assert np.mean(np.array(apart) > shingles.BITS) > 0.99


@pytest.mark.parametrize("kind", ["lines", "edits"])
def test_composed_and_fuzzy_passages(spark, kind):
    """Passages whose lines were first seen elsewhere apart, and passages with a word in ten replaced."""
    rnd = random.Random(8)
    rows, want, k = [], set(), 0
    for _ in range(40):
        if kind == "lines":
            parts = [prose(rnd, 20) for _ in range(3)]
            for part in parts:
                rows.append((k, " ".join(prose(rnd, 30) + part + prose(rnd, 30))))
                k += 1
            copies = [sum(parts, []), sum(parts, [])]
        else:
            base = prose(rnd, 100)
            copies = [base, [w if at % 10 else f"edit{rnd.randrange(10**6)}" for at, w in enumerate(base)]]
        for copy in copies:
            rows.append((k, " ".join(prose(rnd, 40) + copy + prose(rnd, 40))))
            k += 1
        want.add((k - 1, k - 2))
    found = {(r.doc_id, r.other_id) for r in passages.shared_passages(spark.createDataFrame(rows, DOC)).collect()}
    assert len(want & found) >= (40 if kind == "lines" else 30)
    assert not found - want


def test_every_run_is_linked_to_its_own_first_holder(spark):
    """Runs of 50 words whose every part of 40 was first seen elsewhere, and documents that hold such parts twice."""
    rnd = random.Random(12)
    rows, want, k = [], set(), 0
    for _ in range(30):
        run = prose(rnd, 50)
        for part in (run[:40], run[10:], run, prose(rnd, 5) + run + prose(rnd, 5), run):
            rows.append((k, " ".join(prose(rnd, 30) + part + prose(rnd, 30))))
            k += 1
        want |= {(k - 2, k - 3), (k - 1, k - 3)}
    for _ in range(10):  # the second time, the part goes on
        run = prose(rnd, 50)
        rows += [(k, " ".join(prose(rnd, 30) + run[:40] + prose(rnd, 30) + run + prose(rnd, 30) + run[10:])), (k + 1, " ".join(prose(rnd, 30) + run + prose(rnd, 30)))]
        k += 2
        want.add((k - 1, k - 2))
    found = passages.shared_passages(spark.createDataFrame(rows, DOC)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == want
    texts = {n: t.split() for n, t in rows}
    assert all(texts[r.doc_id][r.start_word : r.end_word] == texts[r.other_id][r.other_start : r.other_end] for r in found if r.identity == 1.0)


def test_what_stands_around_an_exact_run_does_not_hide_it():
    rnd = random.Random(13)
    one, two, ends = prose(rnd, 50), prose(rnd, 50), [prose(rnd, 4) for _ in range(4)]
    apart = [one + prose(rnd, 28) + two for _ in range(2)]
    assert passages.align(*apart, [0, 78], [0, 78]) == [(0, 50, 0, 50, 50), (78, 128, 78, 128, 50)]
    edited = [one + [w for e in ends for w in prose(rnd, 10) + e] for _ in range(2)]
    (found,) = passages.align(*edited, [0], [0])
    assert found[0] == 0 and found[1] >= 50 and found[4] >= 0.8 * found[1]


@pytest.mark.parametrize("n", [4, 20, 145, 900, 5000])
def test_parities_differ_in_no_more_bits_than_the_sets_in_shingles(n):
    from docloom.llm import shingles

    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 2**63, n // 9 + 1, dtype=np.uint64)]))
    differ = [(x ^ y) & (2**64 - 1) for x, y in zip(shingles.parities(a), shingles.parities(b), strict=True)]
    folded = [differ[w] ^ differ[w + 4] ^ differ[w + 8] ^ differ[w + 12] for w in range(4)]
    bits = lambda words: sum(w.bit_count() for w in words)
    assert bits(folded) <= bits(differ) <= len(np.setxor1d(a, b))


def test_copies_around_the_threshold_are_verified_once_a_component(spark, monkeypatch):
    """Copies of one text whose similarity lies around the threshold: groups as by brute force, few pairs of sets compared."""
    from docloom.llm import shingles

    rnd = random.Random(4)
    base = prose(rnd, 150)
    rows = []
    for k in range(90):
        words = list(base)
        start = rnd.randrange(150)
        for at in range(13 + k % 9):
            words[(start + at) % 150] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    sets = {k: set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for k, t in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                one, two = sorted((root[a], root[b]))
                root = {k: one if r == two else r for k, r in root.items()}
    met, compared, possible, similar = [], [], shingles.possible, shingles.similar
    monkeypatch.setattr(shingles, "possible", lambda pairs, nodes: met.append(pairs.count()) or possible(pairs, nodes))
    monkeypatch.setattr(shingles, "similar", lambda both, own, shingle=5: compared.append(both.count()) or similar(both, own, shingle))
    found = shingles.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id: r.component_id for r in found} == root
    # Pairs with hubs alone are joined with their nodes; the others come tested out of their keys.
    assert len(met) == 1 and met[0] < 6 * len(rows) and 1 < len(set(root.values())) and sum(compared) < 4 * len(rows), (met, compared)
