"""Archives by round trip; codes and clusters against brute force, with ties."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import warc
from docloom.llm.clusters import Centroids, clustered, with_inertia
from docloom.llm.codes import Codebook, decoded, vector_codes
from docloom.llm.common import durable

PAGE = "page_id long, url string, html string"


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, PAGE).repartition(3)
    return df.select("*", F.lit("x").alias("digest"), F.lit(1).alias("n"), F.lit(2).alias("kind"), F.lit("k").alias("key"))


def test_archives_hold_every_page_once(spark):
    long = "".join(random.Random(1).choices("abcdé <", k=400_000))
    rows = [(k, f"http://a/{k}", f"<p>{k % 7}</p>") for k in range(60)] + [(100, "http://a/\r\nx y", None), (101, None, ""), (102, "u", long), (103, "u", long)]
    rows += [(7, "http://again", "<p>0</p>"), (None, "u", "<p>1</p>"), (None, "u", "alone"), (8, "http://a/8", "<p>1</p>")]
    index = warc.write_archives(pages_of(spark, rows))
    found = index.collect()
    assert len(found) == len(rows) and {r.url for r in found} == {r[1] for r in rows}
    back = durable(warc.read_records(index), "t")
    full = warc.resolved(back).collect()
    assert len(full) == len(rows)
    texts = {}
    for k, _, x in rows:
        texts.setdefault((x or ""), []).append(k)
    digest = {warc.digest_of(x.encode()): x for x in texts}
    for r in full:
        x = digest[r.digest]
        assert r.n_bytes == len(x.encode())
        top = max((k for k in texts[x] if k is not None), default=None)
        if r.kind == "response":
            assert r.payload.decode() == x and r.key == top and r.refers_key is None
        else:
            assert r.payload is None and r.refers_key == top
    assert sum(r.kind == "response" for r in full) == len(texts)
    assert sorted((str(r.key) for r in full)) == sorted(str(r[0]) for r in rows)
    # A selection reads its own ranges only; any gzip reader reads a whole archive.
    some = warc.read_records(index.filter("key in (7, 103)")).collect()
    assert sorted(r.key for r in some) == [7, 7, 103]
    for file in {r.file for r in found}:
        whole = gzip.open(file.removeprefix("file://")).read()
        assert whole.count(b"WARC/1.1\r\n") == sum(r.file == file for r in found)


def test_small_payloads_stay_responses_and_no_pages_give_no_index(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (5, "u", None), (6, "u", "")]
    index = warc.write_archives(pages_of(spark, rows), least_bytes=3).collect()
    assert {r.key for r in index if r.kind == "revisit"} == {3}
    assert warc.write_archives(pages_of(spark, rows).filter("false")).count() == 0
    assert warc.read_records(warc.write_archives(pages_of(spark, rows).filter("false"))).count() == 0


def test_reads_are_coalesced_and_records_are_checked():
    ranges = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 500, 5), ("b", 505, 5), ("b", 510, 95)]
    assert [(f, s, e, list(r)) for f, s, e, r in warc.coalesced(ranges, gap=30, most=90)] == [("a", 0, 45, [0, 1, 2]), ("a", 500, 505, [3]), ("b", 505, 510, [4]), ("b", 510, 605, [5])]
    good = warc.record_bytes(3, "http://x", "id", warc.digest_of(b"abc"), 3, "d", b"abc")
    assert warc.parsed(good)["payload"] == b"abc"
    bad = warc.record_bytes(3, "http://x", "id", warc.digest_of(b"abd"), 3, "d", b"abc")
    with pytest.raises(ValueError, match="its payload"):
        warc.parsed(bad)


def squares(a, b):
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 70), st.sampled_from([1, 3, 40, 2**26]))
def test_tree_search_equals_brute_force(seed, n, most):
    rnd = np.random.default_rng(seed)
    entries, parts = rnd.integers(-most, most + 1, (n, 4)), rnd.integers(-most, most + 1, (200, 4))
    which, best = Codebook(entries).nearest(parts)
    d = squares(parts, entries)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 16), st.sampled_from([1, 2, 30, 2**24]))
def test_bounds_lose_no_centroid(seed, k, most):
    rnd = np.random.default_rng(seed)
    v = rnd.integers(-most, most + 1, (300, 5))
    at = rnd.integers(-most, most + 1, (k, 5))
    now, cluster, upper, lower = Centroids(at), np.zeros(300, dtype=np.int64), np.full(300, np.inf), np.zeros((300, k))
    for _ in range(6):
        cluster, upper, lower, calculated = now.assign(v, cluster, upper, lower)
        d = squares(v, now.at)
        assert (cluster == d.argmin(axis=1)).all() and calculated.max() <= k
        assert (upper**2 * (1 + 1e-9) >= d.min(axis=1)).all() and (lower**2 <= d * (1 + 1e-9)).all()
        now = now.updated({c: (int((cluster == c).sum()), v[cluster == c].sum(axis=0).tolist()) for c in np.unique(cluster)})


def vector_rows(n, width=64, values=9):
    rnd = random.Random(5)
    rows = [(k, [rnd.randrange(-values, values) / 16 + 0.01 for _ in range(width)], rnd.choice([1, 2, None])) for k in range(n)]
    rows += [(n // 2, rows[n // 2][1], 1)] * 2 + [(None, rows[0][1], 3), (900, None, 1), (901, [1.0, None] + [0.0] * (width - 2), 1), (902, [float("nan")] * width, 1), (903, [float("inf")] * width, None)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.select("*", *(F.lit(1).alias(c) for c in ("v", "s", "key", "of", "error", "cluster", "n")))


def kept(rows, scale):
    good = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return good, np.array([[int(np.floor(scale * x)) for x in r[1]] for r in good])


@pytest.mark.parametrize("n", [20, 300])
def test_codes_equal_brute_force(spark, n):
    rows = vector_rows(n)
    coded, books = vector_codes(frame(spark, rows))
    good, q = kept(rows, 256)
    q = q.reshape(len(good), 16, 4)
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, q[k].tolist()))
    want = np.stack([q[order[:64], p] for p in range(16)])
    for round_ in range(3):
        d = np.stack([squares(q[:, p], want[p]) for p in range(16)])
        which = d.argmin(axis=2)
        if round_ < 2:
            for p in range(16):
                for e in range(want.shape[1]):
                    mine = q[which[p] == e, p]
                    if len(mine):
                        want[p, e] = [int(x) // len(mine) for x in mine.sum(axis=0)]
    assert (books.entries == want).all()
    error = d.min(axis=2).sum(axis=0)
    label = {x: int(sum(e for r, e in zip(good, error, strict=True) if r[2] == x)) for x in (1, 2, 3, None)}
    expected = sorted((str(r[0]), bytes(which[:, k].tolist()).hex(), int(error[k]), label[r[2]]) for k, r in enumerate(good))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in coded.collect()) == expected
    back = {(r.vec_id, r.code): r.approximate for r in decoded(coded, books).collect()}
    r = good[3][0], bytes(which[:, 3].tolist()).hex()
    assert back[r] == [x / 256 for p in range(16) for x in want[p, which[p, 3]]]


@pytest.mark.parametrize("n", [9, 400])
def test_clusters_equal_brute_force(spark, n):
    rows = vector_rows(n) + [(950, [1.0] * 63, 1), (951, [], 1)]
    found, centroids = clustered(frame(spark, rows))
    good, q = kept([r for r in rows if r[1] is not None and len(r[1]) == 64], 64)
    name = lambda k: hashlib.sha256(f"1:{good[k][0]}".encode()).hexdigest()
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, name(k), q[k].tolist()))
    at = q[order[:16]].copy()
    for round_ in range(4):
        d = squares(q, at)
        which = d.argmin(axis=1)
        if round_ < 3:
            for c in np.unique(which):
                at[c] = [int(x) // int((which == c).sum()) for x in q[which == c].sum(axis=0)]
    assert (centroids.at == at).all()
    least = d.min(axis=1)
    rows_out = with_inertia(found, centroids).collect()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    expected = [(str(r[0]), int(which[k]), int(least[k]), int(least[which == which[k]].sum()), int(least.sum()), digest[which[k]]) for k, r in enumerate(good)]
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows_out) == sorted(expected)


def test_bounds_skip_calculations_on_clustered_vectors(spark):
    rnd = np.random.default_rng(3)
    rows = [(int(k), (rnd.normal(0, 0.05, 64) + 3 * np.eye(64)[k % 16]).tolist(), 1) for k in range(2000)]
    found, _ = clustered(frame(spark, rows))
    assert found.agg(F.avg("calculated")).first()[0] < 8


def test_no_usable_vectors_give_no_rows_and_large_ones_an_error(spark):
    none = frame(spark, vector_rows(3)[-4:])
    assert vector_codes(none)[0].count() == 0 == clustered(none)[0].count()
    assert vector_codes(none.filter("false"))[0].count() == 0 == clustered(none.filter("false"))[0].count()
    with pytest.raises(ValueError, match="too large"):
        clustered(frame(spark, [(1, [1e300] * 64, 1)]))
