"""Requests over time: the limiter and the failover against plain loops, in batch and as a stream."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docloom.operators import profiles as P
from docloom.streaming import limits as L


def test_the_limiter_equals_a_loop_over_each_key(spark):
    rnd = random.Random(3)
    rows, at = [], defaultdict(int)
    for n in range(4000):
        key = rnd.choice([1, 1, 1, 2, 3])
        at[key] += rnd.choice([0, 0, 1, 5, 30, 59, 60, 61, 300])
        rows.append((key, at[key], n))
    df = spark.createDataFrame(rows, "user long, s long, n long").withColumn("ts", F.timestamp_seconds("s")).repartition(4)
    got = {r.n: r.allowed for r in L.rate_limit(df, "user", "ts", "n", 3, 60).collect()}
    state = {}
    for key, t, n in sorted(rows):
        count, reset, ok = L.limit_step(*state.get(key, (0, 0.0)), t, 3, 60)
        state[key] = (count, reset)
        assert got[n] == ok
    assert 0 < sum(got.values()) < len(rows)


def outcomes(rnd):
    said = [None, None, None, "timeout", "429 rate limit", "402 payment", "HTTP 404", "413", "401 no", "RESOURCE_EXHAUSTED limit: 0", "RESOURCE_EXHAUSTED", "port 4040"]
    return [(run, seq, p, t, rnd.choice(said) if rnd.random() < 0.7 else "timeout") for run in range(20) for seq in range(12) for p in range(3) for t in range(3)]


def answered(rows):
    """{(run, seq): (provider, tried, attempts)} by a loop over the requests of each run."""
    by = defaultdict(list)
    for run, seq, p, t, m in sorted(rows, key=lambda r: r[:4]):
        by[run, seq, p].append(m)
    lost, out = defaultdict(set), {}
    for run, seq in sorted({r[:2] for r in rows}):
        used, tried, attempts = None, 0, 0
        for p in range(3):
            if p in lost[run]:
                continue
            tried += 1
            for m in by[run, seq, p]:
                attempts += 1
                if m is None:
                    used = p
                    break
                if m in ("402 payment", "HTTP 404"):
                    lost[run].add(p)
                    break
                if m in ("413", "401 no", "RESOURCE_EXHAUSTED limit: 0"):
                    break
            if used is not None:
                break
        out[run, seq] = (used, tried, attempts)
    return out


def test_a_lost_provider_stays_out_in_batch_and_in_a_stream(spark, tmp_path):
    rows = outcomes(random.Random(9))
    results = L.provider_results(spark.createDataFrame(rows, "run long, seq long, provider int, attempt int, message string"), ["run", "seq", "provider"])
    want = answered(rows)
    got = {(r.run, r.seq): (r.provider, r.tried, r.attempts) for r in L.failover(results, "run", "seq", [0, 1, 2]).collect()}
    assert got == want and {x[0] for x in want.values()} == {None, 0, 1, 2}
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("provider", "result", "n"))), lambda s: s)
    wide = results.groupBy("run", "seq").agg(ordered.alias("o")).select("run", "seq", F.col("o.result").alias("results"), F.col("o.n").alias("ns"))
    for k in range(3):  # the requests come in three files, each later than the last
        wide.filter(F.floor(F.col("seq") / 4) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = L.failover_stream(spark.readStream.schema(wide.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "run", "seq")
    q = stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.run, r.seq): (r.provider, r.tried, r.attempts) for r in spark.table("answers").collect()} == want


def test_profiles_are_data(spark):
    base = P.Registry()
    mine = base.register("memo", [("memo_no", "string", "Memo no", True, False)], [("memo_no", "string", True, r"^M\d+$", None, None, False)])
    docs = spark.createDataFrame([(1, "memo"), (2, "receipt"), (3, "novel")], "doc_id long, profile string")
    values = spark.createDataFrame([(1, "memo_no", "M12"), (1, "color", "red"), (2, "mobile_number", "123")], "doc_id long, key string, value string")
    found = {(r.doc_id, r.key, r.rule): (r.ok, r.missing) for r in P.checked(mine, docs, values).collect()}
    assert found[1, "memo_no", 0] == (True, None) and found[2, "mobile_number", 8] == (False, None)
    assert found[2, "receipt_number", 0] == (True, None) and not any(d == 3 for d, *_ in found)
    assert not P.checked(mine.without("memo"), docs.filter("doc_id = 1"), values).count()
    assert {tuple(r) for r in P.unknown_keys(mine, docs, values).select("doc_id", "key").collect()} == {(1, "color")}
    lines = spark.createDataFrame([(1, 0, "Memo no : m77", 0.9), (1, 1, "Memo no m78", None), (2, 0, "receipt number 5", 0.8)], "doc_id long, line_idx int, text string, ocr double")
    lack = P.lacking(mine, docs, values.filter("doc_id = 2"))
    assert {(r.doc_id, r.key) for r in lack.collect()} == {(1, "memo_no"), (2, "receipt_number"), (2, "receipt_date"), (2, "merchant_name"), (2, "total_amount")}
    out = {(r.doc_id, r.key): (r.status, r.value, r.alternatives) for r in P.recovered(P.recovery(mine, lines, lack), lines).collect()}
    assert out[1, "memo_no"] == ("ambiguous", None, ["m77", "m78"]) and out[2, "receipt_number"][:2] == ("flagged", "5")
