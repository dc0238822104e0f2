"""Keyed state over events: an anchored rate limiter, stream assembly and job states, in batch and streaming form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.anchors import anchored

#: limit and window in seconds by kind of request (fixed values)
PRESETS = {"chat": (30, 60), "upload": (10, 60), "pipeline": (30, 60), "auth": (10, 900)}


def limit_step(count: int, reset: float, at: float, limit: int, seconds: int) -> tuple[int, float, bool]:
    """Next (count, reset) and whether the request at `at` is allowed. A window starts at the first request it allows."""
    if count == 0 or reset < at:
        return 1, at + seconds, True
    if count >= limit:
        return count, reset, False
    return count + 1, reset, True


def rate_limit(requests: DataFrame, key: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """requests with allowed. A window opens with the first request after the last one's end: groups anchored at their first row, however many
    requests a key has; the first `limit` of a group are allowed."""
    groups = anchored(requests.select(key, at, order), [key], F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000, [F.col(order)])
    return groups.select(key, at, order, (F.col("_row") - F.col("_first") < limit).alias("allowed"))


def rate_limit_stream(requests: DataFrame, key: str, at: str, limit: int, seconds: int) -> DataFrame:
    """The limiter over a stream: state (count, reset) a key, which leaves when its window has passed."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, reset = state.get if state.exists else (0, 0.0)
        for df in frames:
            df = df.sort_values(at)
            flags = []
            for t in df[at].astype("datetime64[ns]").astype("int64") / 1e9:
                count, reset, ok = limit_step(count, reset, t, limit, seconds)
                flags.append(ok)
            yield pd.DataFrame({key: name[0], at: df[at].to_numpy(), "allowed": flags})
        state.update((count, reset))
        state.setTimeoutDuration(seconds * 1000)

    kinds = requests.schema
    schema = f"{key} {kinds[key].dataType.simpleString()}, {at} {kinds[at].dataType.simpleString()}, allowed boolean"
    return requests.groupBy(key).applyInPandasWithState(run, schema, "count long, reset double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def client_id(forwarded: Column, real_ip: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), F.nullif(real_ip, F.lit("")), F.lit("unknown"))


def assemble_events(pieces: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """(key, content, n_events): pieces in order make the stream; events end at a blank line, an open tail is left.

    An event's last data line counts, as the client reads it.
    """
    stream = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda p: p[text]), "")
    whole = pieces.groupBy(key).agg(stream.alias("stream"))
    events = F.slice(F.split("stream", "\n\n"), 1, F.greatest(F.size(F.split("stream", "\n\n")) - 1, F.lit(0)))
    last = lambda e, head: F.coalesce(F.try_element_at(F.regexp_extract_all(e, F.lit(f"(?m)^{head}: (.*)$"), F.lit(1)), F.lit(-1)), F.lit(""))
    tokens = F.transform(F.filter(events, lambda e: last(e, "event") == "token"), lambda e: last(e, "data"))
    return whole.select(key, F.array_join(tokens, "").alias("content"), F.size(events).alias("n_events"))


RANK = {"queued": 0, "classifying": 1, "extracting": 2, "validating": 3, "complete": 4, "error": 4}


def job_state(updates: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """(key, status): the state after all updates; a job never moves back, and complete or error is final."""
    rank = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))[F.col("status")]
    ended = F.col("_rank") == 4
    rows = updates.withColumn("_rank", rank)
    first_end = rows.filter(ended).groupBy(key).agg(F.min_by("status", F.struct(at, order)).alias("final"))
    furthest = rows.groupBy(key).agg(F.max_by("status", F.struct("_rank", at, order)).alias("open"))
    return furthest.join(first_end, key, "left").select(key, F.coalesce("final", "open").alias("status"))


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, start, end, n): runs of events with no gap of `gap` or more between them."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


# What a provider's message says of trying it again.
PERMANENT, FINAL, EXHAUSTED = r"\b(402|404)\b", r"\b(413|402|401|404)\b", ["RESOURCE_EXHAUSTED", "limit: 0"]


def provider_results(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, result, n): what trying a provider comes to, and after how many attempts: ok, permanent, final or failed.

    outcomes: keys, attempt (from 0) and message, null where it succeeds. Nothing is tried again after a success, a final error or a used-up quota."""
    m = F.col("message")
    kind = F.when(m.isNull(), "ok").when(m.rlike(PERMANENT), "permanent").when(m.rlike(FINAL) | (m.contains(EXHAUSTED[0]) & m.contains(EXHAUSTED[1])), "final")
    per = outcomes.withColumn("_kind", kind).groupBy(*keys).agg(F.min(F.when(F.col("_kind").isNotNull(), F.struct("attempt", "_kind"))).alias("_end"), F.count("*").alias("_n"))
    return per.select(*keys, F.coalesce("_end._kind", F.lit("failed")).alias("result"), F.coalesce(F.col("_end.attempt") + 1, F.col("_n")).cast("int").alias("n"))


def failover(results: DataFrame, run: str, seq: str, providers: list[int]) -> DataFrame:
    """(run, seq, provider, tried, attempts): the provider that answers each request of a run, null if none does, how many were tried, and how often in all.

    A provider that once fails for good is left out of the later requests of its run. It is tried where those before it don't answer, which is known before
    its own turn, so one window for each provider finds when it drops out. results: run, seq, provider, result, n; every request has all providers."""
    by = Window.partitionBy(run).orderBy(seq)
    wide = results.groupBy(run, seq).pivot("provider", providers).agg(F.first("result").alias("result"), F.first("n").alias("n"))
    out = wide.withColumns({"provider": F.lit(None).cast("int"), "tried": F.lit(0), "attempts": F.lit(0)})
    for p in providers:
        result = F.col(f"{p}_result")
        turn = F.col("provider").isNull() & result.isNotNull()
        lost = F.coalesce(F.max((turn & (result == "permanent")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
        out = out.withColumn("_on", turn & ~lost)
        out = out.withColumns({"tried": F.col("tried") + F.col("_on").cast("int"), "attempts": F.col("attempts") + F.when(F.col("_on"), F.col(f"{p}_n")).otherwise(0), "provider": F.when(F.col("_on") & (result == "ok"), p).otherwise(F.col("provider"))})
    return out.select(run, seq, "provider", "tried", "attempts")


def failover_stream(requests: DataFrame, run: str, seq: str) -> DataFrame:
    """failover() over a stream of requests (run, seq, results array<string> and ns array<int> by provider), in order of seq within a batch. State of a run: its lost providers."""

    def answer(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lost = set(state.get[0]) if state.exists else set()
        rows = []
        for df in frames:
            for r in df.itertuples(index=False):
                rows.append((getattr(r, seq), list(r.results), list(r.ns)))
        out = []
        for at, results, ns in sorted(rows):
            used, tried, attempts = None, 0, 0
            for p, result in enumerate(results):
                if p in lost:
                    continue
                tried, attempts = tried + 1, attempts + int(ns[p])
                if result == "permanent":
                    lost.add(p)
                if result == "ok":
                    used = p
                    break
            out.append((name[0], at, used, tried, attempts))
        state.update((sorted(lost),))
        yield pd.DataFrame(out, columns=[run, seq, "provider", "tried", "attempts"]).astype({"provider": "Int32", "tried": "int32", "attempts": "int32"})

    kinds = requests.schema
    schema = f"{run} {kinds[run].dataType.simpleString()}, {seq} {kinds[seq].dataType.simpleString()}, provider int, tried int, attempts int"
    return requests.groupBy(run).applyInPandasWithState(answer, schema, "lost array<int>", "append", GroupStateTimeout.NoTimeout)


# Characters that a request to a provider may have, and what a message is cut for and down to.
PROVIDER_CHARS = {"groq": 20000, "cerebras": 20000, "huggingface": 20000}
CUT_FROM, CUT_TO = 1000, 500


def truncated(messages: DataFrame, request: str) -> DataFrame:
    """messages (request, provider, role, content) with the contents that their provider takes: where a request is too long, each long message of the
    system or the user loses what the request has too much from its beginning, down to CUT_TO characters."""
    most = F.create_map(*(F.lit(x) for pair in PROVIDER_CHARS.items() for x in pair))[F.col("provider")]
    over = F.sum(F.char_length("content")).over(Window.partitionBy(request)) - most
    n = F.char_length("content")
    cut = F.when((over > 0) & F.col("role").isin("system", "user") & (n > CUT_FROM), F.least(n - CUT_TO, over)).otherwise(0)
    return messages.withColumn("_cut", cut.cast("int")).withColumn("content", F.substr("content", F.col("_cut") + 1)).drop("_cut")


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """The first attempt of each key that succeeded, in provider order."""
    best = Window.partitionBy(key).orderBy("ord")
    return attempts.filter("ok").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
