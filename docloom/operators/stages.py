"""A list of stages run one after the other over documents, with a trace: what each started, finished or failed at.

A stage is a function from the state (tables by name, `docs` among them) to the state after it and an outcome for each document: doc_id, error (null where it
went well) and detail. Documents with an error go no further; the stages after them do not see them. Stages are plain values in a list, so a caller adds, leaves out or replaces any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.cut import cut

State = dict[str, DataFrame]
Stage = Callable[[State], tuple[State, DataFrame]]


def run(stages: list[tuple[str, Stage]], state: State) -> tuple[State, DataFrame]:
    """(state after the last stage, events): events are doc_id, ord, stage, event (start, finish or error) and detail."""
    events = None
    for ord_, (name, stage) in enumerate(stages):
        docs = state["docs"]
        state, outcome = stage(state)
        outcome = cut(outcome.select("doc_id", "error", "detail"))
        row = lambda df, event, detail, ord_=ord_, name=name: df.select("doc_id", F.lit(ord_).alias("ord"), F.lit(name).alias("stage"), event.alias("event"), detail.alias("detail"))
        both = row(docs, F.lit("start"), F.lit(None).cast("string")).unionByName(row(outcome, F.when(F.col("error").isNull(), "finish").otherwise("error"), F.coalesce("error", "detail")))
        events = both if events is None else events.unionByName(both)
        state = state | {"docs": docs.join(outcome.filter("error IS NULL").select("doc_id"), "doc_id", "left_semi")}
    return state, events
