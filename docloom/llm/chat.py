"""Chat formatting by token-level assembly.

Every turn's text is escaped and encoded on its own, so no token spans a border; the reserved ids of the
template are spliced in around it as ids, never as text. The loss mask is a list of spans: their offsets are
prefix sums of the segments' lengths, within the turn and, over a window, within the conversation.

Template (one row a turn): <s> [INST] role, line feed, text [/INST] for all but the assistant;
assistant turns are text </s>. The template's strings inside texts are broken by an escape character, which
is reversible: "<s>" becomes "<\\s>", a backslash becomes two. A role's line feeds are escaped, so the first one
ends it. The model's marker character, which decoding would turn into a space, is escaped too.

A conversation is never collected: turns are formatted row by row, sorted within their partition, and read
back as a stream in which a conversation's digests grow turn by turn. The ids under the loss mask are decoded
before that shuffle, so it carries each text once. The digest of one conversation is sequential by contract.

Cases: null texts and roles are empty; texts of any length are encoded whole; a null conv_id is a conversation;
turns with equal numbers (repeated rows) are ordered by role, then formatted text; null turn numbers come first; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sentencepiece_codec import MARK, ChunkTable, codec, slices

ESCAPE = "\\"
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (BEGIN, END, OPEN, CLOSE, "<unk>", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """text without control strings, markers or lone escapes; unescape() gives it back."""
    if ESCAPE in text:
        text = text.replace(ESCAPE, ESCAPE * 2)
    for control in CONTROLS:
        if control in text:
            text = text.replace(control, control[0] + ESCAPE + control[1:])
    return text.replace(MARK, ESCAPE + "_") if MARK in text else text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, parts = [], iter(text.split(ESCAPE))
    out.append(next(parts))
    for part in parts:
        if not part:  # a pair of escapes: what follows the second is plain
            out.append(ESCAPE + next(parts, ""))
        else:
            out.append({"_": MARK, "n": "\n"}[part[0]] + part[1:] if part[0] in "_n" else part)
    return "".join(out)


def escape_role(role: str) -> str:
    """A role on one line; unescape() gives it back."""
    return escape(role).replace("\n", ESCAPE + "n")


TURN = "struct<ids:array<int>,formatted:string,loss_start:int,loss_length:int>"


def format_turns(conversations: DataFrame, model_path: str) -> DataFrame:
    """One row a turn: conv_id, turn, role, ids, formatted (the text form), n_ids, loss_start and loss_length
    (the span of ids under the loss mask, from the turn's first id)."""

    @F.arrow_udf(TURN)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = ChunkTable(codec(model_path))
        whole = table.model.whole
        begin, end = whole.piece_to_id(BEGIN), whole.piece_to_id(END)
        marks = {s: np.array(whole.encode(s), dtype=np.int32) for s in (OPEN, CLOSE)}
        one = lambda x: np.array([x], dtype=np.int32)
        for roles, texts in batches:
            names = [r.as_py() or "" for r in roles]
            at, out = 0, []
            for part in slices(texts):
                own = names[at : at + len(part)]
                at += len(part)
                clean = [escape(t) for t in part]
                headers = [escape_role(r) + "\n" for r in own]
                ids, counts = table.look_up(clean)
                head_ids, head_counts = table.look_up(headers)
                content = np.split(ids, np.cumsum(counts)[:-1])
                heads = np.split(head_ids, np.cumsum(head_counts)[:-1])
                for role, text, header, body, head in zip(own, clean, headers, content, heads, strict=True):
                    if role == ASSISTANT:
                        segments, shown = [body, one(end)], text + END
                        masked = 0
                    else:
                        segments, shown = [one(begin), marks[OPEN], head, body, marks[CLOSE]], BEGIN + OPEN + header + text + CLOSE
                        masked = None
                    starts = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
                    span = (0, 0) if masked is None else (int(starts[masked]), len(segments[masked]))
                    out.append({"ids": np.concatenate(segments), "formatted": shown, "loss_start": span[0], "loss_length": span[1]})
            kinds = [("ids", pa.list_(pa.int32())), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_length", pa.int32())]
            yield pa.array(out, type=pa.struct(kinds))

    made = conversations.select("conv_id", "turn", "role", run(F.col("role"), F.col("text")).alias("_made"))
    return made.select("conv_id", "turn", "role", "_made.*").withColumn("n_ids", F.size("ids"))


def order() -> list:
    return [F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.col("formatted")]


def assemble(turns: DataFrame, model_path: str) -> DataFrame:
    """The turns with `learnt`, and with `offset`, the place of their first id in their conversation's ids (a running sum)."""
    turns = turns.withColumn("learnt", learnt(F.col("ids"), F.col("loss_start"), F.col("loss_length"), F.col("formatted"), model_path)).drop("ids")
    before = Window.partitionBy("conv_id").orderBy(*order()).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    if formatted.startswith(BEGIN):
        role, _, text = formatted[len(BEGIN) + len(OPEN) : -len(CLOSE)].partition("\n")
        return unescape(role), unescape(text)
    return ASSISTANT, unescape(formatted[: -len(END)])


def learnt(ids: Column, start: Column, length: Column, formatted: Column, model_path: str) -> Column:
    """Column of the text under a turn's loss mask, decoded from its ids; null where it is just the turn's text again."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = codec(model_path)
        for batch in batches:
            out = []
            for row, s, n, shown in zip(*batch, strict=True):
                text = unescape(model.decode(row.values.to_numpy(zero_copy_only=False)[s.as_py() : s.as_py() + n.as_py()].tolist()))
                out.append(None if text == (parse(shown.as_py())[1] if n.as_py() else "") else text)
            yield pa.array(out, type=pa.string())

    return run(ids, start, length, formatted)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, mask_sha256 string"


def digests(assembled: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the formatted turns and from the ids under the loss mask.

    mask_sha256: of "first id:number of ids," of each span of the conversation's loss mask. The rows arrive
    sorted, so each task holds one batch and the running digests of one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, state = None, None

        def close() -> None:
            n, turns, chars, loss, shown, ids, mask = state
            rows.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), shown, ids, mask.hexdigest()))

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = [c.split(" ")[0] for c in DIGESTS.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for conv, shown, ids, offset, start, length, other in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "n_ids", "offset", "loss_start", "loss_length", "learnt")), strict=True):
                if (conv,) != now:
                    if state:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, hashlib.sha256()]
                role, text = parse(shown)
                loss = other if other is not None else text if length else ""
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(shown)
                state[5] += ids
                if length:
                    state[6].update(f"{offset + start}:{length},".encode())
            if rows:
                yield emit()
                rows.clear()
        if state:
            close()
            yield emit()

    # The window of assemble() has dealt and sorted the turns by conversation already: neither is done again.
    return assembled.select("conv_id", "formatted", "n_ids", "offset", "loss_start", "loss_length", "learnt").mapInArrow(run, DIGESTS)
