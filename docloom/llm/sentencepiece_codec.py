"""SentencePiece encoding and decoding through a distinct-chunk table.

In a BPE model whose pieces never hold a whitespace marker after another character, no merge crosses the
place where a marker follows a word. A text, marked as the library marks it, is therefore cut there into
chunks ("marked words"), and each chunk's segmentation depends on nothing else. Every task keeps a table of
the distinct chunks it has met: the model segments a chunk once, and the ids are joined back to the texts by
position with one ragged gather. A text needs no shuffle, so the work is as large as the scan.

Characters that occur in no piece of two or more characters (line feeds in the public models) cut too.

Cases: a null or empty text has no ids and decodes to the empty text; texts of any length are cut chunk by
chunk, so a task holds one text and the table; repeated texts are repeated work on a filled table; an empty
table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import frugal, ragged_gather

MARK = "▁"

#: Distinct chunks that a task keeps before it starts a new table: bounds memory, changes no result.
TABLE_SIZE = 150_000

#: Characters of text that are gathered at once.
SLICE_CHARS = 1_000_000


class CrossingPieces(ValueError):
    """The model has pieces that cross a whitespace marker, so chunks aren't independent."""


def _proto(model_path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


class Codec:
    """What a task needs of one model: the chunk pattern, the segmenter of chunks, and the pieces' bytes."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        proto = _proto(model_path)
        spec = proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise CrossingPieces(f"{model_path}: a piece holds a whitespace marker after another character")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{model_path}: only models that leave characters as they are and mark words in front")
        self.prefix = bool(spec.add_dummy_prefix)
        inside = set("".join(p for p in pieces if len(p) > 1))
        apart = "".join(re.escape(c) for c in "\n\t" if c not in inside)
        word = f"[^{MARK}{apart}]"
        self.chunks = re.compile(f"{MARK}*{word}+|{MARK}+" + (f"|[{apart}]" if apart else "")).findall
        spec.add_dummy_prefix = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = {p: k for k, p in enumerate(("unused0", "normal", "unknown", "control", "user", "unused", "byte"))}
        self.piece_bytes = [
            b"" if p.type == kinds["control"] else proto.trainer_spec.unk_surface.encode() if p.type == kinds["unknown"] else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds["byte"] else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces
        ]
        self.marked = {k for k, p in enumerate(proto.pieces) if p.type == kinds["normal"] and p.piece.startswith(MARK)}
        self.path = model_path

    @cached_property
    def whole(self):
        """The library's own processor, loaded only where it is asked."""
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return self.chunks((MARK if self.prefix else "") + text.replace(" ", MARK))

    def decode(self, ids: list[int]) -> str:
        """As the library decodes; ids whose bytes aren't valid UTF-8 are left to it."""
        found = self.piece_bytes
        raw = b"".join([found[i] for i in ids])
        if self.prefix:
            first = next((i for i in ids if found[i]), None)
            if first in self.marked:
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self.whole.decode(ids)


@lru_cache(maxsize=4)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


class ChunkTable:
    """Distinct chunks and where their ids lie in one flat array."""

    def __init__(self, model: Codec) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def add(self, chunks: list[str]) -> None:
        """Segment chunks that the table doesn't hold."""
        for chunk, ids in zip(chunks, self.model.segmenter.encode(chunks, num_threads=1), strict=True):
            k, end = len(self.place), self.used + len(ids)
            while end > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            if k == len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.ids[self.used : end] = ids
            self.start[k], self.length[k] = self.used, len(ids)
            self.place[chunk] = k
            self.used = end

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, and how many each text has."""
        if len(self.place) > TABLE_SIZE:
            self.clear()
        cut = [self.model.cut(t) for t in texts]
        held = self.place
        if new := {c for chunks in cut for c in chunks if c not in held}:
            self.add(sorted(new))
        place = self.place
        at = np.fromiter((place[c] for chunks in cut for c in chunks), dtype=np.int64)
        lengths = self.length[at]
        ids = ragged_gather(self.ids, self.start[at], lengths)
        chunk_ends = np.concatenate([[0], np.cumsum(lengths)])
        text_ends = np.cumsum([len(c) for c in cut], dtype=np.int64) if cut else np.zeros(0, dtype=np.int64)
        return ids, np.diff(chunk_ends[np.concatenate([[0], text_ends])])


def slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Python strings of an Arrow column (null: empty), about `most` characters at a time."""
    part, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(text: Column, model_path: str) -> Column:
    """Column of ids, array<int>, as the library's encode() without begin or end ids gives them."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(codec(model_path))
        for batch in batches:
            parts = [table.look_up(part) for part in slices(batch)]
            ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int32)
            counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))

    return run(text)


def round_trip(text: Column, model_path: str) -> Column:
    """Column of (ids, decoded): encode() and decode() of each text in one worker."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    @frugal
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(codec(model_path))
        for batch in batches:
            ids, counts, decoded = [], [], [pa.array([], type=pa.string())]
            for part in slices(batch, SLICE_CHARS // 4):
                found, sizes = table.look_up(part)
                ends = np.cumsum(sizes)
                decoded.append(pa.array([table.model.decode(found[e - n : e].tolist()) for e, n in zip(ends, sizes, strict=True)], type=pa.string()))
                ids.append(found)
                counts.append(sizes)
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.concat_arrays(decoded)], names=["ids", "decoded"])

    return run(text)


def decode(ids: Column, model_path: str) -> Column:
    """Column of texts, as the library's decode() of the ids gives them; null ids decode to the empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = codec(model_path)
        for batch in batches:
            yield pa.array([model.decode(row.as_py() or []) if row.is_valid else "" for row in batch], type=pa.string())

    return run(ids)
