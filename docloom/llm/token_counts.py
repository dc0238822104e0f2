"""Token counts of a byte-level BPE by rank-synchronous array merging.

A batch's distinct pre-tokens are held as one ragged numpy array of symbols. In each round every unfinished
pre-token finds its lowest-rank neighbouring pair and merges all its occurrences at once; pre-tokens without
a mergeable pair leave with the number of symbols they have left. Merges were learned in rank order, so a
pair that a merge creates never ranks below it, and the rounds give what one merge at a time gives.

Counts of distinct pre-tokens are kept per task; a text's count is the sum over its pre-tokens, plus one for
each special string in it. No shuffle.

Cases: null and empty texts have no tokens; texts of any length count whole, and a pre-token of any
length is merged in linear memory; repeated rows have equal counts; an empty table gives an empty result; extra
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sentencepiece_codec import slices

#: Distinct pre-tokens that a task keeps before it starts anew: bounds memory, changes no result.
TABLE_SIZE = 200_000

#: Symbols that are merged at once.
BATCH_SYMBOLS = 2_000_000

NO_RANK = np.iinfo(np.int64).max


def byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class Merges:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        written = byte_characters()
        self.symbol = np.array([vocab[written[b]] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.split = regex.compile("|".join(map(regex.escape, special))).split if special else lambda text: [text]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        left = np.where(sizes == 1, 1, 0)
        live = np.flatnonzero(sizes > 1)
        symbols = self.symbol[np.frombuffer(b"".join(words[k] for k in live), dtype=np.uint8)]
        sizes = sizes[live]
        while len(live):
            ends = np.cumsum(sizes)
            pair = np.full(len(symbols), NO_RANK)
            pair[:-1] = self.rank(symbols[:-1], symbols[1:])
            pair[ends - 1] = NO_RANK  # no pair crosses from one word to the next
            lowest = np.minimum.reduceat(pair, ends - sizes)
            done = lowest == NO_RANK
            left[live[done]] = sizes[done]
            if done.any():
                keep = np.repeat(~done, sizes)
                symbols, pair = symbols[keep], pair[keep]
                live, sizes, lowest = live[~done], sizes[~done], lowest[~done]
                if not len(live):
                    break
            hit = pair == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # In a run of overlapping pairs (a a a) every second one merges, from the left.
            run_start = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.merged[pair[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), np.cumsum(sizes) - sizes)
            symbols = symbols[keep]
        return left


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class CountTable:
    def __init__(self, model: Merges) -> None:
        self.model, self.known = model, {}

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > TABLE_SIZE:
            self.known = {}
        find, split = self.model.find, self.model.split
        special, words = [], []
        for text in texts:
            parts = split(text)
            special.append(len(parts) - 1)
            words.append([w for part in parts for w in find(part)])
        new, raw, size = [], [], 0
        known = self.known
        for word in {w for found in words for w in found if w not in known}:
            new.append(word)
            raw.append(word.encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            if size > BATCH_SYMBOLS:
                self.known.update(zip(new, self.model.count(raw).tolist(), strict=True))
                new, raw, size = [], [], 0
        if new:
            self.known.update(zip(new, self.model.count(raw).tolist(), strict=True))
        known = self.known
        return [n + sum([known[w] for w in found]) for n, found in zip(special, words, strict=True)]


def token_count(text: Column, path: str) -> Column:
    """Column with the number of tokens the tokenizer at `path` gives each text, without added ones."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = CountTable(merges(path))
        for batch in batches:
            yield pa.array([n for part in slices(batch, 300_000) for n in table.counts(part)], type=pa.int64())

    return run(text)
