"""SimHash near-duplicates through pivot distance tables.

Fingerprints are made from a text's word shingles and collapsed to distinct ones before anything is joined.
A pivot distance table holds, for every distinct fingerprint, its Hamming distances to fixed reference
fingerprints, by segment of the 64 bits. Two fingerprints that differ in at most d bits agree in all but d of
the SEGMENTS segments, and where segments agree, so do their distances to every reference: each choice of
SEGMENTS - d segments is an equi-join key made of table entries. Fingerprints of one key are alike in 56 of
64 bits, so at most 256 distinct ones meet in a key whatever the data. Of the pairs in a key, those with
a coordinate (distance of the whole fingerprint to a reference) that differs by more than d are discarded,
as the triangle inequality allows, and the rest are verified bit by bit.

Components are then found over the links of distinct fingerprints only, and joined back to the documents;
fingerprints that hold more than a thousandth of all rows are broadcast there, at most a thousand of them.

similar_documents() is the same for a similarity of shingle sets (shingles.py): pairs that share a rare
shingle take the place of the keys, the table's coordinates discard, and the exact sets verify.

Cases: null and empty texts have fingerprint 0; texts shorter than a shingle are one shingle; texts of any
length are read whole, a bounded number of shingles at a time; repeated rows get equal rows; a null doc_id
counts for no component id; an empty table gives an empty result; columns other than key and text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted
from .components import components

SHINGLE = 3
SEED = 42
DIFFERENCE = 2
SEGMENTS = 16
REFERENCES = 16


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text, unsigned."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=">u8")
    set_in = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Column of fingerprints as signed longs."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([fingerprint_of(x.as_py() or b"", shingle) for x in batch.cast(pa.binary())], dtype=np.uint64)
            yield pa.array(found.view(np.int64))

    return run(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def references(n: int = REFERENCES) -> list[int]:
    """n fixed fingerprints, by a multiplicative rule."""
    import xxhash

    return [_signed(xxhash.xxh64_intdigest(k.to_bytes(8, "big"), SEED)) for k in range(n)]


def pivot_table(distinct: DataFrame, segments: int = SEGMENTS, n: int = REFERENCES) -> DataFrame:
    """distinct (fp, ...) with `near`: its distances to the references, an array for each segment."""
    size = 64 // segments
    masks = [_signed(((1 << size) - 1) << (size * s)) for s in range(segments)]
    refs = references(n)
    rows = [F.array(*(F.bit_count((F.col("fp").bitwiseXOR(F.lit(r))).bitwiseAND(F.lit(m))).cast("tinyint") for r in refs)) for m in masks]
    return distinct.withColumn("near", F.array(*rows))


def links(distinct: DataFrame, difference: int = DIFFERENCE, segments: int = SEGMENTS, n: int = REFERENCES) -> DataFrame:
    """(u, v), u < v, for all distinct fingerprints within `difference` bits of each other."""
    if not 1 <= difference < segments:
        raise ValueError("difference must be between 1 and the number of segments, less one")
    table = pivot_table(distinct.select("fp"), segments, n).select("fp", F.transform("near", lambda row: F.xxhash64(row)).alias("own"))
    # A key is the sum of what its segments hash to, position included: each left-out choice is taken from the whole.
    table = table.select("fp", F.transform("own", lambda h, s: F.xxhash64(s, h).bitwiseAND(F.lit((1 << 56) - 1))).alias("own"))
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x)
    left_out = F.array(*(F.array(*map(F.lit, out)) for out in combinations(range(segments), difference)))
    each = table.withColumn("whole", whole).select("fp", "own", "whole", F.posexplode(left_out).alias("k", "out"))
    keyed = each.select("fp", F.xxhash64("k", F.col("whole") - sum((F.col("own")[F.col("out")[j]] for j in range(1, difference)), F.col("own")[F.col("out")[0]])).alias("key"))
    met = keyed.groupBy("key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    met = durable(met.select("fps"), "simhash-met")

    refs = references(n)
    apart = lambda a, b: F.greatest(*(F.abs(F.bit_count(a.bitwiseXOR(F.lit(r))) - F.bit_count(b.bitwiseXOR(F.lit(r)))) for r in refs))
    ordered = met.select(F.explode("fps").alias("u"), "fps")
    pairs = ordered.select("u", F.explode(F.filter("fps", lambda v: v > F.col("u"))).alias("v"))
    near = pairs.filter(apart(F.col("u"), F.col("v")) <= difference).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= difference)
    return near.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, difference: int = DIFFERENCE) -> DataFrame:
    """(key, fp, component_id) for each row of docs; component_id is the smallest key that near-duplicate links reach."""
    prints = durable(docs.select(F.col(key), fingerprint(F.col(text), shingle).alias("fp")), "simhash")
    distinct = durable(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    of = components(links(distinct, difference))
    grouped = of.join(distinct.select(F.col("fp").alias("node"), "first"), "node")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    linked = join_counted(grouped.select("node", "root"), least, "root").select(F.col("node").alias("fp"), "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    return join_counted(prints, durable(named, "simhash-named"), "fp").select(key, "fp", "component_id")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) for each row of docs with a key, linked where the sets of word shingles have a similarity of 0.8 or more."""
    from .shingles import near_duplicates as by_similarity

    return by_similarity(docs, key, text, shingle)
