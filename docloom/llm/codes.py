"""Vector codes: each part of a vector becomes the number of its codebook's nearest entry, found in a ball tree.

Vectors become integers, scale * x rounded down, and are cut into equal parts. A part position has a codebook, and
its entries a ball tree: a ball's centre is one of its entries and its radius reaches the farthest, rounded up. A
batch of parts goes down the tree at once, each into its nearer ball first. A ball is visited where the distance to
its centre, rounded down, less its radius does not exceed the best distance so far, rounded up; it is visited at
equality too, so that an equally near entry of a lower number is never missed. In the leaves distances are exact
integers, and these alone decide.

A round assigns every part and replaces each entry by the mean of its parts, rounded down, from exact integer
sums; codebooks have a bounded size (positions x entries x width of a part) and are all that the driver holds.

Cases: null vectors and those with null or non-finite components take no part; shorter vectors count as padded with
zeros, and all to a multiple of the parts; the first codebook is of the rows smallest by key (null last), then
vector, fewer where fewer rows are left; equally near entries go to the lower number; unused entries stay; rows of
a repeated or null key are rows of their own; null labels are one label; an empty table gives an empty result; other
columns are ignored, whatever their names; components too large for exact 64-bit distances raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted
from .vectors import down, group_sums, integers, matrix, squared, up

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a leaf, and parts that go down a tree together.
LEAF = 8
STEP_ROWS = 8192


class Ball:
    """Entries around one of them, in a leaf or in two balls."""

    def __init__(self, entries: np.ndarray, members: np.ndarray) -> None:
        points = entries[members]
        self.centre = points[np.square(points - points.mean(axis=0)).sum(axis=1).argmin()]
        reach = squared(points, self.centre)
        self.radius = float(up(np.sqrt(reach.max().astype(np.float64))))
        self.members, self.halves = members, ()
        if len(members) > LEAF and self.radius > 0:
            one = points[reach.argmax()]
            other = points[squared(points, one).argmax()]
            order = np.argsort(squared(points, one) - squared(points, other), kind="stable")
            cut = len(members) // 2
            self.halves = tuple(Ball(entries, np.sort(members[part])) for part in (order[:cut], order[cut:]))


class Codebook:
    """The entries of one part position with their tree."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.tree = Ball(entries, np.arange(len(entries)))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest entry of each row, the lowest number of equally near ones."""
        best = np.full(len(parts), np.iinfo(np.int64).max)
        which = np.zeros(len(parts), dtype=np.int64)

        def visit(ball: Ball, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if not ball.halves:
                d = squared(parts[rows, None, :], self.entries[None, ball.members, :])
                at = d.argmin(axis=1)
                d, at = d[np.arange(len(rows)), at], ball.members[at]
                better = (d < best[rows]) | ((d == best[rows]) & (at < which[rows]))
                best[rows[better]], which[rows[better]] = d[better], at[better]
                return
            far = [np.sqrt(squared(parts[rows], half.centre).astype(np.float64)) for half in ball.halves]
            least = [down(d) - half.radius for d, half in zip(far, ball.halves, strict=True)]
            nearer = far[0] <= far[1]
            for first, mine in ((0, nearer), (1, ~nearer)):
                own = rows[mine]
                for k in (first, 1 - first):
                    open_ = least[k][mine] <= up(np.sqrt(best[own].astype(np.float64)))
                    visit(ball.halves[k], own[open_])

        visit(self.tree, np.arange(len(parts)))
        return which, best


class Codebooks:
    """One codebook for each part position."""

    def __init__(self, entries: np.ndarray) -> None:
        """entries: position, entry, component."""
        self.entries = entries
        self.books = [Codebook(e) for e in entries]

    def cut(self, vectors: pa.Array) -> np.ndarray:
        """Rows, positions, components of a batch of integer vectors."""
        n, parts, size = len(vectors), *self.entries.shape[::2]
        return matrix(vectors, parts * size).reshape(n, parts, size)

    def assigned(self, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(parts, numbers, squared distances) of slices of a batch."""
        cut = self.cut(vectors)
        for start in range(0, len(cut), STEP_ROWS):
            step = cut[start : start + STEP_ROWS]
            found = [book.nearest(np.ascontiguousarray(step[:, p])) for p, book in enumerate(self.books)]
            yield step, np.stack([w for w, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def updated(self, sums: dict[int, tuple[int, list[int]]]) -> Codebooks:
        """With every used entry replaced by the mean of its parts, rounded down; the groups are position * entries + entry."""
        new, many = self.entries.copy(), self.entries.shape[1]
        for slot, (n, totals) in sums.items():
            new[slot // many, slot % many] = [t // n for t in totals]
        return Codebooks(new)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def trained(data: DataFrame, width: int, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of (key, v) after so many rounds. Sent to the driver: the first entries, and a sum for each entry and component a round."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    size = -(-width // parts)
    chosen = data.select(key, "v").orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).collect()
    start = matrix(pa.array([r["v"] for r in chosen], type=pa.list_(pa.int64())), parts * size)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(chosen), parts, size).transpose(1, 0, 2)))
    for _ in range(rounds):
        now, many = books, len(chosen)

        def assign(batch: pa.RecordBatch, now: Codebooks = now, many: int = many) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for cut, numbers, _ in now.assigned(batch.column(0)):
                for p in range(cut.shape[1]):
                    yield p * many, numbers[:, p], cut[:, p]

        books = books.updated(group_sums(data.select("v"), size, assign))
    return books


def encoded(data: DataFrame, books: Codebooks) -> DataFrame:
    """data with code and error in place of v."""

    @F.arrow_udf("struct<code:string,error:long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            codes, errors, digits = [], [np.zeros(0, dtype=np.int64)], 2 * books.entries.shape[0]
            for _, numbers, distances in books.assigned(batch):
                text = numbers.astype(np.uint8).tobytes().hex()
                codes += [text[k : k + digits] for k in range(0, len(text), digits)]
                errors.append(distances.sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(codes, type=pa.string()), pa.array(np.concatenate(errors))], names=["code", "error"])

    return data.withColumn("_c", run(F.col("v"))).select(*(c for c in data.columns if c != "v"), "_c.code", "_c.error")


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(key, label, code, error, label_error) of the usable vectors, and the codebooks that decode them."""
    data, width, rows = integers(vectors, vector, scale, F.col(key).alias("key"), F.col(label).alias("label"))
    if not rows:
        return data.select(F.col("key").alias(key), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    books = trained(data, max(width, 1), "key", parts, entries, rounds)
    # Nulls meet in joins as a text of their own.
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("of")
    coded = durable(encoded(data, books).select("*", named), "codes")
    per = durable(coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "code-labels")
    return join_counted(coded, per, "of").select(F.col("key").alias(key), "label", "code", "error", "label_error"), books


def decoded(codes: DataFrame, books: Codebooks, code: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with `approximate`: the vector of the entries that a code names, scaled back."""
    whole = F.array(*(F.array(*(F.lit([x / scale for x in e]) for e in book)) for book in books.entries.tolist()))
    number = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximate", F.flatten(F.array(*(F.get(whole[p], number(p)) for p in range(len(books.entries))))))
