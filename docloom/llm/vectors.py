"""Integer vectors, exact sums by group, and conservative rounding, shared by code compression and clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .knn import _matrix as matrix
from .knn import usable

#: Relative error that covers the rounding of a square root and of a few sums and products of doubles.
SLACK = 2.0**-48


def up(x: np.ndarray) -> np.ndarray:
    """Not below what x was meant to be."""
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors along the last axis."""
    apart = a - b
    return np.einsum("...i,...i->...", apart, apart)


def integers(vectors: DataFrame, vector: str, scale: int, *columns: Column, also: Column | None = None) -> tuple[DataFrame, int, int]:
    """(columns..., v): floor(scale * x) of the usable vectors as a written table, with their width and number.

    Squared distances are exact in 64 bits if no component is beyond about 2^62 / (4 width) to the power of 1/2
    (2^27 for 64 components); larger ones raise an error."""
    keep = usable(F.col(vector)) if also is None else usable(F.col(vector)) & also
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    data = durable(vectors.filter(keep).select(*columns, v.alias("v")), "integers")
    width, rows, most = data.agg(F.max(F.size("v")), F.count("*"), F.max(F.greatest(F.abs(F.array_max("v").cast("decimal(20,0)")), F.abs(F.array_min("v").cast("decimal(20,0)"))))).first()
    if 4 * int(most or 0) ** 2 * max(1, width or 0) >= 1 << 62:
        raise ValueError(f"a component of {most} is too large for exact distances of 64 bits")
    return data, width or 0, rows


def group_sums(data: DataFrame, width: int, assign: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, tuple[int, list[int]]]:
    """{group: (rows, sum of each component)} from assign(batch), which gives (first group, groups of its rows counted from there, integer rows).

    A task sends a row for each group and component that it saw; as many reach the driver, whatever the data."""
    schema = pa.schema([("slot", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for base, groups, rows in assign(batch):
                for g in np.unique(groups):
                    mine = rows[groups == g]
                    held = counts.setdefault(base + int(g), np.zeros(rows.shape[1] + 1, dtype=np.int64))
                    held[0] += len(mine)
                    held[1:] += mine.sum(axis=0)
        slots = [(slot, dim, int(c[0]), int(x)) for slot, c in counts.items() for dim, x in enumerate(c[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*slots, strict=True) if slots else [[]] * 4, schema, strict=True)], schema=schema)

    rows = data.mapInArrow(run, "slot int, dim int, n long, total long").groupBy("slot", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows):
        out.setdefault(r.slot, (r.n, []))[1].append(r.total)
    return out


__all__ = ["SLACK", "down", "group_sums", "integers", "matrix", "squared", "up", "usable"]
