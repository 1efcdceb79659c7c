"""What the two vector operators share: valid vectors, equal vectors, hashed orders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Concatenated hashes of an order's key, and random hyperplanes of each.
HASHES, BITS = 3, 20


def usable(v: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that are equal in their first ``keys`` columns, which come together."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != at:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def pieces(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """Tables of at most ``most`` rows that are equal in their first ``keys`` columns; a run's last two are of one size."""
    for own in stretches(batches, keys, 2 * most):
        half = -(-own.num_rows // 2) if own.num_rows > most else own.num_rows
        for at in range(0, own.num_rows, half):
            yield own.slice(at, half)


def stretches(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """Tables of at most ``most`` rows that are equal in their first ``keys`` columns, in order."""
    held: list[pa.RecordBatch] = []
    at, n = None, 0
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != at:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            at = key
            while a < b:
                end = min(b, a + most - n)
                held.append(batch.slice(a, end - a))
                n, a = n + end - a, end
                if n == most:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


@lru_cache(maxsize=64)
def planes(turn: int, dim: int) -> np.ndarray:
    return np.random.default_rng((turn, dim)).standard_normal((dim, HASHES * BITS))


def sorted_passes(rows: DataFrame, passes: int, carry: str = "v", first: int = 0) -> DataFrame:
    """``rows(grp, id, v)`` once a pass, range-partitioned and sorted by hash.

    Returns ``(turn, grp, dim, id, carry)``; turns count from ``first``.  In each pass vectors stand in
    lexicographic order of their concatenated random hashes within their group
    and dimension; ties stand by id, so equal hashes are no hot task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)[carry]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(HASHES * BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = matrix(part.column(2))
                for turn in range(first, first + passes):
                    key = ((x @ planes(turn, dim)) > 0) @ weights
                    m = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, turn, np.int32)), part.column(0), pa.array(np.full(m, dim, np.int32)), pa.array(key), part.column(1), part.column(3)], ["turn", "grp", "dim", "key", "id", carry])

    order = ["turn", "grp", "dim", "key", "id"]
    each = rows.select("grp", "id", "v", F.col(carry).alias("_carry")).mapInArrow(keyed, f"turn int, grp string, dim int, key long, id long, {carry} {kind}")
    return each.repartitionByRange(n, *order).sortWithinPartitions(*order).select("turn", "grp", "dim", "id", carry)


def hashed(v: Column) -> list[Column]:
    """128 bits by which equal vectors are found."""
    return [F.xxhash64(F.lit(0), v), F.xxhash64(F.lit(1), v)]
