"""Sums of large numpy arrays over the tasks of a job, by blocks: what meets in a task is a block, not an array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placelink.session import ship

#: Numbers of a block.
BLOCK = 1 << 16


def summed(rows: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int) -> np.ndarray:
    """The sum of the arrays of ``size`` numbers that ``made`` gives for the partitions of ``rows``.

    Arrays are summed in two levels: the blocks of sixteen tasks, then what came
    of those.  Only the sum reaches the driver.
    """
    ship(rows.sparkSession)
    shape = "block int, part int, held binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = made(batches)
        if total is not None:
            for at in range(0, size, BLOCK):
                yield _row(at // BLOCK, TaskContext.get().partitionId() // 16, total[at : at + BLOCK])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for block, part, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(held, np.float64)
                if now == (block, part):
                    total += own
                else:
                    if now:
                        yield _row(*now, total)
                    now, total = (block, part), own.copy()
        if now:
            yield _row(*now, total)

    out = np.zeros(size)
    near = rows.mapInArrow(cut, shape).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(meet, shape)
    far = near.selectExpr("block", "0 as part", "held").repartition("block").sortWithinPartitions("block").mapInArrow(meet, shape)
    for r in far.collect():  # a row a block
        out[r["block"] * BLOCK : r["block"] * BLOCK + BLOCK] += np.frombuffer(r["held"], np.float64)
    return out


def _row(block: int, part: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["block", "part", "held"])
