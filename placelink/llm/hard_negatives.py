"""Hard negatives of anchors by blocked dense products.

Components become whole numbers, ``floor(scale * x)``; a score is the inner
product of two such vectors.  Anchors stand in blocks, of which groups of at
most ``GROUP_BYTES`` are broadcast to the blocks of candidates, one job a group
and pass.  A pair of blocks is one product in float64: no partial sum passes
the product of the two lengths, so below ``2 ** 53`` it is exact; rows longer
than ``2 ** 26`` stand in blocks of their own, whose products are made in 64-bit
integers.  Pass one keeps the best positives of an anchor, pass two the best
negatives in the window of each positive's score.  Tasks hold the best of what
they have seen, so what they hand on merges in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelink.llm.common import drop, prepare, table
from placelink.llm.vectors import matrix, stretches

#: Rows and bytes of a block, and bytes of anchors that are broadcast at a time.
ROWS, BLOCK_BYTES, GROUP_BYTES = 2_048, 4 << 20, 32 << 20
#: Squared lengths up to which float64 is exact, and from which a score may not be a long.
EXACT, LONGEST = float(1 << 52), float((1 << 63) - (1 << 12))

_BLOCK = "dim int, wide boolean, first long, last long, ids binary, labels binary, codes binary"
_ENDS = np.iinfo(np.int64).min


def usable_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``(dim, wide, label, id, v)`` of the rows that take part."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.where(F.col(label_col).isNotNull() & v.isNotNull() & F.col(id_col).isNotNull() & ~odd)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.cast("array<double>").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * float(scale) + 1.0, F.lit(2.0)))
    return rows.withColumn("q", length).where(F.col("q") < LONGEST).select(F.size("v").alias("dim"), (F.col("q") > EXACT).alias("wide"), "label", "id", "v")


def blocks(rows: DataFrame, scale: int) -> DataFrame:
    """Blocks of rows of one dimension, near in label, each sorted by id."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "wide", "label", "id"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in stretches(batches, 2, ROWS):
            held = run.combine_chunks()
            dim, wide = held["dim"][0].as_py(), held["wide"][0].as_py()
            most = max(1, min(ROWS, BLOCK_BYTES // (8 * max(1, dim))))
            for at in range(0, held.num_rows, most):
                part = held.slice(at, most).combine_chunks()
                ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
                x = matrix(part["v"].chunk(0)) if dim else np.zeros((len(ids), 0))
                place = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([wide]), pa.array([labels.min()]), pa.array([labels.max()])]
                    + [pa.array([a[place].tobytes()], pa.binary()) for a in (ids, labels, np.floor(scale * x))],
                    ["dim", "wide", "first", "last", "ids", "labels", "codes"],
                )

    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(made, _BLOCK)


class Best:
    """The ``k`` best of each of ``n`` lists: highest score, then least id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.score, self.ident = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, _ENDS, np.int64)

    def add(self, first: int, scores: np.ndarray, mask: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``scores`` where ``mask`` holds to the lists from ``first`` on; ``ids`` names the columns."""
        mask &= scores >= self.floor[first : first + len(scores)][:, None]
        if mask.sum() > 8 * self.k * len(scores) and scores.shape[1] > self.k:
            least = np.partition(np.where(mask, scores, _ENDS), -self.k, axis=1)[:, -self.k]
            mask &= scores >= least[:, None]
        r, c = np.nonzero(mask)
        if not len(r):
            return
        row, score, ident = np.concatenate([self.row, r + first]), np.concatenate([self.score, scores[r, c]]), np.concatenate([self.ident, ids[c]])
        place = np.lexsort((ident, -score, row))
        row, score, ident = row[place], score[place], ident[place]
        new = np.concatenate([[True], row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        keep = rank < self.k
        self.row, self.score, self.ident = row[keep], score[keep], ident[keep]
        full = rank == self.k - 1
        self.floor[row[full]] = score[full]


def _products(a: bytes, b: bytes, dim: int, wide: bool) -> np.ndarray:
    x, y = (np.frombuffer(c, np.float64) for c in (a, b))
    x, y = (c.reshape(-1, dim) if dim else None for c in (x, y))
    if not wide:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T  # wraps on the way, but the sum itself is a long


def _pairs(candidates: DataFrame, anchors: DataFrame, same: bool) -> DataFrame:
    """Blocks of candidates beside the anchors of a group whose labels they may share, or may not."""
    meet = (F.col("first") <= F.col("a_last")) & (F.col("last") >= F.col("a_first"))
    apart = ~((F.col("first") == F.col("last")) & (F.col("a_first") == F.col("a_last")) & (F.col("first") == F.col("a_first")))
    side = anchors.select("dim", "block", "told", *(F.col(c).alias(f"a_{c}") for c in ("wide", "first", "last", "ids", "labels", "codes")))
    on = (candidates["dim"] == side["dim"]) & (meet if same else apart)
    wide = (F.col("wide") | F.col("a_wide")).alias("wide")
    return candidates.join(F.broadcast(side), on).select(candidates["dim"], wide, "block", "told", "a_ids", "a_labels", "a_codes", "ids", "labels", "codes")


def _walk(batches: Iterator[pa.RecordBatch], state: Callable) -> Iterator:
    """One ``state`` a block of anchors, which gets the scores of each pair of blocks; yields them at the end."""
    held: dict = {}
    for batch in batches:
        for k in range(batch.num_rows):
            dim, wide, block, told, a_ids, a_labels, a_codes, ids, labels, codes = (c[k].as_py() for c in batch.columns)
            a_ids, a_labels, ids, labels = (np.frombuffer(x, np.int64) for x in (a_ids, a_labels, ids, labels))
            if block not in held:
                held[block] = state(block, a_ids, told)
            scores = _products(a_codes, codes, dim, wide) if dim else np.zeros((len(a_ids), len(ids)), np.int64)
            held[block].offer(scores, a_labels[:, None] == labels[None], ids)
    yield from held.values()


class _Positives:
    def __init__(self, block: int, anchors: np.ndarray, k: int):
        self.block, self.anchors, self.best = block, anchors, Best(len(anchors), k)

    def offer(self, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> None:
        self.best.add(0, scores, same & (self.anchors[:, None] != ids[None]), ids)


class _Negatives:
    """Windows of scores, one a positive of an anchor."""

    def __init__(self, anchors: np.ndarray, told: list[dict], k: int, low: int, high: int):
        self.n = len(anchors)
        self.anchors, self.places = anchors, max((t["place"] for t in told), default=0)
        shape = (self.places, self.n)
        self.ident, self.score = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.low, self.high = np.ones(shape, np.int64), np.zeros(shape, np.int64)  # empty
        for t in told:
            at = t["place"] - 1, t["at"]
            self.ident[at], self.score[at] = t["id"], t["score"]
            self.low[at], self.high[at] = -((-low * t["score"]) // 100), (high * t["score"]) // 100
        self.best = Best(self.places * self.n, k)

    def offer(self, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> None:
        other = ~same & (self.anchors[:, None] != ids[None])
        for p in range(self.places):
            self.best.add(p * self.n, scores, other & (scores >= self.low[p][:, None]) & (scores <= self.high[p][:, None]), ids)


def mine(df: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_rank, positive_id, positive_score, rank, negative_id, negative_score)``.

    Anchors are the ids divisible by ``every``; of each, the ``positives`` best
    rows of its label, and for each of these the ``negatives`` best rows of other
    labels with ``low * p <= 100 * s <= high * p`` for its score ``p``.  Ties go
    to the smaller id.  All rows are compared.

    Rows without an id or a label, without a vector or with a component that is
    null or not finite take no part, nor do those whose squared length (with 1
    added to each scaled component) reaches ``2 ** 63``, as their scores are no
    longs.  Vectors are compared within their dimension; zero and empty vectors
    take part.  Rows that repeat a candidate's id count each; rows that share an
    anchor's id are that anchor, with the least label and vector among them.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = usable_rows(df, id_col, vector_col, label_col, scale)
    candidates = table(blocks(rows, scale), "candidates")
    one = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "dim", "wide", "v")).alias("r")).select("r.*", "id")
    anchors = table(blocks(one.select("dim", "wide", "label", "id", "v"), scale).withColumn("block", F.monotonically_increasing_id()), "anchors")
    out = None
    for group in _groups(anchors):
        own = anchors.where(F.col("block").isin(group))
        near = table(_positives(candidates, own, positives), "positives")
        windows = own.join(near.groupBy("block").agg(F.collect_list(F.struct("at", "place", "id", "score")).alias("told")), "block")
        found = table(_negatives(candidates, windows, negatives, low, high), "negatives")
        drop(near)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_rank int, positive_id long, positive_score long, rank int, negative_id long, negative_score long")
    return out


def _groups(anchors: DataFrame) -> list[list[int]]:
    """Block numbers by jobs: as many as ``GROUP_BYTES`` hold, one at least."""
    out: list[list[int]] = []
    held = 0
    for block, size in anchors.select("block", F.length("codes")).orderBy("block").toLocalIterator():
        if not out or held + size > GROUP_BYTES:
            out.append([])
            held = 0
        out[-1].append(block)
        held += size
    return out


def _positives(candidates: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``(block, at, place, id, score)``: the ``k`` best of each anchor."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _walk(batches, lambda block, ids, told: _Positives(block, ids, k)):
            b = s.best
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.row), s.block)), pa.array(b.row.astype(np.int32)), pa.array(b.ident), pa.array(b.score)], ["block", "at", "id", "score"])

    found = _pairs(candidates, anchors.withColumn("told", F.lit(0)), same=True).mapInArrow(best, "block long, at int, id long, score long")
    place = Window.partitionBy("block", "at").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("block", "at", "place", "id", "score")


def _negatives(candidates: DataFrame, anchors: DataFrame, k: int, low: int, high: int) -> DataFrame:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _walk(batches, lambda block, ids, told: _Negatives(ids, told, k, low, high)):
            b = s.best
            p, at = b.row // max(1, s.n), b.row % max(1, s.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.anchors[at]), pa.array((p + 1).astype(np.int32)), pa.array(s.ident[p, at]), pa.array(s.score[p, at]), pa.array(b.ident), pa.array(b.score)],
                ["anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score"],
            )

    found = _pairs(candidates, anchors, same=False).mapInArrow(best, "anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long")
    place = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_rank", "positive_id", "positive_score", "rank", "negative_id", "negative_score")


def report(df: DataFrame) -> DataFrame:
    """The mined negatives of ``embeddings``, of which every seventh label is shifted first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(df.select("vec_id", "embedding", label.alias("label")))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
