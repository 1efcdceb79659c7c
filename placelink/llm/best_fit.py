"""Best-fit packing of documents into sequences, by partitions and then up a tree.

A document is its ids and an end id; longer ones than a sequence are cut into
full pieces and a rest.  Every partition best-fits its pieces, longest first,
and emits its nearly full bins; the underfull ones are the items of the next
round, where the partitions of a branch are one and best-fit anew, until one is
left.  A bin that goes into another takes its pieces along by one shift, so the
pieces themselves are written once and never move again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.llm.common import drop, prepare, table
from placelink.llm.packing import word_encoder

#: Partitions that meet in one of the next round, and pieces of a partition of the first.
BRANCH, LOCAL_ITEMS = 8, 50_000
#: A bin with less room than this share of its size is nearly full.
SLACK = 1 / 64


class Bins:
    """Open bins by the room they have; a bin of the least room that is enough is found by one shift of a bit mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: dict[int, list[int]] = {}

    def take(self, size: int) -> tuple[int | None, int]:
        """The bin of least room that holds ``size``, taken out, and its room."""
        fits = self.mask >> size
        if not fits:
            return None, self.capacity
        room = size + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        found = held.pop()
        if not held:
            self.mask ^= 1 << room
        return found, room

    def put(self, which: int, room: int) -> None:
        if room:
            held = self.by_room.setdefault(room, [])
            held.append(which)
            self.mask |= 1 << room

    def underfull(self, spare: int) -> Iterator[tuple[int, int]]:
        """``(bin, fill)`` of the bins that go on: of those with equal room as many as a round can use."""
        for room, held in sorted(self.by_room.items()):
            if room >= spare:
                for which in held if 2 * room >= self.capacity else held[:BRANCH]:
                    yield which, self.capacity - room


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(df: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, ids)`` of every document's pieces, encoded where texts are read."""
    prepare(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, made in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(made, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity].tobytes()
                    rows.append((doc, k, at, len(own) // 4, zlib.crc32(own), own if keep_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(cut, _PIECE)


def pack(df: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row a piece.

    ``start`` counts the document's ids before the piece, ``offset`` the ids
    before it in its sequence; pieces lie there without gaps.  With
    ``keep_ids`` the column ``ids`` has them as little-endian 32-bit integers.
    A null text counts as empty: its end id alone is a piece.  Rows without an
    id and rows that share one are documents each.
    """
    spark = df.sparkSession
    prepare(spark)
    made = table(pieces(df, path, end_id, capacity, keep_ids, id_col, text_col), "pieces")
    spare = max(1, int(capacity * SLACK))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // LOCAL_ITEMS)))
    placed = table(_local(made, parts, capacity, spare), "placed")
    drop(made)
    moves = _merged(placed.where("piece is null").select("grp", "bin", F.col("length").alias("fill")), parts, capacity, spare)
    out = placed.where("piece is not null")
    if moves is None:
        out = out.withColumns({"to": F.lit(None).cast("long"), "shift": F.lit(0).cast("long")})
    else:  # a round moves at most one bin of each partition that it joins, so their number is bounded by that of partitions
        out = out.join(F.broadcast(moves), "bin", "left")
    out = out.withColumn("sequence_id", F.coalesce("to", "bin")).withColumn("offset", F.col("at") + F.coalesce("shift", F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def _local(made: DataFrame, parts: int, capacity: int, spare: int) -> DataFrame:
    """The pieces with ``bin`` and ``at``, the place there; and ``(grp, bin, length)`` of underfull bins, without a piece."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        grp = TaskContext.get().partitionId()
        bins, new = Bins(capacity), grp << 40
        for batch in batches:
            own, at = [], []
            for size in batch.column("length").to_pylist():
                found, room = bins.take(size) if size < capacity else (None, capacity)
                if found is None:
                    found, new = new, new + 1
                bins.put(found, room - size)
                own.append(found)
                at.append(capacity - room)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), grp)), pa.array(own, pa.int64()), pa.array(at, pa.int64())], names)
        left = list(bins.underfull(spare))
        for k in range(0, len(left), 10_000):
            part = left[k : k + 10_000]
            empty = [pa.nulls(len(part), f.type) for f in shape]
            empty[3] = pa.array([f for _, f in part], pa.int64())
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(len(part), grp)), pa.array([b for b, _ in part], pa.int64()), pa.nulls(len(part), pa.int64())], names)

    names = [*made.columns, "grp", "bin", "at"]
    shape = [pa.field("a", t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
    longest = [F.desc("length"), F.asc("doc_id"), F.asc("piece"), F.asc("ids_crc32")]
    return made.repartition(parts).sortWithinPartitions(*longest).mapInArrow(fit, f"{_PIECE}, grp long, bin long, at long")


def _merged(left: DataFrame, parts: int, capacity: int, spare: int) -> DataFrame | None:
    """``(bin, to, shift)`` of all bins that go into others in the rounds up the tree.

    At most one bin of a partition is no more than half full, as two such bins
    would share one; only these can go into others, ``BRANCH`` of them at most
    in a branch.  So of bins of equal room no round can use more than ``BRANCH``
    of a partition, and what it is handed is bounded by sizes, not by rows.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, bins = None, Bins(capacity)
        for batch in batches:
            for grp, which, fill in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != now:
                    out += [(now, *b, None, None) for b in bins.underfull(spare)]
                    now, bins = grp, Bins(capacity)
                found, room = bins.take(fill)
                if found is None:
                    found = which
                else:
                    out.append((grp, which, fill, found, capacity - room))
                bins.put(found, room - fill)
        out += [(now, *b, None, None) for b in bins.underfull(spare)]
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k : k + 10_000], strict=True)], ["grp", "bin", "fill", "to", "shift"])

    moves = None
    while parts > 1:
        parts = -(-parts // BRANCH)
        near = left.withColumn("grp", F.floor(F.col("grp") / BRANCH).cast("long")).repartition(parts, "grp").sortWithinPartitions("grp", F.desc("fill"), "bin")
        done = table(near.mapInArrow(fit, "grp long, bin long, fill long, to long, shift long"), "round")
        left = done.where("to is null").select("grp", "bin", "fill")
        new = done.where("to is not null").select("bin", "to", "shift")
        if moves is not None:
            then = new.select(F.col("bin").alias("to"), F.col("to").alias("_to"), F.col("shift").alias("_shift"))
            moves = moves.join(F.broadcast(then), "to", "left").select("bin", F.coalesce("_to", "to").alias("to"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
            new = moves.union(new)
        moves = table(new, "moves")
    return moves


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed with ``keep_ids``: the ids of each sequence, at most its size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
