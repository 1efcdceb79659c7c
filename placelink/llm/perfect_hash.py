"""A minimal perfect hash over keys of three 64-bit words, built by shards and looked up by numpy.

A shard places its keys in levels of bits: a key that is alone at its place of
a level stays there, the others go to the next, smaller level.  A key's slot is
the number of set bits before its own, so slots are dense and in order of
shards.  The keys stand at their slots, and a lookup compares them, so a key
that is not in the set is told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.llm.common import open_store
from placelink.llm.vectors import runs

#: Keys of a shard, about, and bits a key of a level.
SHARD_KEYS, GAMMA = 1 << 16, 2.0
_LEVELS = 200

SCHEMA = "shard long, n long, sizes array<long>, bits binary, k1 binary, k2 binary, k3 binary, c binary"


@lru_cache(maxsize=1024)
def _odd(salt: int) -> tuple[np.uint64, ...]:
    return tuple(np.random.default_rng((77, salt)).integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1))


def mix(keys: tuple[np.ndarray, ...], salt: int) -> np.ndarray:
    """64-bit hashes of keys of up to three words; a missing word is zero."""
    c = _odd(salt)
    x = keys[0] * c[0] + c[3]
    for word, factor in zip(keys[1:], c[1:], strict=False):
        x += word * factor
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def top(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of hashes."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def build(keys: tuple[np.ndarray, ...]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits as 64-bit words, and the keys' order by slot.  Keys are distinct."""
    left = np.arange(len(keys[0]))
    sizes, words, order = [], [], []
    while len(left):
        if len(sizes) > _LEVELS:
            raise ValueError("keys repeat")
        m = -(-max(64, int(GAMMA * len(left))) // 64) * 64
        at = (mix(tuple(k[left] for k in keys), 1 + len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m)[at] == 1
        bits = np.zeros(m, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        order.append(left[alone][np.argsort(at[alone])])
        sizes.append(m)
        left = left[~alone]
    return sizes, np.concatenate(words) if words else np.zeros(0, "<u8"), np.concatenate(order) if order else np.zeros(0, np.int64)


def shards_for(count: int) -> int:
    """Bits of a shard's number."""
    return max(0, (-(-count // SHARD_KEYS) - 1).bit_length())


def sharded(seen: DataFrame, bits: int) -> DataFrame:
    """The shards of the keys of ``seen(k1, k2, k3, c)``, one row each, with the sums of their ``c`` by slot; keys may come more than once."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = tuple(c.to_numpy().view(np.uint64) for c in batch.columns[:3])
            yield pa.RecordBatch.from_arrays([pa.array(top(mix(own, 0), bits)), *batch.columns], ["shard", "k1", "k2", "k3", "c"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 1):
            rows = tuple(run[c].to_numpy().view(np.uint64) for c in ("k1", "k2", "k3"))
            own, key = _each_once(rows)
            sizes, words, order = build(own)
            slot = np.empty(len(order), np.int64)
            slot[order] = np.arange(len(order))
            total = np.zeros(len(order), np.int64)
            np.add.at(total, slot[key], run["c"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [pa.array([run["shard"][0].as_py()]), pa.array([len(order)]), pa.array([sizes], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary())]
                + [pa.array([k.tobytes()], pa.binary()) for k in (*(k[order] for k in own), total)],
                ["shard", "n", "sizes", "bits", "k1", "k2", "k3", "c"],
            )

    n = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = seen.select(*(F.col(c).cast("long") for c in ("k1", "k2", "k3", "c"))).mapInArrow(dealt, "shard long, k1 long, k2 long, k3 long, c long")
    return each.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(made, SCHEMA)


def _each_once(keys: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys, and the number of the key of each row."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return tuple(k[order[new]] for k in keys), which


def joined(rows: pa.Table, column: str, kind: str) -> np.ndarray:
    """The numbers of a binary column of a table in one chunk, one row after another, as they lie in memory."""
    held = rows.column(column)
    if not len(held):
        return np.zeros(0, kind)
    held = held.chunk(0)
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2][int(ends[0]) : int(ends[-1])], kind)


class Slots:
    """Shards ``first`` to ``last`` (exclusive) in memory; slots follow the order of ``rows``, that of the files they are read from."""

    def __init__(self, rows: pa.Table, bits: int, first: int, last: int):
        rows = rows.combine_chunks()
        self.bits, self.first, self.last = bits, first, last
        told = list(zip(*(rows.column(c).to_pylist() for c in ("shard", "n", "sizes")), strict=True))
        deep = max((len(sizes) for _, _, sizes in told), default=0)
        self.sizes, self.at = np.zeros((last - first, deep), np.int64), np.zeros((last - first, deep), np.int64)
        self.spans: dict[int, tuple[int, int]] = {}
        end = slot = 0
        for shard, n, sizes in told:
            self.spans[shard] = (slot, slot + n)
            slot += n
            for level, m in enumerate(sizes):
                self.sizes[shard - first, level], self.at[shard - first, level] = m, end
                end += m
        self.words = joined(rows, "bits", "<u8")
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.keys = tuple(joined(rows, k, "<u8") for k in ("k1", "k2", "k3"))
        self.n = len(self.keys[0])
        self.counts = joined(rows, "c", "<i8") if "c" in rows.column_names else None

    def find(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """The slots of ``keys`` (fewer than three words: the rest are zero); -1 where a key is not here."""
        out = np.full(len(keys[0]), -1, np.int64)
        shard = top(mix(keys, 0), self.bits) - self.first
        left = np.flatnonzero((shard >= 0) & (shard < self.last - self.first))
        for level in range(self.sizes.shape[1]):
            own = shard[left]
            size = self.sizes[own, level]
            left, own, size = left[size > 0], own[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.at[own, level] + (mix(tuple(k[left] for k in keys), 1 + level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            slot = self.rank[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = slot[hit]
            left = left[~hit]
        got = np.flatnonzero(out >= 0)
        same = np.ones(len(got), bool)
        for k, stored in enumerate(self.keys):
            same &= stored[out[got]] == (keys[k][got] if k < len(keys) else 0)
        out[got[~same]] = -1
        return out


def read_batches(path: str, columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """A table in the shared folder, file by file, ``rows`` at a time."""
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    store, at = open_store(path)
    for file in ds.dataset(at, filesystem=store, format="parquet").files:
        with store.open_input_file(file) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns, use_threads=False)
