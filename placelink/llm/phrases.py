"""Phrase collocations: exact counts of candidate phrases in arrays by slot of a minimal perfect hash.

Words are counted once and get 64-bit hashes, of which a look at all distinct
words shows that no two are equal; texts are then written as streams of these
hashes.  Passes over the streams find Apriori-safe candidates: pairs of
frequent words in a bucket of pairs that is frequent, then triples of such
pairs in a frequent bucket of triples.  Buckets are summed as sorted blocks and
kept as bit maps, whose size is bounded.  Occurrences of candidates go to the
shard of their key, which gives all its keys slots of a minimal perfect hash
that stores them, and counts them by slot in a numpy array.  The counts of the
parts of a candidate before a cut and behind it are read by slot, too: each
part asks its own shard.  So streams and shards are gone through once, however
many candidates there are.
"""

from __future__ import annotations

import fcntl
import hashlib
import mmap
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelink.llm import perfect_hash as H
from placelink.llm.common import drop, prepare, table
from placelink.llm.vectors import runs

#: Code points of texts that are split together when words are counted, and when a row of a stream is written (Parquet
#: holds 100 rows before it looks at their size); words of a stream that a task counts, and keys it makes distinct at a time.
TOGETHER, STREAM, WORDS_A_TASK, KEYS = 2 << 20, 1 << 18, 1 << 24, 1 << 18
#: Bytes of a word up to which it is hashed together with others.
LONG = 256
#: Places of buckets and slots that a task gathers before it counts them.
GATHERED = 1 << 20
#: Bits of a bit map's size at most (256 MB), and of a block of buckets and slots.
MAP_BITS, BLOCK_BITS = 31, 16
#: Start of the names of an executor's files of bit maps, and how many of them it keeps (a pass looks at two).
_MAPS, MAPS_HELD = "placelink-map-", 3
#: Distinct keys and their counts that a task holds (32 bytes each).
MERGED = 1 << 20
#: Counts of parts that a task looks up together.
PASS_KEYS = 1 << 18

_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "32", "spark.sql.execution.arrow.maxRecordsPerBatch": str(1 << 16), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

_BLANK = re.compile("[ \t]")

#: What a byte is (0 of a word, 1 a blank, 2 the end of a piece), and the byte in lower case.
_KIND, _LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[list(b" \t")], _KIND[list(b".,;:!?\n\x0b\x0c\r")] = 1, 2
_LOWER[65:91] += 32


def _split(texts: pa.Array, end: bool) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of ``texts`` and, for each place, the number of its word; -1 where a piece ends.

    All that parts words is a byte, so they are found in the bytes of all texts at once.
    """
    rows = pa.concat_arrays([texts, pa.array([""], texts.type)]) if end else texts
    held = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), "\n").buffers()[2] or b"", np.uint8)
    kind = _KIND[held]
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(held):
        edges = np.concatenate([[0] if inside[0] else [], edges, [len(held)] if inside[-1] else []]).astype(np.int64)
    ends = np.cumsum(np.concatenate([[0], edges[1::2] - edges[::2]]))
    words = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_LOWER[held[inside]])).dictionary_encode()
    told = kind == 2
    told[edges[::2]] = True
    at = np.where(inside[told], 0, -1)
    at[at == 0] = words.indices.to_numpy()
    return words.dictionary, at


def _texts(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[tuple[str, pa.Array, bool, bool]]:
    """``(lang, texts, whole, first)``: texts of a language together, or a long one in slices cut at blanks."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(text) > together:
                at = 0
                while at < len(text):
                    cut = _BLANK.search(text, at + together)
                    end = cut.end() if cut else len(text)
                    yield lang, pa.array([text[at:end]], pa.string()), end == len(text), at == 0
                    at = end
                continue
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] > together:
                size.pop(lang)
                yield lang, pa.array(held.pop(lang), pa.string()), True, True
        if sum(size.values()) > 4 * together:  # many languages
            yield from ((k, pa.array(v, pa.string()), True, True) for k, v in held.items())
            held, size = {}, {}
    yield from ((k, pa.array(v, pa.string()), True, True) for k, v in held.items())


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all of the given ones."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _drawn(first: int, count: int, seed: int) -> np.ndarray:
    """``count`` random odd numbers from the ``first`` of a seed on."""
    start = np.uint64(xxhash.xxh64_intdigest(b"words", seed))
    return _mixed(start + np.arange(first, first + count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hashes(lang: str, words: pa.Array, seed: int) -> np.ndarray:
    """Hashes of distinct words, none of them 0: sums of random numbers of bytes times those of their places."""
    h = np.zeros(len(words), np.uint64)
    size = pc.binary_length(words).to_numpy()
    for k in np.flatnonzero(size > LONG).tolist():  # by themselves, as numbers take eight times their bytes
        h[k] = xxhash.xxh64_intdigest(f"{len(lang)} {lang}{words[k]}", seed)
    short = np.flatnonzero(size <= LONG)
    if len(short):
        held = words.take(pa.array(short)) if len(short) < len(words) else words
        size = size[short].astype(np.int64)
        first = np.cumsum(size) - size
        start = int(np.frombuffer(held.buffers()[1], np.int32)[held.offset])
        of_byte, of_place = _drawn(0, 256, seed), _drawn(256, LONG, seed)
        each = of_byte[np.frombuffer(held.buffers()[2], np.uint8)[start : start + size.sum()]]
        each *= of_place[np.arange(len(each)) - np.repeat(first, size)]
        h[short] = _mixed(np.add.reduceat(each, first) + np.uint64(xxhash.xxh64_intdigest(lang, seed)))
    h[h == 0] = 1
    return h


def _documents(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.where(F.col(text_col) != "").select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def words(docs: DataFrame, seed: int) -> DataFrame:
    """``(lang, word, h, f)``: all distinct words, their hashes and counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts, whole, _ in _texts(batches, TOGETHER):
            own, at = _split(texts, whole)
            n = np.bincount(at[at >= 0], minlength=len(own))
            h = _hashes(lang, own, seed).view(np.int64)
            for k in range(0, len(own), 50_000):
                part = own[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(h[k : k + 50_000]), pa.array(n[k : k + 50_000])], ["lang", "word", "h", "c"])

    return docs.mapInArrow(counted, "lang string, word string, h long, c long").groupBy("lang", "word", "h").agg(F.sum("c").alias("f"))


def streams(docs: DataFrame, frequent: str, bits: int, seed: int) -> DataFrame:
    """``(lead, ids)``: texts as word hashes, 0 where a piece ends or a word is not frequent.

    The first ``lead`` words of a row repeat the last ones of the slice before.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lead, ids in _ids(batches, bit_map(frequent, bits), bits, seed):
            yield pa.RecordBatch.from_arrays([pa.array([lead], pa.int32()), pa.array([ids.tobytes()], pa.binary())], ["lead", "ids"])

    return docs.mapInArrow(coded, "lead int, ids binary")


def _ids(batches: Iterator[pa.RecordBatch], known: _Bits, bits: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    before = np.zeros(0, np.uint64)
    for lang, texts, whole, first in _texts(batches, STREAM):
        own, at = _split(texts, whole)
        h = _hashes(lang, own, seed)
        h[~known[H.top(H.mix((h,), 0), bits)]] = 0
        before = before[:0] if first else before
        ids = np.concatenate([before, np.append(h, np.uint64(0))[at]])  # -1 is the last
        yield len(before), ids
        before = ids[-2:]


def bit_blocks(rows: DataFrame, bits: int, least: int) -> DataFrame:
    """``(block, map)`` of a bit map of ``2 ** bits`` places: set where the counts of ``rows(block, at, n)`` sum to ``least``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = 1 << min(bits, BLOCK_BITS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(size, np.int64)
        for batch in batches:
            for block, at, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield _row(["block", "map"], now, np.packbits(total >= least, bitorder="little").tobytes())
                    now, total = block, np.zeros(size, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(c, "<u4")
        if now is not None:
            yield _row(["block", "map"], now, np.packbits(total >= least, bitorder="little").tobytes())

    return rows.repartition(n, "block").sortWithinPartitions("block").mapInArrow(summed, "block long, map binary")


def _row(names: list[str], *values) -> pa.RecordBatch:
    kinds = {int: pa.int64(), bytes: pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[type(v)]) for v in values], names)


@lru_cache(maxsize=2)
def bit_map(path: str, bits: int) -> _Bits:
    """A written bit map, as booleans that are looked up by place.

    It is written to a file among the executor's own, which all its workers map: they share one copy.
    """
    folder, name = SparkFiles.getRootDirectory(), f"{_MAPS}{hashlib.md5(path.encode()).hexdigest()}"
    while True:
        try:
            with open(os.path.join(folder, name), "rb") as f:
                return _Bits(np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8))
        except FileNotFoundError:
            _write_map(path, bits, folder, name)


def _write_map(path: str, bits: int, folder: str, name: str) -> None:
    """Write a bit map, a block at a time, unless another worker has; but for the newest, older ones go (who still maps one keeps it)."""
    width = max(1, (1 << min(bits, BLOCK_BITS)) >> 3)
    at = os.path.join(folder, name)
    with open(os.path.join(folder, f".{_MAPS}lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if os.path.exists(at):
            return
        held = sorted((f for f in os.scandir(folder) if f.name.startswith(_MAPS)), key=lambda f: f.stat().st_mtime)
        for f in held[: len(held) - MAPS_HELD + 1]:
            os.unlink(f.path)
        with open(at + ".part", "wb") as f:
            f.truncate(1 << max(0, bits - 3))
            for batch in H.read_batches(path, ["block", "map"], 256):
                for block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.seek(block * width)
                    f.write(part)
        os.replace(at + ".part", at)


class _Bits:
    def __init__(self, held: np.ndarray):
        self.held = held

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _blocks(at: np.ndarray, n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted places and their counts, by block."""
    block = at >> BLOCK_BITS
    cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
    low, n = (at & ((1 << BLOCK_BITS) - 1)).astype("<u2"), n.astype("<u4")
    for k in range(0, len(cuts) - 1, 1_000):
        ends = cuts[k : k + 1_001]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[ends[:-1]]), pa.array([low[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())],
            ["block", "at", "n"],
        )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, pairs, triples)`` of each row of a stream: which pairs and triples start where, and are no repeats of the lead."""
    for batch in batches:
        for lead, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(held.as_buffer(), np.uint64)
            if len(ids) < 2:
                yield ids, np.zeros(0, bool), np.zeros(0, bool)
                continue
            two = (ids[:-1] != 0) & (ids[1:] != 0)
            three = two[:-1] & two[1:]
            two[: max(0, lead - 1)] = False
            yield ids, two, three


def _pair(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[at], ids[at + 1]


def _triple(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ids[at], ids[at + 1], ids[at + 2]


def _hot(ids: np.ndarray, two: np.ndarray, three: np.ndarray, pairs: _Bits, triples: _Bits, bits: int) -> tuple[tuple, tuple]:
    """Keys of the pairs and of the triples that are in frequent buckets."""
    at = np.flatnonzero(two)
    at = at[pairs[H.top(H.mix(_pair(ids, at), 0), bits)]]
    far = _hot_triples(ids, three, pairs, bits)
    far = far[triples[H.top(H.mix(_triple(ids, far), 0), bits)]]
    return _pair(ids, at), _triple(ids, far)


def _hot_triples(ids: np.ndarray, three: np.ndarray, pairs: _Bits, bits: int) -> np.ndarray:
    """Starts of the triples of which both pairs are in frequent buckets."""
    at = np.flatnonzero(three)
    at = at[pairs[H.top(H.mix(_pair(ids, at), 0), bits)]]
    return at[pairs[H.top(H.mix(_pair(ids, at + 1), 0), bits)]]


def buckets(rows: DataFrame, bits: int, pairs: str | None) -> DataFrame:
    """``(block, at, n)``: how often buckets of pairs occur or, where a map of ``pairs`` is given, buckets of triples."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bit_map(pairs, bits) if pairs else None
        held, n = [], 0
        for ids, two, three in _rows(batches):
            keys = _triple(ids, _hot_triples(ids, three, known, bits)) if pairs else _pair(ids, np.flatnonzero(two))
            held.append(H.top(H.mix(keys, 0), bits).astype(np.uint32))
            n += len(held[-1])
            if n >= GATHERED:
                yield from _blocks(*_counts(held), bits)
                held, n = [], 0
        if n:
            yield from _blocks(*_counts(held), bits)

    return rows.mapInArrow(found, "block long, at binary, n binary")


def _counts(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(np.concatenate(held), return_counts=True)
    return at.astype(np.int64), n


def occurrences(rows: DataFrame, bits: int, pairs: str, triples: str) -> DataFrame:
    """``(k1, k2, k3, c)``: how often a task finds a pair (``k3`` is 0) or triple that is in a frequent bucket.

    A task makes keys distinct ``KEYS`` at a time and goes on with up to ``MERGED`` of
    them, so a key has a row or several of each task that finds it.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two_known, three_known = bit_map(pairs, bits), bit_map(triples, bits)
        held, n = [], 0
        once: list[tuple] = []
        for ids, two, three in _rows(batches):
            near, far = _hot(ids, two, three, two_known, three_known, bits)
            held += [(*near, np.zeros(len(near[0]), np.uint64)), far]
            n += len(near[0]) + len(far[0])
            if n >= KEYS:
                once.append(_distinct(*map(np.concatenate, zip(*held, strict=True))))
                held, n = [], 0
                if sum(len(x[0]) for x in once) >= MERGED:
                    once = [_distinct(*map(np.concatenate, zip(*once, strict=True)))]
                    if 2 * len(once[0][0]) >= MERGED:  # the frequent ones stay
                        order = np.argsort(-once[0][3], kind="stable")
                        yield from _keyed(tuple(x[order[MERGED // 4 :]] for x in once[0]))
                        once = [tuple(x[order[: MERGED // 4]] for x in once[0])]
        if held:
            once.append(_distinct(*map(np.concatenate, zip(*held, strict=True))))
        if once:
            yield from _keyed(_distinct(*map(np.concatenate, zip(*once, strict=True))))

    return rows.mapInArrow(found, "k1 long, k2 long, k3 long, c long")


def _distinct(k1: np.ndarray, k2: np.ndarray, k3: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Each key once, as far as its hash tells, and the sum of its ``c`` (1 each); those whose hash another key has stay as they are."""
    keys, c = (k1, k2, k3), np.ones(len(k1), np.int64) if c is None else c
    if not len(k1):
        return *keys, c
    mixed = H.mix(keys, 0)
    order = np.argsort(mixed)
    mixed, *keys = (k[order] for k in (mixed, *keys))
    new = np.ones(len(order), bool)
    new[1:] = mixed[1:] != mixed[:-1]
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return *(k[first] for k in keys), np.add.reduceat(c[order], first)


def _keyed(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000].view(np.int64)) for x in rows], ["k1", "k2", "k3", "c"])


#: A phrase's count, and those of its parts before and behind each cut: the words of their keys.
_PARTS = {"l1": ("k1",), "r1": ("k2", "k3"), "l2": ("k1", "k2"), "r2": ("k3",)}
_CUTS = ["k1", "k2", "k3", "a", *_PARTS]
_HELD = ["n", "sizes", "bits", "k1", "k2", "k3", "c"]
_SCORED = "k1 long, k2 long, k3 long, a long, l long, r long, score long, front long, back long"


def _asked(shards: DataFrame, deep: int, least: int) -> DataFrame:
    """``(shard, is_ask, asks)``: phrases that occur often enough, once for each of their parts, in blocks for the shard of that part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                *keys, counts = (np.frombuffer(batch.column(c)[row].as_buffer(), "<u8") for c in ("k1", "k2", "k3", "c"))
                own = np.flatnonzero((counts.view(np.int64) >= least) & (keys[1] != 0))
                for part, words in enumerate(_PARTS.values()):
                    some = own if part < 2 else own[keys[2][own] != 0]  # a pair has one cut
                    cols = dict(zip(("k1", "k2", "k3"), (k[some] for k in keys), strict=True))
                    shard = H.top(H.mix(tuple(cols[w] for w in words), 0), deep)
                    held.append(np.stack([shard, *(k.view(np.int64) for k in cols.values()), counts[some].view(np.int64), np.full(len(some), part)]))
                    n += len(some)
                if n >= PASS_KEYS:
                    yield from _dealt(np.concatenate(held, axis=1))
                    held, n = [], 0
        if n:
            yield from _dealt(np.concatenate(held, axis=1))

    return shards.select("k1", "k2", "k3", "c").mapInArrow(read, "shard long, is_ask int, asks binary")


def _dealt(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns of asks, but for the first, which is their shard, as a block a shard."""
    rows = np.ascontiguousarray(rows[:, np.argsort(rows[0], kind="stable")].T)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]])
    for k in range(0, len(cuts) - 1, 1_000):
        ends = cuts[k : k + 1_001]
        blocks = [rows[a:b, 1:].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[ends[:-1], 0]), pa.array(np.ones(len(blocks), np.int32)), pa.array(blocks, pa.binary())], ["shard", "is_ask", "asks"])


def _answered(asked: DataFrame, shards: DataFrame, deep: int) -> DataFrame:
    """``(k1, k2, k3, a, part, n)``: the counts of parts of phrases, read by slot where their shard is.

    A shard's row comes ahead of the blocks that ask it, of which some ``PASS_KEYS`` asks are held at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: H.Slots | None = None
        left, n = [], 0
        for batch in batches:
            for row, is_ask in enumerate(batch.column("is_ask").to_pylist()):
                if is_ask:
                    left.append(np.frombuffer(batch.column("asks")[row].as_buffer(), np.int64).reshape(-1, 5))
                    n += len(left[-1])
                if n and (not is_ask or n >= PASS_KEYS):
                    yield from _found(held, np.concatenate(left))
                    left, n = [], 0
                if not is_ask:
                    shard, one = batch.column("shard")[row].as_py(), batch.slice(row, 1)
                    held = H.Slots(pa.Table.from_arrays([one.column("shard"), *one.column("held").flatten()], ["shard", *_HELD]), deep, shard, shard + 1)
        if n:
            yield from _found(held, np.concatenate(left))

    size = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = shards.select("shard", F.lit(0).alias("is_ask"), F.lit(None).cast("binary").alias("asks"), F.struct(*_HELD).alias("held"))
    both = told.union(asked.select("shard", "is_ask", "asks", F.lit(None).cast(told.schema["held"].dataType).alias("held")))
    return both.repartition(size, "shard").sortWithinPartitions("shard", "is_ask").mapInArrow(read, "k1 long, k2 long, k3 long, a long, part long, n long")


def _found(held: H.Slots, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = np.zeros(len(asks), np.int64)
    cols = dict(zip(("k1", "k2", "k3", "a", "part"), np.ascontiguousarray(asks.T), strict=True))
    for part, words in enumerate(_PARTS.values()):
        own = np.flatnonzero(cols["part"] == part)
        at = held.find(tuple(cols[w][own].view(np.uint64) for w in words))
        n[own[at >= 0]] = held.counts[at[at >= 0]]
    cols["n"] = n
    for k in range(0, len(n), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols.values()], list(cols))


def _scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cut of least score of each phrase, exact in Python's integers; of equal ones the first."""
    for batch in batches:
        out = []
        for k1, k2, k3, a, l1, r1, l2, r2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            score, left, right = 1_000_000 * a * a // (l1 * r1), l1, r1
            if k3 and (other := 1_000_000 * a * a // (l2 * r2)) < score:
                score, left, right = other, l2, r2
            out.append((k1, k2, k3, a, left, right, score, l2, r1))
        names = [c.split()[0] for c in _SCORED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 9)], names)


def mine(df: DataFrame, least: int = 10, share: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``most`` phrases of two or three words.

    A phrase counts from ``least`` occurrences on, unless a longer one that holds
    its words has ``share`` percent of them.  A null or empty text has no words,
    a null language is ``und``.  Repeated rows count each; a text of any length
    is counted whole.
    """
    spark = df.sparkSession
    prepare(spark)
    with _small_batches(spark):
        return _mined(_documents(df, text_col, lang_col), least, share, most)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Let readers and Arrow hold few rows of a stream at a time, each of which is some 300 KB."""
    held = {k: spark.conf.get(k, None) for k in _BATCHES}
    for k, v in _BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _mined(docs: DataFrame, least: int, share: int, most: int) -> DataFrame:
    spark = docs.sparkSession
    for seed in range(100):
        known = table(words(docs, seed), "words")
        if known.groupBy("h").count().where("count > 1").isEmpty():
            break
        drop(known)
    sizes = known.groupBy("lang").agg(F.sum("f").alias("n"))
    count, frequent = known.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count_if(F.col("f") >= least)).first()
    if not frequent:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    common = known.where(F.col("f") >= least)
    word_bits = min(MAP_BITS, max(BLOCK_BITS, (32 * frequent).bit_length()))
    bits = min(MAP_BITS, max(BLOCK_BITS, count.bit_length()))
    word_map = table(bit_blocks(_word_blocks(common, word_bits), word_bits, 1), "map")
    coded = table(streams(docs, word_map._placelink_path, word_bits, seed), "streams")
    parts = max(spark.sparkContext.defaultParallelism, -(-count // WORDS_A_TASK))
    few = coded.coalesce(parts)
    pairs = table(bit_blocks(buckets(few, bits, None), bits, least), "map")
    triples = table(bit_blocks(buckets(few, bits, pairs._placelink_path), bits, least), "map")
    maps = pairs._placelink_path, triples._placelink_path
    none = F.lit(0).cast("long")
    seen = table(occurrences(few, bits, *maps).union(common.select(F.col("h").alias("k1"), none.alias("k2"), none.alias("k3"), F.col("f").alias("c"))), "occurrences")
    deep = H.shards_for(seen.count())
    shards = table(H.sharded(seen, deep), "slots")
    scored = _counted(shards, deep, least)
    kept = table(scored.join(_covered(scored, share), ["k1", "k2", "k3"], "left_anti"), "kept")
    for gone in (word_map, coded, pairs, triples, seen, shards):
        drop(gone)
    return _ranked(kept, common, sizes, most)


def _word_blocks(common: DataFrame, bits: int) -> DataFrame:
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(H.top(H.mix((batch.column(0).to_numpy().view(np.uint64),), 0), bits))
            yield from _blocks(at, np.ones(len(at), np.int64), bits)

    return common.select("h").mapInArrow(placed, "block long, at binary, n binary")


def _counted(shards: DataFrame, deep: int, least: int) -> DataFrame:
    """Frequent phrases with their best cut; each part's count is asked for where it is, so the shards are gone through once."""
    told = _answered(_asked(shards, deep, least), shards, deep)
    count = lambda part: F.max(F.when(F.col("part") == part, F.col("n")).otherwise(0))
    cuts = told.groupBy("k1", "k2", "k3").agg(F.max("a").alias("a"), *(count(k).alias(c) for k, c in enumerate(_PARTS)))
    return table(cuts.select(*_CUTS).mapInArrow(_scored, _SCORED), "scored")


def _covered(scored: DataFrame, share: int) -> DataFrame:
    """Pairs that stand inside a triple with ``share`` percent of their occurrences."""
    three = scored.where("k3 <> 0")
    inside = lambda a, b, f: three.where(100 * F.col("a") >= share * F.col(f)).select(F.col(a).alias("k1"), F.col(b).alias("k2"), F.lit(0).cast("long").alias("k3"))
    return inside("k1", "k2", "front").union(inside("k2", "k3", "back")).distinct()


def _ranked(kept: DataFrame, common: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """The first of each language; words are joined to those only that reach the score of the last one."""
    lang = common.select(F.col("h").alias("k1"), "lang", F.col("word").alias("w1"))
    known = table(kept.join(lang, "k1"), "ranked")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "k1", "k2", "k3")
    last = known.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    some = known.join(last, "lang").where(F.struct("score", "a") >= F.col("last"))
    for column, name in (("k2", "w2"), ("k3", "w3")):
        some = some.join(common.select(F.col("h").alias(column), F.col("word").alias(name)), column, "left")
    some = some.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = some.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
