"""A trainable encoder: two towers over sub-word n-grams, one for contexts and one for descriptions.

A tower adds up the vectors of a text's words and letter n-grams, hashed into
buckets, and scales the sum to unit length.  Training is contrastive: a context
is to be nearer to its right description than to those of the other candidates
of its name and to all others of its batch.  Each step sums the gradients of
all partitions up a tree; the towers are what the driver holds.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.modules.sums import summed
from placelink.storage import Storage

#: Buckets and components of a tower, lengths of letter n-grams, and what similarities are divided by.
BUCKETS, DIMENSIONS, LETTERS, HEAT = 1 << 13, 48, (3, 4), 0.1
#: Pairs that are compared with each other.
BATCH = 256


@lru_cache(maxsize=200_000)
def _buckets(word: str, buckets: int) -> tuple[int, ...]:
    marked = f"^{word}$"
    parts = [f"w{word}", *(marked[k : k + n] for n in LETTERS for k in range(len(marked) - n + 1))]
    return tuple(zlib.crc32(p.encode()) % buckets for p in parts)


def bucketed(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' parts, and the number of the text that each belongs to."""
    each = [[b for w in re.findall(r"\w+", t.lower()) for b in _buckets(w, buckets)] for t in texts]
    return np.array([b for e in each for b in e], np.int64), np.repeat(np.arange(len(texts)), [len(e) for e in each])


class TwoTowers:
    """Encoders ``context`` and ``description``; both begin as one random projection of the buckets."""

    def __init__(self, towers: np.ndarray | None = None, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 0):
        if towers is None:
            one = np.random.default_rng(seed).standard_normal((buckets, dimensions)) / np.sqrt(dimensions)
            towers = np.stack([one, one])
        self.towers = towers

    def _vectors(self, tower: int, at: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((n, self.towers.shape[2]))
        np.add.at(x, of, self.towers[tower][at])
        size = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
        return x / size, size

    def encode(self, texts: list[str], tower: int) -> np.ndarray:
        return self._vectors(tower, *bucketed(texts, self.towers.shape[1]), len(texts))[0]

    def context(self, texts: list[str]) -> list[list[float]]:
        return self.encode(texts, 0).astype(np.float32).tolist()

    def description(self, texts: list[str]) -> list[list[float]]:
        return self.encode(texts, 1).astype(np.float32).tolist()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.context(texts)

    def slope(self, contexts: list[str], descriptions: list[str], right: np.ndarray) -> tuple[np.ndarray, float, int]:
        """Gradient of both towers, loss and number of contexts; ``right[i, j]``: description j is right for context i."""
        sides = [bucketed(t, self.towers.shape[1]) for t in (contexts, descriptions)]
        (c, c_size), (d, d_size) = (self._vectors(k, *side, len(t)) for k, (side, t) in enumerate(zip(sides, (contexts, descriptions), strict=True)))
        s = c @ d.T / HEAT
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        want = p * right
        hit = want.sum(axis=1, keepdims=True)
        want /= np.maximum(hit, 1e-12)
        miss = (p - want) / HEAT
        out = np.zeros_like(self.towers)
        for k, (g, own, size) in enumerate(((miss @ d, c, c_size), (miss.T @ c, d, d_size))):
            g = (g - (g * own).sum(axis=1, keepdims=True) * own) / size
            at, of = sides[k]
            np.add.at(out[k], at, g[of])
        return out, float(-np.log(np.maximum(hit, 1e-12)).sum()), len(contexts)

    def save(self, spark, path: str) -> None:
        out = io.BytesIO()
        np.savez_compressed(out, towers=self.towers.astype(np.float32))
        Storage(spark, path).write("towers.npz", out.getvalue())

    @classmethod
    def load(cls, spark, path: str) -> TwoTowers:
        return cls(np.load(io.BytesIO(Storage(spark, path).data("towers.npz")), allow_pickle=False)["towers"].astype(np.float64))


def trained(pairs: DataFrame, epochs: int = 20, rate: float = 0.3, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 0) -> TwoTowers:
    """Towers from ``pairs(ref_id, context, description, label)``, as :func:`resolve.training_pairs` makes them.

    References are dealt out by hash, so that a batch's other descriptions are
    chance ones; a reference without a right description is left out.  The steps
    are those of Adagrad, of the summed gradient of all references.
    """
    told = pairs.groupBy("ref_id", "context").agg(F.collect_set(F.when(F.col("label") == 1, F.col("description"))).alias("right"), F.collect_set(F.when(F.col("label") != 1, F.col("description"))).alias("wrong"))
    rows = told.where(F.size("right") > 0).select("context", "right", "wrong", F.xxhash64("ref_id").alias("h")).repartition("h").sortWithinPartitions("h").select("context", "right", "wrong").cache()
    towers = TwoTowers(None, buckets, dimensions, seed)
    seen = np.zeros_like(towers.towers)
    try:
        for _ in range(epochs):
            now = towers.towers

            def epoch(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> np.ndarray | None:
                own, total, waiting, size = TwoTowers(now), np.zeros(now.size + 2), [], 0

                def told() -> None:
                    listed: dict[str, int] = {}
                    for _, right, wrong in waiting:
                        for text in (*right, *wrong):
                            listed.setdefault(text, len(listed))
                    right = np.zeros((len(waiting), len(listed)))
                    for k, (_, good, _) in enumerate(waiting):
                        right[k, [listed[t] for t in good]] = 1
                    slope, loss, n = own.slope([w[0] for w in waiting], list(listed), right)
                    total[:-2] += slope.ravel()
                    total[-2:] += loss, n

                for batch in batches:
                    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        waiting.append(row)
                        size += len(row[1]) + len(row[2])
                        if len(waiting) >= BATCH or size >= 4 * BATCH:
                            told()
                            waiting, size = [], 0
                if waiting:
                    told()
                return total if total[-1] else None

            total = summed(rows, epoch, now.size + 2)
            if not total[-1]:
                raise ValueError("no training pairs: no reference has a right description")
            slope = total[:-2].reshape(now.shape) / total[-1]
            seen += slope * slope
            towers = TwoTowers(now - rate * slope / np.sqrt(seen + 1e-10))
    finally:
        rows.unpersist()
    return towers
