"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over overlapping chunks that cover the
whole document.  Each filter is max-pooled per chunk; the mean and the maximum
over the chunks go through one logistic unit.  It is fitted on the driver on a
bounded sample of labelled rows and scores every text where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from placelink.llm.common import prepare, table

#: Bytes of a filter, bytes between its places, bytes of a chunk's half, filters, bytes' dimensions.
WIDTH, STRIDE, HALF, FILTERS, EMBED = 8, 1, 128, 16, 8
#: The sample learnt from: so many labelled rows at most, none of more bytes than this.
MAX_ROWS, MAX_BYTES = 3_000, 32_768
EPOCHS, BATCH, RATE = 10, 64, 0.01
#: Halves of a segment of a long text, and bytes of texts that are scored together.
SEGMENT, TOGETHER = 2_048, 1 << 18
THRESHOLD = 0.7
_PER = HALF // STRIDE


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 256, FILTERS): what a byte adds at a place of the filters
    bias: np.ndarray
    head: np.ndarray  # of means, then of maxima
    offset: float


class Pages:
    """Texts laid out in halves of chunks, zero bytes between them."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.halves = (self.lengths + WIDTH - 1) // HALF + 1
        self.first = np.concatenate([[0], np.cumsum(self.halves)]).astype(np.int64)
        self.data = np.zeros(int(self.first[-1]) * HALF + WIDTH, np.uint8)
        for at, text in zip(self.first.tolist(), texts, strict=False):
            self.data[at * HALF : at * HALF + len(text)] = np.frombuffer(text, np.uint8)
        starts = np.arange(0, int(self.first[-1]) * HALF, STRIDE)
        owner = np.repeat(np.arange(len(texts)), self.halves * _PER)
        self.beyond = starts - self.first[owner] * HALF >= np.maximum(self.lengths[owner], 1)
        # chunks: each half with its follower; the only half of a text alone
        self.chunks = np.maximum(self.halves - 1, 1)
        self.chunk_first = np.concatenate([[0], np.cumsum(self.chunks)]).astype(np.int64)
        inner = np.arange(int(self.chunk_first[-1])) - np.repeat(self.chunk_first[:-1], self.chunks)
        self.left = np.repeat(self.first[:-1], self.chunks) + inner
        self.right = np.minimum(self.left + 1, np.repeat(self.first[1:], self.chunks) - 1)

    def pairs(self, k: int) -> np.ndarray:
        """Two successive bytes of each place, as one number."""
        a = self.data[k : k + len(self.beyond) * STRIDE : STRIDE].astype(np.int32)
        return a * 256 + self.data[k + 1 : k + 1 + len(self.beyond) * STRIDE : STRIDE]


def pair_tables(model: Model) -> list[np.ndarray]:
    """What two successive bytes add, for each pair of places."""
    return [(model.table[k][:, None, :] + model.table[k + 1][None, :, :]).reshape(65_536, FILTERS) for k in range(0, WIDTH, 2)]


def _pooled(pages: Pages, tables: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Activations ``(halves, places, filters)`` and their maxima a half."""
    held = np.take(tables[0], pages.pairs(0), axis=0)
    for k in range(1, len(tables)):
        held += np.take(tables[k], pages.pairs(2 * k), axis=0)
    held[pages.beyond] = -np.inf
    held = held.reshape(-1, _PER, FILTERS)
    return held, held.max(axis=1) + bias


def _features(pages: Pages, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chunk = np.maximum(np.maximum(top[pages.left], top[pages.right]), 0)
    at = pages.chunk_first[:-1]
    mean = np.add.reduceat(chunk, at, axis=0) / pages.chunks[:, None]
    return chunk, np.concatenate([mean, np.maximum.reduceat(chunk, at, axis=0)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(texts: list[bytes], model: Model, tables: list[np.ndarray]) -> np.ndarray:
    pages = Pages(texts)
    _, top = _pooled(pages, tables, model.bias)
    return _sigmoid(_features(pages, top)[1].astype(np.float64) @ model.head + model.offset)


def probability(text: bytes, model: Model, tables: list[np.ndarray]) -> float:
    """The same of one text, walked in segments; only the maxima of its halves are held whole."""
    parts, at = [], 0
    while at + SEGMENT * HALF < len(text):
        # places up to the segment's end look WIDTH - 1 bytes beyond it
        pages = Pages([text[at : at + SEGMENT * HALF + WIDTH]])
        parts.append(_pooled(pages, tables, model.bias)[1][:SEGMENT])
        at += SEGMENT * HALF
    parts.append(_pooled(Pages([text[at:]]), tables, model.bias)[1])
    top = np.concatenate(parts)
    chunk = np.maximum(np.maximum(top[:-1], top[1:]) if len(top) > 1 else top, 0)
    feats = np.concatenate([np.add.reduceat(chunk, [0], axis=0)[0] / np.int64(len(chunk)), chunk.max(axis=0)])
    return float(_sigmoid(feats.astype(np.float64) @ model.head + model.offset))


def fit(texts: list[bytes], labels: list[int], seed: int = 0, epochs: int = EPOCHS) -> Model:
    """Fit on texts and 0/1 labels; one class alone gives its rate, no rows keep everything."""
    y = np.array(labels, np.float64)
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 0.35, (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "head": rng.normal(0, 0.1, 2 * FILTERS),
        "offset": np.zeros(1),
    }
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 30.0)
    p["offset"][0] = np.log(y.mean() / (1 - y.mean()))
    step = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    t, total = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            grads = _gradients(p, Pages([texts[k] for k in own]), y[own])
            t += 1
            rate = RATE * (1 - 0.9 * t / total)
            for k, g in grads.items():
                m, v = step[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    table = np.einsum("be,wef->wbf", p["embed"], p["filters"]).astype(np.float32)
    return Model(table, p["bias"].astype(np.float32), p["head"], float(p["offset"][0]))


def _gradients(p: dict[str, np.ndarray], pages: Pages, y: np.ndarray) -> dict[str, np.ndarray]:
    table = np.einsum("be,wef->wbf", p["embed"], p["filters"]).astype(np.float32)
    n = len(pages.beyond)
    held = np.zeros((n, FILTERS), np.float32)
    for k in range(WIDTH):
        held += table[k][pages.data[k : k + n * STRIDE : STRIDE]]
    held[pages.beyond] = -np.inf
    held = held.reshape(-1, _PER, FILTERS)
    place = held.argmax(axis=1)
    top = np.take_along_axis(held, place[:, None, :], axis=1)[:, 0, :] + p["bias"].astype(np.float32)
    place += (np.arange(len(place)) * _PER)[:, None]
    chunk, feats = _features(pages, top)
    miss = (_sigmoid(feats @ p["head"] + p["offset"][0]) - y) / len(y)
    back = miss[:, None] * p["head"][None, :]
    doc = np.repeat(np.arange(len(y)), pages.chunks)
    g = back[doc, :FILTERS] / pages.chunks[doc][:, None]
    best = chunk == feats[doc, FILTERS:]  # overlapping chunks can share a best place
    g += back[doc, FILTERS:] * best / np.add.reduceat(best, pages.chunk_first[:-1], axis=0, dtype=np.int64)[doc]
    g *= chunk > 0
    from_left = top[pages.left] >= top[pages.right]
    where = np.where(from_left, place[pages.left], place[pages.right])
    kernel = np.broadcast_to(np.arange(FILTERS), where.shape)
    on = g != 0
    where, kernel, weight = where[on], kernel[on], g[on]
    grown = np.empty((WIDTH, 256, FILTERS))
    for k in range(WIDTH):
        grown[k] = np.bincount(pages.data[where * STRIDE + k].astype(np.int64) * FILTERS + kernel, weights=weight, minlength=256 * FILTERS).reshape(256, FILTERS)
    return {
        "embed": np.einsum("wbf,wef->be", grown, p["filters"]),
        "filters": np.einsum("be,wbf->wef", p["embed"], grown),
        "bias": np.bincount(kernel, weights=weight, minlength=FILTERS),
        "head": feats.T @ miss + 1e-4 * p["head"],
        "offset": np.array([miss.sum()]),
    }


def held_out(ident: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled rows that are not held out.

    Of those with texts of at most ``max_bytes`` bytes the ``max_rows`` whose
    ids hash least are taken, which bounds what reaches the driver.  Null
    labels and ids, and ids with labels that contradict each other, are left
    out; of an id with several texts all that are short enough count.
    """
    told = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    told = told.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    told = table(told.select(F.col("doc_id").alias("label_id"), "y"), "labelled")
    # max_rows rows of two numbers
    found = rows.join(F.broadcast(told), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y").distinct().orderBy("doc_id", "text").limit(max_rows)
    sample = [(r["text"], r["y"]) for r in found.toLocalIterator()]
    return fit([t.encode("utf-8", "surrogatepass") for t, _ in sample], [int(y > 0) for _, y in sample])


_tables: dict[bytes, list[np.ndarray]] = {}


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``(id, score)`` of every whole text, or with ``keep`` all columns and ``_score``.

    A null text counts as empty; empty texts have a score too; null ids stay
    null; rows that repeat come as often; an empty table gives none.
    """
    prepare(df.sparkSession)
    rows = df if keep else df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    at_text = rows.columns.index(text_col if keep else "text")
    names = [*rows.columns, "_score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = model.table.tobytes()
        if mark not in _tables:
            _tables.clear()
            _tables[mark] = pair_tables(model)
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(at_text)]
            out, at = np.empty(len(texts)), 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                if size > TOGETHER:
                    out[at] = probability(texts[at], model, _tables[mark])
                else:
                    while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                        size += len(texts[end])
                        end += 1
                    out[at:end] = probabilities(texts[at:end], model, _tables[mark])
                at = end
            held = [*batch.columns, pa.array(out)] if keep else [batch.column(0), pa.array(out)]
            yield pa.RecordBatch.from_arrays(held, names if keep else ["id", "_score"])

    shape = StructType([*(f for f in rows.schema.fields if keep or f.name == "id"), StructField("_score", DoubleType())])
    found = rows.mapInArrow(scan, shape)
    return found if keep else found.withColumnRenamed("_score", "score")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    found = score(docs, train(docs, labels))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
