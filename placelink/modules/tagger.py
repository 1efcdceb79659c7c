"""A trainable tagger of place names: an averaged perceptron over label sequences, decoded by Viterbi.

Texts are cut into sequences of words, words become hashed features, and each
word gets a label that begins, continues or leaves a span.  Training mixes
parameters: in each epoch every partition goes on from the common weights with
its own texts, and the weights of all are averaged by numbers of sequences.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.modules.base import Recognizer
from placelink.modules.sums import summed
from placelink.modules.recognizers import SPANS
from placelink.operators import spans
from placelink.session import scratch, ship
from placelink.storage import Storage

#: Hashed features, words of a sequence, sequences that are learnt from together, those that are tagged together, and code
#: points of texts that are cut into words together.
FEATURES, LONGEST, TOGETHER, TAGGED, TEXTS = 1 << 15, 64, 64, 1024, 1 << 18
#: Ahead of a place in a text: the number of the text.
_TEXT = 1 << 40

_SHAPES = [(re.compile(r"\d"), "0"), (re.compile(r"[^\W\d_]"), "a"), (re.compile(r"(.)\1+"), r"\1")]
_PREFIX = {k: zlib.crc32(f"{k} ".encode()) for k in "wsphba"}


@lru_cache(maxsize=200_000)
def _own(word: str, features: int) -> tuple[int, ...]:
    """Features of a word alone: itself, its ends, its shape; and of a word beside it."""
    low = word.lower()
    if word.isalpha():
        shape = "a"
    else:
        shape = word
        for pattern, by in _SHAPES:
            shape = pattern.sub(by, shape)
    whole, crc, p = low.encode(), zlib.crc32, _PREFIX
    ends = (crc(low[-3:].encode(), p["s"]), crc(low[:3].encode(), p["p"]), crc(shape.encode(), p["h"]))
    return tuple(c % features for c in (crc(whole, p["w"]), *ends, crc(whole, p["b"]), crc(whole, p["a"])))


def _owns(words: list[str], features: int) -> np.ndarray:
    """:func:`_own` of many words."""
    crc, p = zlib.crc32, _PREFIX
    low = [w.lower() for w in words]
    whole = [w.encode() for w in low]
    out = np.empty((len(words), 6), np.int64)
    for k, c in ((0, "w"), (4, "b"), (5, "a")):
        start = p[c]
        out[:, k] = [crc(w, start) for w in whole]
    start = p["s"]
    out[:, 1] = [crc(w[-3:] if len(w) == len(t) else t[-3:].encode(), start) for w, t in zip(whole, low, strict=True)]
    start = p["p"]
    out[:, 2] = [crc(w[:3] if len(w) == len(t) else t[:3].encode(), start) for w, t in zip(whole, low, strict=True)]
    out[:, 3] = crc(b"a", p["h"])
    for k, w in enumerate(words):
        if not w.isalpha():
            out[k, 3] = _own(w, 1 << 32)[3]
    return out % features


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is: 0 a blank, 1 of a word, 2 a word by itself."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), 2, np.uint8)
    for pattern, kind in ((r"\w+", 1), (r"\s+", 0)):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


class Words:
    """Words of some texts, one after another: the text, start, end and sequence of each, and sizes of sequences."""

    def __init__(self, texts: list[str]):
        whole = "\n".join(texts)
        points, raw = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.frombuffer(whole.encode(), np.uint8)
        kind = _kinds()[points]
        inside, alone = kind == 1, kind == 2
        edge = inside[1:] != inside[:-1]
        begun, done = inside | alone, inside | alone
        begun[1:] &= edge | alone[1:]
        done[:-1] &= edge | alone[:-1]
        start, end = np.flatnonzero(begun), np.flatnonzero(done) + 1
        first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)) if len(raw) > len(points) else np.arange(len(raw) + 1)
        held = raw[np.repeat(kind > 0, np.diff(first))]
        cuts = np.append(0, np.cumsum(first[end] - first[start])).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(cuts), pa.py_buffer(held)).dictionary_encode()
        self.ids, self.known = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        size = np.array([len(t) + 1 for t in texts], np.int64)
        base = np.cumsum(size) - size
        self.text = np.searchsorted(base, start, "right") - 1
        self.start, self.end = start - base[self.text], end - base[self.text]
        stop = (points == 33) | (points == 46) | (points == 63)
        ends = np.sort(np.concatenate([np.flatnonzero(stop[:-1] & (kind[1:] == 0)) + 2, np.flatnonzero(points == 10) + 1]))
        # a sentence is told by how many ends lie before its words
        group = np.searchsorted(ends, start, "right")
        at = np.arange(len(self.ids))
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (self.text[1:] != self.text[:-1])
        self.first = new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0)
        self.sizes = np.diff(np.append(np.flatnonzero(self.first), len(at)))

    def features(self, features: int = FEATURES) -> np.ndarray:
        """The features of each word: its own four, one of the word before and one of the word after."""
        told = _owns(self.known, features)[self.ids]
        edge = zlib.crc32(b"edge") % features
        out = told.copy()
        last = np.append(self.first[1:], True)[: len(out)]
        out[1:, 4], out[:-1, 5] = told[:-1, 4], told[1:, 5]
        out[self.first, 4], out[last, 5] = edge, edge
        return out


def _by_size(features: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same sequences, shorter ones first: those that are decoded together take as many steps as the longest has words."""
    order = np.argsort(sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(labels))
    return features[at], labels[at], sizes


def _batched(texts: Iterable[tuple]) -> Iterator[list[tuple]]:
    """``(text, ...)`` rows by some ``TEXTS`` code points."""
    held, size = [], 0
    for row in texts:
        held.append(row)
        size += len(row[0])
        if size >= TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Words as (start, end), cut at ends of sentences and at ``LONGEST`` words."""
    words = Words([text])
    spans_ = list(zip(words.start.tolist(), words.end.tolist(), strict=True))
    ends = np.cumsum(words.sizes).tolist()
    return [spans_[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def featured(text: str, words: list[tuple[int, int]], features: int = FEATURES) -> np.ndarray:
    """The features of each word: its own four, one of the word before and one of the word after."""
    own = [_own(text[a:b], features) for a, b in words]
    edge = zlib.crc32(b"edge") % features
    return np.array([[*o[:4], own[k - 1][4] if k else edge, own[k + 1][5] if k + 1 < len(own) else edge] for k, o in enumerate(own)], np.int64)


class Tagger:
    """Weights of features by label, and of a label after another; the last row of ``after`` begins a sequence."""

    def __init__(self, kinds: list[str], weights: np.ndarray | None = None, after: np.ndarray | None = None):
        self.kinds = list(kinds)
        n = 1 + 2 * len(self.kinds)  # outside, then begin and continue for each kind
        self.weights = np.zeros((FEATURES, n)) if weights is None else weights
        self.after = np.zeros((n + 1, n)) if after is None else after
        self.banned = np.zeros((n + 1, n))  # a span continues only in its own kind
        for k in range(len(self.kinds)):
            self.banned[:, 2 + 2 * k] = -1e9
            self.banned[1 + 2 * k : 3 + 2 * k, 2 + 2 * k] = 0

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.after.ravel()])

    @classmethod
    def of(cls, kinds: list[str], flat: np.ndarray) -> Tagger:
        n = 1 + 2 * len(kinds)
        return cls(kinds, flat[: FEATURES * n].reshape(FEATURES, n).copy(), flat[FEATURES * n :].reshape(n + 1, n).copy())

    def decode(self, held: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of sequences of features."""
        size = np.array([len(f) for f in held])
        return np.split(self.best(np.concatenate(held), size), np.cumsum(size)[:-1])

    def best(self, features: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best labels of sequences of these sizes, one after another; all at once step by step, longest first."""
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(int(size.max())), "left").tolist()  # sequences longer than each place
        ends = np.append(0, np.cumsum(live))
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        place = np.arange(len(features)) - np.repeat(np.cumsum(size) - size, size)
        at = ends[place] + np.repeat(rank, size)  # words lie by place, then by sequence
        emitted = np.empty((len(features), self.after.shape[1]))
        total = self.weights.take(features[:, 0], axis=0)
        for k in range(1, features.shape[1]):
            total += self.weights.take(features[:, k], axis=0)
        emitted[at] = total
        step = self.after + self.banned
        into = np.ascontiguousarray(step[:-1].T)
        starts = ends.tolist()
        score = emitted[: live[0]] + step[-1]
        back: list[np.ndarray] = []
        for k, i, j in zip(live[1:], starts[1:], starts[2:], strict=False):
            each = score[:k, None, :] + into
            back.append(each.argmax(axis=2))
            np.max(each, axis=2, out=score[:k])
            score[:k] += emitted[i:j]
        now = score.argmax(axis=1)  # labels at the place of those that reach it, at their last one of the others
        labels = np.empty(len(features), np.int64)
        rows = np.arange(len(size))
        for t in range(len(live) - 1, 0, -1):
            k = live[t]
            labels[starts[t] : starts[t + 1]] = now[:k]
            now[:k] = back[t - 1][rows[:k], now[:k]]
        labels[: live[0]] = now
        return labels[at]

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of all texts: the text's number, start, end and kind of each."""
        out = [(np.zeros(0, np.int64),) * 4]
        done = 0
        for held in _batched((t,) for t in texts):
            words = Words([t for (t,) in held])
            if len(words.ids):
                cuts = np.append(np.cumsum(words.sizes)[TAGGED - 1 :: TAGGED], len(words.ids))
                features, labels, at = words.features(), np.zeros(len(words.ids), np.int64), 0
                for k, end in enumerate(cuts.tolist()):
                    if end > at:
                        labels[at:end] = self.best(features[at:end], words.sizes[k * TAGGED : (k + 1) * TAGGED])
                    at = end
                here, last = self._ends(labels)
                out.append((words.text[here] + done, words.start[here], words.end[last], labels[here] // 2))
            done += len(held)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Labelled spans of each text."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for k, a, b, kind in zip(*(c.tolist() for c in self.found(texts)), strict=True):
            out[k].append((a, b, self.kinds[kind]))
        return out

    @staticmethod
    def _ends(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first and of the last word of each span."""
        other = np.flatnonzero((labels % 2 == 1) | (labels == 0))  # all but words that continue a span
        last = np.append(other[1:], len(labels)) - 1
        begun = labels[other] % 2 == 1
        return other[begun], last[begun]

    def _spans(self, words: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, str]]:
        return [(words[i][0], words[j][1], self.kinds[labels[i] // 2]) for i, j in zip(*(c.tolist() for c in self._ends(labels)), strict=True)]

    def gold(self, words: list[tuple[int, int]], entities: list) -> np.ndarray:
        """Labels of the words of a sequence by entities in order; a word is in an entity that it overlaps."""
        a, b = np.array(words, np.int64).reshape(-1, 2).T
        first = np.zeros(len(words), bool)
        first[:1] = True
        kind = np.array([self.kinds.index(e["label"]) if e["label"] in self.kinds else -1 for e in entities], np.int64)
        return self.labels(a, b, first, *(np.array([e[k] for e in entities], np.int64) for k in ("start", "end")), kind)

    @staticmethod
    def labels(a: np.ndarray, b: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Labels of words from ``a`` to ``b``, in order, by entities in order; ``first`` words begin sequences."""
        out = np.zeros(len(a), np.int64)
        if not len(start) or not len(a):
            return out
        at = np.searchsorted(np.maximum.accumulate(end), a, "right")  # the first entity that ends behind the word's start
        own = np.minimum(at, len(start) - 1)
        held = (at < len(start)) & (start[own] < b) & (kind[own] >= 0)
        inside = np.zeros(len(a), bool)
        inside[1:] = held[:-1] & (at[1:] == at[:-1]) & ~first[1:]
        out[held] = 1 + 2 * kind[own[held]] + inside[held]
        return out

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
        """Averaged weights after an epoch over ``(features, labels, sizes)``, times the number of sequences, and that number."""
        late_w, late_a, steps, count = np.zeros_like(self.weights), np.zeros_like(self.after), 1, 0
        n = self.after.shape[1]
        for features, want, size in batches:
            got = self.best(features, size)
            wrong = np.flatnonzero(want != got)
            if len(wrong):
                seq = np.repeat(np.arange(len(size)), size)
                first = np.cumsum(size) - size
                before = np.empty((2, len(want)), np.int64)
                for row, labels in zip(before, (want, got), strict=True):
                    row[1:], row[first] = labels[:-1], n
                of = np.zeros(len(size), bool)
                of[seq[wrong]] = True
                path = np.flatnonzero(of[seq])
                for at, cells, weights, late in ((wrong, None, self.weights, late_w), (path, before, self.after, late_a)):
                    # sequence by sequence, what is wanted before what was found: sums round as if one by one
                    order = np.argsort(np.concatenate([2 * seq[at], 2 * seq[at] + 1]), kind="stable")
                    to = np.concatenate([want[at], got[at]])
                    cell = np.concatenate([features[at]] * 2) * n + to[:, None] if cells is None else (cells[:, at].ravel() * n + to)[:, None]
                    by = np.repeat(np.where(order < len(at), 1.0, -1.0), cell.shape[1])
                    np.add.at(weights.reshape(-1), cell[order].ravel(), by)
                    np.add.at(late.reshape(-1), cell[order].ravel(), by * steps)
            count += len(size)
            steps += 1
        mean = np.concatenate([(self.weights - late_w / steps).ravel(), (self.after - late_a / steps).ravel()])
        return mean * count, count

    def drawn(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(features, labels, sizes)`` of ``TOGETHER`` sequences at a time of ``batches(text, entities)``."""
        kept = (np.zeros((0, 6), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        kinds = pa.array(self.kinds, pa.string())

        def rows() -> Iterator[tuple]:
            for batch in batches:
                listed = batch.column(1)
                flat = listed.flatten()
                size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(size)
                start, end = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
                kind = pc.fill_null(pc.index_in(pc.struct_field(flat, "label"), value_set=kinds), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                for text, i, j in zip(batch.column(0).to_pylist(), (ends - size).tolist(), ends.tolist(), strict=True):
                    yield text, start[i:j], end[i:j], kind[i:j]

        for held in _batched(rows()):
            words = Words([r[0] for r in held])
            shift = words.text * _TEXT
            start, end = (np.concatenate([k * _TEXT + r[c] for k, r in enumerate(held)]) for c in (1, 2))
            labels = self.labels(shift + words.start, shift + words.end, words.first, start, end, np.concatenate([r[3] for r in held]))
            kept = _by_size(*(np.concatenate(c) for c in zip(kept, (words.features(), labels, words.sizes), strict=True)))
            ends, full = np.append(0, np.cumsum(kept[2])), len(kept[2]) // TOGETHER * TOGETHER
            for k in (np.random.default_rng(full).permutation(full // TOGETHER) * TOGETHER).tolist():
                own = slice(ends[k], ends[k + TOGETHER])
                yield kept[0][own], kept[1][own], kept[2][k : k + TOGETHER]
            kept = kept[0][ends[full] :], kept[1][ends[full] :], kept[2][full:]
        if len(kept[2]):
            yield kept

    def save(self, spark, path: str) -> None:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights, after=self.after, kinds=np.array(self.kinds))
        Storage(spark, path).write("tagger.npz", out.getvalue())

    @classmethod
    def load(cls, spark, path: str) -> Tagger:
        held = np.load(io.BytesIO(Storage(spark, path).data("tagger.npz")), allow_pickle=False)
        return cls(held["kinds"].tolist(), held["weights"], held["after"])


def train(examples: DataFrame, kinds: list[str], epochs: int = 4) -> Tagger:
    """A tagger from ``examples(text, entities)`` as of :func:`spans.training_set`.

    Entities of other kinds count as none; null texts are left out.
    """
    spark = examples.sparkSession
    store = Storage(spark, scratch(spark, "training"))
    ship(spark)
    examples.where("text is not null").select("text", "entities").write.parquet(store.path("set"))  # read once an epoch
    rows = spark.read.parquet(store.path("set"))
    tagger = Tagger(kinds)
    for _ in range(epochs):
        begun = tagger.flat

        def epoch(batches: Iterator[pa.RecordBatch], begun: np.ndarray = begun) -> np.ndarray | None:
            own = Tagger.of(kinds, begun)
            total, count = own.learn(own.drawn(batches))
            return np.append(total, count) if count else None

        total = summed(rows, epoch, len(begun) + 1)
        if not total[-1]:
            raise ValueError("no training examples: there are no texts")
        tagger = Tagger.of(kinds, total[:-1] / total[-1])
    store.delete("set")
    return tagger


class TaggerRecognizer(Recognizer):
    """Spans that a :class:`Tagger` finds; of its labels only ``entity_types`` count."""

    NAME = "TaggerRecognizer"

    def __init__(self, tagger: Tagger | None, label: str, entity_types: tuple[str, ...] = ("LOC",), epochs: int = 4):
        super().__init__(label=label, entity_types=list(entity_types), epochs=epochs)
        self.tagger = tagger

    def entities(self, documents: DataFrame) -> DataFrame:
        """``(document_id, start, end, label)`` of all that the tagger finds; a null text has none."""
        if self.tagger is None:
            raise ValueError(f"{self} has not been trained")
        ship(documents.sparkSession)
        tagger = self.tagger

        kind = dict(documents.dtypes)["document_id"]
        kinds = pa.array(tagger.kinds, pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, start, end, label = tagger.found(pc.fill_null(batch.column(1), "").to_pylist())
                columns = [batch.column(0).take(pa.array(at)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), kinds.take(pa.array(label))]
                yield pa.RecordBatch.from_arrays(columns, ["document_id", "start", "end", "label"])

        return documents.select("document_id", "text").mapInArrow(run, f"document_id {kind}, start int, `end` int, label string")

    def predict(self, documents: DataFrame) -> DataFrame:
        found = spans.of_types(self.entities(documents), self.config["entity_types"])
        listed = found.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
        return documents.select("document_id").join(listed, "document_id", "left").select("document_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

    def fit(self, examples: DataFrame, output_path: str, label: str | None = None) -> TaggerRecognizer:
        """Train on ``examples(document_id, document, start, end)`` and save.

        Spans have the labels that the present tagger gives them; without one,
        and where it gives none, the first of ``entity_types``.
        """
        kinds = self.config["entity_types"]
        rows = examples.where("start is not null")
        if rows.isEmpty():
            raise ValueError("no training examples: the documents have no spans")
        documents = examples.select("document_id", F.col("document").alias("text")).distinct()
        if self.tagger is None:
            labelled = rows.select("document_id", "start", "end").distinct().withColumn("label", F.lit(kinds[0]))
        else:
            labelled = spans.distilled(rows, self.entities(documents), kinds, kinds[0])
        tagger = train(spans.training_set(documents, labelled), kinds, self.config["epochs"])
        tagger.save(examples.sparkSession, output_path)
        return TaggerRecognizer(tagger, label or f"{self.config['label']}-fitted", tuple(kinds), self.config["epochs"])

    @classmethod
    def load(cls, spark, path: str, label: str, entity_types: tuple[str, ...] | None = None) -> TaggerRecognizer:
        """A recognizer with a tagger that was saved."""
        tagger = Tagger.load(spark, path)
        return cls(tagger, label, entity_types or tuple(tagger.kinds))
