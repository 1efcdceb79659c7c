"""Resolvers: references to rows of a gazetteer."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.modules.base import Resolver
from placelink.modules.encoder import trained
from placelink.operators import resolve
from placelink.session import ship
from placelink.storage import Storage


class ManualResolver(Resolver):
    """Locations given for spans of texts; the settings are the label alone.

    Of spans given twice for a text the first counts.
    """

    NAME = "ManualResolver"

    def __init__(self, label: str, texts: list[str], references: list[list[tuple[int, int]]], referents: list[list[tuple[str, str] | None]]):
        super().__init__(label=label)
        self.rows = []
        for k, (text, spans, found) in enumerate(zip(texts, references, referents, strict=True)):
            for n, ((a, b), where) in enumerate(zip(spans, found, strict=True)):
                if where is not None:
                    self.rows.append((k * 1_000_000 + n, text, int(a), int(b), where[0], str(where[1])))

    def predict(self, references: DataFrame) -> DataFrame:
        given = references.sparkSession.createDataFrame(self.rows, "pos long, document string, start int, end int, gazetteer string, location_id string")
        first = given.groupBy("document", "start", "end").agg(F.min_by(F.struct("gazetteer", "location_id"), "pos").alias("w"))
        return references.select("reference_id", "document", "start", "end").join(first, ["document", "start", "end"]).select("reference_id", "w.gazetteer", "w.location_id")


_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s|$)|\n+|$)", re.DOTALL)


def sentences(text: str) -> list[tuple[int, int]]:
    """Sentences as (start, end) without outer white space."""
    out = []
    for m in _SENTENCE.finditer(text):
        part = m.group()
        if part.strip():
            out.append((m.start() + len(part) - len(part.lstrip()), m.start() + len(part.rstrip())))
    return out


def window(text: str, start: int, limit: int, count: Callable[[str], int] = lambda s: len(s.split())) -> str:
    """The text around ``start`` that has at most ``limit`` tokens.

    The whole text if it fits; else its sentence, and then, in turns, the
    sentence before and the one after, until neither fits any more.
    """
    if count(text) <= limit:
        return text
    parts = sentences(text)
    at = next((k for k, (a, b) in enumerate(parts) if a <= start < b), None)
    if at is None:
        raise ValueError(f"no sentence at {start}")
    tokens = [count(text[a:b]) for a, b in parts]
    low = high = at
    total, grown = tokens[at], True
    while grown:
        grown = False
        if low and total + tokens[low - 1] <= limit:
            low, total, grown = low - 1, total + tokens[low - 1], True
        if high + 1 < len(parts) and total + tokens[high + 1] <= limit:
            high, total, grown = high + 1, total + tokens[high + 1], True
    return " ".join(text[a:b] for a, b in parts[low : high + 1])


class HashEncoder:
    """Vectors of hashed letter trigrams and words; deterministic, without a model."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions, np.float64)
            for word in re.findall(r"\w+", text.lower()):
                padded = f"^{word}$"
                for part in [word, *(padded[k : k + 3] for k in range(len(padded) - 2))]:
                    h = zlib.crc32(part.encode())
                    v[h % self.dimensions] += 1.0 if h >> 31 else -1.0
            size = float(np.sqrt((v * v).sum()))
            out.append((v / size if size else v).astype(np.float32).tolist())
        return out


class WeightedEncoder(HashEncoder):
    """A hash encoder whose dimensions have learnt weights."""

    def __init__(self, weights: list[float]):
        super().__init__(len(weights))
        self.weights = np.asarray(weights, np.float64)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        found = np.asarray(super().__call__(texts), np.float64) * np.sqrt(self.weights)
        size = np.sqrt((found * found).sum(axis=1, keepdims=True))
        return (found / np.where(size > 0, size, 1)).astype(np.float32).tolist()

    def save(self, spark, path: str) -> None:
        Storage(spark, path).write("weights.json", json.dumps(self.weights.tolist()))

    @classmethod
    def load(cls, spark, path: str) -> WeightedEncoder:
        return cls(json.loads(Storage(spark, path).read("weights.json")))


def learned(pairs: DataFrame, dimensions: int = 256, epochs: int = 20, rate: float = 2.0) -> WeightedEncoder:
    """Weights of a hash encoder's dimensions by which right descriptions are more like their contexts than wrong ones.

    Logistic regression of ``pairs(context, description, label)`` on the
    products of the two vectors' components.  Each step sums the gradient over
    the partitions; only ``dimensions`` numbers a partition reach the driver.
    """
    ship(pairs.sparkSession)
    weights, offset = np.ones(dimensions), 0.0

    def slopes(weights: np.ndarray, offset: float):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode, total = HashEncoder(dimensions), np.zeros(dimensions + 2)
            for batch in batches:
                x = np.asarray(encode(batch["context"].fillna("").tolist())) * np.asarray(encode(batch["description"].fillna("").tolist()))
                miss = 1 / (1 + np.exp(-np.clip(4 * (x @ weights) + offset, -30, 30))) - batch["label"].to_numpy()
                total += np.concatenate([4 * miss @ x, [miss.sum(), len(batch)]])
            yield pd.DataFrame({"sums": [total.tolist()]})

        return pairs.select("context", "description", "label").mapInPandas(run, "sums array<double>")

    for _ in range(epochs):
        total = np.sum([r["sums"] for r in slopes(weights, offset).collect()], axis=0)  # a row a partition
        if not total[-1]:
            break
        weights = np.maximum(weights - rate * (total[:dimensions] / total[-1] + 1e-3 * (weights - 1)), 0.0)
        offset -= rate * total[-2] / total[-1]
    return WeightedEncoder(weights.tolist())


class SimilarityResolver(Resolver):
    """The candidate whose description is most like the context, by rounds of search.

    ``names(feature_id, name)`` are searched; ``described(feature_id,
    location_id, description)`` says what each feature is.  Distinct contexts
    and descriptions are encoded once; only described features that came up as
    candidates are encoded at all.
    """

    NAME = "SimilarityResolver"

    def __init__(self, gazetteer: str, names: DataFrame, described: DataFrame, min_similarity: float = 0.6, max_tiers: int = 3, max_tokens: int = 126, encoder: Callable[[list[str]], list[list[float]]] | None = None, indexed: DataFrame | None = None):
        super().__init__(gazetteer=gazetteer, min_similarity=min_similarity, max_tiers=max_tiers, max_tokens=max_tokens)
        self.names, self.described, self.encoder, self.indexed = names, described, encoder or HashEncoder(), indexed

    @classmethod
    def installed(cls, store, gazetteer: str, source: str, columns: tuple | None = None, **options) -> SimilarityResolver:
        """A resolver over an installed gazetteer: its names, stored index, and descriptions by the columns known for it or given."""
        return cls(gazetteer, store.read(gazetteer, "names"), store.describe(gazetteer, source, columns), indexed=store.read(gazetteer, "texts"), **options)

    def fit(self, pairs: DataFrame, output_path: str, towers: bool = True, **options) -> SimilarityResolver:
        """This resolver with an encoder fitted on training pairs and saved: two towers, or weights of the hash encoder."""
        encoder = trained(pairs, **options) if towers else learned(pairs, **options)
        encoder.save(pairs.sparkSession, output_path)
        c = self.config
        return SimilarityResolver(c["gazetteer"], self.names, self.described, c["min_similarity"], c["max_tiers"], c["max_tokens"], encoder, self.indexed)

    def contexts(self, references: DataFrame) -> DataFrame:
        """``references`` with ``context``."""
        ship(references.sparkSession)
        limit = self.config["max_tokens"]

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for text, start in batches:
                yield pd.Series([window(t, int(s), limit) for t, s in zip(text, start, strict=True)], dtype=object)

        return references.withColumn("context", F.pandas_udf(run, "string")(F.col("document"), F.col("start")))

    def encoded(self, texts: DataFrame, column: str) -> DataFrame:
        """Distinct texts of a column with their vectors; an encoder may have a method of the column's name for them."""
        ship(texts.sparkSession)
        encoder = getattr(self.encoder, column, self.encoder)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(encoder(batch.fillna("").tolist()), dtype=object)

        return texts.select(column).distinct().withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(column)))

    def predict(self, references: DataFrame) -> DataFrame:
        asked = references.select(F.col("text").alias("qid"), F.col("text").alias("query")).distinct()
        found = resolve.candidates(self.names, asked, self.config["max_tiers"], indexed=self.indexed)
        rows = self.contexts(references).select("reference_id", "text", "context")
        pairs = rows.join(found, rows.text == found.qid).select(F.col("reference_id").alias("ref_id"), "context", "feature_id", "round", "score")
        pairs = pairs.join(self.described, "feature_id")
        sims = pairs.join(self.encoded(rows, "context").withColumnRenamed("vector", "_c"), "context").join(self.encoded(pairs, "description").withColumnRenamed("vector", "_d"), "description")
        from placelink.functions.text import cosine

        scored = sims.select("ref_id", "feature_id", "location_id", "round", F.col("score").alias("pos"), cosine(F.col("_c"), F.col("_d")).alias("sim"))
        best = resolve.first_good_round(scored.drop("location_id"), self.config["min_similarity"])
        told = best.join(self.described.select("feature_id", "location_id"), "feature_id")
        return told.select(F.col("ref_id").alias("reference_id"), F.lit(self.config["gazetteer"]).alias("gazetteer"), "location_id")

    def training_pairs(self, references: DataFrame, gold: DataFrame) -> DataFrame:
        """``(ref_id, context, description, label)`` from exact candidates of gold references."""
        from placelink.operators import search

        rows = self.contexts(references).select(F.col("reference_id").alias("ref_id"), "text", "context")
        found = search.exact(self.names, rows.select(F.col("ref_id").alias("qid"), F.col("text").alias("query"))).withColumnRenamed("qid", "ref_id")
        made = resolve.training_pairs(rows, gold.select(F.col("reference_id").alias("ref_id"), "location_id"), found, self.described)
        if made.isEmpty():
            raise ValueError("no training pairs: no gold reference has an exact candidate")
        return made


