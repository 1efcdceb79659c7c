"""Recognizers: texts to spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelink.modules.base import Recognizer
from placelink.operators import resolve, spans
from placelink.session import ship

SPANS = "array<struct<start:int,end:int>>"


class ManualRecognizer(Recognizer):
    """Spans given for texts; the settings are the label alone."""

    NAME = "ManualRecognizer"

    def __init__(self, label: str, texts: list[str], references: list[list[tuple[int, int]]]):
        super().__init__(label=label)
        self.rows = [(k, t, [(int(a), int(b)) for a, b in r]) for k, (t, r) in enumerate(zip(texts, references, strict=True))]

    def predict(self, documents: DataFrame) -> DataFrame:
        given = documents.sparkSession.createDataFrame(self.rows, f"pos int, text string, spans {SPANS}")
        return resolve.manual(documents, given).select("document_id", "spans")


class DictionaryRecognizer(Recognizer):
    """Mentions of names of up to ``longest`` words, longest first."""

    NAME = "DictionaryRecognizer"

    def __init__(self, names: DataFrame, label: str, longest: int = 3):
        super().__init__(label=label, longest=longest)
        self.names = names

    def fit(self, examples: DataFrame, output_path: str, least: float = 0.5, label: str | None = None) -> DictionaryRecognizer:
        """Learn names from ``examples(document_id, document, start, end, text)`` and save the lexicon.

        A text of up to ``longest`` words that is a span somewhere becomes a
        name if it is one in at least a share ``least`` of its mentions in the
        examples' documents; a known name that falls below goes.
        """
        rows = examples.where("start is not null")
        if rows.isEmpty():
            raise ValueError("no training examples: the documents have no spans")
        longest = self.config["longest"]
        documents = examples.select("document_id", F.col("document").alias("text")).distinct()
        gold = rows.select("document_id", "start", "end", F.regexp_replace("text", " +", " ").alias("name")).distinct()
        known = self.names.select("name").distinct()
        asked = known.union(gold.select("name")).distinct()
        seen = spans.grams(documents, longest).join(asked, "name").select("document_id", "start", "end", "name").distinct()
        share = seen.join(gold.select("document_id", "start", "end", F.lit(1).alias("hit")), ["document_id", "start", "end"], "left").groupBy("name").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
        kept = asked.join(share, "name", "left").where(F.coalesce("share", F.lit(1.0)) >= least).join(seen.select("name").union(known).distinct(), "name", "left_semi").select("name")
        kept.write.mode("overwrite").parquet(output_path)
        return DictionaryRecognizer.load(examples.sparkSession, output_path, label or f"{self.config['label']}-fitted", longest)

    @classmethod
    def load(cls, spark, path: str, label: str, longest: int = 3) -> DictionaryRecognizer:
        """A recognizer with a lexicon that :meth:`fit` saved."""
        return cls(spark.read.parquet(path), label, longest)

    def predict(self, documents: DataFrame) -> DataFrame:
        found = spans.dictionary(documents, self.names.select("name"), self.config["longest"])
        listed = found.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
        return documents.select("document_id").join(listed, "document_id", "left").select("document_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


class FunctionRecognizer(Recognizer):
    """A Python function from texts to lists of spans (or None), batch by batch.

    ``make`` builds the function once per task, so it can load a model there.
    A model that labels its spans gives ``(start, end, label)``; of these only
    ``entity_types`` count.  ``trainer(training_set, output_path, **options)``,
    where there is one, fits the model and saves it.
    """

    NAME = "FunctionRecognizer"

    def __init__(self, make: Callable[[], Callable[[list[str]], list]], entity_types: tuple[str, ...] | None = None, trainer: Callable | None = None, **config):
        super().__init__(**config | ({"entity_types": list(entity_types)} if entity_types else {}))
        self.make, self.kinds, self.trainer = make, entity_types, trainer

    def entities(self, documents: DataFrame) -> DataFrame:
        """``(document_id, start, end, label)``: what a model finds that labels its spans."""
        ship(documents.sparkSession)
        make = self.make

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            function = make()
            for batch in batches:
                found = function(batch.fillna("").tolist())
                yield pd.Series([[{"start": int(a), "end": int(b), "label": str(k)} for a, b, k in s or ()] for s in found], dtype=object)

        each = documents.select("document_id", F.explode(F.pandas_udf(run, "array<struct<start:int,end:int,label:string>>")(F.col("text"))).alias("e"))
        return each.select("document_id", "e.start", "e.end", "e.label")

    def fit(self, examples: DataFrame, output_path: str, **options):
        """Hand the trainer a training set whose spans have the labels the present model gives them."""
        if self.trainer is None:
            raise ValueError(f"{self} cannot be trained: it has no trainer")
        rows = examples.where("start is not null")
        if rows.isEmpty():
            raise ValueError("no training examples: the documents have no spans")
        documents = examples.select("document_id", F.col("document").alias("text")).distinct()
        labelled = spans.distilled(rows, self.entities(documents), list(self.kinds or ("LOC",)))
        return self.trainer(spans.training_set(documents, labelled), output_path, **options)

    def predict(self, documents: DataFrame) -> DataFrame:
        ship(documents.sparkSession)
        make, kinds = self.make, self.kinds

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            function = make()
            for batch in batches:
                found = function(batch.fillna("").tolist())
                yield pd.Series([None if s is None else [{"start": int(e[0]), "end": int(e[1])} for e in s if not kinds or e[2] in kinds] for s in found], dtype=object)

        return documents.select("document_id", F.pandas_udf(run, SPANS)(F.col("text")).alias("spans"))
