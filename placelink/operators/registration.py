"""Features and names of a source, registered without duplicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(table: DataFrame, source: str, identifier: str) -> DataFrame:
    """``(feature_id, source, location_id)``: one row per identifier that is not null or empty.

    The id is a hash of source and identifier, so it stays the same when a
    gazetteer is built again.
    """
    ident = F.col(f"`{identifier}`").cast("string")
    rows = table.select(F.lit(source).alias("source"), ident.alias("location_id")).where("location_id is not null and location_id <> ''").distinct()
    return rows.select(F.xxhash64("source", "location_id").alias("feature_id"), "source", "location_id")


def names(table: DataFrame, source: str, identifier: str, columns: list[tuple[str, str | None]]) -> DataFrame:
    """``(feature_id, name)``: the distinct names of each feature.

    ``columns`` are (column, separator): a plain column is one name as it is;
    with a separator its parts are trimmed.  Empty ones are left out.
    """
    ident = F.col(f"`{identifier}`").cast("string")
    parts = []
    for column, separator in columns:
        text = F.col(f"`{column}`").cast("string")
        parts.append(F.array(text) if separator is None else F.transform(F.split(text, re.escape(separator), -1), lambda p: F.trim(p)))
    held = F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))
    rows = table.where(ident.isNotNull() & (ident != "")).select(F.xxhash64(F.lit(source), ident).alias("feature_id"), F.explode(held).alias("name"))
    return rows.where("name is not null and name <> ''").distinct()


def new_rows(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known yet, each once: what an idempotent append adds."""
    return rows.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with those replaced that ``changes`` has, and its others added."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def counts(feature_rows: DataFrame, name_rows: DataFrame) -> DataFrame:
    """``(source, n_features, n_names)`` of a gazetteer."""
    own = feature_rows.select("feature_id", "source").join(name_rows.groupBy("feature_id").agg(F.count("*").alias("n")), "feature_id", "left")
    return own.groupBy("source").agg(F.count("*").alias("n_features"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_names"))


def cascade(project_ids: DataFrame, documents: DataFrame, references: DataFrame, referents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of documents, references and referents when projects go."""
    docs = documents.join(project_ids.select("project_id"), "project_id", "left_anti")
    refs = references.join(docs.select("document_id"), "document_id", "left_semi")
    return docs, refs, referents.join(refs.select("reference_id"), "reference_id", "left_semi")
