"""Tags: which recognizer's and resolver's results a view shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retag(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """Tags ``(project_id, tag, recognizer_id, resolver_id)`` repointed; what a change leaves null stays."""
    keys = ["project_id", "tag"]
    new = changes.select(*keys, F.col("recognizer_id").alias("_c"), F.col("resolver_id").alias("_s"))
    return tags.join(new, keys, "full").select(*keys, F.coalesce("_c", "recognizer_id").alias("recognizer_id"), F.coalesce("_s", "resolver_id").alias("resolver_id"))


def view(documents: DataFrame, references: DataFrame, referents: DataFrame, tags: DataFrame, tag: str = "latest") -> DataFrame:
    """Documents with the toponyms and locations that a tag points at.

    ``(project_id, document_id, start, end, text, location_id)``: references of
    the tag's recognizer; of each the first referent of the tag's resolver, null
    without one.  Documents without toponyms have one row with null spans.
    """
    own = tags.where(F.col("tag") == tag).select("project_id", "recognizer_id", "resolver_id")
    docs = documents.select("project_id", "document_id").join(own, "project_id", "left")
    refs = references.select("reference_id", "document_id", "recognizer_id", "start", "end", "text")
    rows = docs.join(refs, ["document_id", "recognizer_id"], "left")
    ranked = referents.groupBy("reference_id", "resolver_id").agg(F.min_by("location_id", "referent_id").alias("location_id"))
    return rows.join(ranked, ["reference_id", "resolver_id"], "left").select("project_id", "document_id", "start", "end", "text", "location_id")
