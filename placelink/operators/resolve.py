"""Resolution: candidates by rounds, similarity, the first good round's best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placelink.functions import text as T
from placelink.operators import search as S


def rounds(max_tiers: int = 3) -> list[tuple[int, str, int]]:
    """(round, method, tiers) in the order in which candidates are asked for."""
    out = [(1, "exact", 1)]
    for tiers in range(1, max_tiers + 1):
        out += [(0, m, tiers) for m in ("phrase", "partial", "fuzzy")]
    return [(k + 1, m, t) for k, (_, m, t) in enumerate(out)]


def candidates(names: DataFrame, queries: DataFrame, max_tiers: int = 3, limit: int = S.LIMIT, indexed: DataFrame | None = None) -> DataFrame:
    """``(qid, feature_id, round, score)``: the first round that finds a feature for a query, and its score there.

    A method is searched once with the most tiers; a feature of tier t comes up
    in that method's round t.
    """
    number = {(m, t): k for k, m, t in rounds(max_tiers)}
    found = None
    for method in S.METHODS:
        tiers = 1 if method == "exact" else max_tiers
        rows = S.search(names, queries, method, limit, tiers, indexed)
        at = F.create_map(*(F.lit(x) for t in range(1, tiers + 1) for x in (t, number[method, t])))
        rows = rows.select("qid", "feature_id", at[F.col("tier")].alias("round"), F.col("score").cast("double").alias("score"))
        found = rows if found is None else found.union(rows)
    return found.groupBy("qid", "feature_id").agg(F.min(F.struct("round", "score")).alias("f")).select("qid", "feature_id", "f.round", "f.score")


def union_distinct(found: DataFrame) -> DataFrame:
    """``found(ref_id, feature_id, round, pos)`` with each candidate once, where it came up first."""
    first = F.min(F.struct("round", "pos"))
    return found.groupBy("ref_id", "feature_id").agg(first.alias("f")).select("ref_id", "feature_id", "f.round", "f.pos")


def best(scored: DataFrame) -> DataFrame:
    """``(ref_id, feature_id, sim)``: the most similar candidate, ties by ``pos``."""
    chosen = F.max_by(F.struct("feature_id", "sim"), F.struct(F.col("sim"), -F.col("pos")))
    return scored.groupBy("ref_id").agg(chosen.alias("b")).select("ref_id", "b.feature_id", "b.sim")


def first_good_round(scored: DataFrame, least: float) -> DataFrame:
    """``(ref_id, round, feature_id, sim)`` of ``scored(ref_id, feature_id, round, pos, sim)``.

    A reference is decided in the first round with a similarity of at least
    ``least`` among the candidates so far; of these the most similar wins, ties
    by round and position.  References without such a round are left out.
    """
    good = scored.where(F.col("sim") >= least).groupBy("ref_id").agg(F.min("round").alias("won"))
    held = scored.join(good, "ref_id").where(F.col("round") <= F.col("won"))
    order = Window.partitionBy("ref_id").orderBy(F.desc("sim"), "round", "pos", "feature_id")
    top = held.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return top.select("ref_id", F.col("won").alias("round"), "feature_id", "sim")


def similarities(pairs: DataFrame, contexts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``pairs(ref_id, feature_id, ...)`` with ``sim``: vectors meet their pair once each."""
    joined = pairs.join(contexts.select("ref_id", F.col("vector").alias("_c")), "ref_id").join(descriptions.select("feature_id", F.col("vector").alias("_d")), "feature_id")
    return joined.withColumn("sim", T.cosine(F.col("_c"), F.col("_d"))).drop("_c", "_d")


def training_pairs(references: DataFrame, gold: DataFrame, found: DataFrame, descriptions: DataFrame) -> DataFrame:
    """``(context, description, label)``: exact candidates of each gold reference, 1 for the right one."""
    rows = references.select("ref_id", "context").join(gold.select("ref_id", F.col("location_id").alias("right")), "ref_id").join(found.select("ref_id", "feature_id"), "ref_id").join(descriptions.select("feature_id", "location_id", "description"), "feature_id")
    return rows.select("ref_id", "context", "description", F.when(F.col("location_id") == F.col("right"), 1).otherwise(0).alias("label"))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a marker of having been processed."""
    return rows.join(done.select(key), key, "left_anti")


def manual(asked: DataFrame, given: DataFrame) -> DataFrame:
    """``asked(document_id, text)`` with the spans given for an equal text: the first such, null if none.

    ``given`` has ``(pos, text, spans)``.
    """
    first = given.groupBy("text").agg(F.min_by("spans", "pos").alias("spans"))
    return asked.join(first, "text", "left")
