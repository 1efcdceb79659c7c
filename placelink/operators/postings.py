"""A positional index of names, stored in blocks by impact, and search that skips what cannot enter its limit.

A posting is a token and a text that holds it; its impact is the part of the
score that the token has there, but for the token's weight.  The postings of a
token are spread over shards by the text's hash, and stand in blocks by falling
impact, each with its best and its least one.  From these figures alone a search
knows what its limit's last row scores at least, which tokens of a query cannot
reach that by themselves, and which blocks of the others cannot.  Only texts of
the blocks that are left are scored, each by its own tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelink.functions import text as T
from placelink.operators import search

#: Postings of a block, and of a shard of a token, about.
BLOCK, SHARD = 1_024, 1 << 16
#: Different impacts of a token, the highest ones, that its statistics keep.
LEVELS = 64
#: Tokens that are pushed down to the scan as a list, and rows of what is broadcast to it.
PUSHED, BROADCAST_ROWS = 1_000, 100_000
#: Scores that differ by less may be equal when they are rounded.
SLACK = 1e-8


@dataclass
class Index:
    """``texts`` as of :func:`search.index`, ``postings``, ``tokens`` and the one row of ``statistics``."""

    texts: DataFrame
    postings: DataFrame
    tokens: DataFrame
    statistics: DataFrame


def build(texts: DataFrame, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``(postings, tokens)`` of ``texts(name, n_rows, tok, dl)``.

    ``postings(token, shard, block, n_rows, best, least, entries)``, a row a
    block; ``tokens(token, n_texts, n_rows, shards, levels)``.
    """
    stats = search.statistics(texts)  # one row
    each = texts.join(F.broadcast(stats)).select("name", "n_rows", "tok", "dl", "mean_dl", F.explode(F.array_distinct("tok")).alias("token"))
    tf = F.size(F.filter("tok", lambda t: t == F.col("token")))
    each = each.select("token", "name", "n_rows", "tok", T.impact(tf, F.col("dl"), F.col("mean_dl")).alias("impact"))
    spread = each.groupBy("token").agg(F.count("*").alias("n_texts"), F.sum("n_rows").alias("n_rows")).withColumn("shards", F.ceil(F.col("n_texts") / shard).cast("int"))
    levels = each.select("token", "impact").distinct()
    order = Window.partitionBy("token").orderBy(F.desc("impact"))
    levels = levels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEVELS).groupBy("token").agg(F.sort_array(F.collect_list("impact"), asc=False).alias("levels"))
    dealt = each.join(spread.select("token", "shards"), "token").withColumn("shard", F.pmod(F.xxhash64("name"), F.col("shards")).cast("int"))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("token", "shard").orderBy(F.desc("impact"), "name")))
    placed = placed.withColumn("block", F.floor((F.col("place") - 1) / block).cast("int"))
    entries = F.collect_list(F.struct("name", "n_rows", "tok", "impact")).alias("entries")
    postings = placed.groupBy("token", "shard", "block").agg(F.sum("n_rows").alias("n_rows"), F.max("impact").alias("best"), F.min("impact").alias("least"), entries)
    return postings, spread.join(levels, "token")


def _with(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(token, ...)`` with the blocks of its tokens: few tokens are pushed to the scan and go to where blocks are read.

    Many meet the blocks by token and shard, so that no task has all blocks of
    a common token.
    """
    few = wanted.select("token").distinct().limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        postings = postings.where(F.col("token").isin([r["token"] for r in few]))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return postings.join(F.broadcast(wanted.drop("shards")), "token")
    spread = wanted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    return postings.join(spread, ["token", "shard"])


def _phrases(index: Index, asked: DataFrame) -> DataFrame:
    """``(phrase, token, n_tokens, n_texts, n_rows, shards, levels)``: distinct phrases by their rarest token; those with a token that no text has are left out."""
    each = asked.select("phrase").distinct().select("phrase", F.size("phrase").alias("n_tokens"), F.explode(F.array_distinct("phrase")).alias("token"))
    met = each.join(index.tokens, "token").groupBy("phrase", "n_tokens").agg(F.count("*").alias("found"), F.min(F.struct("n_texts", "token", "n_rows", "shards", "levels")).alias("t"))
    return met.where(F.col("found") == F.size(F.array_distinct("phrase"))).select("phrase", "n_tokens", "t.token", "t.n_texts", "t.n_rows", "t.shards", "t.levels")


def occurrences(index: Index, phrases: DataFrame) -> DataFrame:
    """``(phrase, name, n_rows, tok, tf)`` of ``phrases(phrase, token, shards)``: texts that hold a phrase, by its rarest token's postings."""
    met = _with(index.postings.select("token", "shard", "entries"), phrases.select("phrase", "token", "shards"))
    rows = met.select("phrase", F.explode("entries").alias("e")).select("phrase", "e.name", "e.n_rows", "e.tok")
    return rows.withColumn("tf", T.phrase_count(F.col("tok"), F.col("phrase"))).where("tf > 0")


def _levels(weight: Column, levels: Column, tiers: int) -> Column:
    """The score of the ``tiers``-th best group of texts of a token, as far as its highest impacts tell; 0 where they do not."""
    scores = F.array_distinct(F.transform(levels, lambda x: F.round(weight * x, 9)))
    return F.coalesce(F.try_element_at(scores, F.lit(tiers)), F.lit(0.0))


def bounded(index: Index, asked: DataFrame, limit: int, tiers: int) -> DataFrame:
    """``asked(qid, pos, phrase)`` with what skipping needs: a phrase's weight, the most it adds, what the rest of its query adds, and the score to reach."""
    found = _phrases(index, asked)
    mean = index.statistics.select("rows", "mean_dl")
    several = found.where("n_tokens > 1")
    hits = occurrences(index, several).join(F.broadcast(mean))
    counted = hits.groupBy("phrase").agg(F.sum("n_rows").alias("n_with"), F.max(T.impact(F.col("tf"), F.size("tok"), F.col("mean_dl"))).alias("best"))
    one = found.where("n_tokens = 1").select("phrase", "token", "n_tokens", "shards", "levels", F.col("n_rows").alias("n_with"), F.element_at("levels", 1).alias("best"))
    more = several.drop("n_rows", "n_texts").join(counted, "phrase").select("phrase", "token", "n_tokens", "shards", F.lit(None).cast("array<double>").alias("levels"), "n_with", "best")
    # the impact that at least as many rows as the limit have, from the blocks' figures
    ahead = Window.partitionBy("token").orderBy(F.desc("least"), "shard", "block")
    blocks = _with(index.postings.select("token", "shard", "block", "n_rows", "least"), one.select("token", "shards").distinct())
    full = blocks.withColumn("held", F.sum("n_rows").over(ahead)).where(F.col("held") >= limit).groupBy("token").agg(F.max("least").alias("least"))
    one = one.join(full, "token", "left")
    more = more.withColumn("least", F.lit(None).cast("double"))
    told = one.unionByName(more).join(F.broadcast(mean)).withColumn("weight", T.idf(F.col("rows"), F.col("n_with"))).drop("n_with", "rows", "mean_dl")
    rows = asked.join(told, "phrase").withColumn("most", F.col("weight") * F.col("best"))
    query = Window.partitionBy("qid")
    rows = rows.withColumn("terms", F.count("*").over(query)).withColumn("all_most", F.sum("most").over(query))
    by_limit = F.coalesce(F.col("weight") * F.col("least"), F.lit(0.0))
    # with one tier the best row of a term is enough; more tiers are known for a query of one token only, as scores of several may fall together
    by_tier = F.col("most") if tiers == 1 else F.when((F.col("terms") == 1) & F.col("levels").isNotNull(), _levels(F.col("weight"), F.col("levels"), tiers)).otherwise(F.lit(0.0))
    rows = rows.withColumn("reach", F.max(F.greatest(by_limit, by_tier)).over(query) - SLACK)
    lower = Window.partitionBy("qid").orderBy("most", "pos").rowsBetween(Window.unboundedPreceding, 0)
    # a text with only the lesser phrases, up to this one, cannot reach it
    rows = rows.withColumn("leads", F.sum("most").over(lower) >= F.col("reach"))
    return rows.select("qid", "pos", "phrase", "token", "n_tokens", "shards", "weight", "leads", (F.col("all_most") - F.col("most")).alias("others"), "reach")


def candidates(index: Index, rows: DataFrame) -> DataFrame:
    """``(qid, name, tok)``: the texts that are scored, of the blocks that may reach what :func:`bounded` found."""
    one = rows.where("leads and n_tokens = 1").select("qid", "token", "shards", "weight", "others", "reach")
    met = _with(index.postings, one).where(F.col("weight") * F.col("best") + F.col("others") >= F.col("reach"))
    near = met.select("qid", "weight", "others", "reach", F.explode("entries").alias("e")).where(F.col("weight") * F.col("e.impact") + F.col("others") >= F.col("reach"))
    near = near.select("qid", "e.name", "e.tok")
    several = rows.where("leads and n_tokens > 1")
    far = several.select("qid", "phrase").join(occurrences(index, several.select("phrase", "token", "shards").distinct()), "phrase").select("qid", "name", "tok")
    return near.union(far).groupBy("qid", "name").agg(F.first("tok").alias("tok"))


def ranked(index: Index, names: DataFrame, asked: DataFrame, limit: int, tiers: int) -> DataFrame:
    """``(qid, feature_id, score, tier)`` of ``asked(qid, pos, phrase)``, as the search without an index gives them."""
    rows = bounded(index, asked, limit, tiers)
    held = candidates(index, rows)
    parts = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "phrase", "weight"))).alias("parts"))
    dl, mean = F.size("tok"), F.col("mean_dl")
    score = F.aggregate("parts", F.lit(0.0), lambda s, p: s + T.bm25(p["weight"], T.phrase_count(F.col("tok"), p["phrase"]), dl, mean))
    scored = held.join(parts, "qid").join(F.broadcast(index.statistics.select("mean_dl"))).select("qid", "name", score.alias("score"))
    return search.tiered(scored, names, limit, tiers)


def exact(index: Index, names: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """``(qid, feature_id)`` of ``asked(qid, phrase, qlen)``: texts of the same length that hold the tokens in a row."""
    found = _phrases(index, asked)
    hits = occurrences(index, found).select("phrase", "name")
    return search.same_length(asked, hits, names, limit)
