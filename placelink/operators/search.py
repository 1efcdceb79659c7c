"""Name search: exact, phrase, partial (BM25) and fuzzy, for many queries at once.

Names are indexed by distinct text, since a gazetteer repeats them.  Queries
meet texts through their rarest token (or their Soundex code), so the join is
an equi-join on a selective key; phrase and length tests run on what it finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelink.functions import text as T

METHODS = ("exact", "phrase", "partial", "fuzzy")
LIMIT = 10_000


def index(names: DataFrame) -> DataFrame:
    """``names(feature_id, name)`` with tokens and Soundex code, one row a text and its number of rows."""
    texts = names.where("name is not null").groupBy("name").agg(F.count("*").alias("n_rows"))
    tok = T.tokens(F.col("name"))
    return texts.select("name", "n_rows", tok.alias("tok"), F.size(tok).alias("dl"), F.length("name").alias("len"), T.soundex(F.col("name")).alias("code"))


def statistics(indexed: DataFrame) -> DataFrame:
    """Rows of all names, their mean number of tokens: one row."""
    return indexed.agg(F.sum("n_rows").alias("rows"), (F.sum(F.col("dl") * F.col("n_rows")) / F.sum("n_rows")).alias("mean_dl"))


def _phrase_hits(indexed: DataFrame, phrases: DataFrame) -> DataFrame:
    """``(phrase, name, n_rows, dl, len, tf)`` where the token array ``phrase`` occurs in a text."""
    postings = indexed.select("name", F.explode(F.array_distinct("tok")).alias("token"))
    spread = postings.groupBy("token").agg(F.count("*").alias("df"))
    each = phrases.select("phrase", F.explode("phrase").alias("token")).distinct()
    # a token that no text has decides as well: then there is no hit
    rare = each.join(spread, "token", "left").groupBy("phrase").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), F.col("token"))).alias("token"))
    found = rare.join(postings, "token").join(indexed, "name")
    tf = T.phrase_count(F.col("tok"), F.col("phrase"))
    return found.select("phrase", "name", "n_rows", "dl", "len", tf.alias("tf")).where("tf > 0")


def tiered(scored: DataFrame, names: DataFrame, limit: int, tiers: int, digits: int = 9) -> DataFrame:
    """Limit on the name rows of a query, then dense ranks, then the best row of each feature.

    ``scored(qid, name, score)`` has a row a query and name.  All rows of a name
    score alike there, so only its first ``limit`` ones go on.
    """
    first = Window.partitionBy("name").orderBy("feature_id")
    few = names.select("name", "feature_id").where("name is not null").withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).drop("place")
    rows = scored.join(few, "name")
    rows = rows.withColumn("score", F.round("score", digits))
    near = Window.partitionBy("qid").orderBy("score", "feature_id", "name")
    rows = rows.withColumn("place", F.row_number().over(near)).where(F.col("place") <= limit)
    rows = rows.withColumn("tier", F.dense_rank().over(Window.partitionBy("qid").orderBy("score"))).where(F.col("tier") <= tiers)
    return rows.groupBy("qid", "feature_id").agg(F.min("score").alias("score"), F.min("tier").cast("int").alias("tier"))


def exact(names: DataFrame, queries: DataFrame, limit: int = LIMIT, indexed: DataFrame | None = None) -> DataFrame:
    """``(qid, feature_id)``: the query's tokens occur in a name of the same length."""
    asked = _asked(queries).where(F.size("phrase") > 0)
    return same_length(asked, _phrase_hits(_held(names, indexed), asked.select("phrase").distinct()), names, limit)


def same_length(asked: DataFrame, hits: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """The first rows of ``hits(phrase, name)`` that are as long as the query."""
    rows = asked.join(hits.select("phrase", "name"), "phrase").where(F.col("qlen") == F.length("name")).join(names.select("name", "feature_id"), "name")
    first = Window.partitionBy("qid").orderBy("feature_id", "name")
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)
    return rows.select("qid", "feature_id").distinct()


def phrase(names: DataFrame, queries: DataFrame, limit: int = LIMIT, tiers: int = 1, indexed: DataFrame | None = None) -> DataFrame:
    """``(qid, feature_id, score, tier)``: names that hold the query's tokens in a row."""
    return _ranked(names, whole_phrases(queries), limit, tiers, _held(names, indexed))


def partial(names: DataFrame, queries: DataFrame, limit: int = LIMIT, tiers: int = 1, indexed: DataFrame | None = None) -> DataFrame:
    """As :func:`phrase`, for any of the query's terms; each term is a phrase, repeats count."""
    return _ranked(names, terms(queries), limit, tiers, _held(names, indexed))


def whole_phrases(queries: DataFrame) -> DataFrame:
    """``(qid, pos, phrase)``: the tokens of each query."""
    return _asked(queries).where(F.size("phrase") > 0).select("qid", F.lit(0).alias("pos"), "phrase")


def terms(queries: DataFrame) -> DataFrame:
    """``(qid, pos, phrase)``: the tokens of each term of a query."""
    each = queries.select("qid", F.posexplode(F.split(T.query_text(F.col("query")), "\\s+")).alias("pos", "term"))
    return each.select("qid", "pos", T.tokens(F.col("term")).alias("phrase")).where(F.size("phrase") > 0)


def _asked(queries: DataFrame) -> DataFrame:
    q = T.query_text(F.col("query"))
    return queries.select("qid", T.tokens(q).alias("phrase"), F.length(q).alias("qlen"))


def _held(names: DataFrame, indexed: DataFrame | None) -> DataFrame:
    return index(names) if indexed is None else indexed


def _ranked(names: DataFrame, asked: DataFrame, limit: int, tiers: int, indexed: DataFrame) -> DataFrame:
    hits = _phrase_hits(indexed, asked.select("phrase").distinct())
    spread = hits.groupBy("phrase").agg(F.sum("n_rows").alias("n_with"))
    part = T.bm25(T.idf(F.col("rows"), F.col("n_with")), F.col("tf"), F.col("dl"), F.col("mean_dl"))
    rows = hits.join(spread, "phrase").join(F.broadcast(statistics(indexed)))
    rows = rows.select("phrase", "name", part.alias("part"))
    scored = asked.join(rows, "phrase").groupBy("qid", "name").agg(F.sum("part").alias("score"))
    return tiered(scored, names, limit, tiers)


def fuzzy(names: DataFrame, queries: DataFrame, limit: int = LIMIT, tiers: int = 1, indexed: DataFrame | None = None) -> DataFrame:
    """``(qid, feature_id, score, tier)``: names that sound alike, by least edit distance."""
    q = T.query_text(F.col("query"))
    asked = queries.select("qid", q.alias("q"), T.soundex(q).alias("code"))
    near = asked.join(_held(names, indexed).select("name", "code"), "code").select("qid", "name", T.levenshtein(F.col("q"), F.col("name")).alias("score"))
    rows = near.join(names.select("name", "feature_id"), "name").groupBy("qid", "feature_id").agg(F.min("score").alias("score"))
    first = Window.partitionBy("qid").orderBy("score", "feature_id")
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)
    return rows.withColumn("tier", F.dense_rank().over(Window.partitionBy("qid").orderBy("score")).cast("int")).where(F.col("tier") <= tiers).drop("place")


def search(names: DataFrame, queries: DataFrame, method: str = "exact", limit: int = LIMIT, tiers: int = 1, indexed: DataFrame | None = None, stored=None) -> DataFrame:
    """``(qid, feature_id, score, tier)`` of ``queries(qid, query)`` over ``names(feature_id, name)``.

    An empty partial query finds nothing; exact matches have score 0, tier 1.
    ``indexed`` is the :func:`index` of the names where it is stored, ``stored``
    a :class:`postings.Index`, which also spares texts that cannot be found.
    """
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}")
    if stored is not None:
        from placelink.operators import postings

        if method == "exact":
            asked = _asked(queries).where(F.size("phrase") > 0)
            return postings.exact(stored, names, asked, limit).withColumn("score", F.lit(0.0)).withColumn("tier", F.lit(1))
        if method != "fuzzy":
            asked = whole_phrases(queries) if method == "phrase" else terms(queries)
            return postings.ranked(stored, names, asked, limit, tiers)
        indexed = stored.texts
    if method == "exact":
        return exact(names, queries, limit, indexed).withColumn("score", F.lit(0.0)).withColumn("tier", F.lit(1))
    return {"phrase": phrase, "partial": partial, "fuzzy": fuzzy}[method](names, queries, limit, tiers, indexed)


def find(features: DataFrame, identifier: Column | str | int, id_col: str) -> DataFrame:
    """The feature with an identifier, compared as text: one row or none.

    A given value is also cast to the column's type and compared there, which
    a Parquet scan can use to skip row groups.
    """
    if isinstance(identifier, Column):
        return features.where(F.col(id_col).cast("string") == identifier).limit(1)
    kind, text = dict(features.dtypes)[id_col], str(identifier)
    if kind == "string":
        return features.where(F.col(id_col) == F.lit(text)).limit(1)
    value = features.sparkSession.range(1).select(F.lit(text).try_cast(kind)).first()[0]
    if value is None:
        return features.limit(0)
    return features.where((F.col(id_col) == F.lit(value).cast(kind)) & (F.col(id_col).cast("string") == F.lit(text))).limit(1)
