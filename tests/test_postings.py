"""Search by stored postings against the search without them, and how little of the index it scores."""

import random

import pytest
from pyspark.sql import functions as F

from placelink.operators import postings, search

WORDS = ["saint", "new", "port", "lake", "upper", "lower", "old", "river", "hill", "green", *(f"town{k}" for k in range(40))]


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(5)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    names = [(k, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 6)))) for k in range(1_500)]
    names += [(5_000 + k, names[k][1]) for k in range(0, 300, 3)] + [(9_000, "Saint-Étienne"), (9_001, None), (9_002, "saint saint saint")]
    rows = spark.createDataFrame(names, "feature_id long, name string").repartition(3).cache()
    texts = search.index(rows).cache()
    blocks, tokens = postings.build(texts, block=16, shard=100)
    return rows, postings.Index(texts, blocks.cache(), tokens.cache(), search.statistics(texts).cache())


QUERIES = [("a", "saint"), ("b", "new port"), ("c", "town3"), ("d", "nowhere"), ("e", "saint nowhere town5 town5"), ("f", "saint-etienne"), ("g", "lake new saint upper port"), ("h", '  "old" '), ("i", ""), ("j", "saint saint"), ("k", "town1 town2 lower-hill")]


@pytest.mark.parametrize("method,limit,tiers", [("exact", 10_000, 1), ("phrase", 7, 4), ("phrase", 10_000, 2), ("partial", 10_000, 1), ("partial", 40, 1_000)])
def test_equals_the_search_without_an_index(spark, held, method, limit, tiers):
    names, index = held
    queries = spark.createDataFrame(QUERIES, "qid string, query string")
    want, got = (search.search(names, queries, method, limit, tiers, stored=s).withColumn("score", F.round("score", 7)) for s in (None, index))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_that_cannot_enter_the_limit_are_not_scored(spark, held):
    names, index = held
    for query, limit, tiers, most in (("saint", 10, 1_000, 0.2), ("town30 saint new", 10_000, 1, 0.2)):
        asked = search.terms(spark.createDataFrame([("q", query)], "qid string, query string"))
        scored = postings.candidates(index, postings.bounded(index, asked, limit, tiers)).count()
        holding = index.texts.where(F.exists("tok", lambda t: t.isin(query.split()))).count()
        assert 0 < scored <= most * holding, (query, scored, holding)


def test_a_common_token_is_split(held):
    _, index = held
    saint = index.tokens.where("token = 'saint'").first()
    rows = index.postings.where("token = 'saint'").collect()
    assert saint.shards == -(-saint.n_texts // 100) > 1 and {r.shard for r in rows} == set(range(saint.shards))
    assert all(len(r.entries) <= 16 and r.least <= min(e.impact for e in r.entries) and r.best >= max(e.impact for e in r.entries) for r in rows)
    assert sum(r.n_rows for r in rows) == saint.n_rows


def test_many_queries_meet_blocks_by_shard(spark, held, monkeypatch):
    monkeypatch.setattr(postings, "PUSHED", 1)
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 1)
    names, index = held
    queries = spark.createDataFrame(QUERIES, "qid string, query string")
    want, got = (search.search(names, queries, "partial", 50, 2, stored=s).withColumn("score", F.round("score", 7)) for s in (None, index))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_names(spark, held):
    _, index = held
    none = spark.createDataFrame([], "feature_id long, name string")
    texts = search.index(none)
    blocks, tokens = postings.build(texts)
    empty = postings.Index(texts, blocks, tokens, search.statistics(texts))
    queries = spark.createDataFrame(QUERIES, "qid string, query string")
    for method in ("exact", "phrase", "partial"):
        assert search.search(none, queries, method, stored=empty).count() == 0
