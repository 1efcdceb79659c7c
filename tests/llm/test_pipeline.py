"""Each stage, on its own input, against plain Python; and the queries with SQL."""

import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from placelink.llm import bpe, mixing, quality, queries
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_dup import plain as plain_groups

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_filter", "line_dedup", "near_dedup", "source_mix", "byte_bpe"]
    before = docs.collect()
    model = quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    scores = quality.probabilities([r.text.encode() for r in before], model, quality.pair_tables(model))
    good = corpus_pipeline.table(stages["quality_filter"](spark, docs, DIR), "t")
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r, s in zip(before, scores, strict=True) if s >= 0.7}
    lines = corpus_pipeline.table(stages["line_dedup"](spark, good, DIR), "t")
    want = {(d, t) for d, _, _, t in plain_lines([(r.doc_id, r.source, r.text) for r in good.collect()], 10)}
    assert {(r.doc_id, r.text) for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    one = corpus_pipeline.table(stages["near_dedup"](spark, lines, DIR), "t")
    groups = plain_groups([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, c in groups if d == c)
    mixed = corpus_pipeline.table(stages["source_mix"](spark, one, DIR), "t")
    taken = {r.doc_id: r.taken // r["size"] if r["size"] else None for r in mixing.summary(one).collect()}
    counts: dict = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert all(counts.get(d, 0) == n for d, n in taken.items() if n is not None) and mixed.columns == docs.columns
    enc = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((r.doc_id, len(i := enc.encode_ordinary(r.text)), sha(" ".join(map(str, i)).encode()), sha(r.text.encode())) for r in mixed.collect())
    assert sorted(map(tuple, stages["byte_bpe"](spark, mixed, DIR).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == want


def test_repeated_ids_leave_one_row(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "other words here")], "doc_id long, text string")
    got = corpus_pipeline.near_copies(spark, docs, DIR).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (True, 0)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    shown = lambda rows: sorted(str(tuple(round(float(x), 7) if isinstance(x, (float, np.floating)) else x for x in r)) for r in rows)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    assert shown(df.select(*columns).collect()) == shown(want.select(*(f'"{c}"' for c in columns)).fetchall())
