import sqlite3

import pytest
from pyspark.sql import functions as F

from placelink.functions import text as T
from placelink.operators import search

SOUNDEX = {"Robert": "R163", "Pfister": "P236", "Ashcraft": "A261", "Tymczak": "T522", "Lee": "L000", "Andora": "A536", "Andorra": "A536", "": "", None: "", "123 !!": ""}
CORPUS = ["New York", "New York City", "York", "St. Gallen", "St Gallen", "St-Gallen", "Zürich", "Zurich", "New New York", "Foo", "Bar baz", "Île-de-France", "Washington D.C.", "O'Brien", "Straße", "york"]


def test_soundex(spark):
    rows = spark.createDataFrame([(k,) for k in [*SOUNDEX, "O'Brien", "OBrien"]], "t string").select("t", T.soundex(F.col("t"))).collect()
    got = dict(map(tuple, rows))
    assert {k: got[k] for k in SOUNDEX} == SOUNDEX and got["O'Brien"] == got["OBrien"]


@pytest.mark.parametrize("a,b,d", [("Paris", "Paris", 0), ("paris", "PARIS", 0), ("Andorra", "Andora", 1), (None, "Paris", 5), ("Paris", None, 5)])
def test_levenshtein(spark, a, b, d):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.levenshtein(F.col("a"), F.col("b"))).first()[0] == d


def test_tokens(spark):
    rows = spark.createDataFrame([("St. Gallen",), ("St-Gallen",), ("O'Brien",), ("ÎLE",), ("áb",), ("Straße",), (None,)], "t string")
    got = [r[0] for r in rows.select(T.tokens(F.col("t"))).collect()]
    assert got == [["st.", "gallen"], ["st", "gallen"], ["o", "brien"], ["ile"], ["ab"], ["straße"], None]


def _fts(match, terms=None):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize=\"unicode61 remove_diacritics 2 tokenchars '.'\")")
    db.executemany("insert into f(rowid, t) values (?, ?)", enumerate(CORPUS))
    return {r[0]: round(r[1], 9) for r in db.execute("select rowid, bm25(f) from f where f match ?", (match,))}


@pytest.mark.parametrize("method,query,match", [
    ("phrase", "New York", '"New York"'), ("phrase", "York", '"York"'), ("phrase", "St. Gallen", '"St. Gallen"'), ("phrase", "St Gallen", '"St Gallen"'),
    ("phrase", "Zurich", '"Zurich"'), ("phrase", "strasse", '"strasse"'), ("partial", "New York", '"New" OR "York"'), ("partial", "York York", '"York" OR "York"'),
    ("partial", "St-Gallen", '"St-Gallen"'), ("partial", "d.c. île", '"d.c." OR "île"'),
])
def test_ranking_agrees_with_a_full_text_index(spark, method, query, match):
    names = spark.createDataFrame(list(enumerate(CORPUS)), "feature_id long, name string")
    asked = spark.createDataFrame([(1, query)], "qid long, query string")
    got = {r.feature_id: r.score for r in search.search(names, asked, method, tiers=100).collect()}
    want = _fts(match)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_search_edges(spark):
    names = spark.createDataFrame([*enumerate(CORPUS), (99, None), (100, "")], "feature_id long, name string")
    asked = spark.createDataFrame([(1, 'new  "york"'), (2, ""), (3, "!!"), (4, "York"), (5, "Andora")], "qid long, query string")
    for method in search.METHODS[:3]:
        assert {r.qid for r in search.search(names, asked, method).collect()} <= {1, 4}
    exact = {(r.qid, r.feature_id) for r in search.search(names, asked, "exact").collect()}
    assert (4, 2) in exact and (4, 15) in exact and not any(q in (2, 3) for q, _ in exact)
    fuzzy = search.search(names.union(spark.createDataFrame([(7, "Andorra")], names.schema)), asked, "fuzzy").where("qid = 5").collect()
    assert [(r.feature_id, r.score) for r in fuzzy] == [(7, 1)]
    assert search.search(names, asked, "phrase", limit=1, tiers=5).where("qid = 4").count() == 1
    one, two = (search.search(names, asked, "phrase", tiers=t).where("qid = 4").count() for t in (1, 2))
    assert two > one
    assert search.search(names.limit(0), asked, "partial").count() == 0
    with pytest.raises(ValueError):
        search.search(names, asked, "best")


def test_small_expressions(spark):
    row = spark.createDataFrame([("a\r\nb\rc😀d", "Bern", "", None)], "t string, n string, e string, z string")
    got = row.select(T.newlines(F.col("t")), T.span_text(F.col("t"), F.lit(-2), F.lit(3)), T.span_text(F.col("t"), F.lit(6), F.lit(99)), T.description(F.col("n"), F.col("e"), [F.col("z"), F.lit("BE")]), T.description(F.col("n"), F.lit("city"), []), T.escape_html(F.lit("<a>&'\""))).first()
    assert list(got) == ["a\nb\nc😀d", "a\r\n", "😀d", "Bern in BE", "Bern (city)", "&lt;a&gt;&amp;&#x27;&quot;"]
    assert T.module_text("M", {"b": 1, "a": "x"}) == "M(a='x', b=1)" and len(T.module_id("M", {})) == 8
