"""Rows that cannot be in a result do not go on, and tables that grow do not go to the driver."""

from placelink import queries
from placelink.operators import search


def test_only_the_first_rows_of_a_name_meet_its_queries(spark):
    names = spark.createDataFrame([(k, "same" if k % 3 else "other") for k in range(600)], "feature_id long, name string")
    scored = spark.createDataFrame([(q, n, -float(q % 2) - (n == "same")) for q in range(4) for n in ("same", "other")], "qid long, name string, score double")
    found = search.tiered(scored, names, 5, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit [name#") == 1
    want = {(q, k, -float(q % 2) - 1, 1) for q in range(4) for k in (1, 2, 4, 5, 7)}
    assert {tuple(r) for r in found.collect()} == want
    assert search.tiered(scored, names, 1000, 2).count() == 4 * 600


def test_registered_features_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(k, f"n {k % 5}", "b", "t") for k in range(50)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("register_names", "register_names_split"):
        rows = queries.QUERIES[name](spark, str(tmp_path))
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count()
