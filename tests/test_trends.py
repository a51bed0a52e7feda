"""Counts of keywords, where groups without any fall back on their abstracts."""

import pytest

from scriptorium.operators import trends as T


@pytest.mark.parametrize("most", [20_000, 0])
def test_abstracts_of_groups_without_keywords_stay_where_they_are(spark, monkeypatch, most):
    if hasattr(T, "MOST_GROUPS"):
        monkeypatch.setattr(T, "MOST_GROUPS", most)
    rows = [(1, ["graph"], "never counted"), (1, [], "never counted"), (2, [], "words words here"), (2, None, "here"), (None, [], "lost words"), (None, ["the"], None)]
    df = spark.createDataFrame(rows, "project_id int, keywords array<string>, abstract string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        found = T.keyword_counts(df, ["project_id"])
        got = sorted(map(tuple, found.collect()), key=repr)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == sorted([(1, "graph", 1), (2, "words", 2), (2, "here", 2), (None, "lost", 1), (None, "words", 1)], key=repr)
    moved = [below for line, below in zip(plan, plan[1:]) if "Exchange hashpartitioning" in line]
    assert moved and not any("abstract" in line for line in moved)
