"""Rules go to the texts: no part of a text is shuffled, however many rules there are."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import rule_tables


@pytest.mark.parametrize("at_once", [200_000, 40])
def test_texts_are_judged_where_they_are_read(spark, monkeypatch, at_once):
    monkeypatch.setattr(rule_tables, "RULES_AT_ONCE", at_once)
    texts = spark.range(300).select("id", F.concat(F.lit("Text "), F.col("id"), F.lit(" of many")).alias("text"))
    texts = texts.unionAll(texts.filter("id < 5"))  # rows that come twice are judged twice
    rules = [(f"n{i}", f"T {i} ", None) for i in range(100)]
    rules += [("p", "text", "text [0-4] of"), ("all", None, "^text"), ("short", "of", None), ("n1", "t 1 ", None)]
    hits = rule_tables.rule_hits(texts, spark.createDataFrame(rules, "rule_id string, literal string, pattern string"), ["id"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    every = [*range(300), *range(5)]
    expected = [(i, r) for i in every for r in ("all", "short")] + [(i, "p") for i in [*range(5)] * 2]
    expected += [(i, f"n{i}") for i in every if i < 100]
    assert sorted(map(tuple, hits.collect())) == sorted(expected)
