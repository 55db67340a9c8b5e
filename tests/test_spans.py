"""Runs of neighbouring tokens."""

from pyspark.sql import functions as F

from inkspark.functions.text import spans


def test_spans_split_a_text_once(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(text,), (None,), ("a b",)], "text string").select(spans(F.split("text", " ")).alias("s"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [len(r.s) for r in rows.collect()] == [147, 0, 3]
