"""Job states: composed maps and streams against the plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from inkspark.operators import folds, histories

EVENTS = [*folds.EVENTS, "noise", None]


def rows(n, jobs, seed):
    rng = random.Random(seed)
    return [(rng.choice(jobs), i, rng.choice(EVENTS)) for i in range(n)]


def states(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("jobs", [["a", "b", None], ["one"], [f"j{i}" for i in range(400)]])
def test_composed_maps_equal_the_fold(spark, jobs):
    df = spark.createDataFrame([(j, i % 3, i, e) for j, i, e in rows(3000, jobs, len(jobs))], "job string, kind int, seq int, event string").repartition(5)
    keys = ["job", "kind"]
    want = states(folds.job_states(df, keys, "event", ["seq"]))
    assert states(histories.job_states(df, keys, "event", ["seq"])) == want and len(want) == 3 * len(set(jobs)) or len(want) <= 3 * len(jobs)


def test_one_long_history_is_spread(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        df = spark.range(60_000).select(F.lit("job").alias("job"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, folds.EVENTS)), (F.pmod(F.xxhash64("id"), F.lit(6)) + 1).cast("int")).alias("event"))
        assert states(histories.job_states(df, ["job"], "event", ["seq"])) == states(folds.job_states(df, ["job"], "event", ["seq"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_events(spark):
    assert histories.job_states(spark.createDataFrame([], "job string, seq int, event string"), ["job"], "event", ["seq"]).count() == 0


def test_every_rule():
    assert histories.after("start", "approved", "approved") == ("analyzing", "approved")
    assert histories.after("failed", "analyzing", "needs_review") == ("needs_review", "needs_review")
    assert histories.after("approve", "needs_review", "needs_review") is None and histories.after("acknowledge", "needs_review", "needs_review") == ("approved", "approved")


# streams

LOG = "job string, at timestamp, seq long, event string, stage string"


def replay(spark, path, checkpoint, found, patience=None):
    """Runs what is new in the folder through a fresh query from the checkpoint, as after a restart; one file is a micro-batch."""
    from inkspark.streaming import jobs

    jobs.use_state_store(spark)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    keep = lambda df, _: [found.__setitem__(r.job, r) for r in df.collect()]
    query = jobs.job_states(stream, patience_ms=patience).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(240)


def test_stream_with_restarts_equals_the_fold(spark, tmp_path):
    log, found = rows(240, [f"j{i}" for i in range(12)], 9), {}
    start = 1_700_000_000
    for part in range(4):  # the third run finds two files
        mine = [(j, i, e) for j, i, e in log if i // 60 == part]
        df = spark.createDataFrame([(j, i, e) for j, i, e in mine], "job string, seq long, event string")
        df = df.select("job", F.timestamp_seconds(F.col("seq") + start).alias("at"), "seq", "event", F.lit(None).cast("string").alias("stage"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        if part != 2:
            replay(spark, f"{tmp_path}/log", f"{tmp_path}/state", found)
    whole = spark.createDataFrame(log, "job string, seq long, event string")
    want = {r.job: (r.status, r.accepted, r.rejected) for r in folds.job_states(whole, ["job"], "event", ["seq"]).collect()}
    assert {j: (r.status, r.accepted, r.rejected) for j, r in found.items()} == want


def test_stages_and_timeouts(spark, tmp_path):
    found = {}
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    file = lambda *events: spark.createDataFrame([(j, n, e, g) for n, (j, _, e, g) in enumerate(events)], "job string, seq long, event string, stage string").select("job", F.timestamp_seconds(1_700_000_000 + F.element_at(F.array(*[F.lit(s) for _, s, _, _ in events]), (F.col("seq") + 1).cast("int"))).alias("at"), "seq", "event", "stage").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    file(("a", 0, "start", None), ("a", 1, "stage", "vision"), ("a", 2, "stage", "vision"), ("b", 0, "stage", "vision"), ("b", 1, "start", None), ("b", 2, "passed", None), ("b", 3, "start", None))
    replay(spark, f"{tmp_path}/log", f"{tmp_path}/state", found, 60_000)
    assert (found["a"].status, found["a"].stage, found["a"].accepted, found["a"].rejected) == ("analyzing", "vision", 2, 1)
    assert (found["b"].status, found["b"].accepted, found["b"].rejected) == ("analyzing", 3, 1)
    file(("c", 4000, "start", None))
    file(("c", 4001, "passed", None))
    replay(spark, f"{tmp_path}/log", f"{tmp_path}/state", found, 60_000)
    assert (found["a"].status, found["a"].last_event, found["b"].status) == ("draft", "timeout", "awaiting_approval")
    assert found["c"].status == "awaiting_approval"
    assert at(0) is not None
