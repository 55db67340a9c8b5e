"""Queries of long histories and of streams; both must end in the states of the plain fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import histories
from inkspark.plans.queries import ORACLE, query, table
from inkspark.sources.scratch import folder
from inkspark.streaming import jobs

_TO = "CASE WHEN x.e = 'start' AND a.status <> 'analyzing' THEN 'analyzing' WHEN x.e = 'passed' AND a.status = 'analyzing' THEN 'awaiting_approval' WHEN x.e = 'unsure' AND a.status = 'analyzing' THEN 'needs_review' WHEN x.e = 'failed' AND a.status = 'analyzing' THEN a.before WHEN x.e = 'approve' AND a.status = 'awaiting_approval' THEN 'approved' END"


def _named(kind):
    """Kinds of the events table as events of jobs."""
    return F.when(kind == "signup", "start").when(kind == "view", "passed").when(kind == "click", "unsure").when(kind == "error", "failed").otherwise("approve")


@query(f"""
WITH ev AS (SELECT user_id % 3 AS job, list({{'e': CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'passed' WHEN 'click' THEN 'unsure' WHEN 'error' THEN 'failed' ELSE 'approve' END, 'status': '', 'before': '', 'accepted': 0, 'rejected': 0}} ORDER BY ts, event_id) AS es FROM events GROUP BY ALL),
f AS (SELECT job, list_reduce(es, lambda a, x: {{'e': '', 'status': coalesce({_TO}, a.status), 'before': CASE WHEN x.e = 'start' AND a.status <> 'analyzing' THEN a.status ELSE a.before END, 'accepted': a.accepted + (({_TO}) IS NOT NULL)::INT, 'rejected': a.rejected + (({_TO}) IS NULL)::INT}},
  {{'e': '', 'status': 'draft', 'before': 'draft', 'accepted': 0, 'rejected': 0}}) AS s FROM ev)
SELECT job, s.status, s.accepted, s.rejected FROM f
""")
def long_histories(spark: SparkSession, d: str) -> DataFrame:
    """Three jobs with a third of all events each: pieces of a history are composed apart."""
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("job"), _named(F.col("event_type")).alias("event"), "ts", "event_id")
    return histories.job_states(e, ["job"], "event", ["ts", "event_id"])


@query(ORACLE["job_state_fold"])
def job_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream: what is there runs through the state store, each job's last output counts."""
    jobs.use_state_store(spark)
    out, kept = folder(spark, "stream"), folder(spark, "stream-state")
    kinds = table(spark, d, "events").schema
    stream = spark.readStream.schema(kinds).parquet(f"{d}/event[s].parquet")  # a pattern matches a file or a folder
    named = stream.select(F.col("user_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), _named(F.col("event_type")).alias("event"), F.lit(None).cast("string").alias("stage"))
    found = jobs.job_states(named)
    run = found.writeStream.outputMode("update").option("checkpointLocation", kept).trigger(availableNow=True).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
    run.awaitTermination()
    rows = spark.read.schema(f"{jobs.OUTPUT}, batch long").parquet(out)
    last = rows.groupBy("job").agg(F.max_by(F.struct("status", "accepted", "rejected"), "batch").alias("s"))
    return last.select(F.col("job").cast("long").alias("user_id"), "s.status", F.col("s.accepted").cast("int").alias("accepted"), F.col("s.rejected").cast("int").alias("rejected"))
