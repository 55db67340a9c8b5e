"""Context of jobs whose workspaces have long lists."""

import os

from pyspark.sql import functions as F

from inkspark.operators import analyses


def test_long_lists_are_written_once_for_each_slice(spark, tmp_path):
    """24 workspaces with lists of 130 kB, 1200 jobs that take turns: 156 MB if each job's list is written."""
    jobs = spark.range(1200).select(F.col("id").alias("job_id"), F.when(F.col("id") % 25 < 24, F.col("id") % 25).alias("workspace_id"))
    entries = spark.range(24 * 2000).select((F.col("id") % 24).alias("workspace_id"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("code"), F.lit("m").alias("meaning"))
    nodes = spark.createDataFrame([(3, 1, "B/x")], "workspace_id long, seq long, path string")
    standards = spark.createDataFrame([(1, "FILLET")], "seq int, joint_type string")
    shown = {"codes": F.array_join(F.transform("symbols", lambda s: s.code), ","), "tree": F.size("tree")}
    analyses.context_input(jobs.coalesce(1), entries, nodes, standards, shown=shown).write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in os.scandir(f"{tmp_path}/out")) < 30_000_000
    texts = entries.groupBy("workspace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda s: s.code), ",").alias("codes"))
    want = jobs.join(texts, "workspace_id", "left").select("job_id", "workspace_id", F.md5("codes").alias("codes"), (F.col("workspace_id") == 3).alias("tree"))
    got = spark.read.parquet(f"{tmp_path}/out").select("job_id", "workspace_id", F.md5("codes").alias("codes"), "tree")
    rows = lambda df: sorted((r.job_id, r.workspace_id, r.codes, r.tree in (True, 1)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 1200
