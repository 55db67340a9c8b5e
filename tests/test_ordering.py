"""Order over a whole table in slices, partitions of bounded size, lists that are derived once for each workspace."""

from pyspark.sql import functions as F

from inkspark.operators import analyses, ordering


def test_places_of_a_whole_table(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("at"))
    got = {r.at: r.n for r in ordering.numbered_whole(rows, ["at"], "n").collect()}
    assert got == {k: k + 1 for k in range(5000)}
    assert ordering.in_slices(rows.repartition(8), ["at"]).agg(F.count_distinct("at")).first()[0] == 5000


def test_partitions_follow_the_rows(spark):
    assert ordering.sized_slices(spark.range(1000), "id", most=100).rdd.getNumPartitions() == 10
    assert ordering.sized_slices(spark.range(1000), "id", most=1000).rdd.getNumPartitions() == spark.range(1000).rdd.getNumPartitions()


def test_context_is_derived_once_for_each_workspace(spark):
    jobs = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None)], "job_id int, workspace_id int")
    entries = spark.createDataFrame([(5, 2, "b", "x"), (5, 1, "a", "y")], "workspace_id int, seq int, code string, meaning string")
    nodes = spark.createDataFrame([(6, 1, "p")], "workspace_id int, seq int, path string")
    rules = spark.createDataFrame([(1, "FILLET")], "seq int, joint_type string")
    shown = {"codes": F.array_join(F.transform("symbols", lambda s: s.code), ","), "rules": F.size("standards")}
    got = sorted((r.job_id, r.codes, r.rules) for r in analyses.context_input(jobs, entries, nodes, rules, shown=shown).collect())
    assert got == [(1, "a,b", 1), (2, "a,b", 1), (3, None, 1), (4, None, 1)]
    assert analyses.context_input(jobs, entries, nodes, rules).where("job_id = 3").first().tree[0].path == "p"


def test_tree_readings_are_repaired_once_for_each_value(spark):
    from inkspark.operators import tree

    nodes = spark.createDataFrame([(1, 1, "B-1", "B-1", "BLOCK"), (2, 1, "C2", "C2", "BLOCK")], "ws int, seq int, node_id string, path string, level string")
    none = F.array().cast("array<struct<text:string,prob:double>>")
    rows = [(k, ws, "t1", 1, "b1", 0.5) for k, ws in ((1, 1), (2, 1), (3, 2))] + [(4, 2, "t1", 1, "c2", 0.5), (4, 2, "t1", 2, "none", 0.5), (5, 2, "t1", 1, None, 0.5)]
    df = spark.createDataFrame(rows, "k int, ws int, ref_id string, seq int, value string, prob double").withColumn("candidates", none)
    found = tree.hits(df, nodes, ["k"], ["ws"])
    assert sorted((r.k, r.seq, r.value, r.node.node_id, r.prob) for r in found.collect()) == [(1, 1, "b1", "B-1", 0.5), (2, 1, "b1", "B-1", 0.5), (4, 1, "c2", "C2", 0.5)]
