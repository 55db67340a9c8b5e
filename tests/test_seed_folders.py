"""Seed folders as tables: order of rows, repeated nodes, missing files."""

import json

from pyspark.sql import functions as F

from inkspark.sources import readers


def test_folders(spark, tmp_path):
    assert readers.project_trees(spark, str(tmp_path)).count() == 0 and readers.projects(spark, str(tmp_path), "id string").count() == 0
    for ws, prj, tree, jobs in (("w1", "p2", "A,,BLOCK,A\nB,A,SUB,A/B\nA,,LARGE,A2\n", [{"id": "j1", "project_id": "x", "n": 2}, {"id": "j2", "n": 1}]), ("w1", "p10", None, None), ("w2", "p1", "Z,,BLOCK,Z\n", [])):
        folder = tmp_path / "workspaces" / ws / "projects" / prj
        folder.mkdir(parents=True)
        (folder / "project.json").write_text(json.dumps({"id": "other", "name": f"{ws} {prj}"}, indent=1))
        if tree is not None:
            (folder / "assembly_tree.csv").write_text("node_id,parent_id,level,path\n" + tree)
            (folder / "jobs.json").write_text(json.dumps({"jobs": jobs}, indent=1))
    rows = readers.project_trees(spark, str(tmp_path)).select("workspace_id", "project_id", "seq", "node_id", "parent_id", "level", "path").collect()
    assert sorted(map(tuple, rows)) == [("w1", "p2", 1, "A", None, "LARGE", "A2"), ("w1", "p2", 2, "B", "A", "SUB", "A/B"), ("w2", "p1", 1, "Z", None, "BLOCK", "Z")]
    found = readers.projects(spark, str(tmp_path), "id string, name string").orderBy("workspace_id", "position").collect()
    assert [tuple(r) for r in found] == [("w1", "p10", "other", "w1 p10", 1), ("w1", "p2", "other", "w1 p2", 2), ("w2", "p1", "other", "w2 p1", 1)]
    jobs = readers.project_jobs(spark, str(tmp_path), "id string, project_id string, n int").orderBy("seq").collect()
    assert [tuple(r) for r in jobs] == [("w1", "p2", 1, "j1", 2), ("w1", "p2", 2, "j2", 1)]


def test_order_of_a_file_read_in_pieces(spark, tmp_path):
    folder = tmp_path / "workspaces" / "w" / "projects" / "p"
    folder.mkdir(parents=True)
    n = 20_000
    (folder / "assembly_tree.csv").write_text("node_id,parent_id,level,path\n" + "".join(f"N{i},,PART,{i}\n" for i in range(n)) + "N7,,PART,last\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = readers.project_trees(spark, str(tmp_path))
        assert rows.where(F.col("node_id") != F.concat(F.lit("N"), (F.col("seq") - 1).cast("string"))).count() == 0
        assert rows.count() == n and rows.where("node_id = 'N7'").first().path == "last"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
