"""Every query of the library against its SQL in DuckDB, on the smallest driver tables."""

import pytest
from compare import database, duck_rows, spark_rows

from inkspark.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert spark_rows(plans.QUERIES[name](spark, SF)) == duck_rows(con, plans.ORACLE[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["o_orderkey", "c_name", "o_orderdate", "o_orderpriority"]


def test_queries_without_sql_are_whole(spark):
    import zlib

    assert plans.QUERIES["fuzzy_ratio"](spark, SF).count() == 200
    rows = plans.QUERIES["greedy_iou_match"](spark, SF).collect()
    assert rows and all(r.overlap >= 0.2 for r in rows)
    assert len({(r.photo, r.pred) for r in rows}) == len({(r.photo, r.truth) for r in rows}) == len(rows)
    seeds = plans.QUERIES["crc_seeds"](spark, SF).collect()
    assert seeds and all(r.seed == zlib.crc32(f"{r.user_id}|{r.event_type}".encode()) for r in seeds)
    assert set(plans.QUERIES) - set(plans.ORACLE) == {"fuzzy_ratio", "greedy_iou_match", "crc_seeds"}


def test_stores_refuse_what_is_not_empty(spark, tmp_path):
    from inkspark.sources import readers, writers

    docs = spark.createDataFrame([("jobs", "a/1", 1, '{"n": 1}')], writers.DOCS)
    docs.write.parquet(f"{tmp_path}/a/docs")
    assert writers.is_empty(spark, f"{tmp_path}/b") and not writers.is_empty(spark, f"{tmp_path}/a")
    writers.migrate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    with pytest.raises(ValueError):
        writers.migrate(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert readers.collection(spark.read.parquet(f"{tmp_path}/b/docs"), "jobs", "n int").first().n == 1


def test_image_files(spark, tmp_path):
    from inkspark.sources import readers

    head = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    (tmp_path / "a.png").write_bytes(head)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.path[-5:]: (r.format, r.width, r.height) for r in readers.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 640, 480), "b.jpg": ("jpeg", None, None), "c.txt": (None, None, None)}
