"""Matching and shares on small planted tables."""

from pyspark.sql import functions as F

from inkspark.functions import geometry as G
from inkspark.operators import matching, metrics


def _boxed(spark, rows, name):
    df = spark.createDataFrame(rows, f"photo long, label string, {name} long, score double, x double, size double")
    return df.select("photo", "label", name, "score", G.box(F.col("x"), F.lit(0.0), F.col("x") + F.col("size"), F.lit(10.0)).alias("box"))


def test_a_truth_of_two_boxes_takes_with_both(spark):
    preds = _boxed(spark, [(1, "a", 7, 0.5, 0.0, 10.0), (1, "a", 8, 0.5, 50.0, 10.0), (1, "a", 9, 0.5, 90.0, 10.0)], "pred")
    truths = _boxed(spark, [(1, "a", 3, 0.0, 0.0, 10.0), (1, "a", 3, 0.0, 50.0, 10.0), (1, "a", 4, 0.0, 200.0, 10.0)], "truth")
    got = sorted((r.truth, r.preds, r.found) for r in matching.centre_matches(preds, truths.coalesce(1)).collect())
    assert got == [(3, [7, 8], True), (4, None, False)]


def test_shares_of_equal_sums_go_by_text(spark):
    rows = [(1, "b", x) for x in (0.1, 0.2, 0.3)] + [(1, "a", 0.6)] + [(2, "x", 0.0)]
    got = sorted((r.k, r.rank, r.text, r.share) for r in metrics.candidate_shares(spark.createDataFrame(rows, "k int, text string, p double"), ["k"], "text", "p").collect())
    assert got[:2] == [(1, 1, "a", 0.5), (1, 2, "b", 0.5)]
    assert got[2][:3] == (2, 1, "x") and got[2][3] != got[2][3]


def test_shares_equal_their_sql_in_the_last_digits(spark, tmp_path):
    """Sums that are equal but for the order of addition, nothing at all, what cancels, no value, no type."""
    import duckdb

    from inkspark.plans import queries as plans

    rows = [(1, "b", x) for x in (0.1, 0.2, 0.3)] + [(1, "a", 0.6)] + [(2, "a", x) for x in (0.3, 0.2, 0.1)] + [(2, "b", 0.6)]
    rows += [(3, "x", 0.0), (3, "y", None), (3, None, 0.0), (4, "x", 5.0), (4, "y", -5.0), (5, "x", None), (6, "y", 1e-25), (6, "x", 3e-25), (7, "y", 1e12), (7, "x", float("nan"))]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double").repartition(5, "value").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(repr, map(tuple, plans.QUERIES["candidate_shares"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, con.execute(plans.ORACLE["candidate_shares"]).fetchall())) and len(got) == 11


def test_precision_of_one_long_key(spark):
    """40000 rows of one key, as one slice: the frame that was read anew for each row took minutes here."""
    import time

    n = 40_000
    rows = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") % 7 < 3).alias("hit"), F.lit(n).alias("positives"), (F.col("id") * 37 % n % 10).alias("score"), F.col("id").alias("tie")).coalesce(1)
    started = time.time()
    got = metrics.average_precision(rows, ["k"], "hit", "score", "tie").first()
    assert time.time() - started < 60
    order, hits, curve = sorted(range(n), key=lambda i: (-(i * 37 % n % 10), i)), 0, []
    for r, i in enumerate(order, 1):
        hits += i % 7 < 3
        curve.append((i % 7 < 3, hits / r))
    top, area = 0.0, 0.0
    for hit, p in reversed(curve):
        top = max(top, p)
        area += top * hit
    assert got.n == n and abs(got.ap - area / n) < 1e-9
