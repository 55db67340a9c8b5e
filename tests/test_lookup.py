"""Similar keys against brute force, number and time texts in odd cases."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from inkspark.functions import values as V
from inkspark.operators import lookup


def test_closest_keys_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    known = [word(abc, rng.randint(1, 9)) for abc in ("AB", "ABCDE", "WELD-X1") for _ in range(40)]
    asked = {word(abc, rng.randint(1, 9)) for abc in ("AB", "ABCDE", "WELD-X1") for _ in range(60)}
    asked |= {k[:i] + rng.choice("AZ") + k[i + rng.randint(0, 1) :] for k in known for i in (0, len(k) // 2)} | {"", "A"}
    table = spark.createDataFrame([(1, k, i) for i, k in enumerate(known)] + [(2, "ABCDEFG", 0)], "ws int, key string, place int").withColumn("entry", F.col("key"))
    rows = spark.createDataFrame([(1, a) for a in sorted(asked)] + [(2, "ABCDEFG1"), (3, "ABCDEFG")], "ws int, key string").repartition(3)
    got = {(r.ws, r.key): (r.place, round(r.ratio, 9)) for r in lookup.closest(rows, table, ["ws"]).collect()}
    want = {(2, "ABCDEFG1"): (0, round(14 / 15, 9))}
    for a in asked:
        best = None
        for i, k in enumerate(known):
            if len(a) >= 2 and len(k) >= 2 and (ratio := SequenceMatcher(None, a, k).ratio()) >= lookup.FUZZY_MIN and (best is None or ratio > best[1]):
                best = (i, ratio)
        if best:
            want[(1, a)] = (best[0], round(best[1], 9))
    assert got == want and len(want) > 50


def test_the_pairs_compared_are_few(spark):
    """Two thousand keys and as many readings: the inverted index compares a small share of their pairs."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(8))
    known = sorted({word() for _ in range(2000)})
    table = spark.createDataFrame([(1, k, i) for i, k in enumerate(known)], "ws int, key string, place int").withColumn("entry", F.col("key"))
    asked = spark.createDataFrame([(1, k[:7] + "#") for k in known], "ws int, key string")
    assert lookup.closest(asked, table, ["ws"]).where("ratio >= 0.875").count() == len(known)


def test_short_numbers(spark):
    cases = [1234.5678, 0.0, 1.0, -2.5, 1234567.0, 0.0001234567, 0.00001, 999999.5, 100.0, 12.30, 1e100]
    df = spark.createDataFrame([(c,) for c in cases], "x double")
    assert [r.s for r in df.select(V.short_number("x").alias("s")).collect()] == [f"{c:g}" for c in cases]


def test_short_numbers_between_two_values(spark):
    """Halves go to the even digit, as the double's exact value says."""
    rng = random.Random(3)
    cases = [1000785.0, 1001785.0, 1000775.0, -1000785.0, 0.1234565, 123456.5, 123455.5, 9999995.0, -0.0, float("inf")]
    cases += [(rng.randrange(10**6) * 10 + 5) * 10.0 ** rng.randrange(-12, 20) for _ in range(3000)] + [(rng.randrange(10**6) * 2 + 1) / 2 ** rng.randrange(1, 9) for _ in range(1000)]
    df = spark.createDataFrame([(c,) for c in cases], "x double")
    assert [r.s for r in df.select(V.short_number("x").alias("s")).collect()] == [f"{c:g}" for c in cases]


def test_utc_texts_in_another_zone(spark):
    keep = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        df = spark.sql("SELECT TIMESTAMP '2024-01-01T00:00:00Z' AS t")
        assert df.select(V.utc_text("t").alias("s")).first().s == "2024-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", keep)
