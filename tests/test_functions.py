"""Marking functions on the cases that their contract fixes."""

import pytest
from pyspark.sql import functions as F

from inkspark.functions import text as T
from inkspark.operators import folds, metrics, ranges


def values(spark, cases, f):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_repaired_forms_hold_the_right_one(spark):
    got = values(spark, ["F5,5", "V6.O", "54.5", None], T.ocr_variants)
    assert "F5.5" in got[0] and "V6.0" in got[1] and "S4.5" in got[2] and got[3] is None


def test_plausible_legs(spark):
    assert values(spark, ["55", "120", "5.5", "25", "26", "x", None], T.plausible_leg) == ["5.5", None, "5.5", "25", "2.6", None, None]


def test_thickness(spark):
    got = values(spark, ["t = 10", "t=10", "T 10", "12t", "T=1O", "835", None], lambda v: T.read_thickness(v).mm)
    assert got == [10.0, 10.0, 10.0, 12.0, 10.0, None, None]


def test_normalised_readings(spark):
    assert values(spark, [" p‐1０ ", "Ｐ-10"], T.normalize) == ["P-10", "P-10"]


def test_same_reading(spark):
    df = spark.createDataFrame([("→ f5.5", "F5.5"), ("P−1", "p-1"), ("O", "0"), (None, "")], "a string, b string")
    assert [r.o for r in df.select(T.same_reading("a", "b").alias("o")).collect()] == [True, True, False, True]


def test_natural_order(spark):
    df = spark.createDataFrame([("A/P-10",), ("A/P-2",), ("A",)], "p string")
    assert [r.p for r in df.orderBy(T.natural_key("p")).collect()] == ["A", "A/P-2", "A/P-10"]


def test_greedy_segments(spark):
    df = spark.createDataFrame([(["t", "=", "10", "F5.5", "x"], ["t = 10", "F5.5"])], "t array<string>, k array<string>")
    assert df.select(folds.segments(F.col("t"), F.col("k")).alias("o")).first().o == ["t = 10", "F5.5", "x"]


def test_wildcard_distance(spark):
    df = spark.createDataFrame([("F?5", "F55"), ("F?5", "F5"), ("abc", "")], "t string, r string")
    assert [r.o for r in df.select(metrics.edit_distance(F.col("t"), F.col("r")).alias("o")).collect()] == [0, 1, 3]


@pytest.mark.parametrize("thickness,outcome,position", [(10.0, "thickness", "2F"), (12.0, "thickness", "1F"), (8.0, "thickness_assumed", "2F"), (7.0, "no_thickness", None)])
def test_welding_condition(spark, thickness, outcome, position):
    standards = spark.createDataFrame(
        [(1, "FILLET", 8.0, 11.0, 4.0, 5.0, "P", "2F"), (2, "FILLET", 11.5, 14.0, 6.0, 7.0, "P", "1F"), (3, "FILLET", 8.0, 9.0, None, None, "P", "1F")],
        "seq int, joint_type string, thickness_min_mm double, thickness_max_mm double, leg_min_mm double, leg_max_mm double, process string, position string",
    )
    asked = spark.createDataFrame(
        [(1, "FILLET", None, thickness, None, None)], "photo_id int, joint_type string, positions array<string>, thickness double, leg_mm double, leg_positions array<string>"
    )
    r = ranges.welding_condition(asked, standards).first()
    assert (r.outcome, r.standard and r.standard.position) == (outcome, position)
