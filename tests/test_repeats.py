"""What is found of a text is found once for each distinct one, however often it is read."""

import pytest
from pyspark.sql import functions as F

from inkspark.functions.text import normalize
from inkspark.operators import interpret, lookup

ENTRIES = [(1, 1, "FW", "text", "fillet weld", ["F/W"], False), (1, 2, "F", "text", "3F leg (number in mm)", [], True), (1, 3, "BV", "text", "bevel", [], False)]
ENTRY = "ws int, seq int, code string, kind string, meaning string, aliases array<string>, is_leg boolean"
CANDIDATES = "array<struct<text:string,prob:double>>"


@pytest.fixture
def sizes(monkeypatch):
    """Rows of each table that the operators write."""
    seen = {}

    def counted(module):
        real = module.written

        def write(df, name="stage"):
            out = real(df, name)
            seen[name] = max(seen.get(name, 0), out.count())
            return out

        monkeypatch.setattr(module, "written", write)

    counted(lookup)
    if hasattr(interpret, "written"):
        counted(interpret)
    return seen


def test_lookup_of_repeats(spark, sizes):
    values = [("FW", []), ("f/w", [("BV", 0.3)]), ("5W", [("??", 0.9), ("BV", 0.4)]), ("F55", []), ("F5,5", [("BV", 0.2)]), ("unknown", [("FW", 0.5)]), (None, [("F7", 0.5)]), ("t=8", [])]
    rows = [(1, f"r{i}", *values[i % 8][:1], 0.5, values[i % 8][1], None, 0.8) for i in range(400)]
    readings = spark.createDataFrame(rows, f"ws int, ref_id string, value string, prob double, candidates {CANDIDATES}, second_meaning string, second_prob double")
    got = {r.ref_id: (r.raw, r.code, r.match, r.score) for r in lookup.matched(readings, spark.createDataFrame(ENTRIES, ENTRY), ["ws"]).collect()}
    expected = [("FW", "FW", "exact", 0.5), ("f/w", "FW", "alias", 0.5), ("BV", "BV", "candidate", 0.4), ("F5.5", "F", "fuzzy", 0.45), ("BV", "BV", "candidate", 0.2), ("FW", "FW", "candidate", 0.5), ("F7", "F", "candidate", 0.5), ("t=8", None, "none", 0.5)]
    assert len(got) == 400 and all(got[f"r{i}"] == expected[i % 8] for i in range(400))
    assert max(sizes.values()) < 20, sizes


def test_lines_of_repeats(spark, sizes):
    lines = ["P-1 FW t = 8", "FW", " ", None, "t = 8", "x y"]
    rows = [(i, 1, "t1", 1, "text", lines[i % 6], 0.5, []) for i in range(300)]
    readings = spark.createDataFrame(rows, f"photo int, ws int, ref_id string, seq int, kind string, value string, prob double, candidates {CANDIDATES}")
    nodes = spark.createDataFrame([(1, 1, "P-1", "B/P-1", "PART")], "ws int, seq int, node_id string, path string, level string")
    cut = interpret.segmented(readings, spark.createDataFrame(ENTRIES, ENTRY), nodes, ["photo"], ["ws"])
    got = {r.photo: r.pieces for r in cut.groupBy("photo").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda p: p.value).alias("pieces")).collect()}
    expected = [["P-1", "FW", "t = 8"], ["FW"], [" "], [None], ["t = 8"], ["x", "y"]]
    assert len(got) == 300 and all(got[i] == expected[i % 6] for i in range(300))
    assert sizes and max(sizes.values()) < 20, sizes


def test_plain_text_is_normalised_like_any(spark):
    given = ["a_b\t\n\x0b\f\r c-D", "", "x", "ｘ _Y", "\x1c\x7f"]
    rows = spark.createDataFrame([(v,) for v in given], "v string").select(normalize("v").alias("n")).collect()
    assert [r.n for r in rows] == ["A-BC-D", "", "X", "X-Y", "\x1c\x7f"]
