"""Queries of the interpretation of readings, over cases that the rows' keys deal out; the SQL states each case's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import interpret, lookup, ranges
from inkspark.plans.queries import query, table

_CANDS = "array<struct<text:string,prob:double>>"


def _entries(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 1, "F", "text", "3F leg (number in mm)", [], True, None), (1, 2, "V", "text", "2F leg (number in mm)", ["VV"], True, None),
        (1, 3, "FW", "text", "fillet weld", ["FILLET", "fil-w"], False, "FILLET"), (1, 4, "WELDZ", "text", "weld z", [], False, "BUTT"),
        (1, 5, "WELDA", "text", "weld a", [], False, "BUTT"), (1, 6, "slit", "symbol", "slit", [], False, None), (1, 7, "scallop", "symbol", "scallop 1F and 2F", [], False, None),
        (1, 8, "N", "text", "number (no unit)", [], False, None),
    ]
    return spark.createDataFrame(rows, "ws int, seq int, code string, kind string, meaning string, aliases array<string>, is_leg boolean, joint_type string")


def _nodes(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, "B1", "B1", "BLOCK"), (1, 2, "S1", "B1/S1", "SUB"), (1, 3, "P-1", "B1/S1/P-1", "PART"), (1, 4, "P-3", "B1/S2/P-3", "PART"), (1, 5, "S2", "B1/S2", "SUB")]
    return spark.createDataFrame(rows, "ws int, seq int, node_id string, path string, level string")


def _pick(key, *values):
    """The value at ``key`` modulo their number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_pick(key: str, *values: str) -> str:
    return f"(['{"', '".join(values)}'])[{key} % {len(values)} + 1]"


# --- the cascade and what is known ---------------------------------------------------------

_CASCADE = (
    # value, raw, code, meaning, match, score at probability 0.9
    ("fw", "fw", "FW", "fillet weld", "exact", 0.9), ("vv", "vv", "V", "2F leg (number in mm)", "alias", 0.9), ("F5.5", "F5.5", "F", "3F leg 5.5mm", "exact", 0.9),
    ("F55", "F5.5", "F", "3F leg 5.5mm", "fuzzy", 0.81), ("qq", "FW", "FW", "fillet weld", "candidate", 0.3), ("V6.O", "V6.0", "V", "2F leg 6.0mm", "fuzzy", 0.81),
    ("835", "835", None, "dimension 835mm", "none", 0.9), ("WELDX", "WELDX", "WELDZ", "weld z", "fuzzy", 0.72), ("~~", "~~", None, "a wave", "vlm", 0.6),
    ("t = 12", "t = 12", None, "plate thickness 12mm", "none", 0.9), ("tI2", "T12", None, "plate thickness 12mm", "none", 0.81), ("F120", "F120", None, None, "none", 0.0),
    ("unknown", "FILLET", "FW", "fillet weld", "candidate", 0.2), ("N7", "N7", "N", "number 7", "exact", 0.9),
)
_VALUES = ", ".join("(" + ", ".join([str(i)] + ["NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in row[1:]]) + ")" for i, row in enumerate(_CASCADE))


@query(f"SELECT p_partkey, raw, code, meaning, match, score FROM part JOIN (VALUES {_VALUES}) v(i, raw, code, meaning, match, score) ON i = p_partkey % {len(_CASCADE)}")
def cascade_steps(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the lookup cascade, ties of similarity, and readings that no step explains."""
    k = F.col("p_partkey")
    value = _pick(k, *[row[0] for row in _CASCADE])
    case = F.pmod(k, F.lit(len(_CASCADE)))
    cand = lambda text, p: F.array(F.struct(F.lit("?!").alias("text"), F.lit(0.5).alias("prob")), F.struct(F.lit(text).alias("text"), F.lit(p).alias("prob")))
    cands = F.when(case == 4, cand("FW", 0.3)).when(case == 12, cand("FILLET", 0.2)).otherwise(F.array().cast(_CANDS)).cast(_CANDS)
    readings = table(spark, d, "part").select(F.lit(1).alias("ws"), k.alias("ref_id"), value.alias("value"), F.lit(0.9).alias("prob"), cands.alias("candidates"), F.when(case == 8, "a wave").alias("second_meaning"), F.lit(0.6).alias("second_prob"))
    return lookup.matched(readings, _entries(spark), ["ws"]).select(F.col("ref_id").alias("p_partkey"), "raw", "code", "meaning", "match", "score")


_TRIED = (("FW", True), ("zz9", False), ("F5.5", True), ("F120", False), ("P1", True), ("P-I", True), ("T=1O", True), ("B1/S1", True), ("N", True), ("835", False), ("slit7", False))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', {k})" for v, k in _TRIED) + ") v(value, known)")
def known_markings(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "part").select(F.lit(1).alias("ws"), _pick(F.col("p_partkey"), *[v for v, _ in _TRIED]).alias("value"))
    return interpret.known_values(values, _entries(spark), _nodes(spark), ["ws"]).select("value", "known")


# --- readings of two readers ----------------------------------------------------------------

_FIRST, _SECOND = ("FW", "zz9", "F5.5", "qq"), ("unknown", "FW", "q7", "f5.5", "V7")
_SCENE = f"""
e AS (SELECT user_id, event_id, event_id % 10 / 10.0::DOUBLE AS prob, {_sql_pick("event_id", *_FIRST)} AS value, event_id % 7 = 0 AS corrected, CASE WHEN event_id % 3 = 0 THEN {_sql_pick("event_id", *_SECOND)} END AS other FROM events),
r AS (SELECT *, coalesce(NOT corrected AND upper(other) <> upper(value) AND other <> 'unknown' AND ((other IN ('FW', 'f5.5', 'V7') AND value NOT IN ('FW', 'F5.5')) OR (prob < 0.9 AND (other IN ('FW', 'f5.5', 'V7') OR value NOT IN ('FW', 'F5.5')))), false) AS used FROM e)
"""


def _scene(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First readings, corrections and second readings of users' events; users are photos."""
    e, k = table(spark, d, "events").withColumn("ws", F.lit(1)), F.col("event_id")
    ref = lambda kind: F.concat(F.lit(kind), k.cast("string")).alias("ref_id")
    first = e.select("user_id", "ws", ref("t"), k.alias("seq"), F.lit("text").alias("kind"), _pick(k, *_FIRST).alias("value"), (k % 10 / 10).alias("prob"), F.array().cast(_CANDS).alias("candidates"))
    fixed = e.where("event_id % 7 = 0").select("user_id", ref("t").alias("target"), F.lit("V6").alias("value"), F.lit("m").alias("meaning"))
    seen = lambda kind, cond: e.where(cond).select("user_id", "ws", ref(kind), k.alias("seq"), F.lit("text").alias("kind"), _pick(k, *_SECOND).alias("value"), F.lit(0.8).alias("second_prob"))
    return first, fixed, seen("t", "event_id % 3 = 0").union(seen("v", "event_id % 11 = 0"))


def _collected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    first, fixed, second = _scene(spark, d)
    values = first.select("ws", "value").union(second.select("ws", "value"))
    known = interpret.known_values(values, _entries(spark), _nodes(spark), ["ws"])
    return interpret.collected(first, fixed, second, known, ["user_id"], ["ws"]), second


@query(f"""
WITH {_SCENE}
SELECT user_id, 't' || event_id AS ref_id, CASE WHEN corrected THEN 'V6' WHEN used THEN other ELSE value END AS value, CASE WHEN corrected THEN 1 WHEN used THEN 0.8 ELSE prob END::DOUBLE AS prob, corrected, used AS second_used,
       CASE WHEN used THEN value END AS first_value, used::INT AS candidates FROM r
UNION ALL SELECT user_id, 'v' || event_id, {_sql_pick("event_id", *_SECOND)}, 0.8, false, false, NULL, 0 FROM events WHERE event_id % 11 = 0
""")
def collect_readings(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _collected(spark, d)
    return rows.select("user_id", "ref_id", "value", "prob", "corrected", "second_used", "first_value", F.size("candidates").alias("candidates"))


@query(f"""
WITH {_SCENE}
SELECT user_id, 't' || event_id AS ref_id, used FROM r WHERE other IS NOT NULL UNION ALL SELECT user_id, 'v' || event_id, false FROM events WHERE event_id % 11 = 0
""")
def mark_used(spark: SparkSession, d: str) -> DataFrame:
    rows, second = _collected(spark, d)
    return interpret.marked_used(second, rows, ["user_id"]).select("user_id", "ref_id", "used")


@query(f"""
WITH {_SCENE}
SELECT user_id, 't' || event_id AS ref_id, CASE WHEN other IS NULL THEN 'first_only' WHEN used THEN 'used' ELSE 'differ' END AS kind, CASE WHEN other IS NOT NULL AND NOT used THEN 'warning' ELSE 'info' END AS severity
FROM r WHERE NOT corrected AND (other IS NULL OR used OR upper(other) <> upper(value))
UNION ALL SELECT user_id, 'v' || event_id, 'second_only', 'info' FROM events WHERE event_id % 11 = 0
""")
def reader_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows, second = _collected(spark, d)
    return interpret.second_conflicts(rows, second, ["user_id"])


_LINES = (("P-1 FW t = 10", "P-1|FW|t = 10"), ("t = 10", "t = 10"), ("F 5.5 x", "F 5.5|x"), ("FW", "FW"), ("V 6.0  FW fil - w", "V 6.0|FW|fil - w"), ("a b c", "a|b|c"))


@query(f"SELECT p_partkey, {_sql_pick('p_partkey', *[p for _, p in _LINES])} AS pieces FROM part")
def segment_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.lit(1).alias("ws"), F.lit("t1").alias("ref_id"), F.lit("text").alias("kind"), _pick(k, *[v for v, _ in _LINES]).alias("value"), F.array().cast(_CANDS).alias("candidates"))
    cut = interpret.segmented(rows, _entries(spark), _nodes(spark), ["p_partkey"], ["ws"])
    return cut.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda x: x.value), "|").alias("pieces"))


# --- the part ------------------------------------------------------------------------------------

_PARTS = (
    # readings, correction, job path -> source, node, path, level, found, refs, conflict
    (("P-1", "S1"), "B1/S2", None, ("correction", "S2", "B1/S2", "SUB", True, "", None)),
    (("S1", "P1"), None, "B1", ("tree", "P-1", "B1/S1/P-1", "PART", True, "t1|t2", None)),
    (("P-1", "P-3"), None, None, ("tree", "P-1", "B1/S1/P-1", "PART", True, "t1", "ambiguous")),
    (("P-I", "zz"), None, None, ("tree", "P-1", "B1/S1/P-1", "PART", True, "t1", "repaired")),
    (("zz", "P-9"), None, "B1", ("part_like", "P-9", None, None, False, "t2", "not_in_tree")),
    (("zz", "yy"), None, "B1/S1", ("job", "S1", "B1/S1", "SUB", True, "", None)),
    (("zz", "yy"), None, "B1/X", ("job", "X", "B1/X", None, False, "", "not_in_tree")),
    (("zz", "yy"), None, None, ("none", None, None, None, False, "", None)),
    (("P-1", "S2"), "B1/S1/P-1", None, ("correction", "P-1", "B1/S1/P-1", "PART", True, "t1", None)),
)


def _lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, bool) else f"'{x}'"


@query(
    "SELECT c_custkey, source, node_id, assembly_path, level, found_in_tree, refs, conflict FROM customer JOIN (VALUES "
    + ", ".join(f"({i}, {', '.join(map(_lit, row[3]))})" for i, row in enumerate(_PARTS))
    + f") v(i, source, node_id, assembly_path, level, found_in_tree, refs, conflict) ON i = c_custkey % {len(_PARTS)}"
)
def find_part(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").withColumn("ws", F.lit(1))
    photos = c.select("c_custkey", "ws", F.nullif(_pick(k, *[r[2] or "" for r in _PARTS]), F.lit("")).alias("job_path"))
    one = lambda n: c.select("c_custkey", "ws", F.lit(f"t{n}").alias("ref_id"), F.lit(n).alias("seq"), F.lit("text").alias("kind"), _pick(k, *[r[0][n - 1] for r in _PARTS]).alias("value"), F.lit(1.0 - n / 10).alias("prob"), F.array().cast(_CANDS).alias("candidates"))
    fixed = c.select("c_custkey", F.lit("part").alias("target"), _pick(k, *[r[1] or "" for r in _PARTS]).alias("value")).where("value <> ''")
    part = interpret.part_of(photos, one(1).union(one(2)), _nodes(spark), fixed, ["c_custkey"], ["ws"])
    return part.withColumn("refs", F.array_join("ref_ids", "|")).drop("ref_ids")


# --- marks, legs, cells, conflicts ------------------------------------------------------------------

_CODES = ("F", "FW", "scallop", "WELDA", "V", "slit")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("user_id", F.lit(1).alias("ws"), F.concat(F.lit("t"), k.cast("string")).alias("ref_id"), k.alias("seq"), _pick(k, *_CODES).alias("code"), (k % 10 / 10).alias("score"))


_MATCHES = f"SELECT user_id, event_id, event_id % 10 / 10.0::DOUBLE AS score, {_sql_pick('event_id', *_CODES)} AS code FROM events"


@query(f"""
WITH m AS ({_MATCHES})
SELECT user_id, CASE code WHEN 'FW' THEN 'FILLET' ELSE 'BUTT' END AS joint_type, max(score) AS top_score, min(event_id) AS first_seq, string_agg('t' || event_id, '|' ORDER BY event_id) AS refs FROM m WHERE code IN ('FW', 'WELDA') GROUP BY ALL
""")
def joint_type_marks(spark: SparkSession, d: str) -> DataFrame:
    marks = interpret.joint_marks(_matches(spark, d), _entries(spark), ["user_id"], ["ws"])
    return marks.select("user_id", "joint_type", "top_score", "first_seq", F.array_join("ref_ids", "|").alias("refs"))


@query(f"""
WITH m AS ({_MATCHES}), p AS (SELECT user_id, event_id, unnest(CASE code WHEN 'F' THEN ['3F'] WHEN 'V' THEN ['2F'] ELSE ['1F', '2F'] END) AS p FROM m WHERE code IN ('F', 'V', 'scallop'))
SELECT user_id, array_to_string(list_sort(list(DISTINCT p)), '|') AS positions, count(DISTINCT event_id) AS refs FROM p GROUP BY user_id
""")
def position_marks(spark: SparkSession, d: str) -> DataFrame:
    marks = interpret.position_marks(_matches(spark, d), _entries(spark), ["user_id"], ["ws"])
    return marks.select("user_id", F.array_join("positions", "|").alias("positions"), F.size("ref_ids").cast("long").alias("refs"))


@query("""
WITH r AS (SELECT event_id, user_id, event_id % 10 AS n, event_id % 4 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'F' ELSE 'V' END AS code, n + 2.5::DOUBLE AS size_mm, CASE k WHEN 0 THEN 'F' ELSE 'V' END || (n + 2) || '.5' AS raw_text, CASE k WHEN 0 THEN '3F leg' ELSE '2F leg' END AS meaning,
       NOT (user_id % 2 = 0 AND event_id % 5 > 0 AND NOT EXISTS (SELECT 1 FROM r s WHERE s.user_id = r.user_id AND s.event_id % 3 = 0 AND s.n = r.n AND s.k % 2 = r.k % 2)) AS used
FROM r WHERE k < 2
""")
def leg_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Legs of even users, whose photo the second reader saw, count only if it read them too, or a person corrected them."""
    k, n = F.col("event_id"), F.col("event_id") % 10 + 2
    e = table(spark, d, "events").withColumn("ws", F.lit(1))
    code = F.when(k % 4 == 0, "F").when(k % 4 == 1, "V").otherwise("FW")
    raw = F.concat(F.lower(code), F.lit(" "), n.cast("string"), F.lit(".5"))
    pairs = e.select("user_id", "ws", F.concat(F.lit("t"), k.cast("string")).alias("ref_id"), k.alias("seq"), raw.alias("raw"), code.alias("code"), F.lit("exact").alias("match"), (k % 5 == 0).alias("corrected"))
    second = e.where("event_id % 3 = 0").select("user_id", F.lit("text").alias("kind"), F.concat(F.lit("→"), F.when(k % 2 == 0, "F").otherwise("V"), n.cast("string"), F.lit(".5, x")).alias("value"))
    legs = interpret.leg_lengths(pairs, _entries(spark), second, e.where("user_id % 2 = 0").select("user_id"), ["user_id"], ["ws"])
    return legs.select(F.col("seq").alias("event_id"), "code", "size_mm", "raw_text", "meaning", "used")


@query("""
WITH r AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'scallop' WHEN 1 THEN 'slit' ELSE 'arrow' END AS code, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'right' WHEN value < 50 THEN 'left' ELSE 'right' END AS side FROM events)
SELECT user_id, concat_ws('|', CASE WHEN bool_or(side = 'left' AND code = 'slit') THEN 'slit' END, CASE WHEN bool_or(side = 'left' AND code = 'scallop') THEN 'scallop' END) AS left_side,
       concat_ws('|', CASE WHEN bool_or(side = 'right' AND code = 'slit') THEN 'slit' END, CASE WHEN bool_or(side = 'right' AND code = 'scallop') THEN 'scallop' END) AS right_side,
       count(side) AS placed, count(*) - count(side) AS unplaced FROM r WHERE code <> 'arrow' GROUP BY user_id
""")
def cell_sides(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, d, "events").withColumn("ref_id", F.concat(F.lit("s"), k.cast("string")))
    pairs = e.select("user_id", "ref_id", k.alias("seq"), F.lit("symbol").alias("kind"), _pick(k, "scallop", "slit", "arrow").alias("code"))
    boxes = e.where("event_id % 4 <> 0").select("user_id", "ref_id", (F.col("value") - 10).alias("x1"), (F.col("value") + 10).alias("x2"))
    second = e.where("event_id % 4 <> 0 AND event_id % 5 = 0").select("user_id", "ref_id", F.lit(90.0).alias("x1"), F.lit(95.0).alias("x2"))
    found = interpret.cells(pairs, boxes, second, e.select("user_id", F.lit(100.0).alias("width")).distinct(), ["user_id"])
    return found.select("user_id", F.array_join("left", "|").alias("left_side"), F.array_join("right", "|").alias("right_side"), F.size("ref_ids").cast("long").alias("placed"), F.size("unplaced").cast("long").alias("unplaced"))


_CONFLICTS = (
    # value, raw, match, meaning, ref, kind, candidate -> conflicts
    ("F55", "F5.5", "fuzzy", "x", "t", "text", None, "point_restored:warning"), ("F120", "F120", "none", None, "t", "text", None, "implausible_leg:warning"), ("V6.O", "V6.0", "fuzzy", "x", "t", "text", None, "repaired:info"),
    ("WELDX", "WELDX", "fuzzy", "x", "t", "text", None, "similar:info"), ("~", "~", "vlm", "x", "t", "text", None, "second_meaning:info"), ("t=12", "t=12", "none", "x", "t", "text", None, "rule:info"),
    ("hook", "hook", "none", None, "v", "symbol", None, "unknown_symbol:info"), ("qq", "qq", "none", None, "t", "text", None, "unmatched:warning"), ("835", "835", "none", "x", "t", "text", None, ""),
    ("FW", "FW", "exact", "x", "t", "text", "V6", "rival:warning"), ("V6", "V6", "exact", "x", "t", "text", "V6.0", ""), ("V6", "V6", "exact", "x", "t", "text", "V7", "rival:warning"), ("FW", "FW", "exact", "x", "t", "text", "zz", ""),
)


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 29 = 0 THEN '' ELSE {_sql_pick('p_partkey', *[r[7] for r in _CONFLICTS])} END AS conflicts FROM part WHERE conflicts <> ''")
def dictionary_conflicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda i: _pick(k, *[r[i] or "" for r in _CONFLICTS])
    cands = F.when(pick(6) != "", F.array(F.struct(pick(6).alias("text"), F.lit(0.7).alias("prob")), F.struct(F.lit("N5").alias("text"), F.lit(0.1).alias("prob")))).otherwise(F.array().cast(_CANDS))
    pairs = table(spark, d, "part").select(
        "p_partkey", F.lit(1).alias("ws"), F.concat(pick(4), F.lit("1")).alias("ref_id"), pick(5).alias("reading_kind"), pick(0).alias("value"), pick(1).alias("raw"), pick(2).alias("match"),
        pick(3).alias("meaning"), F.lit(0.9).alias("prob"), cands.alias("candidates"), (k % 29 == 0).alias("corrected"),
    )
    found = interpret.dictionary_conflicts(pairs, _entries(spark), ["p_partkey"], ["ws"])
    return found.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "severity"))), ",").alias("conflicts"))


_DECISIONS = (
    # joint type, positions, thickness, leg, leg positions -> outcome, position
    ("FILLET", (), 10.0, None, (), "thickness", "2F"), ("FILLET", (), 12.0, None, (), "thickness", "1F"), ("FILLET", (), 8.5, None, (), "thickness_assumed", "2F"), ("FILLET", (), 7.0, None, (), "no_thickness", None),
    ("FILLET", ("1F",), 8.5, None, (), "thickness", "1F"), ("FILLET", ("4G",), 8.5, None, (), "no_position", None), ("FILLET", (), None, 4.5, ("2F",), "leg", "2F"), ("FILLET", (), None, 9.0, (), "leg_nearest", "1F"),
    (None, (), 8.0, None, (), "unknown_type", None), ("PLUG", (), 8.0, None, (), "no_type", None), ("FILLET", (), None, None, (), "ambiguous", None), ("BUTT", (), None, None, (), "single", "1G"),
    ("BUTT", (), 5.0, None, (), "no_thickness_rows", None), ("FILLET", (), None, 4.5, ("4F",), "no_leg", None),
)


@query(
    "SELECT p_partkey, outcome, position FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{r[5]}', {_lit(r[6])})" for i, r in enumerate(_DECISIONS))
    + f") v(i, outcome, position) ON i = p_partkey % {len(_DECISIONS)}"
)
def welding_condition(spark: SparkSession, d: str) -> DataFrame:
    standards = spark.createDataFrame(
        [(1, "FILLET", 8.0, 11.0, 4.0, 5.0, "P", "2F"), (2, "FILLET", 11.5, 14.0, 6.0, 7.0, "P", "1F"), (3, "FILLET", 8.0, 9.0, None, None, "P", "1F"), (4, "BUTT", None, None, None, None, "P", "1G")],
        "seq int, joint_type string, thickness_min_mm double, thickness_max_mm double, leg_min_mm double, leg_max_mm double, process string, position string",
    )
    cases = spark.createDataFrame([(i, r[0], list(r[1]), r[2], r[3], list(r[4])) for i, r in enumerate(_DECISIONS)], "i int, joint_type string, positions array<string>, thickness double, leg_mm double, leg_positions array<string>")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("photo_id"), (F.col("p_partkey") % len(_DECISIONS)).cast("int").alias("i")).join(F.broadcast(cases), "i")
    return ranges.welding_condition(asked, standards).select(F.col("photo_id").alias("p_partkey"), "outcome", F.col("standard.position").alias("position"))


@query("""
WITH s AS (SELECT c_custkey, c_acctbal AS visual, c_custkey % 3 = 0 AS failed, CASE WHEN c_nationkey < 12 THEN false WHEN c_nationkey < 20 THEN true END AS part, c_nationkey % 3 AS n FROM customer),
i AS (
  SELECT c_custkey, 1 AS o, 'visual' AS layer, CASE WHEN visual < 50 THEN 'warning' ELSE 'info' END AS severity, 'least recognition probability 85%' AS message FROM s
  UNION ALL SELECT c_custkey, 2, 'db', 'warning', 'part isn''t in the tree' FROM s WHERE part IS FALSE UNION ALL SELECT c_custkey, 3, 'db', 'warning', 'conflicts with standards: ' || n FROM s WHERE n > 0
  UNION ALL SELECT c_custkey, 4, 'reader', 'error', 'second reader failed' FROM s WHERE failed UNION ALL SELECT c_custkey, 5, 'reader', 'warning', 'runs agree in 67%' FROM s WHERE NOT failed
)
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o) AS position, layer, severity, message FROM i
""")
def evidence_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("visual"), F.lit(0.85).alias("recognition_prob"), F.lit(None).cast("double").alias("agreement"), F.lit(None).cast("double").alias("match_rate"),
        F.when(n < 12, False).when(n < 20, True).alias("part_found"), (n % 3).alias("conflicts"), (F.col("c_custkey") % 3 == 0).alias("reader_failed"), F.lit(0.67).alias("consistency"),
    )
    return interpret.evidence(rows, ["c_custkey"])


@query("""
WITH p AS (SELECT DISTINCT p_name FROM part), q AS (SELECT * FROM (VALUES (1, 'C1', 'a red almond thing'), (2, 'C2', 'steel almond'), (3, 'C3', 'the green and the steel')) v(seq, code, prompt)),
w AS (SELECT DISTINCT p_name, unnest(string_split(lower(p_name), ' ')) AS word FROM p), x AS (SELECT DISTINCT seq, code, unnest(string_split(prompt, ' ')) AS word FROM q),
n AS (SELECT p_name, code, seq, count(*) AS n FROM w JOIN x USING (word) GROUP BY p_name, code, seq), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC, seq) = 1)
SELECT p.p_name, code FROM p LEFT JOIN b USING (p_name)
""")
def phrase_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompts = spark.createDataFrame([(1, "C1", "a red almond thing"), (2, "C2", "steel almond"), (3, "C3", "the green and the steel")], "seq int, code string, prompt string")
    return interpret.phrase_prompts(table(spark, d, "part"), prompts, "p_name", "code", "prompt")
