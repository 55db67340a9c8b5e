"""Queries of evaluation, geometry, validation and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import geometry as G
from inkspark.functions import quads
from inkspark.functions import text as T
from inkspark.functions.json_schema import violations
from inkspark.operators import evaluation, metrics, scoring, search, tree, validate
from inkspark.plans.queries import query, table


def _pick(key, *values):
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


# --- photos and groups -----------------------------------------------------------------

_PHOTO = """
p AS (SELECT c_custkey, c_nationkey, c_custkey % 5 AS k FROM customer),
r AS (SELECT c_custkey, c_nationkey, CASE k WHEN 4 THEN 2 ELSE 3 END AS texts, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 1 END AS ocr_exact, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 2 END AS used_exact,
  CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 0 END AS final_exact, 1 AS legs, CASE WHEN k IN (0, 4) THEN 1 ELSE 0 END AS legs_ocr, CASE WHEN k IN (0, 1) THEN 1 ELSE 0 END AS legs_found,
  CASE k WHEN 4 THEN 0 ELSE 1 END AS parts, CASE WHEN k IN (0, 1) THEN 1 ELSE 0 END AS parts_ocr, CASE WHEN k IN (0, 3) THEN 1 ELSE 0 END AS parts_found FROM p)
"""
_COUNTERS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in evaluation.COUNTERS)
_PCT = ", ".join(f"round_even(100 * (({' + '.join(a)})::DOUBLE / nullif({' + '.join(b)}, 0)), 1) AS {n}" for n, (a, b) in evaluation.SHARES.items())


def _photos(spark: SparkSession, d: str) -> DataFrame:
    """Five kinds of photos: all right, partly, nothing, only the final text, and one with an unreadable truth and no part."""
    k = F.col("c_custkey") % 5
    lists = lambda *xs: F.get(F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in xs]), k.cast("int"))
    return table(spark, d, "customer").select(
        "c_custkey", "c_nationkey",
        lists(("F5.5", "p-1", "Face 350"), ("F5.5", "P-1", "Face 350"), ("F5.5", "P-1", "Face 350"), ("F5.5", "P-1", "Face 350"), ("F5.5", "FW", "P?1")).alias("truth_texts"),
        lists(("→ f5.5", "F5.5", "P-1", "face 350"), ("P-1",), ("zz",), ("FACE350",), ("(F5.5)", "FW")).alias("ocr_texts"),
        lists(("F5.5", "P-1", "FACE 350"), ("P-1", "F5.5"), (), ("Face 350", "P-1"), ("FW", "f5.5")).alias("used_texts"),
        _pick(F.col("c_custkey"), "P-1 F5.5 Face 350", "p-1", "", "Face 350 x P-1", None).alias("raw_text"),
        lists(("F5.5",), ("F5.5", "V6"), ("V6",), (), ()).alias("found_legs"), F.array(F.lit("P-1"), F.lit("P-2")).alias("part_codes"),
        _pick(F.col("c_custkey"), "P-1", "P-2", None, "P-1", "P-1").alias("found_part"),
    )


@query(f"WITH {_PHOTO} SELECT c_custkey, {', '.join(f'{c}::BIGINT AS {c}' for c in evaluation.COUNTERS)} FROM r")
def photo_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.photo_row(_photos(spark, d)).select("c_custkey", *evaluation.COUNTERS)


@query(f"""
WITH {_PHOTO}, g AS (
  SELECT *, 'all' AS g FROM r WHERE c_nationkey % 3 < 2 UNION ALL SELECT *, 'dataset d' || c_nationkey % 2 FROM r WHERE c_nationkey % 3 < 2 UNION ALL SELECT *, 'condition dark' FROM r WHERE c_nationkey % 3 = 1
  UNION ALL SELECT *, 'condition wet' FROM r WHERE c_nationkey % 3 = 1 AND c_custkey % 2 = 0 UNION ALL SELECT *, 'simulated glare' FROM r WHERE c_nationkey % 3 = 2),
s AS (SELECT g, count(*) AS photos, {_COUNTERS} FROM g GROUP BY g)
SELECT g, photos, {", ".join(evaluation.COUNTERS)}, {_PCT} FROM s
""")
def evaluation_groups(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey") % 3
    rows = evaluation.photo_row(_photos(spark, d)).select("c_custkey", "c_nationkey", *evaluation.COUNTERS)
    none = F.array().cast("array<string>")
    tags = F.when(n == 1, F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("dark"), F.lit("wet"))).otherwise(F.array(F.lit("dark")))).otherwise(none)
    rows = rows.withColumns({"simulated": F.when(n == 2, "glare"), "dataset": F.concat(F.lit("d"), (F.col("c_nationkey") % 2).cast("string")), "conditions": tags})
    return evaluation.group_totals(evaluation.overlapping_groups(rows), ["group"]).withColumnRenamed("group", "g")


@query("""
WITH r AS (SELECT p_type, 'F' || p_size AS truth, CASE p_partkey % 4 WHEN 0 THEN 'F' || p_size WHEN 1 THEN 'V' || p_size WHEN 2 THEN NULL ELSE 'F' || p_size || 'x' END AS got FROM part)
SELECT p_type, round_even(avg((truth = coalesce(got, ''))::INT), 4) AS exact, round_even(sum(least(levenshtein(coalesce(got, ''), truth), length(truth)))::DOUBLE / sum(length(truth)), 4) AS cer,
       round_even(avg((substr(truth, 1, 1) = substr(coalesce(got, ''), 1, 1))::INT), 4) AS letter, round_even(avg(regexp_full_match(coalesce(got, ''), '[FVS][0-9]{1,2}(\\.[0-9])?')::INT), 4) AS format_valid FROM r GROUP BY p_type
""")
def handwriting_scores(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    got = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("F"), size)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("V"), size)).when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("F"), size, F.lit("x")))
    return evaluation.handwriting_score(table(spark, d, "part").select("p_type", F.concat(F.lit("F"), size).alias("truth"), got.alias("got")), ["p_type"], "truth", "got")


@query("SELECT l_returnflag, avg((l_discount * 10 >= 0.5)::INT::DOUBLE) FILTER (l_linenumber > 1) AS iou50, avg(l_tax) AS mean_seconds, median(l_tax) AS median_seconds FROM lineitem GROUP BY l_returnflag")
def overlap_and_time(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 10).alias("iou"), F.col("l_tax").alias("s"))
    return evaluation.overlap_and_time(rows, ["l_returnflag"], "iou", "s")


@query("""
SELECT p_partkey, round_even(least(1.0, (abs(p_size - 10) + 2 + p_partkey % 100) / (3 * 32.0::DOUBLE)), 3) AS change,
  round_even(1 - 0.8 * (1 - p_size / 100.0::DOUBLE) * (1 - CASE WHEN p_size > 10 THEN round_even(least(1.0, log2(p_size / 10.0::DOUBLE * (1 + p_partkey % 3)) / 3), 3) WHEN p_size * (1 + p_partkey % 3) > 10 THEN round_even(log2(p_size / 10.0::DOUBLE * (1 + p_partkey % 3)) / 3, 3) ELSE 0 END), 3) AS strength,
  round_even(1 - 0.8 * (1 - p_size / 100.0::DOUBLE), 3) AS plain FROM part
""")
def image_corrections(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    more = (F.col("p_partkey") % 100).cast("int")
    before, after = F.array(s, F.lit(100), s), F.array(F.lit(10), F.lit(102), s + more)
    steps = F.array(F.lit(0.2), s / 100)
    scale = s / 10 * (1 + F.col("p_partkey") % 3)  # up to 15: enlargements over 8 count whole
    return table(spark, d, "part").select("p_partkey", evaluation.pixel_change(before, after).alias("change"), evaluation.correction_strength(steps, scale).alias("strength"), metrics.combined_strength(steps).alias("plain"))


@query("SELECT p_partkey, rank, text, prob FROM part JOIN (VALUES (0, 1, 'P-1O', 0.6::DOUBLE), (0, 2, 'P-10', 0.4), (1, 1, 'OO', 1.0), (2, 1, 'O', 1.0)) v(k, rank, text, prob) ON k = p_partkey % 3")
def beam_readings(spark: SparkSession, d: str) -> DataFrame:
    """Two last letters, a repeat with a blank between, and a repeat that collapses."""
    chars = "P-1O0"
    hot = lambda c: [1.0 if i == c else 0.0 for i in range(6)]
    tables = ([hot(1), hot(2), hot(3), [0.0, 0.0, 0.0, 0.0, 0.6, 0.4]], [hot(4), hot(0), hot(4)], [hot(4), hot(4), hot(0)])
    slots = F.get(F.array(*[F.array(*[F.array(*map(F.lit, row)) for row in t]) for t in tables]), (F.col("p_partkey") % 3).cast("int"))
    return evaluation.beam_candidates(table(spark, d, "part").select("p_partkey", slots.alias("slots")), "p_partkey", "slots", chars)


@query("""
WITH h AS (SELECT o_orderkey, ('0x' || substr(sha256('3|letter|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(sha256('3|size|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS s FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'F' WHEN u < 0.8 THEN 'V' ELSE 'S' END || (['4', '5.5', '6'])[floor(s * 3)::INT + 1] AS label FROM h
""")
def made_labels(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.weighted_labels(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3, {"F": 5, "V": 3, "S": 2}, ("4", "5.5", "6"))


# --- geometry -----------------------------------------------------------------------------

_XY = "p_size::DOUBLE AS x, (p_partkey % 40)::DOUBLE AS y"


@query(f"""
WITH b AS (SELECT p_partkey, {_XY} FROM part)
SELECT p_partkey, CASE WHEN x + 5 < 30 THEN 'left' ELSE 'right' END AS side, x * 2 AS scaled, greatest(x - 5, 0) AS crop_x1, least(y + 9, 45) AS crop_y2, round(least(1.0, 16 / greatest(least(x + 15, 60) - greatest(x - 5, 0), least(y + 9, 45) - greatest(y - 3, 0))), 9) AS factor,
       x < 45 AND NOT (x % 7 = 0) AS valid, round((2 * x + 1) / 2, 9) AS mapped FROM b
""")
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "cast(p_size AS double) AS x", "cast(p_partkey % 40 AS double) AS y")
    x, y = F.col("x"), F.col("y")
    box = G.box(x, y, x + 10, y + 6)
    crop = G.crop_window(box, F.lit(60.0), F.lit(45.0), 0.5, 16.0)
    values = F.when(x % 7 == 0, F.array(x, y, F.lit(-1.0), x)).when(x < 45, F.array(x, y, x, y)).otherwise(F.array(x, y, x))
    mapped = G.mapped(box, [[2, 0, 1], [0, 1, 0], [0, 0, 2]])
    return rows.select("p_partkey", G.side(box, F.lit(60.0)).alias("side"), G.scaled(box, F.lit(2.0)).x1.alias("scaled"), crop.window.x1.alias("crop_x1"), crop.window.y2.alias("crop_y2"), F.round(crop.factor, 9).alias("factor"), G.valid_box(values).alias("valid"), F.round(mapped.x1, 9).alias("mapped"))


@query("SELECT p_partkey, p_size || ',1|' || (p_size + 9) || ',2|' || (p_size + 8) || ',7|' || (p_size + 1) || ',8' AS quad FROM part")
def ordered_quads(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    pts = [F.array(s + 9, F.lit(2)), F.array(s + 1, F.lit(8)), F.array(s, F.lit(1)), F.array(s + 8, F.lit(7))]
    turned = F.when(F.col("p_partkey") % 2 == 0, F.array(*pts)).otherwise(F.array(*pts[2:], *pts[:2]))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(G.clockwise(turned), lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"))), "|").alias("quad"))


# --- validation ------------------------------------------------------------------------------


@query("""
SELECT c_custkey, concat_ws(' / ', CASE WHEN c_custkey % 6 = 0 THEN 'name: required' END, CASE WHEN c_custkey % 6 = 1 THEN 'name: doesn''t match ^C' END, CASE WHEN c_nationkey >= 20 THEN 'nation: more than 19' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'kind: not one of BUILDING, MACHINERY' END,
  CASE WHEN c_custkey % 4 = 0 THEN 'legs: fewer than 1 items' END, CASE WHEN c_custkey % 4 = 1 THEN 'legs: items repeat' END) AS errors FROM customer
""")
def schema_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 6 == 1, F.concat(F.lit("x"), "c_name")).when(k % 6 != 0, F.concat(F.lit("C"), "c_name"))
    legs = F.when(k % 4 == 0, F.array().cast("array<int>")).when(k % 4 == 1, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    rows = table(spark, d, "customer").select("c_custkey", name.alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind"), legs.alias("legs"))
    rules = {"name": {"required": True, "pattern": "^C"}, "nation": {"minimum": 0, "maximum": 19}, "kind": {"enum": ("BUILDING", "MACHINERY")}, "legs": {"items": 1, "unique": True}}
    return rows.select("c_custkey", F.array_join(evaluation.schema_errors(rows, rules), " / ").alias("errors"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'unique_ids' END, CASE WHEN o_orderkey % 5 = 0 THEN 'refs_known' END, CASE WHEN o_orderkey % 3 = 0 THEN 'overall_is_least' END, CASE WHEN (o_orderkey % 3 = 0) <> (o_orderstatus = 'F') THEN 'passed_means_threshold' END,
  CASE WHEN o_orderkey % 4 = 0 THEN 'missing_is_reviewed' END, CASE WHEN o_orderkey % 11 = 0 THEN 'revision_has_cause' END) AS broken FROM orders WHERE o_orderkey % 4 > 0
UNION ALL SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'unique_ids' END, CASE WHEN o_orderkey % 5 = 0 THEN 'refs_known' END, CASE WHEN o_orderkey % 3 = 0 THEN 'overall_is_least' END, CASE WHEN o_orderstatus = 'F' THEN 'passed_means_threshold' END,
  'missing_is_reviewed', CASE WHEN o_orderkey % 11 = 0 THEN 'revision_has_cause' END) FROM orders WHERE o_orderkey % 4 = 0
""")
def analysis_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rules between the stages of an analysis, each broken by some rows."""
    k = F.col("o_orderkey")
    lit = lambda *xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 7 == 0, lit("t1", "t1")).otherwise(lit("t1", "t2")).alias("text_ids"), lit("s1").alias("symbol_ids"), F.lit(True).alias("char_probs_ok"), F.lit(True).alias("first_candidate_ok"),
        F.when(k % 5 == 0, lit("t1", "t9")).otherwise(lit("t1")).alias("refs"), lit("t1", "t2", "s1").alias("known_ids"), F.lit(90).alias("visual"), F.lit(80).alias("db"), F.lit(85).alias("reasoning"),
        F.when(k % 3 == 0, 90).otherwise(80).alias("overall"), F.lit(85).alias("threshold"), (F.col("o_orderstatus") == "F").alias("passed"), F.when(k % 4 == 0, lit("part")).otherwise(none).alias("missing"),
        none.alias("review_targets"), none.alias("corrected"), F.lit(False).alias("reader_error"), F.lit(True).alias("has_reader"), F.when(k % 11 == 0, 2).otherwise(1).alias("revision"), F.lit(False).alias("has_context"),
    )
    return rows.select("o_orderkey", F.array_join(validate.violations(validate.analysis_rules()), ",").alias("broken"))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 = 0 THEN 'image_missing' END, CASE WHEN p_size = 7 THEN 'split_unknown' END, CASE WHEN p_size > 40 THEN 'box_order' END, CASE WHEN p_size > 30 THEN 'box_bounds' END, CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'label_unknown' END,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 3 = 0 THEN 'name_differs' END) AS errors FROM part
""")
def dataset_lint(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    image = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("p"), k.cast("string"), F.lit(".jpg")))
    rows = table(spark, d, "part").select(
        "p_partkey", image.alias("image"), F.concat(F.when(k % 3 == 0, "q").otherwise("p"), k.cast("string"), F.lit(".json")).alias("file"), F.when(F.col("p_size") == 7, "dev").otherwise("eval").alias("split"), F.col("p_brand").alias("label"),
        s.alias("x1"), s.alias("y1"), F.when(s > 40, s).otherwise(s + 10).alias("x2"), (s + 10).alias("y2"), F.lit(40.0).alias("width"), F.lit(100.0).alias("height"),
    )
    codes = spark.createDataFrame([("Brand#11",), ("Brand#12",), ("Brand#13",), ("Brand#13",)], "code string")
    return validate.dataset_lint(rows, codes).select("p_partkey", F.array_join("errors", ",").alias("errors"))


# --- trees, updates, samples -------------------------------------------------------------------


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'no_parent' WHEN 1 THEN 'path_exists' WHEN 2 THEN 'level_above_parent' WHEN 3 THEN 'too_deep' END AS error, CASE c_custkey % 6 WHEN 4 THEN 'LARGE' WHEN 5 THEN 'PART' WHEN 3 THEN NULL WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'LARGE' ELSE 'LARGE' END AS level FROM customer
""")
def tree_additions(spark: SparkSession, d: str) -> DataFrame:
    nodes = spark.createDataFrame([("B", "BLOCK"), ("B/1", "LARGE"), ("B/1/2", "MID"), ("B/1/2/3", "SUB"), ("B/1/2/3/4", "PART")], "path string, level string")
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select("c_custkey", _pick(k, "X", "B", "B/1", "B/1/2/3/4", "B", "B/1").alias("parent_path"), _pick(k, "n", "1", "n", "n", "n", "n").alias("name"), _pick(k, None, None, "BLOCK", None, None, "PART").alias("level"))
    return tree.addable(asked, nodes).select("c_custkey", "error", "level")


@query("""
SELECT DISTINCT 'SO/' || split_part(p_brand, '#', 1) || '/' || p_brand || '-' || p_size AS path, 'x' AS level FROM part WHERE false
UNION SELECT 'SO', 'BLOCK' UNION SELECT 'SO/' || p_brand, 'SUB' FROM part WHERE p_size % 2 = 0 UNION SELECT 'SO/' || p_brand || '/' || p_brand || '-' || p_size, 'PART' FROM part WHERE p_size % 2 = 0 UNION SELECT 'SO/' || p_type, 'PART' FROM part WHERE p_size % 2 = 1
""")
def trees_of_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("p_size") % 2 == 0, F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).otherwise(F.col("p_type"))
    return tree.from_codes(table(spark, d, "part").select(code.alias("code")), "code", "SO")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def partial_updates(spark: SparkSession, d: str) -> DataFrame:
    """Only sent fields change; a sent null is a change too."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    changes = rows.where(k % 3 == 0).select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"), F.lit(True).alias("sent_o_orderstatus"), (k % 2 == 0).alias("sent_o_orderpriority"))
    return search.partial_update(rows, changes, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey FROM orders ORDER BY sha256('5|' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return search.sampled(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 5, "o_orderkey")


# --- scores and texts ------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, coalesce(min(1 - l_discount) FILTER (l_returnflag <> 'N'), 1) AS recognition_prob, round_even(avg((l_linestatus = 'F' OR (l_linenumber % 2 = 0 AND l_tax > 0.03))::INT), 2) AS match_rate,
       round(sum(l_quantity * l_tax) / sum(l_quantity), 9) AS weighted, concat_ws(',', CASE WHEN l_orderkey % 2 = 0 THEN 'part' END, CASE WHEN l_orderkey % 3 = 0 AND l_orderkey % 5 > 0 THEN 'welding_condition' END) AS missing FROM lineitem GROUP BY l_orderkey
""")
def photo_factors(spark: SparkSession, d: str) -> DataFrame:
    li, k = table(spark, d, "lineitem"), F.col("l_orderkey")
    prob = scoring.least_prob(li.select("l_orderkey", (1 - F.col("l_discount")).alias("prob"), (F.col("l_returnflag") == "N").alias("c")), ["l_orderkey"], F.col("c"))
    kind = F.when(F.col("l_linestatus") == "F", _pick(F.col("l_linenumber"), "exact", "alias", "candidate")).when(F.col("l_linenumber") % 2 == 0, "none").otherwise("vlm")
    rate = scoring.match_rate(li.select("l_orderkey", kind.alias("match"), F.when(F.col("l_tax") > 0.03, "m").alias("meaning")), ["l_orderkey"])
    mean = li.groupBy("l_orderkey").agg(F.round(metrics.length_weighted(F.col("l_tax"), F.col("l_quantity")), 9).alias("weighted"))
    corrected = F.when(k % 5 == 0, F.array(F.lit("welding_condition"))).otherwise(F.array().cast("array<string>"))
    missing = scoring.missing_required(F.when(k % 2 > 0, F.lit("p")), F.when(k % 3 > 0, F.lit("w")), corrected)
    return prob.join(rate, "l_orderkey").join(mean, "l_orderkey").withColumn("missing", F.array_join(missing, ","))


@query("""
SELECT p_partkey, p_size % 3 < 2 AS same, upper(replace(p_name, ' ', '')) AS squeezed, split_part(p_name, ' ', -1) AS suffix, 'a b|' || p_brand AS aliases, CASE p_size % 4 WHEN 0 THEN '12-0' WHEN 1 THEN '10' WHEN 2 THEN '' ELSE '7' END AS kept,
       CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 END AS distance FROM part
""")
def small_texts(spark: SparkSession, d: str) -> DataFrame:
    """Equal readings, squeezed texts, suffixes, alias lists, allowed characters and the distance with wildcards."""
    k, s = F.col("p_partkey"), F.col("p_size")
    other = F.when(s % 3 == 0, F.concat(F.lit("→ "), F.lower("p_brand"))).when(s % 3 == 1, F.translate("p_brand", "B", "Ｂ")).otherwise("x")
    kept = T.constrain(_pick(s, "l2—O", "IO", "xy", "7x"), "0123456789-", {"I": "1", "l": "1", "O": "0", "—": "-"})
    distance = metrics.edit_distance(_pick(s, "F?5", "F?5", "abc", "F?5?"), _pick(s, "F5", "F55", "", "55"))
    return table(spark, d, "part").select(
        "p_partkey", T.same_reading("p_brand", other).alias("same"), T.same_text("p_name").alias("squeezed"), T.suffix(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("suffix"),
        F.array_join(T.parse_aliases(F.concat_ws(",", F.lit(" a b "), F.lit(" "), "p_brand")), "|").alias("aliases"), kept.alias("kept"), distance.alias("distance"),
    ).where(k.isNotNull())


_CUSTOMER = {
    "type": "object", "required": ["id", "segment", "balance", "orders"], "additionalProperties": False,
    "properties": {
        "id": {"$ref": "#/$defs/Id"}, "segment": {"enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}, "balance": {"type": "number", "minimum": 0}, "phone": {"type": "string", "maxLength": 15},
        "nation": {"type": "object", "properties": {"key": {"type": "integer", "maximum": 20}, "name": {"type": "string", "minLength": 6}}},
        "orders": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["price"], "properties": {"price": {"$ref": "#/$defs/Price"}, "day": {"type": "string", "format": "date-time"}}}},
    },
    "$defs": {"Id": {"type": "string", "pattern": "^c[0-9]{1,2}$"}, "Price": {"anyOf": [{"type": "number", "maximum": 200000}, {"type": "null"}]}},
}


@query("""
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS s, c_acctbal::DOUBLE AS b, c_nationkey AS n, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_totalprice::DOUBLE AS p, o_orderkey % 3 AS bad FROM orders)
SELECT k AS c_custkey, 'id: doesn''t match ^c[0-9]{1,2}$' AS violation FROM c WHERE k >= 100
UNION ALL SELECT k, 'segment: isn''t one of BUILDING, MACHINERY, AUTOMOBILE' FROM c WHERE s NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
UNION ALL SELECT k, '(top): balance is missing' FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 'balance: is less than 0' FROM c WHERE k % 7 > 0 AND b < 0
UNION ALL SELECT k, '(top): extra isn''t allowed' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, 'nation/key: is more than 20' FROM c WHERE n > 20 UNION ALL SELECT k, 'nation/name: has fewer than 6 characters' FROM c WHERE length(name) < 6
UNION ALL SELECT k, 'orders: has fewer than 1 items' FROM c WHERE k NOT IN (SELECT k FROM o)
UNION ALL SELECT k, 'orders/' || i || ': price is missing' FROM o WHERE bad = 0
UNION ALL SELECT k, 'orders/' || i || '/price: fits none of 2 alternatives' FROM o WHERE bad > 0 AND p > 200000
UNION ALL SELECT k, 'orders/' || i || '/day: isn''t a date and time' FROM o WHERE bad = 1
""")
def document_violations(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders as JSON documents against a schema with references, alternatives and item paths; a row for each violation."""
    k = F.col("o_orderkey")
    price, day = F.when(k % 3 > 0, F.col("o_totalprice").cast("double")), F.when(k % 3 == 1, "yesterday").otherwise("2024-05-06T07:08:09Z")
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", price.alias("price"), day.alias("day")))).alias("orders"))
    orders = orders.select("c_custkey", F.transform("orders", lambda o: F.struct(o.price.alias("price"), o.day.alias("day"))).alias("orders"))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(orders, "c_custkey", "left")
    c = F.col("c_custkey")
    document = F.struct(
        F.concat(F.lit("c"), c.cast("string")).alias("id"), F.col("c_mktsegment").alias("segment"), F.when(c % 7 > 0, F.col("c_acctbal").cast("double")).alias("balance"),
        F.when(c % 11 == 0, 1).alias("extra"), F.struct(F.col("c_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"), F.coalesce("orders", F.array().cast(dict(orders.dtypes)["orders"])).alias("orders"),
    )
    return rows.select("c_custkey", F.to_json(document).alias("doc")).select("c_custkey", F.explode(violations("doc", _CUSTOMER)).alias("violation"))


@query("""
WITH p AS (SELECT l_orderkey AS k, l_partkey % 97 AS x, l_suppkey % 61 AS y FROM lineitem UNION SELECT l_orderkey, l_partkey % 97 + 5, l_suppkey % 61 + l_linenumber FROM lineitem),
e AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON a.k = b.k AND (a.x, a.y) <> (b.x, b.y)),
s AS (SELECT e.k, ax, ay, dx, dy, min(dx * (p.y - ay) - dy * (p.x - ax)) AS low, max(dx * (p.y - ay) - dy * (p.x - ax)) AS high, max(dx * p.x + dy * p.y) - min(dx * p.x + dy * p.y) AS along FROM e JOIN p ON p.k = e.k GROUP BY ALL)
SELECT k AS l_orderkey, round(min(along * high::DOUBLE / (dx * dx + dy * dy)), 6) AS area FROM s WHERE low = 0 GROUP BY k
""")
def least_quads(spark: SparkSession, d: str) -> DataFrame:
    """The least rectangle around two points of each line of an order; the SQL tries every pair of points as a side."""
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 61).cast("double")
    points = F.explode(F.array(F.array(x, y), F.array(x + 5, y + F.col("l_linenumber"))))
    polygons = table(spark, d, "lineitem").select("l_orderkey", points.alias("p")).groupBy("l_orderkey").agg(F.collect_list("p").alias("polygon"))
    return polygons.select("l_orderkey", F.round(quads.quad_area(quads.least_quad("polygon")), 6).alias("area"))
