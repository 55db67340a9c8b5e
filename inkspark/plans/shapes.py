"""Queries of record shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.functions import geometry as G
from inkspark.functions import text as T
from inkspark.functions import values as V
from inkspark.operators import analyses, matching, metrics, shapes
from inkspark.plans.queries import _boxes, query, table
from inkspark.sources import writers


@query("SELECT p_partkey, p_name AS text, p_size / 50.0::DOUBLE AS prob, p_size::DOUBLE AS x1, p_size + 9::DOUBLE AS x2, 8::DOUBLE AS y2 FROM part WHERE p_size % 5 > 0")
def detected_texts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    points = F.array(F.array(s, F.lit(2.0)), F.array(s + 9, F.lit(1.0)), F.array(s + 8, F.lit(8.0)), F.array(s + 1, F.lit(7.0)))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("seq"), F.when(s % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("text"), (s / 50).alias("score"), points.alias("points"))
    return shapes.text_detections(rows, ["p_partkey"]).select("p_partkey", "text", "prob", "box.x1", "box.x2", "box.y2")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'M' END AS label, greatest(p_size - 10, 0)::DOUBLE AS x1, least(p_size + 10, 40)::DOUBLE AS x2 FROM part WHERE p_size % 3 < 2 AND p_size - 10 < 40
""")
def detected_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    phrase = F.when(s % 3 == 0, "an arrow").when(s % 3 == 1, "mark").otherwise("other")
    rows = table(spark, d, "part").select("p_partkey", phrase.alias("phrase"), F.lit(0.5).alias("score"), G.box(s - 10, F.lit(0.0), s + 10, F.lit(5.0)).alias("box"), F.lit(40.0).alias("width"), F.lit(40.0).alias("height"))
    codes = spark.createDataFrame([("an arrow", "A"), ("mark", "M"), ("mark", "M")], "phrase string, code string")
    return shapes.symbol_detections(rows, codes, ["p_partkey"]).select("p_partkey", "label", "box.x1", "box.x2")


@query("""
SELECT o_orderkey, concat_ws('|', lower(o_orderpriority), CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) END) AS texts, CASE WHEN o_orderstatus = 'F' THEN 'FILLET/2F/manual' END AS condition,
       CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS loud, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS quiet, o_orderkey % 7 = 0 AS second_only, o_orderkey % 7 > 0 AND o_orderkey % 2 > 0 AS first_only FROM orders
""")
def record_shapes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    fields = {c: F.lit({"joint_type": "FILLET", "position": "2F"}.get(c)) for c in shapes.CONDITION}
    rows = table(spark, d, "orders").withColumn("status2", F.when(k % 2 == 0, F.col("o_orderstatus"))).withColumn("row", F.when(F.col("o_orderstatus") == "F", F.struct(*[v.alias(c) for c, v in fields.items()])))
    refs = F.array(F.lit("t1"))
    one = shapes.conflict("standard_conflict", F.when(k % 3 == 0, "error").otherwise("info"), F.lit("m"), refs)
    two = F.when(k % 5 == 0, shapes.conflict("part_not_in_tree", "warning", F.lit("n"), refs))
    rows = rows.withColumn("conflicts", F.array_compact(F.array(one, two)))
    loud, quiet = shapes.by_severity("conflicts")
    ref = F.when(k % 7 == 0, "v1").otherwise("t1")
    condition = shapes.condition_of("row", "manual", leg=F.lit(5.5))
    return rows.select(
        "o_orderkey", F.array_join(shapes.search_texts("o_orderpriority", "status2"), "|").alias("texts"), F.when(condition.isNotNull(), F.concat_ws("/", condition.joint_type, condition.position, condition.source)).alias("condition"),
        F.size(loud).alias("loud"), F.size(quiet).alias("quiet"), shapes.only_second(ref).alias("second_only"), shapes.only_first(ref, k % 2 == 0).alias("first_only"),
    )


@query("SELECT c_custkey, c_name AS model, c_custkey % 3 = 0 AS key_set FROM customer")
def status_rows(spark: SparkSession, d: str) -> DataFrame:
    """Settings without their secrets."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("model"), F.when(k % 3 == 0, "secret").when(k % 3 == 1, " ").alias("key"))
    return shapes.status_row(rows, ["key"])


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'fallback' END AS data FROM orders")
def stored_images(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    images = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("data"))
    return shapes.stored_or(images, o.select(F.col("o_orderkey").alias("job_id"), F.lit("fallback").alias("other")), ["job_id"], "other").drop("other")


@query("""
SELECT user_id, string_agg(event_type, '|' ORDER BY first) AS marks, count(*) > 1 AS several FROM (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY user_id
""")
def distinct_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("mark"), "event_id")
    return shapes.distinct_marks(rows, ["user_id"], "mark", "event_id").select("user_id", F.array_join("values", "|").alias("marks"), "several")


@query("""
SELECT n_name, row_number() OVER (ORDER BY n_regionkey, n_nationkey) AS position, 'R' || n_regionkey || '/' || n_name AS path, '1F|4G' AS positions FROM nation
""")
def ordered_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects by their time, leaves of a tree, a node's path, and positions in a meaning."""
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    nodes = n.select("n_name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name").alias("path"), F.lit("PART").alias("level"))
    nodes = nodes.union(n.select(F.lit("-"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.lit("BLOCK")))
    paths = nodes.join(shapes.leaves(nodes), "path", "left_semi").select("n_name", "path")
    place = F.row_number().over(Window.orderBy("n_regionkey", "n_nationkey"))  # 25 nations
    return n.select("n_name", place.alias("position")).join(paths, "n_name").withColumn("positions", F.array_join(shapes.positions_in(F.lit("from 1F, 12F to 4G; x2Fy")), "|"))


@query("SELECT o_orderkey AS job_id, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS blocked FROM orders")
def export_checks(spark: SparkSession, d: str) -> DataFrame:
    """Passed analyses that couldn't be exported if they were approved now."""
    there = F.when(F.col("o_orderkey") % 3 > 0, "w")
    passed = F.col("o_orderstatus") == "F"
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("approved").alias("status"), F.lit("p").alias("assembly_path"), F.lit("m").alias("marking"), there.alias("welding_condition"), F.lit("c").alias("confidence"), F.lit("auto").alias("approved_by"), passed.alias("passed"))
    out = analyses.robot_export(jobs, ["assembly_path"])
    return out.join(jobs.select("job_id", "passed"), "job_id").select("job_id", (F.col("passed") & F.col("error").isNotNull()).alias("blocked"))


@query("SELECT event_type AS kind, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM events")
def ordered_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))
    return writers.in_order(rows, ["kind"]).withColumn("place", F.col("place").cast("long"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 8 / 9.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.75 END AS ratio FROM part
""")
def similarity_values(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of matching blocks of texts whose blocks are known."""
    a = F.get(F.array(*map(F.lit, ("WELD", "FW", "abc", "abxcd"))), (F.col("p_partkey") % 4).cast("int"))
    b = F.get(F.array(*map(F.lit, ("WELDX", "FW", "xyz", "abc"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.similarity(a, b).alias("ratio"))


@query("""
WITH RECURSIVE b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber % 2 = 0 AS pred, l_quantity AS x1, l_extendedprice / 1000 AS y1, l_quantity + 10 + 50 * l_discount AS x2, l_extendedprice / 1000 + 6 + 100 * l_tax AS y2 FROM lineitem),
i AS (SELECT p.l_orderkey AS photo, p.l_partkey AS pred, t.l_partkey AS truth, -p.l_suppkey / 1000 AS first, greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s
  FROM b p JOIN b t ON p.l_orderkey = t.l_orderkey AND p.pred AND NOT t.pred),
c AS (SELECT photo, pred, truth, row_number() OVER (PARTITION BY photo ORDER BY first, -i / (s - i), pred, truth) AS rn FROM i WHERE i / (s - i) >= 0.2),
g AS (
  SELECT photo, rn, [pred] AS ps, [truth] AS ts, true AS taken, pred, truth FROM c WHERE rn = 1
  UNION ALL
  SELECT c.photo, c.rn, CASE WHEN ok THEN list_append(ps, c.pred) ELSE ps END, CASE WHEN ok THEN list_append(ts, c.truth) ELSE ts END, ok, c.pred, c.truth
  FROM (SELECT c.*, g.ps, g.ts, NOT list_contains(g.ps, c.pred) AND NOT list_contains(g.ts, c.truth) AS ok FROM g JOIN c ON c.photo = g.photo AND c.rn = g.rn + 1) c
)
SELECT photo, pred, truth FROM g WHERE taken
""")
def greedy_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The greedy matching of boxes, as pairs."""
    b = _boxes(spark, d).withColumn("photo", F.col("l_orderkey")).withColumn("label", F.lit("box"))
    preds = b.where("l_linenumber % 2 = 0").select("photo", "label", F.col("l_partkey").alias("pred"), (F.col("l_suppkey") / 1000).alias("score"), "box")
    truths = b.where("l_linenumber % 2 = 1").select("photo", "label", F.col("l_partkey").alias("truth"), "box")
    return matching.iou_matches(preds, truths, 0.2).select("photo", "pred", "truth")


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey AS photo, ((l_partkey * 10000 + l_suppkey) * 100 + l_quantity::BIGINT) * 10 + l_linenumber AS id, l_linenumber % 2 = 0 AS is_pred, ['arrow', 'mark', 'cutout', 'spot'][l_partkey % CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 4 END + 1] AS label,
  l_suppkey % 10 / 10.0::DOUBLE AS score, l_quantity % 7 AS x1, l_suppkey % 5 AS y1, l_quantity % 7 + 6 + l_partkey % 4 AS x2, l_suppkey % 5 + 8 AS y2 FROM lineitem),
a AS (SELECT *, grp FROM l, (SELECT unnest([true, false]) AS own), (SELECT unnest([0.5, 0.3])::DOUBLE AS least), LATERAL (SELECT CASE WHEN own THEN label ELSE 'any' END AS grp)),
c AS (SELECT p.photo, p.grp, p.least, p.id AS pred, list({'o': -i / (s - i), 't': t.id} ORDER BY -i / (s - i), t.id) FILTER (i / (s - i) >= p.least) AS cands
  FROM (SELECT * FROM a WHERE is_pred) p LEFT JOIN (SELECT * FROM a WHERE NOT is_pred) t ON t.photo = p.photo AND t.grp = p.grp AND t.least = p.least,
  LATERAL (SELECT (greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0))::DOUBLE AS i, ((p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1))::DOUBLE AS s) GROUP BY ALL),
k AS (SELECT c.*, score, row_number() OVER (PARTITION BY c.photo, grp, least ORDER BY score DESC, pred) AS rn FROM c JOIN l ON l.photo = c.photo AND l.id = c.pred),
m AS (
  SELECT photo, grp, least, rn, pred, score, cands[1].t AS took, [cands[1].t] AS taken FROM k WHERE rn = 1
  UNION ALL
  SELECT k.photo, k.grp, k.least, k.rn, k.pred, k.score, list_filter(k.cands, lambda x: NOT list_contains(m.taken, x.t))[1].t, list_append(m.taken, list_filter(k.cands, lambda x: NOT list_contains(m.taken, x.t))[1].t)
  FROM m JOIN k ON k.photo = m.photo AND k.grp = m.grp AND k.least = m.least AND k.rn = m.rn + 1
),
n AS (SELECT grp, least, count(*) FILTER (NOT is_pred) AS gt FROM a GROUP BY ALL),
v AS (SELECT grp, least, took IS NOT NULL AS ok, sum((took IS NOT NULL)::INT) OVER w / (row_number() OVER w)::DOUBLE AS p, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY grp, least ORDER BY score DESC, photo, pred)),
e AS (SELECT grp, least, ok, max(p) OVER (PARTITION BY grp, least ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top FROM v),
ap AS (SELECT grp, least, sum(top) FILTER (ok) AS total FROM e GROUP BY ALL),
s AS (SELECT grp, least, least_score, count(*) FILTER (score >= least_score) AS kept, count(took) FILTER (score >= least_score) AS tp FROM m, (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS least_score) GROUP BY ALL)
SELECT n.grp AS label, n.least AS least_overlap, g.least_score, gt, coalesce(tp, 0) AS tp, coalesce(kept - tp, 0) AS fp, gt - coalesce(tp, 0) AS fn, round_even(coalesce(tp, 0) / nullif(gt, 0)::DOUBLE, 3) AS recall, round_even(tp / nullif(kept, 0)::DOUBLE, 3) AS precision,
  CASE WHEN gt > 0 THEN coalesce(round_even(total / gt, 4), 0) END AS ap
FROM n, (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS least_score) g LEFT JOIN s ON s.grp = n.grp AND s.least = n.least AND s.least_score = g.least_score LEFT JOIN ap ON ap.grp = n.grp AND ap.least = n.least
""")
def detection_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as boxes with labels, equal scores and overlaps; predictions never say ``spot``, which only truths have."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    x, y = F.col("l_quantity").cast("double") % 7, (F.col("l_suppkey") % 5).cast("double")
    names = F.array(*map(F.lit, ("arrow", "mark", "cutout", "spot")))
    label = lambda k: F.get(names, (part % k).cast("int")).alias("label")
    box = G.box(x, y, x + 6 + part % 4, y + 8).alias("box")
    rows = table(spark, d, "lineitem").withColumn("id", ((part * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")) * 10 + n)
    preds = rows.where(n % 2 == 0).select(F.col("l_orderkey").alias("photo"), label(3), F.col("id").alias("pred"), (F.col("l_suppkey") % 10 / 10).alias("score"), box)
    truths = rows.where(n % 2 == 1).select(F.col("l_orderkey").alias("photo"), label(4), F.col("id").alias("truth"), box)
    return matching.threshold_report(preds, truths, (0.5, 0.3), (0.1, 0.3, 0.5))


@query("SELECT c_custkey, round_even(0.92 * (1 - exp(-c_nationkey / 6.0::DOUBLE)), 9) AS share FROM customer")
def stage_share(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.bround(metrics.stage_progress(F.col("c_nationkey").cast("double"), 6.0), 9).alias("share"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE '' END AS refs FROM part")
def dangling_lists(spark: SparkSession, d: str) -> DataFrame:
    from inkspark.operators.validate import dangling_refs

    refs = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"), F.lit("t1"))).otherwise(F.array(F.lit("t1")))
    return table(spark, d, "part").select("p_partkey", F.array_join(dangling_refs(refs, F.array(F.lit("t1"), F.lit("t2"))), ",").alias("refs"))


@query("SELECT p_partkey, 'F5.5' AS restored, NULL::DOUBLE AS size, 'F' AS first FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, NULL, 120, 'F' FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey, NULL, NULL, 'F' FROM part WHERE p_size % 3 = 2")
def leg_repairs(spark: SparkSession, d: str) -> DataFrame:
    from inkspark.operators.interpret import implausible_leg, leg_fix

    digits = F.when(F.col("p_size") % 3 == 0, "55").when(F.col("p_size") % 3 == 1, "120").otherwise("6")
    return table(spark, d, "part").select("p_partkey", leg_fix(F.lit("F"), digits).alias("restored"), implausible_leg(digits).alias("size"), V.first_text(F.lit(" "), F.lit("F")).alias("first"))


@query("""
WITH n AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 6 WHEN 0 THEN 'B/' WHEN 1 THEN 'b/' WHEN 2 THEN 'Ä/' WHEN 3 THEN '좌현/' WHEN 4 THEN '1' ELSE 'a' END || CASE WHEN c_custkey % 4 = 0 THEN lower(c_name) ELSE c_name END AS path FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY path COLLATE de) AS place FROM n
""")
def parent_picker(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that may be parents, by their paths as people order them: digits, Latin with capitals and accents, Korean."""
    k = F.col("c_custkey")
    head = F.get(F.array(*map(F.lit, ("B/", "b/", "Ä/", "좌현/", "1", "a"))), (k % 6).cast("int"))
    rows = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").withColumn("path", F.concat(head, F.when(k % 4 == 0, F.lower("c_name")).otherwise(F.col("c_name"))))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(T.collated("path")))
    return rows.select("c_custkey", place.cast("long").alias("place"))
