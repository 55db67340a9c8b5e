"""Queries of analyses, revisions, reader runs and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import analyses
from inkspark.plans.queries import query, table


@query("""
SELECT o_orderkey AS job_id, CASE WHEN o_totalprice > 150000 THEN 'awaiting_approval' ELSE 'needs_review' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'B/x' WHEN o_orderkey % 4 > 0 THEN 'A/' || o_custkey END AS job_path,
       CASE WHEN o_orderstatus = 'F' THEN 'FILLET|' || o_orderpriority END AS condition, CASE WHEN o_orderkey % 5 = 0 THEN 'said' WHEN o_orderkey % 2 = 0 THEN 'reader' ELSE 'one, two' END AS interpretation FROM orders
""")
def job_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.create_map().cast("map<string,string>")
    fixes = F.map_concat(F.when(k % 3 == 0, F.create_map(F.lit("part"), F.lit("B/x"))).otherwise(none), F.when(k % 5 == 0, F.create_map(F.lit("interpretation"), F.lit("said"))).otherwise(none))
    rows = table(spark, d, "orders").select(
        k.alias("job_id"), (F.col("o_totalprice") > 150000).alias("passed"), fixes.alias("corrections"), F.when(k % 4 > 0, F.concat(F.lit("A/"), "o_custkey")).alias("assembly_path"),
        F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("FILLET").alias("joint_type"), F.col("o_orderpriority").alias("process"), F.lit(5.5).alias("leg"))).alias("condition"),
        F.when(k % 2 == 0, "reader").alias("reader_interpretation"), F.array(F.lit("one"), F.lit(None), F.lit(""), F.lit("two")).alias("meanings"),
    )
    out = analyses.job_fields(rows)
    return out.select("job_id", "status", "job_path", F.when(F.col("job_condition").isNotNull(), F.concat_ws("|", "job_condition.joint_type", "job_condition.process")).alias("condition"), "interpretation")


@query("""
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'old' END AS analysis_error, o_custkey FROM orders
""")
def job_with_analysis(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.lit("old").alias("analysis_error"), "o_custkey")
    return analyses.merged_job(jobs, jobs.where("job_id % 2 = 0").select("job_id", F.lit("new").alias("status")), ["status"])


@query("""
SELECT l_orderkey, string_agg(p_brand, ' ' ORDER BY l_tax >= 0.06, l_partkey, l_linenumber, p_brand) AS raw_text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
""")
def raw_texts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    place = (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("n")
    boxed = li.where("l_tax < 0.06").select("l_orderkey", place, F.col("p_brand").alias("value")).withColumnRenamed("n", "position")
    return analyses.raw_text(boxed, li.where("l_tax >= 0.06").select("l_orderkey", place, F.col("p_brand").alias("value")).withColumnRenamed("n", "seq"), ["l_orderkey"])


@query("""
SELECT c_custkey AS job_id, c_nationkey AS workspace_id, (SELECT count(*) FROM part WHERE p_size = c_nationkey) AS symbols, (SELECT string_agg(p_brand, ',' ORDER BY p_partkey) FROM part WHERE p_size = c_nationkey) AS codes,
       (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS tree, 3::BIGINT AS standards FROM customer
""")
def context_inputs(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("workspace_id"))
    entries = table(spark, d, "part").select(F.col("p_size").alias("workspace_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("code"), F.col("p_name").alias("meaning"))
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("workspace_id"), F.col("s_suppkey").alias("seq"), F.col("s_name").alias("path"))
    standards = spark.createDataFrame([(1, "FILLET"), (2, "BUTT"), (3, "FILLET")], "seq int, joint_type string")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    shown = {"symbols": size("symbols"), "codes": F.array_join(F.transform("symbols", lambda s: s.code), ","), "tree": size("tree"), "standards": size("standards")}
    return analyses.context_input(jobs, entries, nodes, standards, shown=shown).select("job_id", "workspace_id", *shown)


@query("SELECT p_partkey, p_size % 3 = 0 AND p_brand = 'Brand#11' OR p_size % 3 = 1 AND p_brand = 'Brand#12' AS standard_matched FROM part")
def manual_conditions(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.lit("M")).alias("process"), F.when(F.col("p_size") % 3 == 2, "odd").otherwise(F.col("p_brand")).alias("position"))
    standards = spark.createDataFrame([(None, "Brand#11"), ("M", "Brand#12"), ("M", "Brand#12")], "process string, position string")
    return analyses.manual_condition(values, standards, ("process", "position")).select("p_partkey", "standard_matched")


# --- revisions --------------------------------------------------------------------------------

_TARGETS = "(['t1', 't2', 'part', 't3'])[(value::INT) % 4 + 1]"


@query(f"""
WITH r AS (SELECT user_id, event_id, {_TARGETS} AS target, event_type || event_id AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS revision FROM events),
x AS (SELECT a.user_id, a.revision, b.target, max(b.revision) AS at, min(b.revision) AS first FROM r a JOIN r b ON a.user_id = b.user_id AND b.revision <= a.revision GROUP BY ALL)
SELECT x.user_id, x.revision, x.target, r.value, coalesce((SELECT arg_max(p.value, p.revision) FROM r p WHERE p.user_id = x.user_id AND p.target = x.target AND p.revision < x.at), CASE WHEN x.target IN ('t1', 'part') THEN 'was ' || x.target END) AS previous,
       row_number() OVER (PARTITION BY x.user_id, x.revision ORDER BY x.first) AS position
FROM x JOIN r ON r.user_id = x.user_id AND r.target = x.target AND r.revision = x.at
""")
def revision_chain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    target = F.get(F.array(*map(F.lit, ("t1", "t2", "part", "t3"))), (F.bround("value").cast("int") % 4))
    reviews = e.select("user_id", F.col("event_id").alias("seq"), target.alias("target"), F.concat("event_type", F.col("event_id").cast("string")).alias("value"))
    current = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit("t1"), F.lit("part"))).alias("target")).withColumn("value", F.concat(F.lit("was "), "target"))
    return analyses.revision_chain(reviews, current, ["user_id"]).select("user_id", "revision", "target", "value", "previous", F.col("position").cast("long").alias("position"))


@query("""
SELECT o_orderkey AS job_id, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'workspace_changed' END, CASE WHEN o_orderkey % 4 = 1 THEN 'project_changed' END, CASE WHEN o_orderkey % 7 = 0 THEN 'revision_number' END, CASE WHEN o_orderkey % 3 = 0 THEN 'vision_changed' END, CASE WHEN o_orderstatus <> 'F' THEN 'status_order' END) AS errors FROM orders
""")
def flow_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    row = lambda space, project, rev, vision, status: table(spark, d, "orders").select(k.alias("job_id"), space.alias("workspace_id"), project.cast("string").alias("project_id"), F.lit("img").alias("image_id"), rev.alias("revision"), vision.alias("vision"), status.alias("status"))
    first = row(F.lit(1), F.lit("p"), F.lit(1), F.array(F.lit("a"), F.lit("b")), F.lit("needs_review"))
    second = row(F.when(k % 5 == 0, 2).otherwise(1), F.when(k % 4 != 1, "p"), F.when(k % 7 == 0, 3).otherwise(2), F.when(k % 3 == 0, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"))), F.when(F.col("o_orderstatus") == "F", "awaiting_approval").otherwise("needs_review"))
    return analyses.flow_errors(first, second).select("job_id", F.array_join("errors", ",").alias("errors"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'unknown_target' WHEN event_id % 5 = 0 THEN 'empty_value' WHEN event_id % 4 = 1 AND event_id % 3 > 0 THEN 'unknown_ref' END AS error FROM events
""")
def correction_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, d, "events")
    target = F.when(k % 4 == 0, "part").when(k % 4 == 1, F.concat(F.lit("t"), k.cast("string"))).when(k % 4 == 2, "cell").otherwise("tx")
    asked = e.select("user_id", "event_id", target.alias("target"), F.when(k % 5 == 0, " ").otherwise("v").alias("value"))
    known = e.where("event_id % 3 = 0").select("user_id", F.concat(F.lit("t"), k.cast("string")).alias("ref_id"))
    return analyses.correction_errors(asked, known, ["user_id"]).select("event_id", "error")


# --- reader runs -----------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'fenced' ELSE NULL END AS interpretation, CASE p_partkey % 5 WHEN 2 THEN 'no_interpretation' WHEN 3 THEN 'no_json' WHEN 4 THEN 'no_json' END AS error FROM part")
def reader_responses(spark: SparkSession, d: str) -> DataFrame:
    texts = ('{"interpretation": "ok", "texts": []}', '```json\n{"interpretation": "fenced"}\n```', '{"texts": []}', "sorry", '{"interpretation": "cut')
    text = F.get(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 5).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", analyses.parsed_response(text, "interpretation string, texts array<string>").alias("r"))
    return rows.select("p_partkey", "r.data.interpretation", "r.error")


@query("""
SELECT user_id, array_to_string(list_sort(list(k)), ';') AS reading_key FROM (SELECT user_id, 'text:' || CASE WHEN event_id % 3 = 0 THEN 'v' ELSE 't' || event_id END || ':' || upper(event_type) AS k FROM events) GROUP BY user_id
""")
def reading_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    items = table(spark, d, "events").select("user_id", F.lit("text").alias("kind"), F.concat(F.when(k % 3 == 0, "v").otherwise("t"), k.cast("string")).alias("ref_id"), F.concat(F.lit(" "), "event_type").alias("value"))
    return analyses.reading_key(items, ["user_id"])


@query("""
SELECT user_id, round_even(avg(value / 100), 4) AS token_prob, coalesce(CASE WHEN user_id % 3 = 0 THEN 0.7 END, CASE WHEN user_id % 2 = 0 THEN 0.4 END, 0.5)::DOUBLE AS reader_prob, round_even(exp(avg(ln((value + 1) / 102))), 4) AS geometric FROM events GROUP BY user_id
""")
def reader_probabilities(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    g = table(spark, d, "events").groupBy("user_id").agg(F.bround(F.avg(F.col("value") / 100), 4).alias("token_prob"), F.collect_list(F.log((F.col("value") + 1) / 102)).alias("logs"))
    prob = analyses.reader_probability(F.when(u % 3 == 0, 0.7), F.when(u % 2 == 0, 0.4))
    return g.select("user_id", "token_prob", prob.alias("reader_prob"), analyses.mean_probability(F.col("logs")).alias("geometric"))


def _second_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events as a second reader's items, the ids of the revision before, those of the first reader, and what a person gave."""
    k = F.col("event_id")
    e = table(spark, d, "events")
    items = e.select("user_id", k.alias("seq"), F.when(k % 4 == 0, F.concat(F.lit("t"), k.cast("string"))).otherwise("new").alias("ref_id"), F.lit("text").alias("kind"), F.col("event_type").alias("value"), (k % 2 == 0).alias("has_box"))
    users = e.select("user_id").distinct()
    before = lambda seq, ref: users.select("user_id", F.lit(seq).alias("seq"), F.lit(ref).alias("ref_id"), F.lit("text").alias("kind"), F.lit("CLICK").alias("value"))
    previous = before(1, "v9").union(before(2, "v10"))
    echoes = users.select("user_id", F.lit("text").alias("kind"), F.lit("Error").alias("value"))
    known = e.where("event_id % 4 = 0").select("user_id", F.concat(F.lit("t"), k.cast("string")).alias("ref_id"))
    return items, previous, known, echoes


_STABLE = """
WITH i AS (SELECT user_id, event_id, event_type AS value, CASE WHEN event_id % 4 = 0 THEN 't' || event_id ELSE 'new' END AS ref, event_id % 2 = 0 AS boxed FROM events WHERE NOT (event_type = 'error' AND event_id % 2 = 1)),
p AS (SELECT *, CASE WHEN ref <> 'new' THEN ref END AS own FROM i),
o AS (SELECT *, CASE WHEN own IS NULL AND value = 'click' AND row_number() OVER (PARTITION BY user_id, value, own IS NULL ORDER BY event_id) = 1 THEN 'v10' ELSE own END AS id FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, id IS NULL ORDER BY event_id) AS nth FROM o)
SELECT user_id, event_id, coalesce(id, 'v' || CASE WHEN nth >= 10 THEN nth + 1 ELSE nth END) AS ref_id FROM n
"""


@query(_STABLE)
def stable_reading_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of second readings: known refs stay, one marking keeps v10, its last id of the revision before, not v9; the rest take free numbers."""
    items, previous, known, echoes = _second_items(spark, d)
    return analyses.stable_ids(items, previous, known, echoes, ["user_id"]).select("user_id", F.col("seq").alias("event_id"), "ref_id")


@query(f"""
WITH s AS ({_STABLE}), e AS (SELECT user_id, event_id, event_type AS value, CASE WHEN event_id % 4 = 0 THEN 't' || event_id ELSE 'new' END AS said FROM events),
a AS (SELECT user_id, arg_max(ref_id, event_id) AS now FROM s JOIN e USING (user_id, event_id) WHERE said = 'new' GROUP BY user_id),
m AS (SELECT user_id, event_id, coalesce(CASE WHEN said = 'new' THEN now END, said) AS ref_id, 'means ' || event_id AS meaning FROM e LEFT JOIN a USING (user_id) WHERE event_id % 3 = 0),
l AS (SELECT user_id, ref_id, arg_max(meaning, event_id) AS meaning FROM m GROUP BY ALL)
SELECT s.user_id, s.event_id, s.ref_id, CASE WHEN s.event_id % 2 = 0 THEN least(round_even((s.event_id % 50 + 5) * 2.5::DOUBLE, 0), 100) END AS x2, CASE WHEN s.event_id % 2 = 0 THEN least((s.event_id % 30 + 7) * 2.0::DOUBLE, 60) END AS y2, l.meaning FROM s LEFT JOIN l ON l.user_id = s.user_id AND l.ref_id = s.ref_id
""")
def resolved_readings(spark: SparkSession, d: str) -> DataFrame:
    """The same items with boxes of the sent image and meanings under their temporary ids."""
    items, previous, known, echoes = _second_items(spark, d)
    n = F.col("seq").cast("double")
    items = items.withColumn("box", F.when(F.col("has_box"), F.array(n % 50, n % 30, n % 50 + 5, n % 30 + 7)).otherwise(F.array(n, -n))).drop("has_box")
    meanings = items.where("seq % 3 = 0").select("user_id", "seq", "ref_id", F.concat(F.lit("means "), F.col("seq").cast("string")).alias("meaning"))
    sizes = items.select("user_id", F.lit(100).alias("width"), F.lit(60).alias("height"), F.lit(2.5).alias("scale_x"), F.lit(2.0).alias("scale_y")).distinct()
    found = analyses.resolved(items, previous, known, echoes, meanings, sizes, ["user_id"])
    return found.select("user_id", F.col("seq").alias("event_id"), "ref_id", F.get("box", 2).alias("x2"), F.get("box", 3).alias("y2"), "meaning")


@query("""
SELECT user_id, 'v' || event_id AS ref_id, false AS kept FROM events WHERE event_id % 3 = 0 UNION ALL SELECT user_id, 'v' || event_id, true FROM events WHERE event_id % 3 <> 0 AND event_id % 5 = 0
""")
def kept_corrected_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("ref_id"), F.lit("text").alias("kind"), F.col("event_type").alias("value"))
    out = analyses.kept_corrected(e.where("event_id % 3 = 0"), e, e.where("event_id % 5 = 0").select("user_id", F.col("ref_id").alias("target")), ["user_id"])
    return out.select("user_id", "ref_id", "kept")


@query("SELECT user_id, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed at ' || max(event_id) END AS error FROM events WHERE event_type <> 'view' GROUP BY user_id")
def last_reader_error(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "disabled").otherwise("ok")
    runs = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), outcome.alias("outcome"), F.concat(F.lit("failed at "), F.col("event_id").cast("string")).alias("error"))
    return analyses.last_reader_error(runs, ["user_id"])


# --- running and approving -------------------------------------------------------------------------


@query("""
SELECT user_id AS job_id, count(*) FILTER (event_type <> 'error') AS stored, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'draft' ELSE arg_max(event_type, event_id) END AS status,
       CASE WHEN arg_max(event_type, event_id) = 'error' THEN repeat('e', 1000) END AS error FROM events GROUP BY user_id
""")
def photo_runs(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return analyses.photo_runs(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("position"), ok.alias("ok"), F.col("event_type").alias("status"), F.repeat(F.lit("e"), 1500).alias("error"), F.lit("draft").alias("before")))


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'end' ELSE 'stage' END AS event, CASE WHEN event_type = 'signup' THEN 'vision' WHEN value < 50 THEN 'context' ELSE 'confidence' END AS stage FROM events),
r AS (SELECT *, last_value(CASE WHEN event <> 'stage' THEN event END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM e),
b AS (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM r WHERE last = 'start')
SELECT user_id, event_id, stage FROM b WHERE event = 'start' OR stage IS DISTINCT FROM before
""")
def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end").otherwise("stage")
    stage = F.when(F.col("event_type") == "signup", "vision").when(F.col("value") < 50, "context").otherwise("confidence")
    rows = table(spark, d, "events").select("user_id", "event_id", event.alias("event"), stage.alias("stage"))
    return analyses.stage_changes(rows, ["user_id"], ["event_id"]).select("user_id", "event_id", "stage")


@query("""
WITH r AS (SELECT o_orderkey, l_partkey, l_linenumber, l_tax > 0.04 AS ack, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_tax) AS rn, CASE o_orderstatus WHEN 'F' THEN 'awaiting_approval' WHEN 'O' THEN 'needs_review' ELSE 'draft' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT *, status = 'awaiting_approval' OR (status = 'needs_review' AND ack) AS valid FROM r),
w AS (SELECT *, coalesce(max(valid::INT) OVER (PARTITION BY o_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM v)
SELECT o_orderkey AS job_id, CASE WHEN earlier = 1 OR status = 'draft' THEN 'wrong_status' WHEN valid THEN 'approved' ELSE 'not_acknowledged' END AS outcome, count(*) AS n FROM w GROUP BY ALL
""")
def approvals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "awaiting_approval").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("draft").alias("status"))
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_tax") > 0.04).alias("acknowledge"), "l_partkey", "l_linenumber", "l_tax")
    out = analyses.approvals(asked, o, ["l_partkey", "l_linenumber", "l_tax"])
    return out.groupBy("job_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 'approved' WHEN o_orderstatus = 'F' THEN 'awaiting_approval' ELSE 'needs_review' END AS status, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 'auto' END AS approved_by FROM orders
""")
def auto_complete(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "awaiting_approval").otherwise("needs_review").alias("status"), F.lit("p").alias("assembly_path"), F.lit("m").alias("marking"),
        F.when(F.col("o_orderkey") % 3 > 0, "w").alias("welding_condition"), F.lit("old").alias("approved_by"),
    )
    return analyses.auto_completed(jobs).select("job_id", "status", "approved_by")


@query("""
SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN to_json({'job_id': o_orderkey, 'assembly_path': 'p', 'cell': NULL::VARCHAR, 'legs': [1, 2], 'approved': true, 'approved_by': 'x'})::VARCHAR END AS document,
       CASE WHEN o_orderstatus <> 'F' THEN 'not approved: needs_review' WHEN o_orderkey % 3 = 0 THEN 'missing: welding_condition, confidence' END AS error FROM orders
""")
def robot_export(spark: SparkSession, d: str) -> DataFrame:
    there = F.when(F.col("o_orderkey") % 3 > 0, "w")
    jobs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("needs_review").alias("status"), F.lit("p").alias("assembly_path"), F.lit("m").alias("marking"), there.alias("welding_condition"),
        there.alias("confidence"), F.lit("x").alias("approved_by"), F.lit(None).cast("string").alias("cell"), F.array(F.lit(1), F.lit(2)).alias("legs"),
    )
    return analyses.robot_export(jobs, ["assembly_path", "cell", "legs"])
