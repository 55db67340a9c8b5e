"""Queries of readers and writers: they write files of the tables' rows to the shared scratch folder, and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators.ordering import numbered_whole
from inkspark.plans.queries import query, table
from inkspark.sources import readers, writers
from inkspark.sources.scratch import folder as scratch


@query("""
SELECT p_type AS joint_type, CASE WHEN p_size % 3 > 0 THEN p_size::DOUBLE END AS thickness_min_mm, CASE WHEN p_size % 3 > 0 THEN p_size + 2.5::DOUBLE END AS thickness_max_mm, p_name AS process, count(*) AS n FROM part GROUP BY ALL
""")
def csv_standards(spark: SparkSession, d: str) -> DataFrame:
    path, s = scratch(spark, "standards"), F.col("p_size")
    low = F.when(s % 3 > 0, s.cast("double"))
    null = F.lit(None).cast("double")
    rows = table(spark, d, "part").select(F.col("p_type").alias("joint_type"), low.alias("thickness_min_mm"), (low + 2.5).alias("thickness_max_mm"), null.alias("leg_min_mm"), null.alias("leg_max_mm"), F.col("p_name").alias("process"), *[F.lit("x, \"y\"").alias(c) for c in ("position", "current_a", "voltage_v", "speed_cm_min")])
    rows.write.csv(path, header=True, escape='"')
    return readers.standards(spark, path).groupBy("joint_type", "thickness_min_mm", "thickness_max_mm", "process").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT n_regionkey AS workspace_id, n_nationkey AS project_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS seq, c_name AS node_id, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS parent_id, CASE WHEN c_custkey % 5 = 0 THEN 'SUB' ELSE 'PART' END AS level,
  n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def project_trees(spark: SparkSession, d: str) -> DataFrame:
    """Tree files in a folder for each workspace and project; some nodes come again with another level, which counts at their first place."""
    root = scratch(spark, "trees")
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    again = F.explode(F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    rows = rows.select("n_regionkey", "n_nationkey", "c_custkey", again, "c_name", "n_name")
    rows = rows.select("n_regionkey", "n_nationkey", "c_custkey", "again", F.col("c_name").alias("node_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).alias("parent_id"), F.when(F.col("again") == 1, "SUB").otherwise("PART").alias("level"), F.concat_ws("/", "n_name", "c_name").alias("path"))
    # the folder names of the layout carry no column name: one write per workspace and project of this small table
    for r in table(spark, d, "nation").select("n_regionkey", "n_nationkey").orderBy("n_nationkey").collect():
        own = rows.where((F.col("n_nationkey") == r["n_nationkey"]))
        own.coalesce(1).sortWithinPartitions("again", "c_custkey").drop("n_regionkey", "n_nationkey", "again", "c_custkey").write.csv(f"{root}/workspaces/{r['n_regionkey']}/projects/{r['n_nationkey']}/assembly_tree.csv", header=True)
    found = readers.project_trees(spark, root)
    return found.withColumns({"workspace_id": F.col("workspace_id").cast("int"), "project_id": F.col("project_id").cast("int"), "seq": F.col("seq").cast("long")})


@query("SELECT p_size % 4 AS file, p_brand AS code, CASE WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'symbol' END AS kind, p_name AS meaning, 'a|' || p_type AS aliases, CASE WHEN p_size = 7 THEN 'FILLET' END AS joint, count(*) AS n FROM part GROUP BY ALL")
def json_dictionary(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "dictionary")
    entry = F.struct(F.concat(F.lit("f"), (F.col("p_size") % 4).cast("string")).alias("id"), F.col("p_brand").alias("code"), F.when(F.col("p_partkey") % 2 == 0, "text").otherwise("symbol").alias("kind"), F.col("p_name").alias("meaning"), F.array(F.lit("a"), F.col("p_type")).alias("aliases"), F.when(F.col("p_size") == 7, "FILLET").alias("welding_joint_type"))
    files = table(spark, d, "part").groupBy((F.col("p_size") % 4).alias("f")).agg(F.collect_list(entry).alias("entries"))
    files.select(F.to_json(F.struct("entries"), {"ignoreNullFields": "false"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = readers.dictionary(spark, path)
    return rows.groupBy(F.substring("id", 2, 1).cast("int").alias("file"), "code", "kind", "meaning", F.array_join("aliases", "|").alias("aliases"), F.col("welding_joint_type").alias("joint")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS workspace_id, o_orderkey AS job_id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS name, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders QUALIFY seq > 0")
def document_store(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot of a collection as JSON documents in a store, copied to an empty store, and rehydrated by its composite keys."""

    path = scratch(spark, "store")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("ws"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("name"), F.col("o_orderkey").alias("n"))
    writers.documents(rows, "jobs", ["ws", "id"], "n").write.parquet(f"{path}/a/docs")
    spark.createDataFrame([("image", "1", 1, bytearray(b"x"))], writers.BLOBS).write.parquet(f"{path}/a/blobs")
    writers.migrate(spark, f"{path}/a", f"{path}/b")
    docs = spark.read.schema(writers.DOCS).parquet(f"{path}/b/docs")
    found = readers.collection(docs, "jobs", "status string, name string")
    typed = found.select(*readers.key_parts("key", "workspace_id", "job_id"), "status", "name", "seq")
    typed = typed.withColumns({"workspace_id": F.col("workspace_id").cast("long"), "job_id": F.col("job_id").cast("long")})
    return numbered_whole(typed.withColumnRenamed("seq", "at"), ["at"], "seq").drop("at")  # the order of one collection


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'sqlite' WHEN 1 THEN 'postgres' WHEN 2 THEN 'parquet' WHEN 3 THEN NULL ELSE NULL END AS kind, CASE c_custkey % 5 WHEN 0 THEN '/x.db' WHEN 1 THEN 'u:***@h/d' WHEN 2 THEN '/t' WHEN 3 THEN 'h' ELSE '' END AS location FROM customer
""")
def source_addresses(spark: SparkSession, d: str) -> DataFrame:
    from inkspark.functions.text import masked_url

    urls = F.array(*map(F.lit, ("sqlite:///x.db  # local", "postgresql+pg8000://u:p@h/d", "FILE:///t", "mongo://h", "nothing")))
    rows = table(spark, d, "customer").select("c_custkey", readers.source_of(masked_url(F.get(urls, (F.col("c_custkey") % 5).cast("int")))).alias("s"))
    return rows.select("c_custkey", "s.kind", "s.location")


@query("SELECT p_size AS width, p_size * 3 AS height, 'png' AS format, count(*) AS n FROM (SELECT DISTINCT p_size FROM part) GROUP BY ALL UNION ALL SELECT NULL, NULL, NULL, 1")
def image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Format and size out of the first bytes of PNG images, and none for other bytes."""
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex(F.col("p_size").cast("long")), 8, "0")), F.unhex(F.lpad(F.hex((F.col("p_size") * 3).cast("long")), 8, "0")))
    sizes = table(spark, d, "part").select("p_size").distinct()
    rows = sizes.select(F.lit("p").alias("path"), F.lit(24).alias("length"), head.alias("content")).union(spark.createDataFrame([("q", 1, bytearray(b"x"))], "path string, length int, content binary"))
    return readers.image_headers(rows).groupBy("width", "height", "format").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey AS image, l_partkey AS text, l_quantity AS x1, l_extendedprice AS y1, l_quantity + 5 AS x2, l_extendedprice + 2 AS y2, l_tax = 0 OR l_returnflag = 'R' AS unreadable, count(*) AS n FROM lineitem GROUP BY ALL
""")
def label_files(spark: SparkSession, d: str) -> DataFrame:
    """Detection labels with JSON in the second column."""
    path, c = scratch(spark, "labels"), F.col
    pts = F.array(*[F.array(x, y) for x, y in ((c("l_quantity"), c("l_extendedprice")), (c("l_quantity") + 5, c("l_extendedprice")), (c("l_quantity") + 5, c("l_extendedprice") + 2), (c("l_quantity"), c("l_extendedprice") + 2))])
    item = F.struct(c("l_partkey").cast("string").alias("transcription"), pts.alias("points"), ((c("l_tax") == 0) | (c("l_returnflag") == "R")).alias("difficult"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(item)).alias("j"))
    lines.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("\t"), "j", F.lit("\r")).alias("value")).union(spark.createDataFrame([("  ",)], "value string")).write.text(path)
    found = readers.detection_labels(spark, path)
    return found.groupBy(c("image").cast("long").alias("image"), c("text").cast("long").alias("text"), "x1", "y1", "x2", "y2", "unreadable").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name || ', ' || p_brand AS text, min(p_size)::DOUBLE AS x1, max(p_size)::DOUBLE AS x2, count(*) AS n FROM part WHERE p_size % 4 > 0 GROUP BY p_name, p_brand, p_size")
def quad_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "quads")
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, "###").otherwise(F.concat_ws(", ", "p_name", "p_brand"))
    table(spark, d, "part").select(F.concat_ws(",", s, F.lit("1"), s, F.lit("2"), s, F.lit("3"), s, F.lit("4"), text).alias("value")).write.text(path)
    return readers.quad_labels(spark, path).groupBy("text", "x1", "x2").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS image, c_name AS text, row_number() OVER (ORDER BY c_custkey) AS seq FROM customer")
def recognition_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "rec")
    table(spark, d, "customer").orderBy("c_custkey").coalesce(1).select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name").alias("value")).write.text(path)
    return readers.recognition_labels(spark, path).select(F.col("image").cast("long").alias("image"), "text", F.col("seq").cast("long").alias("seq"))


@query("SELECT n_name AS image, c_name AS text, c_acctbal AS x1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3")
def annotation_files(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object a file, of which only those of the split ``eval`` are read."""
    path = scratch(spark, "annotations")
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    texts = F.collect_list(F.struct(F.col("c_name").alias("text"), F.array("c_acctbal").alias("bbox"))).alias("texts")
    files = rows.groupBy(F.col("n_name").alias("image"), F.when(F.col("n_regionkey") < 3, "eval").otherwise("train").alias("split")).agg(texts)
    files.select(F.to_json(F.struct("image", "split", "texts")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = readers.annotations(spark, path).select("image", F.explode("texts").alias("t"))
    return found.select("image", "t.text", F.get("t.bbox", 0).alias("x1"))


@query("""
WITH l AS (SELECT user_id % 500 AS kind, event_type AS key, event_id, user_id || ':' || value AS data, least(2, event_id * 3 // (SELECT max(event_id) + 1 FROM events)) AS batch FROM events),
f AS (SELECT batch, min(event_id) AS low FROM l GROUP BY batch),
a AS (SELECT kind, key, min(event_id) AS seq FROM l WHERE batch = 0 GROUP BY ALL),
b AS (SELECT kind, key, min(event_id) - low + (SELECT max(seq) + 1 FROM a) AS seq FROM l JOIN f USING (batch) WHERE batch = 1 AND (kind, key) NOT IN (SELECT (kind, key) FROM a) GROUP BY kind, key, low),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
c AS (SELECT kind, key, min(event_id) - low + (SELECT max(seq) + 1 FROM ab) AS seq FROM l JOIN f USING (batch) WHERE batch = 2 AND (kind, key) NOT IN (SELECT (kind, key) FROM ab) GROUP BY kind, key, low)
SELECT kind::VARCHAR AS kind, key, seq, data FROM (SELECT * FROM ab UNION ALL SELECT * FROM c) JOIN (SELECT kind, key, arg_max(data, event_id) AS data FROM l GROUP BY ALL) USING (kind, key)
""")
def blob_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Binary values: a key keeps its first place and takes the last bytes; two more logs follow, whose numbers start from 1."""
    e = table(spark, d, "events")
    rows = e.select((F.col("user_id") % 500).cast("string").alias("kind"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.concat_ws(":", F.col("user_id").cast("string"), F.col("value").cast("string")).cast("binary").alias("data"))
    top = e.agg(F.max("event_id")).first()[0] + 1
    batch = F.least(F.lit(2), F.floor(F.col("seq") * 3 / top))
    parts = [rows.where(batch == i) for i in range(3)]
    first = parts[0].groupBy("kind", "key").agg(F.min("seq").alias("s"), F.max_by("data", "seq").alias("data")).withColumnRenamed("s", "seq")
    again = lambda part: part.withColumn("seq", F.col("seq") - part.agg(F.min("seq")).first()[0] + 1)
    out = writers.put(writers.put(first, again(parts[1]), ["kind", "key"], "data"), again(parts[2]), ["kind", "key"], "data")
    return out.withColumn("data", F.col("data").cast("string"))


@query("SELECT o_orderkey AS job_id, o_custkey AS image_id, o_orderstatus = 'F' OR o_orderkey % 4 = 0 AND o_orderkey % 2 = 0 AS preprocessed FROM orders")
def image_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("image_id"), (F.col("o_orderstatus") == "F").alias("preprocessed"))
    both = writers.with_image(rows.where("job_id % 2 = 1"), rows.where("job_id % 2 = 0").drop("preprocessed"))
    done = rows.where("(job_id % 2 = 0 AND preprocessed) OR job_id % 4 = 0")
    return writers.preprocessed(both, done)


@query("SELECT o_orderpriority AS report, o_orderstatus AS status, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS note FROM orders")
def report_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "reports")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("report"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("note"))
    writers.write_reports(rows, path, "report")
    back = spark.read.text(path, wholetext=False)
    return back.select("report", F.from_json("value", "status string, id long, note long").alias("v")).select("report", "v.*")
