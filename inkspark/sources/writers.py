"""Writers: document and blob upserts, copies between stores, snapshots, exports and report files.

A store is a folder of Parquet tables ``docs`` (collection, key, seq, value) and ``blobs`` (kind, key, seq, data), written as whole new
versions: a version is a folder, so that a reader never sees half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.functions.values import json_text
from inkspark.operators.search import upserted

DOCS = "collection string, key string, seq long, value string"
BLOBS = "kind string, key string, seq long, data binary"


def documents(rows: DataFrame, collection: str, key: list[str], seq: str) -> DataFrame:
    """Rows as documents of a collection, with a composite key ``a/b`` and all columns as JSON."""
    value = json_text(F.struct(*[c for c in rows.columns if c != seq]))
    return rows.select(F.lit(collection).alias("collection"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"), F.col(seq).cast("long").alias("seq"), value.alias("value"))


def put(docs: DataFrame, log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The table after a log of writes: a key keeps its first place and takes the last value.

    The log's numbers are its own order; they are moved behind the table's last place, so that a second log may start from 1 again.
    """
    last, first = (df.agg(agg("seq")).first()[0] for df, agg in ((docs, F.max), (log, F.min)))
    moved = 0 if last is None or first is None else last + 1 - first
    both = docs.select(*keys, "seq", value).unionByName(log.select(*keys, (F.col("seq") + F.lit(moved)).alias("seq"), value))
    return upserted(both, keys, value, "seq").select(*keys, F.col("position").alias("seq"), F.col("value").alias(value))


def is_empty(spark: SparkSession, path: str, table: str = "docs") -> bool:
    """Whether a store has no row in a table; a store that isn't there is empty."""
    try:
        return spark.read.schema(DOCS if table == "docs" else BLOBS).parquet(f"{path}/{table}").isEmpty()
    except Exception as error:  # noqa: BLE001  Spark has no class of its own for a missing path here
        if "PATH_NOT_FOUND" in str(error):
            return True
        raise


def migrate(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """Copies all documents and blobs in their order and returns the numbers of both; refuses a target that has any."""
    if not (is_empty(spark, target) and is_empty(spark, target, "blobs")):
        raise ValueError(f"{target} isn't empty")
    counts = {}
    for table, schema in (("docs", DOCS), ("blobs", BLOBS)):
        counts[table] = 0
        if not is_empty(spark, source, table):
            rows = spark.read.schema(schema).parquet(f"{source}/{table}")
            rows.write.mode("append").parquet(f"{target}/{table}")
            counts[table] = rows.count()
    return counts


def with_image(images: DataFrame, added: DataFrame) -> DataFrame:
    """Image rows and new ones behind them, not preprocessed yet."""
    return images.unionByName(added.withColumn("preprocessed", F.lit(False)))


def preprocessed(images: DataFrame, done: DataFrame) -> DataFrame:
    """Image rows with the flag set for the images of ``done`` (job_id, image_id)."""
    flag = done.select("job_id", "image_id", F.lit(True).alias("now")).distinct()
    return images.join(flag, ["job_id", "image_id"], "left").withColumn("preprocessed", F.col("preprocessed") | F.coalesce("now", F.lit(False))).drop("now")


def write_json_lines(rows: DataFrame, path: str, value: str) -> None:
    """One JSON document a line."""
    rows.select(value).write.text(path)


def write_reports(rows: DataFrame, path: str, name: str) -> None:
    """A folder of JSON lines for each report name, nulls included."""
    rest = F.struct(*[c for c in rows.columns if c != name])
    rows.select(F.col(name), json_text(rest).alias("value")).repartition(name).write.partitionBy(name).text(path)


def in_order(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows numbered by their order of insertion within a collection or kind."""
    return docs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
