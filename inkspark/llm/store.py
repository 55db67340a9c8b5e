"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only where it is unset (tests, a laptop) a temporary
local folder is used instead. A table written here cuts lineage and survives lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a temporary one for local sessions."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="inkspark-"))
    return f"file://{_LOCAL[0]}"


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB: Spark builds them outside its heap, and a count of rows doesn't bound them where texts are long."""
    key, most = BATCH_BYTES
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:  # a smaller limit of the session's own stays
        spark.conf.set(key, str(most))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; dealt out to all cores where its files alone would keep fewer of them busy."""
    _small_batches(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; removed when the driver ends."""
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{shared_dir(spark)}/inkspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes a table of ``written`` that no later step reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone; the cluster's own clean-up takes the folder
        pass
