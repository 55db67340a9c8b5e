"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split.

A row's hash is the first 60 bits of the MD5 of its id and text, so a hot source, a hot key or thousands of copies of
one text spread evenly. A bucket is a prefix of that hash; one that is over the byte limit splits on the next bit,
until every shard fits. All of it is aggregation over (hash prefix, bytes), never a sort or a group of rows: the first
round counts bytes for prefixes a few bits longer than the data needs on average, rolls them up to every shorter
prefix, and keeps the shortest prefixes that fit. Only rows of prefixes that still don't fit enter another round.

Rows find their shard through the directory, which has a row for each prefix of the round's length. It is broadcast while
``entries * 40`` bytes stay under ``broadcast_bytes``, and joined by shuffle beyond.

Defined results: a null text has 0 bytes; a null id hashes as the empty string; a single row over the limit is a shard of
its own; identical rows (same id and text), which no hash bit separates, go to numbered overflow pages of one bucket,
each within the limit. An empty table gives no rows. Other columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.llm.bloom import unused
from inkspark.llm.store import source, written

HASH_BITS = 60
SLACK_BITS = 3
NEXT_BITS = 4
SALTS = 1024

#: Byte limit of a shard in the query.
LIMIT_BYTES = 2 << 20
SMALL_LIMIT_BYTES = 32 << 10


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of ``id:text``."""
    md5 = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftrightunsigned", F.col("hash"), (F.lit(HASH_BITS) - depth).cast("int"))


def _round(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Of (cell, bytes, rows) at depth ``high``: cell, and the depth, prefix, bytes and rows of its shortest
    prefix of at least ``low`` bits that fits; a null depth if none does."""
    lifted = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(cell, {high} - depth)")
    )
    nodes = (
        lifted.groupBy("depth", "prefix")
        .agg(F.sum("bytes").alias("node_bytes"), F.sum("rows").alias("node_rows"))
        .where((F.col("node_bytes") <= limit) | (F.col("node_rows") == 1) | (F.col("depth") == HASH_BITS))
    )
    first = (
        lifted.select("cell", "depth", "prefix")
        .join(nodes, ["depth", "prefix"])
        .select("cell", F.struct("depth", "prefix", "node_bytes", "node_rows").alias("n"))
        .groupBy("cell")
        .agg(F.min_by("n", F.col("n.depth")).alias("n"))
    )
    return cells.select("cell").join(first, "cell", "left").select("cell", "n.*")


def assign_shards(
    docs: DataFrame,
    limit_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_bytes: int = 8 << 20,
    carry: bool = False,
) -> DataFrame:
    """doc_id, n_bytes and the row's shard: shard_depth, shard_prefix, page, shard_bytes, shard_rows of the bucket; with ``carry``
    also the whole ``row`` as a struct."""
    base = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            row_hash(F.col(id_col), F.col(text_col)).alias("hash"),
            *([F.struct(*docs.columns).alias("row")] if carry else []),
        ),
        "shard-hashes",
    )
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(HASH_BITS, max(0, total // limit_bytes).bit_length() + SLACK_BITS)
    rows, done = base, []
    while True:
        cells = rows.groupBy(_prefix(high).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        directory = written(_round(cells, low, high, limit_bytes), "shard-directory")
        n, n_open = directory.agg(F.count(F.lit(1)), F.count_if(F.col("depth").isNull())).first()
        table = F.broadcast(directory) if n * 40 <= broadcast_bytes else directory
        joined = rows.withColumn("cell", _prefix(high)).join(table, "cell")
        done.append(joined.where("depth IS NOT NULL"))
        if not n_open:
            break
        rows = joined.where("depth IS NULL").select(*base.columns)
        low, high = high + 1, min(HASH_BITS, high + NEXT_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(
        "doc_id",
        "n_bytes",
        "hash",
        F.col("depth").cast("int").alias("shard_depth"),
        F.col("prefix").alias("shard_prefix"),
        F.col("node_bytes").alias("shard_bytes"),
        F.col("node_rows").alias("shard_rows"),
        *base.columns[3:],
    )
    if high < HASH_BITS:  # no bucket is left over: every row is in page 0
        return out.drop("hash").withColumn("page", F.lit(0).cast("long"))
    return _paged(out, limit_bytes)


def _paged(out: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for buckets of identical hashes: rows are numbered per salt, then offset by the salts before."""
    whole = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    # equal rows have nothing to number them by but their place: it is written once, so that a task run again can't change it
    over = written(out.where(~whole).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "shard-overflow")
    inside = Window.partitionBy("hash", "salt").orderBy("n_bytes")
    before = Window.partitionBy("hash").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        over.groupBy("hash", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("hash", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
    paged = (
        over.withColumn("i", F.row_number().over(inside) - 1)
        .join(offsets, ["hash", "salt"])
        .withColumn("page", F.floor((F.col("i") + F.col("offset")) / per_page).cast("long"))
    )
    kept = out.where(whole).withColumn("page", F.lit(0).cast("long"))
    return kept.drop("hash").unionByName(paged.drop("hash", "salt", "i", "offset"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` as one Parquet folder per shard (``shard=depth-prefix-page``); every row once, with all its columns."""
    placed = assign_shards(docs, limit_bytes, id_col, text_col, carry=True)
    name = unused(docs, "shard") if "shard" in docs.columns else "shard"
    named = placed.select("row.*", F.concat_ws("-", "shard_depth", "shard_prefix", "page").alias(name))
    named.repartition(name).write.partitionBy(name).parquet(path)


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row of ``documents``."""
    return assign_shards(source(spark, sf_dir, "documents"), LIMIT_BYTES)


def llm_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards at a limit that makes many of them on small tables, for the comparison with SQL."""
    return assign_shards(source(spark, sf_dir, "documents"), SMALL_LIMIT_BYTES)


_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents
), lifted AS (
  SELECT doc_id, n_bytes, hash, d, hash >> (BITS - d) AS prefix FROM h, range(0, 31) r(d)
), nodes AS (
  SELECT d, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM lifted GROUP BY d, prefix
  HAVING sum(n_bytes) <= LIMIT OR count(*) = 1
), leaf AS (
  SELECT l.doc_id, l.n_bytes, l.d, l.prefix, n.shard_bytes, n.shard_rows,
         row_number() OVER (PARTITION BY l.doc_id ORDER BY l.d) AS rn
  FROM lifted l JOIN nodes n ON n.d = l.d AND n.prefix = l.prefix
)
SELECT doc_id, n_bytes, d::INTEGER AS shard_depth, prefix AS shard_prefix, shard_bytes, shard_rows, 0::BIGINT AS page
FROM leaf WHERE rn = 1
""".replace("BITS", str(HASH_BITS))
ORACLE_SQL = _SQL.replace("LIMIT", str(LIMIT_BYTES))
SMALL_ORACLE_SQL = _SQL.replace("LIMIT", str(SMALL_LIMIT_BYTES))
