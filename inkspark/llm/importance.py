"""Importance resampling of documents towards a target corpus, over bucket-partitioned inverted postings.

1. Postings: each slice of whole texts is cut into words; a feature (a run of words) falls into the bucket of its CRC-32. A slice
   emits, per bucket, the list of its rows and how often each has the bucket, and one more row with its documents' ids and sizes.
   Rows are numbered as they are met and written at once, so that repeated or missing ids stay apart.
2. Co-grouping: the corpora's sums meet by bucket (partial sums first: never more rows than buckets and tasks).
3. The postings are shuffled by bucket and meet both sums there; each bucket computes its gain and turns its lists into
   contributions. A bucket of very common words is no group: its lists stream through the join, which splits where it is hot.
4. Contributions are summed by document (partial sums first), the seeded Gumbel noise is added, and the highest scores are drawn:
   a range-partitioned sort numbers rows within partitions, and the counts of the partitions before are added.

Defined results: null and empty texts have no features and weight 0. Rows that repeat an id are documents of their own, with the
same noise and, if their texts are equal, the same score. A null id draws its noise as an empty text and comes last among ties.
An empty target or empty documents are fine: all counts are 0. A text of any length is one slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.byte_words import byte_classes, byte_words, runs
from inkspark.llm.store import dropped, source, written
from inkspark.llm.words import slices

SLICE_BYTES = 4 << 20
#: All ASCII characters but digits and letters part words.
CLASSES = byte_classes(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
POSTINGS = "bucket int, part long, rows array<long>, counts array<int>, ids array<long>, features array<long>, words array<long>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))


def _postings(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Posting lists of each slice by bucket, and its documents in a row without a bucket."""
    context = TaskContext.get()
    seen = (context.partitionId() if context else 0) << 36
    kinds = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("rows", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("features", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))])
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            n = batch.num_rows
            owner, _, words = byte_words(batch.column("text"), CLASSES)
            keys = []
            for length in range(1, longest + 1):
                own, joined = runs(owner, words, length)
                coded = joined.dictionary_encode()
                crc = np.array([zlib.crc32(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
                keys.append((crc % buckets)[coded.indices.to_numpy(zero_copy_only=False)] * n + own if len(own) else np.zeros(0, np.int64))
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            bucket, row = np.divmod(found, max(n, 1))
            ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1 if len(bucket) else np.zeros(0, np.int64)
            totals = np.r_[0, np.cumsum(counts)]
            none = lambda rows, kind: pa.nulls(rows, pa.list_(kind))
            if len(ends):
                lists = [pa.array(bucket[ends - 1].astype(np.int32)), pa.array(np.diff(totals[np.r_[0, ends]])), _lists(row + seen, ends), _lists(counts.astype(np.int32), ends)]
                yield pa.RecordBatch.from_arrays([*lists, *[none(len(ends), pa.int64())] * 3], schema=kinds)
            sizes = np.bincount(owner, minlength=n)
            features = np.bincount(row, weights=counts, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int32()), pa.array([0], pa.int64()), one(pa.array(np.arange(seen, seen + n))), none(1, pa.int32()), one(ids), one(pa.array(features)), one(pa.array(sizes.astype(np.int64)))],
                schema=kinds,
            )
            seen += n


def gain(s: Column, t: Column, total_s: int, total_t: int, buckets: int) -> Column:
    """The bucket's gain: 1000 times the log ratio of its smoothed shares in target and documents, rounded down."""
    real = lambda x: x.cast("double")
    up, down = real(t + 1) * F.lit(float(total_s + buckets)), real(s + 1) * F.lit(float(total_t + buckets))
    return F.floor(F.lit(1000.0) * F.ln(up / down))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_features, n_words, weight of every row of ``docs``."""
    post = partial(_postings, longest=longest, buckets=buckets)
    posted = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(post, POSTINGS), "importance-postings")
    aimed = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(post, POSTINGS)
    lists = posted.where("bucket IS NOT NULL")
    zero = F.lit(0).cast("long")
    corpora = lists.select("bucket", F.col("part").alias("s"), zero.alias("t")).union(aimed.where("bucket IS NOT NULL").select("bucket", zero, "part"))
    sums = written(corpora.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "importance-buckets")
    total = sums.agg(F.coalesce(F.sum("s"), zero), F.coalesce(F.sum("t"), zero)).first()
    # the sums are few rows, but a hash join over shuffled rows leaves the postings by bucket, as the gains are computed there
    met = lists.select("bucket", "rows", "counts").join(sums.hint("shuffle_hash"), "bucket")
    each = met.select(gain(F.col("s"), F.col("t"), *total, buckets).alias("gain"), F.arrays_zip("rows", "counts").alias("posts")).select("gain", F.inline("posts").alias("row", "times"))
    given = each.select("row", F.lit(None).cast("long").alias("doc_id"), zero.alias("n_features"), zero.alias("n_words"), (F.col("gain") * F.col("times")).alias("weight"))
    known = posted.where("bucket IS NULL").select(F.inline(F.arrays_zip("rows", "ids", "features", "words")).alias("row", "doc_id", "n_features", "n_words"))
    summed = given.unionByName(known.withColumn("weight", zero)).groupBy("row")
    return summed.agg(F.max("doc_id").alias("doc_id"), F.max("n_features").alias("n_features"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank of every row; rank is null where the row isn't drawn."""
    scored = weights(docs, target, longest, buckets, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "importance-scores")  # the range partitioning below reads it twice
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = scored.where(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, so_far = [], 0
    for number, rows in counts:
        before.append((number, so_far))
        so_far += rows
    offsets = docs.sparkSession.createDataFrame(before, "part long, offset long")
    rank = F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= percent * so_far // 100, rank))
    out = ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out).unionByName(rest.select(*out))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", **options: int) -> DataFrame:
    """The ids of the sample in the order of their ranks' numbers: doc_id, rank."""
    return resample(docs, target, percent, id_col=id_col, **options).where("rank IS NOT NULL").select("doc_id", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` weighted towards ``benchmark``, a tenth of those with 20 words drawn."""
    found = resample(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its table, over the distinct words' bytes.
ORACLE_SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), w AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), d AS (SELECT side, doc_id, word, count(*) AS n FROM w GROUP BY ALL),
b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(encode(word))), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM d), tab
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM d JOIN b USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d JOIN b USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)
"""
