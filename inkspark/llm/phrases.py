"""Collocations of each language, mined pass by pass with hashed bucket counts (PCY/DHP) and Apriori pruning before exact counts.

Pass k reads all texts once and does two things: it counts the k-grams that can still be frequent exactly, and it counts the
(k+1)-grams of which both k-grams can be in hashed buckets. A k-gram can be frequent if both its (k-1)-grams are (a bitmap of the
frequent ones' hashes) and its own bucket of the pass before reached the limit (a bitmap of buckets). Both bitmaps only
leave out what can't be frequent, and the exact count decides, so that collisions cost time and never a phrase.

Sizes: a task counts buckets in one array, a byte each up to 255, and emits those that it met, three bytes each; the arrays meet by block of
buckets and stream into one bitmap. There are at most ``most_buckets`` buckets, so that a broadcast is at most an eighth of that in
bytes (8 MB), whatever the input; where so many buckets are full, pruning is left to the words and the counts take more room.

Scores are exact: decimals of 37 digits and a whole division. The longest texts are a slice of their own; nothing is cut.

Defined results: null and empty texts have no words; a null language is ``und``, together with texts that say so. Repeated rows and ids
count as often as they are there. Without texts there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.llm.byte_words import byte_classes, byte_words
from inkspark.llm.store import dropped, source, written
from inkspark.llm.words import hash_strings, mix, ngram_hashes, signed, slices

SLICE_BYTES = 5 << 20
CLASSES = byte_classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
BLOCK = 1 << 14
FEWEST_BUCKETS = 1 << 16
PARTS = 64
PASS = "lang string, phrase string, h long, f long, block int, spots binary, times binary"
PASS_KIND = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("f", pa.int64()), ("block", pa.int32()), ("spots", pa.binary()), ("times", pa.binary())])


def bucket_count(text_bytes: int, most: int) -> int:
    """Buckets for so much text: a power of two, about one for sixteen bytes."""
    n = FEWEST_BUCKETS
    while n < text_bytes // 16 and 2 * n <= most:
        n *= 2
    return n


def _kind(least: int) -> np.dtype:
    return np.dtype(np.uint8 if least < 256 else np.uint32)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the hashes' places."""
    place = h & np.uint64(len(bits) * 8 - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _blocks(counted: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, its places that aren't zero, their counts)."""
    for block in range(len(counted) // BLOCK):
        part = counted[block * BLOCK : (block + 1) * BLOCK]
        spots = np.flatnonzero(part)
        if len(spots):
            yield block, spots.astype("<u2").tobytes(), part[spots].tobytes()


def _add(counted: np.ndarray, spots: np.ndarray, times: np.ndarray, least: int) -> None:
    """Adds counts to distinct places, up to ``least``."""
    sums = counted[spots].astype(np.int64) + np.minimum(times, least)
    counted[spots] = np.minimum(sums, least).astype(counted.dtype)


def _codes(lang: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """A number for each distinct (language, k words) of the places ``at``."""
    code = lang[at].astype(np.int64)
    for i in range(k):
        if len(code) and int(code.max() + 1) * n_words >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * n_words + ids[at + i]
    return code


def _counted(batches: Iterator[pa.RecordBatch], k: int, longest: int, least: int, buckets: int, known: Broadcast | None, full: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Exact counts of the slices' k-grams that pass both bitmaps; at the end the task's bucket counts of (k+1)-grams."""
    frequent, reached = (np.frombuffer(b.value, np.uint8) if b is not None else None for b in (known, full))
    counted = np.zeros(buckets if k < longest else 0, _kind(least))
    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            owner, piece, words = byte_words(batch.column("text"), CLASSES)
            if len(owner) < k:
                continue
            coded = words.dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            hashed = hash_strings(coded.dictionary)[ids]
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[owner]
            salt = hash_strings(langs.dictionary)[lang]
            grams = lambda n: mix(ngram_hashes(hashed, n) ^ salt[: len(hashed) - n + 1])
            own = grams(k)
            good = piece[: len(own)] == piece[k - 1 :]
            if k > 1:
                parts = _has(frequent, grams(k - 1))
                good &= parts[:-1] & parts[1:] & _has(reached, own)
            at = np.flatnonzero(good)
            if len(at):
                _, first, times = np.unique(_codes(lang, ids, at, k, len(coded.dictionary)), return_index=True, return_counts=True)
                at = at[first]
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(at + i)) for i in range(k)], " ") if k > 1 else words.take(pa.array(at))
                empty = [pa.nulls(len(at), t) for t in PASS_KIND.types[4:]]
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at])), phrase, pa.array(signed(own[at])), pa.array(times), *empty], schema=PASS_KIND)
            if k < longest and len(own) > 1:
                longer = good[:-1] & good[1:] & (piece[: len(own) - 1] == piece[k:])
                spots, times = np.unique(grams(k + 1)[longer] & np.uint64(buckets - 1), return_counts=True)
                _add(counted, spots.astype(np.int64), times, least)
    yield from _emitted(counted)


def _emitted(counted: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = list(_blocks(counted))
    for i in range(0, len(rows), 64):
        part = list(zip(*rows[i : i + 64]))
        empty = [pa.nulls(len(part[0]), t) for t in PASS_KIND.types[:4]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(part[0], pa.int32()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], schema=PASS_KIND)


def _marked(batches: Iterator[pa.RecordBatch], least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The places of the hashes, as full buckets."""
    counted = np.zeros(buckets, _kind(least))
    for batch in batches:
        counted[batch.column("h").to_numpy().view(np.uint64) & np.uint64(buckets - 1)] = least
    yield from _emitted(counted)


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the blocks' full buckets; a block's rows stream into one array."""
    kind, blocks = _kind(least), {}
    for batch in batches:
        for block, spots, times in zip(*(c.to_pylist() for c in batch.columns)):
            into = blocks.setdefault(block, np.zeros(BLOCK, kind))
            _add(into, np.frombuffer(spots, "<u2").astype(np.int64), np.frombuffer(times, kind).astype(np.int64), least)
    rows = [(block, np.packbits(into >= least, bitorder="little").tobytes()) for block, into in blocks.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "bits"])


def _bitmap(counts: DataFrame, least: int, buckets: int) -> Broadcast:
    """The bitmap of full buckets, broadcast; ``counts`` has block, spots and times."""
    met = counts.select("block", "spots", "times").repartition("block").mapInArrow(partial(_merged, least=least), "block int, bits binary")
    out = np.zeros(buckets // 8, np.uint8)
    for block, bits in met.toLocalIterator():  # one bit for a bucket, by the limit of buckets
        out[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(bits, np.uint8)
    return counts.sparkSession.sparkContext.broadcast(out.tobytes())


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text", most_buckets: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f of all phrases of up to ``longest`` words found ``least`` times in a language; lang, n of all its words)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(n_bytes, most_buckets)
    found, totals, known, full = [], None, None, None
    for k in range(1, longest + 1):
        count = partial(_counted, k=k, longest=longest, least=least, buckets=buckets, known=known, full=full)
        seen = written(texts.mapInArrow(count, PASS), f"phrases-pass-{k}")
        exact = seen.where("phrase IS NOT NULL")
        if k == 1:
            totals = written(exact.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
        held = exact.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("h").alias("h")).where(F.col("f") >= least)
        held = written(held, f"phrases-{k}")
        found.append(held.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        for old in (known, full):
            if old is not None:
                old.unpersist()
        if k < longest:
            full = _bitmap(seen.where("block IS NOT NULL"), least, buckets)
            known = _bitmap(held.select("h").mapInArrow(partial(_marked, least=least, buckets=buckets), PASS), least, buckets)
        dropped(seen)
    return reduce(DataFrame.union, found), totals


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) without rounding, for counts of up to 14 digits."""
    whole = lambda c: c.cast("decimal(14,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(l) * whole(r))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", most_buckets: int = 1 << 26) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases of two words or more.

    A phrase is dropped if a longer candidate that contains it is found in at least ``percent`` of a hundred of its places.
    """
    frequent, totals = frequent_phrases(docs, longest, least, lang_col, text_col, most_buckets)
    parts = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    candidates = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    # each way to cut, with the counts of both parts; parts of a frequent phrase are frequent
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", parts(1, F.col("cut")).alias("left"), parts(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    lefts = frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    judged = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    least_cut = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best")
    scored = judged.groupBy("lang", "phrase").agg(F.first("a").alias("a"), least_cut).select("lang", "phrase", "a", "best.*")
    # shorter candidates inside longer ones
    longer = candidates.where("k > 2").select("k", "lang", "a", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inside = longer.select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    covers = inside.groupBy("lang", parts(F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {percent} * a")
    # a language's phrases are ranked in parts first: the last task has at most ``top`` rows of each part, however many phrases or tasks there are
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first(first(kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part"), "lang")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_pcy_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two and three words of each language of ``documents``."""
    return collocations(source(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, i, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:i], ' ') AND l.k = i
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[i + 1:], ' ') AND r.k = c.k - i
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), covers AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, n, score
FROM best b JOIN n USING (lang) LEFT JOIN covers v ON v.lang = b.lang AND v.phrase = b.phrase
WHERE v.a IS NULL OR 100 * v.a < 50 * b.a
QUALIFY rank <= 2000
"""
