"""Benchmark decontamination by latent semantic retrieval with subsequence and answer checks.

1. Counts: document frequencies of hashed words over all documents, added up per partition.
2. Latent space: randomised SVD of TF-IDF passages. A random test matrix W is pushed through A'A over the passages of all
   documents and benchmark items in one scan; every partition adds up its own part, and the parts of a bucket are added by group.
   With Y = A'A W, A'A is Y (W'Y)^-1 Y' (Nystrom), so that no second scan is needed. The driver diagonalises
   W'Y and Y'Y (``RANK + OVERSAMPLE`` squared); Y stays a table, and only the vectors are sent (``BUCKETS`` x ``RANK``).
3. Search: every document is cut into windows of the items' lengths, each a sum of its words' latent vectors, at steps of a
   quarter of a window or less. Windows whose cosine with an item of that length is at least ``COSINE`` are candidates.
   The items are a stated query set: up to ``ITEM_BLOCK`` of them are tried in one scan of the documents, and nothing is
   shuffled. Cosines exist for ``CELLS`` pairs of a window and an item at a time.
4. Checks: the longest common subsequence of the item and the words around the candidate. A share of ``VERBATIM`` is a leak; a
   share of ``PARAPHRASE`` is one if the answer is there too (the answer column; or else the item's last sentence, or its
   ``RARE`` rarest words where that is the whole item or shorter than three words). Every candidate window of a document
   and item is checked, in falling cosine, until one is a leak.

Words are runs of characters other than ASCII white space, A-Z lower-cased.

Defined results: null and empty texts and items give nothing; items of fewer than ``SHORT`` words must be there whole. Repeated rows
are reported once for an id and item, with the most common words; rows that share an id are searched each for itself.
Rows with a null id aren't reported. Other columns don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.bloom import unused, without_keys
from inkspark.llm.store import source, written
from inkspark.llm.words import slices, word_hashes

BUCKETS, RANK, OVERSAMPLE = 1 << 15, 64, 8
SVD_WINDOW, FIT_PARTS = 32, 256  # words of a passage; tasks of the fit, each of which sends BUCKETS rows or less
STEP = 4  # words to the smallest unit of a window
LENGTHS = (8, 12, 16, 24, 32, 48, 64)
COSINE = 0.5  # of recall 0.95 or more against brute force at 20 to 45% replaced words; the checks decide
VERBATIM, PARAPHRASE, SHORT, RARE = 0.75, 0.55, 8, 5
RARER = 0.7  # of an item's words; the rest may be anywhere
ITEM_BLOCK, CELLS = 20_000, 1 << 20
ROUNDS, GROUP, SUM_PARTS = 32, 64, 8  # of a bucket's passages added one by one; buckets whose parts are added together; tasks that turn the sums
TEXT_BYTES = 1 << 19  # of text at once: every word has a vector of RANK numbers in the search
SEED = 5


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros(BUCKETS, np.int64), 0
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, h = word_hashes(batch.column("text"))
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            bucket = _buckets(h)
            for a in range(0, batch.num_rows, 256):  # a table of 256 documents by bucket: a word counts once for each
                b = min(a + 256, batch.num_rows)
                part = slice(offsets[a], offsets[b])
                seen = np.zeros((b - a, BUCKETS), bool)
                seen[owner[part] - a, bucket[part]] = True
                counts += seen.sum(0)
            docs += batch.num_rows
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[counts[some], docs])], names=["bucket", "n"])


@lru_cache(1)
def _test_matrix() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, RANK + OVERSAMPLE)).astype(np.float32)


def _passages(batch: pa.RecordBatch) -> np.ndarray:
    """A row per passage: the buckets of its words, once each; the rest is ``BUCKETS``."""
    offsets, h = word_hashes(batch.column("text"))
    lens = np.diff(offsets)
    first = np.r_[0, np.cumsum(-(-lens // SVD_WINDOW))] * SVD_WINDOW
    out = np.full(first[-1], BUCKETS, np.uint16)
    out[np.repeat(first[:-1] - offsets[:-1], lens) + np.arange(len(h))] = _buckets(h)
    out = np.sort(out.reshape(-1, SVD_WINDOW), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = BUCKETS
    return out


def _sums(rows: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers of the ascending ``of``, the sum of the rows of each)."""
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return of[first], np.add.reduceat(rows, first, axis=0)


def _bucket_sums(y: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets of the passages, the sum of the rows ``y`` of the passages that have each)."""
    flat = passages.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[: np.count_nonzero(flat < BUCKETS)]
    bucket, row = flat[order], order // SVD_WINDOW
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    run = np.diff(np.r_[start, len(bucket)])
    by_run = np.argsort(-run, kind="stable")  # the first ROUNDS of each bucket at once, longest runs first; what is left of long runs at the end
    start, run = start[by_run], run[by_run]
    out = y[row[start]]
    for r in range(1, min(ROUNDS, int(run[0]))):
        n = np.searchsorted(-run, -r)
        out[:n] += y[row[start[:n] + r]]
    n = np.searchsorted(-run, -ROUNDS)
    if n:
        left = run[:n] - ROUNDS
        at = np.r_[0, np.cumsum(left)]
        places = np.arange(at[-1]) + np.repeat(start[:n] + ROUNDS - at[:-1], left)
        out[:n] += np.add.reduceat(y[row[places]], at[:-1], axis=0)
    return bucket[start], out


def _range_part(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This partition's part of A'(A W), a row per bucket that it has."""
    width = RANK + OVERSAMPLE
    test = np.vstack([_test_matrix() * idf[:, None], np.zeros((1, width), np.float32)])
    out, seen = np.zeros((BUCKETS, width), np.float32), np.zeros(BUCKETS, bool)
    for whole in batches:
        for batch in slices(whole, "text", TEXT_BYTES):
            passages = _passages(batch)
            if len(passages):
                y, of_word = test[passages[:, 0]], np.empty((len(passages), width), np.float32)
                for k in range(1, SVD_WINDOW):
                    y += np.take(test, passages[:, k], axis=0, out=of_word, mode="clip")  # in range; without a mode, take copies once more
                some, add = _bucket_sums(y, passages)
                out[some] += add
                seen[some] = True
    some = np.flatnonzero(seen)
    for a in range(0, len(some), 4096):
        part = some[a : a + 4096]
        sums = out[part] * idf[part, None]
        yield pa.RecordBatch.from_arrays([pa.array(part // GROUP), pa.array(part), pa.array([s.tobytes() for s in sums], pa.binary())], names=["part", "bucket", "sums"])


def _total(part: pa.Table) -> pa.Table:
    """Sums of the rows of each bucket over all partitions; ``GROUP`` buckets are a group."""
    bucket = part["bucket"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    sums = np.frombuffer(b"".join(part["sums"].to_pylist()), np.float32).reshape(-1, RANK + OVERSAMPLE)[order].astype(np.float64)
    some, added = _sums(sums, bucket[order])
    return pa.table({"bucket": pa.array(some), "sums": pa.array([s.tobytes() for s in added], pa.binary())})


def _of_sums(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows of Y)."""
    return batch.column("bucket").to_numpy(), np.frombuffer(b"".join(batch.column("sums").to_pylist())).reshape(-1, RANK + OVERSAMPLE)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This partition's parts of W'Y and Y'Y."""
    both = np.zeros((2, RANK + OVERSAMPLE, RANK + OVERSAMPLE))
    for batch in batches:
        bucket, y = _of_sums(batch)
        both += np.stack([_test_matrix()[bucket].astype(np.float64).T @ y, y.T @ y])
    yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["both"])


def _turned(batches: Iterator[pa.RecordBatch], turn: np.ndarray, idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Latent vectors of the buckets of this partition."""
    for batch in batches:
        bucket, y = _of_sums(batch)
        vectors = (y @ turn * idf[bucket, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["bucket", "vector"])


def latent_space(docs: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """((BUCKETS, RANK or fewer) latent vectors of the hashed words, scaled by their weights; the weights: squared inverse document frequencies)."""
    counts = docs.mapInArrow(_document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    total = int(n[bucket == -1].sum())
    df = np.zeros(BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = (np.log((1 + total) / (1 + df)) ** 2).astype(np.float32)
    texts = docs.select("text").union(items.select("text")).coalesce(FIT_PARTS)
    parts = texts.mapInArrow(partial(_range_part, idf=idf), "part long, bucket long, sums binary")
    y = written(parts.groupBy("part").applyInArrow(_total, "bucket long, sums binary"), "latent-sums").coalesce(SUM_PARTS)
    both = np.zeros((2, RANK + OVERSAMPLE, RANK + OVERSAMPLE))
    for row in y.mapInArrow(_products, "both binary").toArrow()["both"].to_pylist():
        both += np.frombuffer(row).reshape(both.shape)
    core, gram = both
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > max(values[-1] * 1e-5, 1e-12)  # fewer directions than columns: the others are rounding
    if not kept.any():
        return np.zeros((BUCKETS, 1), np.float32), idf
    root = vectors[:, kept] / np.sqrt(values[kept])  # A'A = (Y root)(Y root)'
    values, vectors = np.linalg.eigh(root.T @ gram @ root)
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    values = np.maximum(values, values[0] * 1e-9)
    turn = root @ vectors * values**-0.75  # to length 1, then by the root of the singular values: common words weigh less
    out = np.zeros((BUCKETS, len(values)), np.float32)
    for batch in y.mapInArrow(partial(_turned, turn=turn, idf=idf), "bucket long, vector binary").toArrow().to_batches(4096):
        out[batch.column("bucket").to_numpy()] = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(-1, len(values))
    return out, idf


@dataclass
class Item:
    """A benchmark item: its words, their latent vector in pieces of one window length, and its answer's words."""

    item_id: int
    words: np.ndarray
    answer: np.ndarray
    length: int
    pieces: np.ndarray
    distinct: frozenset[int]
    least: float  # words in common that a leak has at least
    rarer: np.ndarray  # all but the most frequent words, and how many places in the item the others take
    others: int


def _item(item_id: int, text: str | None, answer: str | None, latent: np.ndarray, weight: np.ndarray) -> Item | None:
    hashed = lambda t: word_hashes(pa.array([t], pa.string()))[1]
    words = hashed(text or "")
    if not len(words):
        return None
    if answer:
        found = hashed(answer)
    else:  # the last sentence stands for it, if it is one of several and not too short
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]
        found = hashed(sentences[-1])
        if len(sentences) < 2 or len(found) < 3:
            rare = np.argsort(-weight[_buckets(words)], kind="stable")[:RARE]
            found = words[np.sort(rare)]
    length = max((n for n in LENGTHS if n <= len(words)), default=LENGTHS[0])
    cuts = range(0, max(1, len(words) - length + 1), length)
    # a window is matched with the whole item where it is about as long, else with pieces of its length
    pieces = [words] if len(words) < 2 * length else [words[a : a + length] for a in cuts]
    vec = np.stack([latent[_buckets(p)].sum(0) for p in pieces])
    vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
    least = len(words) if len(words) < SHORT else PARAPHRASE * len(words)
    by_weight = np.argsort(-weight[_buckets(words)], kind="stable")
    rarer = np.unique(words[by_weight[: max(1, int(np.ceil(RARER * len(words))))]])
    return Item(item_id, words, found, length, vec, frozenset(words.tolist()), least, rarer, int((~np.isin(words, rarer)).sum()))


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(length of the longest common subsequence of a in b, end of it in b)."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1]), int(np.searchsorted(row, row[-1]))


def judged(item: Item, around: np.ndarray) -> tuple[bool, int, bool]:
    """(leak, words in common, answer found) of an item and the words around a candidate."""
    n = len(item.words)
    if len(item.distinct.intersection(around.tolist())) + n - len(item.distinct) < item.least:  # a bound of the common subsequence
        return False, 0, False
    common, _ = common_words(item.words, around)
    if n < SHORT:
        return common == n, common, common == n
    found = bool(common_words(item.answer, around)[0] >= 0.8 * len(item.answer)) if len(item.answer) else False
    return common >= VERBATIM * n or (common >= PARAPHRASE * n and found), common, found


@dataclass
class Places:
    """Where a slice has the items' rarer words: the places of word k of ``words`` are ``order[begin[k]:begin[k + 1]]``."""

    order: np.ndarray
    begin: np.ndarray


def _places(h: np.ndarray, words: np.ndarray) -> Places:
    code = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
    at = np.flatnonzero(words[code] == h) if len(words) else np.zeros(0, np.int64)
    code = code[at].astype(np.uint16 if len(words) < 1 << 16 else np.int64)
    return Places(at[np.argsort(code, kind="stable")], np.r_[0, np.cumsum(np.bincount(code, minlength=len(words)))])


def _possible(item: Item, rarer: list[int], places: Places, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the ranges [lo, hi) hold enough of the item's rarer words.

    A common subsequence has no more words than the range has places of the rarer ones, and all the others: ranges with fewer can't leak.
    ``rarer`` are their numbers in ``places``.
    """
    own = np.concatenate([places.order[places.begin[i] : places.begin[i + 1]] for i in rarer])
    own.sort()
    return np.searchsorted(own, hi) - np.searchsorted(own, lo) >= item.least - item.others


def _searched(batches: Iterator[pa.RecordBatch], items: list[Item], latent: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = np.vstack([latent, np.zeros((1, latent.shape[1]), np.float32)])
    by_length = []
    for length in LENGTHS:
        own = [k for k, i in enumerate(items) if i.length == length]
        if own:
            by_length.append((length, np.concatenate([items[k].pieces for k in own]).astype(np.float32), np.array([k for k in own for _ in items[k].pieces])))
    rarer_words = np.unique(np.concatenate([i.rarer for i in items])) if items else np.zeros(0, np.uint64)
    rarer = [np.searchsorted(rarer_words, i.rarer).tolist() for i in items]
    names = ["doc_id", "item_id", "cosine", "common_words", "item_words", "window_start", "answer_found"]
    for whole in batches:
        for batch in slices(whole, "text", TEXT_BYTES):
            offsets, h = word_hashes(batch.column("text"))
            lens = np.diff(offsets)
            units = -(-lens // STEP)
            unit_off = np.r_[0, np.cumsum(units)]
            place = np.repeat(unit_off[:-1] * STEP - offsets[:-1], lens) + np.arange(len(h))
            idx = np.full(unit_off[-1] * STEP, BUCKETS, np.int64)
            idx[place] = _buckets(h)
            run = np.zeros((unit_off[-1] + 1, latent.shape[1]), np.float32)
            sums = np.take(table, idx[0::STEP], axis=0, out=run[1:], mode="clip")  # in range; without a mode, take copies once more
            of_word = np.empty_like(sums)
            for k in range(1, STEP):
                sums += np.take(table, idx[k::STEP], axis=0, out=of_word, mode="clip")
            np.cumsum(sums, axis=0, out=sums)
            end_of = np.repeat(unit_off[1:], units)
            first_of = np.repeat(unit_off[:-1], units)
            hits = [np.zeros((4, 0))]  # document, item, cosine, first word
            for length, wanted, of in by_length:
                m, step = max(1, length // STEP), max(1, length // STEP // 4)
                start = np.arange(0, len(sums))
                start = start[((start - first_of) % step == 0) & ((start + m <= end_of) | (start == first_of) | (start + m - step < end_of))]
                many = max(64, CELLS // len(wanted))
                for at in range(0, len(start), many):
                    part = start[at : at + many]
                    v = np.take(run, np.minimum(part + m, end_of[part]), axis=0, mode="clip")
                    v -= np.take(run, part, axis=0, mode="clip")
                    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)
                    dots = v @ wanted.T
                    cell = np.flatnonzero(dots >= (COSINE * norm)[:, None])
                    if len(cell):
                        w, j = np.divmod(cell, len(wanted))
                        doc = np.searchsorted(unit_off, part[w], side="right") - 1
                        hits.append(np.stack([doc, of[j], dots.ravel()[cell] / norm[w], (part[w] - unit_off[doc]) * STEP]))
            doc, which, cosine, first = np.concatenate(hits, axis=1)
            doc, which, first = doc.astype(np.int64), which.astype(np.int64), first.astype(np.int64)
            order = np.argsort(which.astype(np.uint16) if len(items) < 1 << 16 else which, kind="stable")
            doc, which, cosine, first = doc[order], which[order], cosine[order], first[order]
            places = _places(h, rarer_words)
            begin = offsets[doc] + first
            out, ids, leaked = [], batch.column("doc_id").to_pylist(), set()
            cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)]):
                item, n = items[which[a]], len(items[which[a]].words)
                d, at = doc[a:b], begin[a:b]
                lo, hi = np.maximum(offsets[d], at - n), np.minimum(offsets[d + 1], at + item.length + n)
                some = np.flatnonzero(_possible(item, rarer[which[a]], places, lo, hi))
                for k in some[np.lexsort((first[a + some], -cosine[a + some], d[some]))].tolist():  # of a document in falling cosine
                    if (d[k], item.item_id) in leaked:
                        continue
                    leak, common, found = judged(item, h[lo[k] : hi[k]])
                    if leak:
                        leaked.add((d[k], item.item_id))
                        out.append((ids[d[k]], item.item_id, float(cosine[a + k]), common, n, int(first[a + k]), found))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None
) -> DataFrame:
    """A row per document and leaked item: doc_id, item_id, cosine, common_words, item_words, window_start, answer_found."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    asked = items.select(
        F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"), (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer")
    ).where("item_id IS NOT NULL AND text IS NOT NULL")
    asked = written(asked, "benchmark-items")
    latent, weight = latent_space(texts, asked)
    out = None
    # the stated query set, a block at a time: what a worker holds doesn't grow with it
    n_blocks = max(1, -(-asked.count() // ITEM_BLOCK))
    for k in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).orderBy("item_id").toArrow().to_pylist()
        block = [x for r in rows if (x := _item(r["item_id"], r["text"], r["answer"], latent, weight))]
        found = texts.mapInArrow(
            partial(_searched, items=block, latent=latent),
            "doc_id long, item_id long, cosine double, common_words long, item_words long, window_start long, answer_found boolean",
        )
        out = found if out is None else out.unionByName(found)
    rest = [c for c in out.columns if c not in ("doc_id", "item_id")]
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("common_words", "cosine", *[c for c in rest if c not in ("common_words", "cosine")])).alias("b"))
    return best.select("doc_id", "item_id", *[F.col("b")[c].alias(c) for c in rest])


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a leaked item; all their columns. Rows with a null id stay, and rows that share an id go together."""
    key = unused(docs, "key")
    bad = written(leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias(key)).distinct(), "leak-ids")
    return without_keys(docs.withColumn(key, F.col(id_col).cast("long")), bad, key).drop(key)


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all of ``documents``."""
    return leaks(source(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
