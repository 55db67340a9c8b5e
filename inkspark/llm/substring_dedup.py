"""Repeated passages across documents by seeds, collinear chaining and alignment.

1. Seeds: a share of ``DENSITY`` of the ``K``-word hashes, chosen by the hash alone so that edits nearby don't move them, and
   the minimizers over windows of ``W`` (an equal run of ``W + K - 1`` words always shares one). Minimizers of ``LONG`` words
   over windows of ``LONG_W`` join too: where earlier documents have a passage in many varying forms and split its short
   seeds, a long one leads to a document with the same ``LONG`` words (an equal run of ``LONG + LONG_W - 1`` always has one).
   Every seed is joined with the first document that has it, the smallest id, and not with every other: the number of
   matches follows the number of seeds, however many documents share a passage. A short seed carries four bits of the hash of each of
   the ``AROUND`` words on either side; a match counts where at least ``ALIKE`` of them agree, so that chance repeats of a
   few common words end at the join.
2. Chains: the matches of a document with one source are chained in order by dynamic programming with linear gap costs;
   a Fenwick tree over source positions gives each match its best predecessor. A single match is a chain too.
3. Alignment: only the words around a chain are fetched, for the document and for the source. Gaps between matches are
   aligned by longest common subsequences, the ends are extended until the score drops, and the longest parts of at least
   ``PIECE`` words and ``IDENTITY`` stay.
4. Passages: neighbouring pieces of a document, of whichever source, are merged; those of at least ``min_words`` are reported.

A word is a run of characters other than ASCII white space, A-Z lower-cased. Positions count words of the whole text.

Defined results: null, empty and short texts have no passages; the first document with a passage keeps it and isn't reported
for it; repeats inside one document aren't reported. A run that repeats (one word, or a few, over and over) is reported by the
fewest pieces of each source that cover it, not by one for every shift. Rows that share id and text count as one. Rows that share an id but not
the text are documents of their own (``keyed``): each is searched and cut by its own spans, reported under the shared id,
and may be the source of another; one of them comes in the order of ids, the others after all ids, by a hash. Rows with a
null id take no part and stay as they are. Other columns don't take part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.bloom import BROADCAST_BYTES, split_by_keys, unused, with_keys_of
from inkspark.llm.store import source, written
from inkspark.llm.words import shingles, signed, slices, word_hashes

K, W = 5, 16
LONG, LONG_W = 16, 32
DENSITY = 0.25
AROUND, ALIKE = 4, 3
GAP_COST = 0.2
EDGE, EDGE_OF_ONE, GRID = 128, 64, 32  # words fetched beyond a chain; a chain of one match has other seeds nearby if it goes on
PIECE, IDENTITY = 15, 0.8
MERGE_GAP = 4
STEP = 8
MIN_WORDS = 50

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def minimizers(offsets: np.ndarray, grams: np.ndarray, w: int) -> np.ndarray:
    """Places (into ``grams``) of the smallest hash of some window of ``w``; runs of one hash count once."""
    lens = np.diff(offsets)
    some = np.flatnonzero(lens)
    if not len(some):
        return np.zeros(0, np.int64)
    big = np.iinfo(np.uint64).max
    shift = np.repeat(np.arange(len(lens)) * w, lens)  # a gap of w places after every text
    at = np.arange(len(grams)) + shift
    line = np.full(len(grams) + len(lens) * w + w, big, np.uint64)
    line[at] = grams

    def sliding(x: np.ndarray, op) -> np.ndarray:
        span, out = 1, x
        while span < w:
            step = min(span, w - span)
            out = op(out[: len(out) - step], out[step:])
            span += step
        return out

    low = sliding(line, np.minimum)  # low[j]: of line[j : j + w]
    begin, end = offsets[:-1] + np.arange(len(lens)) * w, offsets[1:] + np.arange(len(lens)) * w
    valid = np.zeros(len(low) + 1, np.int64)
    last = np.maximum(begin + 1, end - w + 1)  # a short text has one window
    np.add.at(valid, begin[some], 1)
    np.add.at(valid, last[some], -1)
    low = np.where(np.cumsum(valid)[: len(low)] > 0, low, 0)
    high = sliding(np.r_[np.zeros(w - 1, np.uint64), low, np.zeros(w, np.uint64)], np.maximum)  # high[i]: of low[i - w + 1 : i + 1]
    chosen = high[at] == grams
    again = np.r_[False, (grams[1:] == grams[:-1]) & (np.diff(shift) == 0)]
    return np.flatnonzero(chosen & ~again)


def _around(offsets: np.ndarray, h: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Four bits of each of the words before and after the ``K`` words at ``at``, 0 beyond the text's ends."""
    out, bits = np.zeros(len(at), np.uint32), (h >> np.uint64(60)).astype(np.uint32)
    for i, d in enumerate([*range(-AROUND, 0), *range(K, K + AROUND)]):
        inside = (at + d >= offsets[owner]) & (at + d < offsets[owner + 1])
        out[inside] |= bits[at[inside] + d] << np.uint32(4 * i)
    return out


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, doc_id, place, first): ``place`` is the position over the bits of the words around, ``first`` the first in its text."""
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, h = word_hashes(batch.column("text"))
            for k, w in ((K, W), (LONG, LONG_W)):
                long = np.diff(offsets) >= k
                off, grams = shingles(offsets, h, k)
                place = minimizers(off, grams, w)
                if k == K:
                    place = np.union1d(place, np.flatnonzero(grams < np.uint64(DENSITY * 2**64)))
                owner = np.searchsorted(off, place, side="right") - 1
                place, owner = place[long[owner]], owner[long[owner]]
                value = grams[place]
                order = np.lexsort((place, value, owner))
                first = np.zeros(len(place), bool)
                if len(place):
                    v, o = value[order], owner[order]
                    first[order] = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])]
                ids, pos = batch.column("doc_id").take(pa.array(owner)), place - off[owner]
                near = _around(offsets, h, offsets[owner] + pos, owner).astype(np.int64) if k == K else 0  # equal words need no proof
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), ids, pa.array((pos << 32) | near), pa.array(first)], names=["hash", "doc_id", "place", "first"])


def chains(pos: np.ndarray, src: np.ndarray) -> list[np.ndarray]:
    """Disjoint collinear chains over the matches (pos, src), best first; each is an array of match numbers in order.

    The score of a chain is K for each match less GAP_COST for each word skipped on either side. Matches are taken by
    position; a Fenwick tree holds the best ``score + GAP_COST * (pos + src)`` up to each source position.
    """
    n = len(pos)
    order = np.lexsort((-src, pos))
    rank = np.searchsorted(np.unique(src), src) + 1
    size = int(rank.max()) + 1
    tree, who = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    p, s, rk = pos.tolist(), src.tolist(), rank.tolist()
    waiting: list[int] = []
    here = None
    for i in order.tolist():
        if p[i] != here:  # matches at one position don't follow each other
            for j in waiting:
                value, r = score[j] + GAP_COST * (p[j] + s[j]), rk[j]
                while r <= size:
                    if value > tree[r]:
                        tree[r], who[r] = value, j
                    r += r & -r
            waiting, here = [], p[i]
        best, from_, r = float("-inf"), -1, rk[i] - 1
        while r:
            if tree[r] > best:
                best, from_ = tree[r], who[r]
            r -= r & -r
        gained = best - GAP_COST * (p[i] + s[i] - 2 * K) if from_ >= 0 else 0.0
        # overlapping matches add only the words that they don't share
        fresh = min(K, p[i] - p[from_], s[i] - s[from_]) if from_ >= 0 else K
        if from_ >= 0:
            gained -= 2 * GAP_COST * max(0, K - fresh)
        score[i] = float(K)
        if gained + fresh > K:
            score[i], back[i] = gained + fresh, from_
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda j: (-score[j], p[j], s[j])):
        if used[i]:
            continue
        path, j = [], i
        while j >= 0 and not used[j]:
            path.append(j)
            used[j] = True
            j = back[j]
        out.append(np.array(path[::-1]))
    return out


_CHAINS = "doc_id long, src_id long, src_lo int, src_hi int, paths array<struct<pos:array<int>,src:array<int>>>"


def _thinned(paths: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The chains without most of the single matches of a run that repeats within ``STEP`` words: they lead from near places of the document to one
    place of the source, and the first, the last and one in ``STEP`` words between reach as far together."""
    out = [p for p in paths if len(p[0]) > 1]
    single: dict[int, list[int]] = {}
    for pos, src in paths:
        if len(pos) == 1:
            single.setdefault(int(src[0]), []).append(int(pos[0]))
    for src, places in single.items():
        places.sort()
        last = None
        for at, after in zip(places, [*places[1:], None]):
            if last is None or after is None or after - last > STEP:
                out.append((np.array([at]), np.array([src])))
                last = at
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of each document and source by the range of source words that they need."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("pos", pa.list_(pa.int32())), ("src", pa.list_(pa.int32()))]))]
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "src_id", "src_lo", "src_hi", "paths")}
        docs, srcs = batch.column("doc_id").to_pylist(), batch.column("src_id").to_pylist()
        pos, src = batch.column("pos"), batch.column("src")
        for i in range(batch.num_rows):
            a, b = pos[i].values.to_numpy().astype(np.int64), src[i].values.to_numpy().astype(np.int64)
            by_range: dict[tuple[int, int], list] = {}
            for path in chains(a, b):
                edge = EDGE_OF_ONE if len(path) == 1 else EDGE
                lo, hi = max(0, (int(b[path].min()) - edge) // GRID * GRID), -(-(int(b[path].max()) + K + edge) // GRID) * GRID
                by_range.setdefault((lo, hi), []).append((a[path], b[path]))
            for (lo, hi), paths in by_range.items():
                for k, v in zip(out, (docs[i], srcs[i], lo, hi, [{"pos": x.astype(np.int32), "src": y.astype(np.int32)} for x, y in _thinned(paths)])):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def _short(h: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash, enough to align two texts."""
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each asked range of a text: rows (src_id, src_lo, src_hi, src_words)."""
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, h = word_hashes(batch.column("text"))
            h = _short(h)
            ids, asked = batch.column("src_id").to_pylist(), batch.column("ranges").to_pylist()
            out: dict[str, list] = {k: [] for k in ("src_id", "src_lo", "src_hi", "src_words")}
            for i, ranges in enumerate(asked):
                a, b = offsets[i], offsets[i + 1]
                for r in ranges:
                    for k, v in zip(out, (ids[i], r["lo"], r["hi"], h[min(b, a + r["lo"]) : min(b, a + r["hi"])])):
                        out[k].append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of a longest common subsequence."""
    rows = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        rows[i + 1, 1:] = np.maximum(rows[i, 1:], rows[i, :-1] + (b == x))
        np.maximum.accumulate(rows[i + 1], out=rows[i + 1])
    i, j, left, right = len(a), len(b), [], []
    while rows[i, j]:
        if rows[i - 1, j] == rows[i, j]:
            i -= 1
        elif rows[i, j - 1] == rows[i, j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
    return np.array(left[::-1], np.int64), np.array(right[::-1], np.int64)


def _extend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the words that match from the start of both on: a match counts 1, a mismatch -1, until 8 are lost."""
    n = min(len(a), len(b))
    if not n:
        return np.zeros(0, np.int64)
    same = a[:n] == b[:n]
    gain = np.cumsum(np.where(same, 1, -1))
    lost = np.flatnonzero(np.maximum.accumulate(np.maximum(gain, 0)) - gain > 8)
    gain = gain[: lost[0]] if len(lost) else gain
    if not len(gain) or gain.max() < 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(same[: len(gain) - int(gain[::-1].argmax())])  # the last of equal gains


def align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the words that match along a chain, both ascending."""
    x, y = int(pos[0]), int(src[0])
    back = _extend(a[:x][::-1], b[:y][::-1])[::-1]
    left, right = [x - 1 - back], [y - 1 - back]
    for p, s in zip(pos.tolist(), src.tolist()):
        if p > x or s > y:  # the gap before this match
            gap, other = a[x : max(x, p)], b[y : max(y, s)]
            if len(gap) == len(other):
                i = j = np.flatnonzero(gap == other)
            else:
                i, j = common(gap, other)
            left.append(x + i)
            right.append(y + j)
        fresh = min(p + K - max(x, p), s + K - max(y, s))
        if fresh > 0:
            left.append(p + K - fresh + np.arange(fresh))
            right.append(s + K - fresh + np.arange(fresh))
        x, y = max(x, p + K), max(y, s + K)
    more = _extend(a[x:], b[y:])
    return np.concatenate([*left, x + more]), np.concatenate([*right, y + more])


def parts(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, matching words) of the parts of an alignment that have ``PIECE`` words and ``IDENTITY``.

    The longest such part first, then those of what is left on either side of it.
    """
    out, todo = [], [(left, right)]
    while todo:
        x, y = todo.pop()
        n = len(x)
        if n < IDENTITY * PIECE:
            continue
        place = np.arange(n)
        # matches i to j have the share in x where ends[j] >= begins[i]; y is tried after
        ends, begins = place + 1 - IDENTITY * (x + 1), place - IDENTITY * x
        best, at = 0, None
        if n >= IDENTITY * max(x[-1] + 1 - x[0], y[-1] + 1 - y[0]):
            best, at = x[-1] + 1 - x[0], (0, n - 1)
        else:
            top = np.maximum.accumulate(ends[::-1])[::-1]  # of all ends from here on
            for i in range(n):
                if x[-1] + 1 - x[i] <= best:
                    break
                j = int(np.searchsorted(-top, -begins[i] + 1e-9, side="right")) - 1  # the last end that may do
                while j > i and not j - i + 1 >= IDENTITY * max(x[j] + 1 - x[i], y[j] + 1 - y[i]) - 1e-9:
                    j -= 1
                if j > i and x[j] + 1 - x[i] > best:
                    best, at = x[j] + 1 - x[i], (i, j)
        if at is None or best < PIECE:
            continue
        i, j = at
        out.append((int(x[i]), int(x[j]) + 1, int(y[i]), int(y[j]) + 1, j - i + 1))
        todo += [(x[:i], y[:i]), (x[j + 1 :], y[j + 1 :])]
    return out


_PIECE = ["doc_id", "src_id", "start_word", "end_word", "source_start", "source_end", "matched"]


def _covering(pieces: list[tuple]) -> list[tuple]:
    """The fewest pieces of one source that cover the same words of the document: a run that repeats aligns with the source at every shift."""
    left, kept, reach = sorted(set(pieces), key=lambda r: (r[2], -r[3])), [], -1
    at = 0
    while at < len(left):
        best = None
        if left[at][2] > reach:
            best, at = left[at], at + 1
        while at < len(left) and left[at][2] <= reach:
            if left[at][3] > (best[3] if best else reach):
                best = left[at]
            at += 1
        if best:
            kept.append(best)
            reach = best[3]
    return kept


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document from its text and its chains, which come with the source's words."""
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, h = word_hashes(batch.column("text"))
            h, out = _short(h), []
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("chains")
            for i in range(batch.num_rows):
                rows = lists[i].values
                field = {k: rows.field(k) for k in ("src_id", "src_lo", "src_words", "paths")}
                text = h[offsets[i] : offsets[i + 1]]
                found: dict[int, list[tuple]] = {}
                for j in range(len(rows)):
                    src, lo, theirs = field["src_id"][j].as_py(), field["src_lo"][j].as_py(), field["src_words"][j].values.to_numpy()
                    paths = field["paths"][j].values
                    for all_pos, all_src in zip(paths.field("pos"), paths.field("src")):
                        pos, at = all_pos.values.to_numpy().astype(np.int64), all_src.values.to_numpy().astype(np.int64)
                        # only the words that the source's range can reach
                        a, b = max(0, int(pos[0]) - 2 * EDGE), int(pos[-1]) + K + 2 * EDGE
                        for s, e, ss, se, m in parts(*align(text[a:b], theirs, pos - a, at - lo)):
                            found.setdefault(src, []).append((ids[i], src, s + a, e + a, ss + lo, se + lo, m))
                for pieces in found.values():
                    out += _covering(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(len(_PIECE))], names=_PIECE)


def ids_of_several_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(doc_id, the least hash of its texts) of the ids whose rows differ in their texts; None if there are none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash")).where("doc_id IS NOT NULL")
    hashes = rows.groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))
    found = written(hashes.where("least <> most").select("doc_id", "least"), "passage-ids-of-several")
    return None if found.isEmpty() else found


def keyed(docs: DataFrame, several: DataFrame | None, key: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the column ``key``, a number of each different id and text: the id, or a hash for its further texts."""
    rows = docs.withColumn(key, F.col(id_col).cast("long"))
    if several is None:
        return rows
    least = unused(rows, "least")
    several = several.select(F.col("doc_id").alias(key), F.col("least").alias(least))
    several = F.broadcast(several) if several.count() * 24 <= BROADCAST_BYTES else several
    text_hash = F.xxhash64(text_col)
    after_ids = F.call_function("shiftrightunsigned", F.xxhash64(key, text_hash), F.lit(2)).bitwiseOR(F.lit(1 << 62))
    further = F.col(least).isNotNull() & (text_hash != F.col(least))
    return rows.join(several, key, "left").withColumn(key, F.when(further, after_ids).otherwise(F.col(key))).drop(least)


def repeated_pieces(texts: DataFrame) -> DataFrame:
    """Aligned pieces of (doc_id, text) rows whose ids differ where their texts do: doc_id, src_id, start_word, end_word, source_start,
    source_end, matched."""
    seeds = texts.mapInArrow(_seeds, "hash long, doc_id long, place long, first boolean")
    lead = F.when(F.col("first"), F.col("doc_id"))
    firsts = (
        seeds.groupBy("hash")
        .agg(F.min(lead).alias("src_id"), F.min_by("place", lead).alias("src_place"), F.max("doc_id").alias("last"))
        .where("last > src_id")
        .select("hash", "src_id", "src_place")
    )
    firsts = written(firsts, "passage-firsts")  # both sides of the join are plain shuffles then: a hot seed's rows can be split
    differ = F.expr("(place ^ src_place) & 4294967295L")
    unlike = F.bit_count(F.expr("(d | shiftright(d, 1) | shiftright(d, 2) | shiftright(d, 3)) & 286331153L"))  # four-bit groups with a bit set
    matches = (
        seeds.select("hash", "doc_id", "place")
        .join(firsts, "hash")
        .where("doc_id <> src_id")
        .withColumn("d", differ)
        .where(unlike <= 2 * AROUND - ALIKE)
        .select("doc_id", "src_id", F.shiftright("place", 32).cast("int").alias("pos"), F.shiftright("src_place", 32).cast("int").alias("src"))
    )
    grouped = (
        matches.groupBy("doc_id", "src_id")
        .agg(F.collect_set(F.struct("pos", "src")).alias("m"))
        .select("doc_id", "src_id", F.col("m.pos").alias("pos"), F.col("m.src").alias("src"))
    )
    found = written(grouped.mapInArrow(_chained, _CHAINS), "passage-chains")

    # the words of the sources first: few documents, each range once
    ranges = found.groupBy("src_id").agg(F.collect_set(F.struct(F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi"))).alias("ranges"))
    ranges = written(ranges, "passage-ranges")
    source = with_keys_of(texts.withColumnRenamed("doc_id", "src_id"), ranges, "src_id", exact=False).join(ranges.hint("merge"), "src_id")
    source = source.groupBy("src_id").agg(F.min("text").alias("text"), F.first("ranges").alias("ranges"))  # repeated rows once
    theirs = written(source.mapInArrow(_cut, "src_id long, src_lo int, src_hi int, src_words array<int>"), "passage-words")
    # then each document with a chain, together with the words of its sources
    chained = (
        found.join(theirs.hint("merge"), ["src_id", "src_lo", "src_hi"])
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("src_id", "src_lo", "src_words", "paths")).alias("chains"))
    )
    ids = written(found.select("doc_id").distinct(), "passage-ids")
    near = with_keys_of(texts, ids, "doc_id", exact=False).groupBy("doc_id").agg(F.min("text").alias("text"))
    return near.join(chained.hint("merge"), "doc_id").mapInArrow(_aligned, ", ".join(f"{c} long" for c in _PIECE))


def _merged(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Passages of each document from its pieces: (doc_id, passage, from, to, piece)."""
    for batch in batches:
        out: list[tuple] = []
        for doc, pieces in zip(batch.column("doc_id").to_pylist(), batch.column("pieces").to_pylist()):
            pieces.sort(key=lambda r: (r["start_word"], r["end_word"], r["src_id"]))
            at, number = 0, 0
            while at < len(pieces):
                to, end = at + 1, pieces[at]["end_word"]
                while to < len(pieces) and pieces[to]["start_word"] <= end + MERGE_GAP:
                    end = max(end, pieces[to]["end_word"])
                    to += 1
                if end - pieces[at]["start_word"] >= min_words:
                    for r in pieces[at:to]:
                        out.append((doc, number, pieces[at]["start_word"], end, r["src_id"], r["start_word"], r["end_word"], r["source_start"], r["source_end"], r["matched"]))
                    number += 1
                at = to
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(len(_PASSAGE))], names=_PASSAGE)


_PASSAGE = ["doc_id", "passage", "passage_start", "passage_end", "source_doc_id", "start_word", "end_word", "source_start", "source_end", "matched_words"]


def _passages(docs: DataFrame, min_words: int, key: str, text_col: str) -> DataFrame:
    """Passages of documents named by ``key``."""
    pieces = repeated_pieces(docs.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL"))
    grouped = pieces.groupBy("doc_id").agg(F.collect_list(F.struct(*pieces.columns[1:])).alias("pieces"))
    return grouped.mapInArrow(partial(_merged, min_words=min_words), ", ".join(f"{c} long" for c in _PASSAGE))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per passage of at least ``min_words`` and source piece in it, for every document but the first that has it."""
    several, key = ids_of_several_texts(docs, id_col, text_col), unused(docs, "key")
    rows = keyed(docs, several, key, id_col, text_col)
    found = _passages(rows, min_words, key, text_col)
    if several is None:
        return found
    names = written(rows.where(F.col(key) != F.col(id_col).cast("long")).select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id")).distinct(), "passage-names")
    for c in ("doc_id", "source_doc_id"):
        found = found.join(names.withColumnsRenamed({"key": c, "id": "id_again"}), c, "left").withColumn(c, F.coalesce("id_again", c)).drop("id_again")
    return found.select(*_PASSAGE)


def _without_words(text: str, cuts: list[dict]) -> str:
    """The text without the words of the cuts, which don't overlap."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    parts, last = [], 0
    for start, end in sorted((c["passage_start"], c["passage_end"]) for c in cuts):
        parts.append(text[last : at[min(start, len(at) - 1)]])
        last = at[min(end, len(at) - 1)]
    return "".join([*parts, text[last:]])


def _removed(batches: Iterator[pa.RecordBatch], text_col: str, spans_col: str) -> Iterator[pa.RecordBatch]:
    """Rows with the words of their spans cut out of the text; a text of which nothing is left is dropped."""
    for batch in batches:
        spans, texts = batch.column(spans_col), batch.column(text_col)
        hit = pc.and_(pc.is_valid(spans), pc.is_valid(texts))
        if not pc.any(hit).as_py():
            yield batch.drop_columns([spans_col])
            continue
        new = [_without_words(t, c) for t, c in zip(texts.filter(hit).to_pylist(), spans.filter(hit).to_pylist())]
        left = np.ones(batch.num_rows, bool)
        left[np.flatnonzero(hit.to_numpy(zero_copy_only=False))] = [bool(_WORD.search(t)) for t in new]
        text = pc.replace_with_mask(texts, hit, pa.array(new, texts.type))
        yield batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), text).drop_columns([spans_col]).filter(pa.array(left))


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of all but their first document, and documents that were nothing else dropped."""
    key, spans_col = unused(docs, "key"), unused(docs, "spans")
    rows = keyed(docs, ids_of_several_texts(docs, id_col, text_col), key, id_col, text_col)
    found = _passages(rows, min_words, key, text_col)
    spans = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("passage_start", "passage_end")).alias(spans_col))
    spans = written(spans, "passage-spans")
    size = spans.agg(F.sum(48 + 24 * F.size(spans_col))).first()[0] or 0
    remove = partial(_removed, text_col=text_col, spans_col=spans_col)
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(spans), key, "left").drop(key).mapInArrow(remove, docs.schema)
    maybe, sure = split_by_keys(rows, spans, key)
    return sure.drop(key).unionByName(maybe.join(spans, key, "left").drop(key).mapInArrow(remove, docs.schema))


def op1_chained_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all of ``documents``."""
    return repeated_passages(source(spark, sf_dir, "documents"))
