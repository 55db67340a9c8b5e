"""Words of whole texts as arrays of 64-bit hashes, a record batch at a time.

A word is a run of characters other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), A-Z lower-cased. Splitting and
dictionary encoding are Arrow's; only the distinct words of a slice are hashed. Slices are cut by bytes, so that memory
follows the longest text and not the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - 1).clip(0) // limit
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's words, the words); nulls have none."""
    texts = texts.fill_null("")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    kept = np.r_[0, np.cumsum(full)]
    return kept[offsets], flat.filter(pa.array(full))


@lru_cache(1)
def _byte_table() -> np.ndarray:
    """A random number for each byte value at each of 64 places."""
    return np.random.default_rng(0x1D5EED).integers(0, 1 << 64, (64, 256), dtype=np.uint64, endpoint=False)


def hash_strings(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process: its bytes' numbers by place, exclusive or, mixed with its length."""
    enc = words.dictionary_encode()
    uniq = enc.dictionary
    if not len(uniq):
        return np.zeros(0, np.uint64)
    _, offsets, data = uniq.buffers()
    offsets = np.frombuffer(offsets, np.int32)[uniq.offset : uniq.offset + len(uniq) + 1].astype(np.int64)
    octets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    lens = np.diff(offsets)
    place = np.arange(len(octets)) - np.repeat(offsets[:-1] - offsets[0], lens)
    value = _byte_table()[place & 63, octets]
    late = np.flatnonzero(place >= 64)  # places of long words repeat the table, each time mixed otherwise
    value[late] = mix(value[late] + (place[late] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.bitwise_xor.reduceat(value, offsets[:-1] - offsets[0])
    with np.errstate(over="ignore"):
        return mix(out + lens.astype(np.uint64))[enc.indices.to_numpy(zero_copy_only=False)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hash of each word)."""
    offsets, words = split_words(texts)
    return offsets, hash_strings(words)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position (the last n - 1 positions are left out)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix(out)


def shingles(offsets: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of each text's n-grams with repeats; a shorter text with words has one, its whole sequence."""
    lens = np.diff(offsets)
    grams = ngram_hashes(h, n)
    counts = np.where(lens >= n, lens - n + 1, (lens > 0).astype(np.int64))
    out_off = np.r_[0, np.cumsum(counts)]
    out = np.empty(out_off[-1], np.uint64)
    long = np.flatnonzero(lens >= n)
    if len(long):
        reps = counts[long]
        within = np.arange(reps.sum()) - np.repeat(np.r_[0, np.cumsum(reps)[:-1]], reps)
        out[np.repeat(out_off[:-1][long], reps) + within] = grams[np.repeat(offsets[:-1][long], reps) + within]
    for i in np.flatnonzero((lens > 0) & (lens < n)):
        out[out_off[i]] = ngram_hashes(h[offsets[i] : offsets[i + 1]], int(lens[i]))[0]
    return out_off, out


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as int64, as Spark stores them."""
    return x.view(np.int64)
