import re

import numpy as np
import pyarrow as pa

from inkspark.llm.words import ngram_hashes, shingles, slices, split_words, word_hashes

TEXTS = ["  Ab cD\tef\n", "", None, "x", "É ß y z\x0bw", "a b c d e f", "a b c"]


def test_words_are_runs_without_ascii_white_space():
    offsets, words = split_words(pa.array(TEXTS, pa.string()))
    got = [words.to_pylist()[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in TEXTS]


def test_sliced_arrays_keep_their_words():
    arr = pa.array(TEXTS, pa.string())
    whole_off, whole = word_hashes(arr)
    off, part = word_hashes(arr.slice(4, 3))
    assert np.array_equal(part, whole[whole_off[4] :])
    assert np.array_equal(off, whole_off[4:] - whole_off[4])


def test_shingles_of_short_and_long_texts():
    off, h = word_hashes(pa.array(["a b", "a b c d", "", "a b c"], pa.string()))
    s_off, s = shingles(off, h, 3)
    assert np.diff(s_off).tolist() == [1, 2, 0, 1]
    assert s[1] == s[3] == ngram_hashes(h[2:5], 3)[0]
    assert s[0] not in s[1:]


def test_slices_cover_the_batch_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7 % 40) for i in range(50)])], names=["doc_id", "text"])
    parts = list(slices(batch, "text", 60))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(50))
    assert len(parts) > 5
    assert not list(slices(batch.slice(0, 0), "text"))
