"""Recall of the passages of substring deduplication, against brute force over all ranges of each planted copy."""

import random

from inkspark.llm import substring_dedup


def acceptable(same, least=50):
    """Whether some range between two matching words has ``least`` words and ``IDENTITY``."""
    on = [i for i, s in enumerate(same) if s]
    return any(on[j] - on[i] + 1 >= least and j - i + 1 >= substring_dedup.IDENTITY * (on[j] - on[i] + 1) for i in range(len(on)) for j in range(len(on) - 1, i, -1))


def make(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def edited(rng, words, rate):
    return [f"e{rng.randrange(10**9)}" if rng.random() < rate else w for w in words]


def passages(spark, rows):
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: max(0, r.passage_end - r.passage_start) for r in found}


def test_edited_and_short_passages_equal_brute_force(spark):
    rng, rows, wanted = random.Random(7), [], {}
    for n in (51, 55, 60, 80):
        for rate in (0, 0.05, 0.1, 0.15):
            for _ in range(25):
                one = make(rng, n)
                other = edited(rng, one, rate)
                i = len(rows)
                rows.append((i, " ".join(make(rng, 90) + one + make(rng, 90))))
                rows.append((i + 1, " ".join(make(rng, 70) + other + make(rng, 70))))
                if acceptable([a == b for a, b in zip(one, other)]):
                    wanted.setdefault((n, rate), []).append(i + 1)
    got = passages(spark, rows)
    recall = {k: sum(i in got for i in v) / len(v) for k, v in wanted.items()}
    print(recall)
    assert all(r == 1 for (_, rate), r in recall.items() if not rate)
    assert all(r >= 0.9 for r in recall.values()), recall
    assert all(i % 2 for i in got) and max(got.values()) <= 84


def test_parts_of_an_alignment_with_a_bad_middle():
    import numpy as np

    places = np.r_[0:100, 200:300]  # 100 words, 100 others, 100 words
    assert sorted(substring_dedup.parts(places, places)) == [(0, 100, 0, 100, 100), (200, 300, 200, 300, 100)]


def test_exact_copies_are_found_among_many_varying_forms(spark):
    """Every short seed of the copied passage belongs to an earlier document that shares no more than a few words around it."""
    rng, rows, wanted = random.Random(8), [], set()
    for _ in range(12):
        one = make(rng, 64)
        for a in range(0, 58):  # each seven words of it somewhere before
            rows.append((len(rows), " ".join(make(rng, 30) + one[a : a + 7] + make(rng, 30))))
        for _ in range(2):
            rows.append((len(rows), " ".join(make(rng, 40) + one + make(rng, 40))))
        wanted.add(len(rows) - 1)
    got = passages(spark, rows)
    assert set(got) == wanted and min(got.values()) >= 62


def test_runs_that_repeat_give_few_rows(spark):
    """One word or a few over and over, in the source, in the document, or in both: rows follow the length over the source's, and all is covered."""
    rng = random.Random(9)
    period = " ".join(make(rng, 3))
    prose = make(rng, 60)
    texts = {
        1: "of " * 200, 2: "of " * 500, 3: "of " * 4000,  # the source is the shorter one
        10: f"{period} " * 400, 11: f"{period} " * 30, 12: f"{period} " * 900,  # and the longer one
        20: " ".join(prose), 21: " ".join(prose * 8),  # a source without repeats
        30: " ".join(make(rng, 60) * 6), 31: "x",
    }
    texts[31] = " ".join(texts[30].split()[:60])
    found = substring_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    by_doc = {i: [r for r in found if r.doc_id == i] for i in texts}
    assert not by_doc[1] and not by_doc[10] and not by_doc[20] and not by_doc[30]
    for i, most in ((2, 8), (3, 60), (11, 6), (12, 20), (21, 12), (31, 2)):
        n = len(texts[i].split())
        assert 0 < len(by_doc[i]) <= most, (i, len(by_doc[i]))
        covered = set()
        for r in by_doc[i]:
            covered |= set(range(r.start_word, r.end_word))
        assert len(covered) >= n - 4, (i, len(covered), n)
