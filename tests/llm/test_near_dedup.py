import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from inkspark.llm.components import components
from inkspark.llm.near_dedup import band_rows, near_duplicates, without_near_duplicates


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


def corpus(seed, n=60, copies=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    out = []
    for i in range(n):
        out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))))
    for _ in range(copies):  # a group around one text: 0 to 9 edits, so some are linked only over others
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += [out[3], out[3].upper(), "", None, "one", "ONE", "one two", out[-1] + " tail"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    rows = corpus(words)
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, class string")
    got = {r.doc_id: r for r in near_duplicates(df, words, percent).collect()}
    want = brute(rows, words, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_a_chain_of_edits_is_one_component(spark):
    rng = random.Random(5)
    w, rows = [f"v{rng.random()}" for _ in range(200)], []
    for i in range(30):
        rows.append((100 - i, " ".join(w)))
        for k in range(3):
            w[(i * 6 + k) % 200] = f"n{i}-{k}"
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows, 3, 85)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, " \n"), (2, "q r s t u v"), (5, "q r s t u v")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by[None] == {(None, True)} and by[1] == {(1, True)} and by[2] == {(1, False)} and by[5] == {(1, False)}
    assert by[3] == {(3, True)} and by[4] == {(4, True)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 3, 85).count() == 0


def test_the_kept_table_has_the_same_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "s"), (2, "a b c d e f g", "s"), (3, "other words here are six now", "s")], "doc_id long, text string, source string")
    out = without_near_duplicates(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_long_chains_connect(spark):
    edges = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 50 <> 49")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(c == (n // 50) * 50 for n, c in got.items()) and len(got) == 200


def test_band_rows_miss_few_pairs_at_the_threshold():
    assert band_rows(0.85) == 5 and band_rows(0.8) == 4
