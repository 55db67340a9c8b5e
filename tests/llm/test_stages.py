"""The stages of the corpus pipeline on odd tables, and the whole pipeline against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_near_dedup import brute

from inkspark.llm import bloom, decontaminate, near_dedup, packing, substring_dedup, toxicity
from inkspark.llm.words import word_hashes

HELPERS = ["_id", "_key", "__key", "block", "w0", "__block", "__w0", "_maybe", "__maybe", "spans", "__spans", "__theirs", "key", "leader"]
KINDS = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in HELPERS)


def make(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def odd(spark, rows):
    return spark.createDataFrame([(i, t, *HELPERS) for i, t in rows], KINDS)


@pytest.mark.parametrize("limit", [bloom.BROADCAST_BYTES, 1])
def test_stages_keep_columns_whatever_their_names(spark, monkeypatch, limit):
    """With small keys broadcast, and with a limit that takes the way of large ones."""
    for module in (bloom, substring_dedup):
        monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
    rng = random.Random(1)
    passage, item = make(rng, 80), make(rng, 40)
    rows = [(i, " ".join(make(rng, 60))) for i in range(12)]
    rows += [(20, rows[0][1]), (21, " ".join(make(rng, 30) + passage)), (22, " ".join(passage + make(rng, 30))), (23, " ".join(make(rng, 20) + item))]
    rows += [(None, rows[1][1]), (30, None), (31, " \n"), (9, rows[9][1])]
    docs = odd(spark, rows)
    items = spark.createDataFrame([(1, " ".join(item), "x")], "item_id long, text string, block string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)], "doc_id long, toxic int, block string")

    def kept(out):
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r)[2:] == tuple(HELPERS) for r in got)
        return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got)

    want = lambda drop: sorted((i is None, i or 0, t or "") for i, t in rows if i not in drop)
    assert kept(near_dedup.without_near_duplicates(docs)) == want({20})
    assert kept(decontaminate.without_leaks(docs, items)) == want({23})
    cut = [(i, " ".join(t.split()[80:]) if i == 22 else t) for i, t in rows]
    cut = [(i, None) if i in (20,) else (i, t) for i, t in cut]  # a whole copy goes
    got = kept(substring_dedup.without_passages(docs))
    assert got == sorted((i is None, i or 0, t or "") for i, t in cut if i != 20)
    assert len(kept(toxicity.without_toxic(docs, labels))) <= len(rows)


def test_rows_of_one_id_keep_their_own_text(spark):
    rng = random.Random(2)
    passage = make(rng, 80)
    alone = " ".join(make(rng, 200))
    rows = [(1, " ".join(make(rng, 50) + passage)), (2, " ".join(passage + make(rng, 40))), (2, alone), (2, alone), (3, " ".join(make(rng, 70)))]
    out = sorted((r.doc_id, r.text) for r in substring_dedup.without_passages(odd(spark, rows)).collect())
    assert out == sorted([rows[0], (2, " ".join(rows[1][1].split()[80:])), (2, alone), (2, alone), rows[4]])
    found = substring_dedup.repeated_passages(odd(spark, rows)).collect()
    assert {(r.doc_id, r.source_doc_id, r.passage_end - r.passage_start) for r in found} == {(2, 1, 80)}
    assert sorted(r.doc_id for r in near_dedup.without_near_duplicates(odd(spark, rows)).collect()) == [1, 2, 2, 2, 3]


def test_very_long_texts(spark):
    rng = random.Random(3)
    passage = make(rng, 70)
    rows = [(1, " ".join(make(rng, 60_000) + passage)), (2, " ".join(passage + make(rng, 60_000))), (3, "x" * 300_000), (4, "a " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.passage_start, r.passage_end) for r in substring_dedup.repeated_passages(docs).collect()} == {(2, 0, 70)}
    assert sorted(r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()) == [1, 2, 3, 4]
    items = spark.createDataFrame([(7, " ".join(passage[:40]))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(1, 7), (2, 7)}


def test_the_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(30_000)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(30)) + ". " + " ".join(words(8)) + ".") for i in range(6)]
    rows, toxic = [], {}
    for i in range(160):
        text = words(rng.randint(5, 120))
        if i % 8 == 3:
            text += ["awful", "curse", "insult", "vile"] * 3
        if i < 120:
            toxic[i] = int(i % 8 == 3)
        rows.append((i, " ".join(text)))
    for i in range(10):  # near copies: an edit of one word in a hundred
        text = words(120)
        rows.append((200 + 2 * i, " ".join(text)))
        text[60] = "edited"
        rows.append((201 + 2 * i, " ".join(text)))
    passage = words(66)
    for i in range(8):
        rows.append((300 + i, " ".join(words(40) + passage + words(50))))
    for i, text in items:
        rows.append((400 + i, " ".join(words(50) + text.split() + words(60))))
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, " ".join(words(30))), (7, rows[7][1]), (503, "word " * 30_000)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, block string, _id long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "b", 5) for i, t in rows], kinds)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(sorted(toxic.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # toxicity: the scores are a model's, the decision is plain
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    bad = {r.doc_id for r in scored if r.score >= 0.7}
    assert {i for i in range(160) if i % 8 == 3} <= bad and not bad - set(range(160))
    left = [(i, t) for i, t in rows if i not in bad]
    # near duplicates: all pairs of shingle sets
    group = brute([(i, t) for i, t in left if i is not None], 5, 80)
    left = [(i, t) for i, t in left if i is None or group[i] == i]
    # passages: the planted one, in all but its first document; a text of which nothing is left goes
    first = min(i for i, t in left if i is not None and " ".join(passage) in (t or ""))
    left = [(i, t.replace(" ".join(passage) + " ", "") if t and i != first else t) for i, t in left]
    # benchmark items: every item at every place
    latent, weight = decontaminate.latent_space(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    asked = [decontaminate._item(k, t, None, latent, weight) for k, t in items]

    def leaks(text):
        h = word_hashes(pa.array([text or ""]))[1]
        return any(decontaminate.judged(q, h[a : a + 3 * len(q.words)])[0] for q in asked for a in range(0, max(1, len(h)), 10))

    left = [(i, t) for i, t in left if i is None or not leaks(t)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append(r.n_tokens)
    want = {}
    for i, t in left:
        want.setdefault(i, []).append(len((t or "").split()))
    assert {i: sum(v) for i, v in tokens.items()} == {i: sum(v) for i, v in want.items()}
    # packing: one item at a time into the fullest sequence that has room
    bins = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_capacity))
    for b in bins.values():
        b.sort()
        assert all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= b[0][2] and b[0][0] == 0


def test_best_fit_is_as_good_as_one_item_at_a_time():
    rng = np.random.default_rng(6)
    for top in (400, 3000, 4096):
        lengths = sorted(rng.integers(1, top, 600).tolist() + [7] * 60 + [512] * 9, reverse=True)
        counts = {}
        for n in lengths:
            counts[n] = counts.get(n, 0) + 1
        left, rooms = dict(counts), []
        for n in lengths:
            left[n] -= 1
            fits = [i for i, (room, _) in enumerate(rooms) if room >= n]
            if fits:
                i = min(fits, key=lambda i: rooms[i][0])
                rooms[i] = (rooms[i][0] - n, rooms[i][1] + n)
                continue
            some = {k: v for k, v in left.items() if v}
            cost = lambda s: ((s + packing.OVERHEAD) / (n + packing._filled(s - n, sorted(some), some)), s)  # noqa: B023, E731
            size = min((s for s in packing.CAPACITIES if s >= n), key=cost)
            rooms.append((size - n, n))
        one = sum(min(c for c in packing.CAPACITIES if c >= used) for _, used in rooms)
        ours = sum(g.bins * (g.room + sum(a * b for a, b in g.placed)) for g in packing.best_fit(counts))
        print("\ncapacity", ours, "one at a time", one, "items", sum(lengths))
        assert ours <= 1.02 * one


def test_packing_of_ties_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    rows = [(i % 5, "w " * 300) for i in range(200)]
    got = packing.pack(odd(spark, rows), packing.word_count(F.col("text"))).collect()
    assert len(got) == 200 and len({(r.bin_id, r.bin_offset) for r in got}) == 200
