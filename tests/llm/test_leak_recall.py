"""Recall of decontamination against the checks alone, on reworded copies of benchmark items."""

import random

import numpy as np
import pyarrow as pa

from inkspark.llm import decontaminate
from inkspark.llm.words import word_hashes

SF = "/root/testdata/sf0.01"


def test_reworded_items_equal_brute_force(spark):
    rng = random.Random(9)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [r.text.split() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    pool = [w for t in texts for w in t]
    run = lambda n: [pool[a := rng.randrange(len(pool) - n)], *pool[a + 1 : a + n]]
    rows, planted = [(i, " ".join(t)) for i, t in enumerate(texts)], []
    for r in items.collect():
        words = (r.text or "").split()
        for rate in (0.35, 0.4, 0.45) * 4:
            copy = [rng.choice(pool) if rng.random() < rate else w for w in words]
            planted.append((len(rows), r))
            rows.append((len(rows), " ".join(run(50) + copy + run(50))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    latent, weight = decontaminate.latent_space(docs, items)
    wanted = set()
    for i, r in planted:
        item = decontaminate._item(r.item_id, r.text, None, latent, weight)
        if item and len(item.words) >= decontaminate.SHORT and decontaminate.judged(item, word_hashes(pa.array([rows[i][1]]))[1])[0]:
            wanted.add((i, r.item_id))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    print("\nrecall", len(wanted & found), len(wanted), flush=True)
    assert len(wanted) >= 50 and len(wanted & found) >= 0.95 * len(wanted)


def test_a_decoy_of_the_same_words_hides_nothing(spark):
    """The words of the item in another order have a larger cosine than the item itself further on."""
    rng = random.Random(10)
    vocab = [f"t{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(36))) for i in range(8)]
    rows = [(i, " ".join(make(200))) for i in range(100)]
    for i, text in items:
        shuffled = text.split()
        rng.shuffle(shuffled)
        rows.append((200 + i, " ".join([*make(72), *shuffled, *make(75), *text.split(), *make(71)])))
        rows.append((300 + i, " ".join([*make(72), *shuffled, *make(75)])))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(200 + i, i) for i in range(8)}


def test_items_of_one_sentence_and_short_last_sentences(spark):
    rng = random.Random(11)
    vocab = [f"t{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(0, " ".join(make(40)) + "."), (1, " ".join(make(38)) + ". no.")]
    rows = [(i, " ".join(make(200)) + " no.") for i in range(60)]
    for i, text in items:  # a third of the words changed, but not the rarest ones, the last of equals being first
        words = text.split()
        for k in range(6, 38, 3):
            words[k] = rng.choice(vocab)
        rows.append((100 + i, " ".join([*make(50), *words, *make(50)])))
        rows.append((200 + i, " ".join([*make(50), *text.split()[:16], *make(50)])))  # too few words
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table).collect()}
    latent, weight = decontaminate.latent_space(docs, table)
    wanted = {
        (i, k)
        for i, text in rows
        for k, t in items
        if decontaminate.judged(decontaminate._item(k, t, None, latent, weight), word_hashes(pa.array([text]))[1])[0]
    }
    assert found == wanted and not any(d >= 200 for d, _ in found)


def test_the_latent_space_is_that_of_all_passages(spark):
    """Passages of 40 kinds, some of them a few times in thousands of documents: A'A has rank 40, and its roots must come out whole."""
    rng = random.Random(12)
    kinds = [" ".join(f"k{rng.randrange(400)}" for _ in range(30)) for _ in range(40)]
    texts = [kinds[min(39, int(rng.expovariate(0.2)))] for _ in range(6000)] + kinds
    rng.shuffle(texts)
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(0, "k1 k2 k3")], "item_id long, text string")
    latent, weight = decontaminate.latent_space(docs.repartition(7), items)
    a = np.zeros((len(texts) + 1, decontaminate.BUCKETS), np.float32)
    for i, text in enumerate([*texts, "k1 k2 k3"]):
        a[i, decontaminate._buckets(word_hashes(pa.array([text]))[1])] = 1
    df = a[:-1].sum(0)
    assert np.allclose(weight, np.log((1 + len(texts)) / (1 + df)) ** 2, rtol=1e-5)
    some = np.flatnonzero(a.any(0))
    a = a[:, some].astype(np.float64) * weight[some]
    values, vectors = np.linalg.eigh(a.T @ a)
    own = values > values[-1] * 1e-10
    assert own.sum() == 41
    wanted = vectors[:, own] * weight[some, None] * values[own] ** -0.25
    got, wanted = latent[some].astype(np.float64) @ latent[some].T, wanted @ wanted.T
    assert np.abs(got - wanted).max() < 0.01 * np.abs(wanted).max()


def test_every_word_of_the_documents_has_a_vector(spark):
    texts = [" ".join(f"d{i}x{k}" for k in range(4)) for i in range(5000)]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(0, "d1x1 d2x2")], "item_id long, text string")
    latent, _ = decontaminate.latent_space(docs, items)
    seen = np.unique(decontaminate._buckets(word_hashes(pa.array(texts))[1]))
    assert (np.abs(latent[seen]).max(axis=1) > 0).all()


def test_sums_by_bucket_equal_dense_products(spark):
    rng = random.Random(13)
    texts = [" ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(0, 200))) for _ in range(300)] + [None, "", "a", "a a a"]
    passages = decontaminate._passages(pa.record_batch({"text": pa.array(texts)}))
    cut = [w[a : a + decontaminate.SVD_WINDOW] for t in texts for w in [(t or "").split()] for a in range(0, len(w), decontaminate.SVD_WINDOW)]
    assert len(passages) == len(cut)
    dense = np.zeros((len(cut), decontaminate.BUCKETS))
    for i, words in enumerate(cut):
        dense[i, decontaminate._buckets(word_hashes(pa.array([" ".join(words)]))[1])] = 1
    y = np.random.default_rng(1).standard_normal((len(cut), 5))
    bucket, sums = decontaminate._bucket_sums(y, passages)
    assert dense.sum(0).max() > decontaminate.ROUNDS and sorted(bucket) == np.flatnonzero(dense.any(0)).tolist()
    assert np.allclose(sums, (dense.T @ y)[bucket])


def test_places_of_rarer_words_equal_a_plain_count(spark):
    rng = random.Random(14)
    vocab = [f"t{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    weight = np.random.default_rng(2).random(decontaminate.BUCKETS).astype(np.float32)
    latent = np.ones((decontaminate.BUCKETS, 4), np.float32)
    items = [decontaminate._item(i, " ".join(make(n)), None, latent, weight) for i, n in enumerate((3, 20, 36, 70))]
    words = np.unique(np.concatenate([i.rarer for i in items]))
    h = word_hashes(pa.array([" ".join(make(3000))]))[1]
    places = decontaminate._places(h, words)
    lo = np.arange(0, 2900, 7)
    seen = 0
    for item in items:
        hi = np.minimum(lo + 3 * len(item.words), len(h))
        got = decontaminate._possible(item, np.searchsorted(words, item.rarer).tolist(), places, lo, hi)
        wanted = [int(np.isin(h[a:b], item.rarer).sum()) >= item.least - item.others for a, b in zip(lo, hi)]
        assert got.tolist() == wanted
        seen += sum(wanted)
    assert 0 < seen < 4 * len(lo)
    none = decontaminate._places(h[:0], words)
    assert not decontaminate._possible(items[1], np.searchsorted(words, items[1].rarer).tolist(), none, np.zeros(1, int), np.zeros(1, int)).any()


def test_the_driver_gets_the_vectors_alone(spark, monkeypatch):
    """Not the sums that they are made of, which are larger by half and in double precision."""
    texts = [" ".join(f"d{i}x{k}" for k in range(4)) for i in range(5000)]
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(0, "d1x1 d2x2")], "item_id long, text string")
    sent, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda df: sent.append(to_arrow(df)) or sent[-1])
    latent, _ = decontaminate.latent_space(docs, items)
    seen = np.unique(decontaminate._buckets(word_hashes(pa.array(texts))[1]))
    assert latent.shape[1] == decontaminate.RANK and (np.abs(latent[seen]).max(axis=1) > 0).all()
    assert max(t.nbytes for t in sent) < len(seen) * (4 * decontaminate.RANK + 32)
