"""Phrases, vectors and importance resampling against brute force, SQL and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkspark.llm import flat_graph, importance, phrases, vector_dedup
from inkspark.llm.byte_words import byte_classes, byte_words, runs

DOCS = "doc_id long, text string, lang string, score string, rank string, word string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_byte_words_equal_the_pattern():
    rng = random.Random(5)
    texts = [None, "", " ", *("".join(rng.choice("aB9 .,\t\né한\x0b\x00|") for _ in range(rng.randint(0, 60))) for _ in range(300))]
    owner, piece, words = byte_words(pa.array(texts), phrases.CLASSES)
    got = list(zip(owner.tolist(), words.to_pylist()))
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", lowered(t))]
    pieces = Counter(zip(owner.tolist(), piece.tolist()))
    assert sorted(pieces.values()) == sorted(len(re.findall(r"[^\x20\x09]+", p)) for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t)) if re.search(r"[^\x20\x09]", p))
    two, joined = runs(owner, words, 2)
    assert joined.to_pylist() == [f"{a[1]} {b[1]}" for a, b in zip(got, got[1:]) if a[0] == b[0]] and len(two) == len(joined)
    sliced = pa.array(["xx yy", *texts]).slice(1)
    assert byte_words(sliced, phrases.CLASSES)[2].to_pylist() == words.to_pylist()


# phrases


def brute_phrases(rows, longest, least, percent, top):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in candidates.items():
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = (c for q, c in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * c >= percent * a for c in inside):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top", [(3, 3, 2000), (4, 2, 15), (2, 300, 5)])
def test_phrases_equal_brute_force(spark, longest, least, top):
    rng = random.Random(longest)
    words = ["The", "of", "Ænd", "x|", "new", "york", "city", "한글", "a\x00b", " q"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    rows = [("".join(sentence() + rng.choice([".", ", ", "\n", "\t", " new york city "]) for _ in range(rng.randint(1, 8))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" ,. ", "xx"), ("of " * 5000, "en"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i // 2, t, g, "s", "r", "w") for i, (t, g) in enumerate(rows)], DOCS).repartition(5)
    for most in (1 << 16, 1 << 26):
        got = phrases.collocations(docs, longest, least, 50, top, most_buckets=most)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, longest, least, 50, top)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None, None, None, None, None)], DOCS)).count() == 0


def test_buckets_only_prune(monkeypatch):
    assert phrases.bucket_count(0, 1 << 26) == 1 << 16
    assert phrases.bucket_count(1 << 50, 1 << 26) == 1 << 26
    counted = np.zeros(phrases.BLOCK, np.uint8)
    for _ in range(30):
        phrases._add(counted, np.array([3, 9]), np.array([1, 400]), 25)
    assert counted[3] == counted[9] == 25 and counted.sum() == 50


# vectors


def brute_vectors(rows, least=0.9):
    good = [i for i, (key, v) in enumerate(rows) if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    units = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    units = {i: v / np.sqrt(v @ v) for i, v in units.items()}
    links, group = Counter(), {i: i for i in good}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in good:
        for b in good:
            if a < b:
                near = len(units[a]) == len(units[b]) and units[a] @ units[b] >= least
                links.update([a, b] if near else [])
                if near or rows[a][0] == rows[b][0]:
                    group[find(a)] = find(b)
    smallest = {}
    for i in good:
        smallest[find(i)] = min(rows[i][0], smallest.get(find(i), rows[i][0]))
    out = []
    for i, (key, _) in enumerate(rows):
        component = smallest[find(i)] if i in group else key
        out.append((key, links[i], component, key is None or key == component))
    return sorted(out, key=repr)


def odd_vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(260, 16))
    crowd = base[0] + rng.normal(size=(150, 16)) * 0.12 * np.linalg.norm(base[0]) / 4  # a crowd wider than a ball
    chain = [np.cos(t) * np.eye(16)[1] + np.sin(t) * np.eye(16)[2] for t in np.arange(0, 3, 0.3)]  # links without a common ball
    near = base[20:120] + rng.normal(size=(100, 16)) * rng.uniform(0.05, 0.6, (100, 1))
    vectors = [*base, *crowd, *chain, *near, *base[:30], *(3.5 * base[:5])]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [math.nan] * 16), (904, [None] * 16), (905, [math.inf] * 16), (None, base[0].tolist())]
    rows += [(906, [1e-200] * 16), (907, [1e200] * 16), (908, [2.0] * 5), (909, [4.0] * 5), (910, [1.0])]
    return rows + [(5, base[5].tolist()), (6, base[200].tolist()), (911, base[201].tolist())]


def test_vectors_equal_brute_force(spark, monkeypatch):
    rows = odd_vectors()
    table = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, node string, radius double").repartition(3)
    want = brute_vectors(rows)
    assert sorted((tuple(r) for r in vector_dedup.near_vectors(table).collect()), key=repr) == want
    for name, value in (("BLOCK", 60), ("SHARD", 50), ("PER_PIVOT", 40)):  # many small blocks
        monkeypatch.setattr(vector_dedup, name, value)
    assert sorted((tuple(r) for r in vector_dedup.near_vectors(table, overlap=2, recall=1.0).collect()), key=repr) == want
    kept = sorted((r.vec_id for r in vector_dedup.without_near_vectors(table).collect()), key=repr)
    assert kept == sorted((r[0] for r in want if r[3]), key=repr)


def test_vectors_of_nothing(spark):
    kind = "vec_id long, embedding array<float>"
    assert vector_dedup.near_vectors(spark.createDataFrame([], kind)).count() == 0
    assert [tuple(r) for r in vector_dedup.near_vectors(spark.createDataFrame([(1, None)], kind)).collect()] == [(1, 0, 1, True)]


def test_poor_recall_widens_the_search(spark, monkeypatch):
    rows = odd_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector_dedup, "PER_PIVOT", 10)
    seen, real = [], vector_dedup.audited
    monkeypatch.setattr(vector_dedup, "audited", lambda *a: seen.append(real(*a)) or seen[-1])
    got = vector_dedup.near_vectors(table, overlap=1, recall=1.01)  # never reached: every pivot's shard at last
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_vectors(rows)
    assert len(seen) > 2 and seen[-1] == 1.0 and seen[0] < 1.0


def test_graph_recall():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(1500, 32))
    unit[-500:] = unit[:500] + rng.normal(size=(500, 32)) * 0.3
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    small = unit.astype(np.float32)
    edges = flat_graph.build(small)
    assert edges.shape == (1500, flat_graph.DEGREE) and all(len(set(e[e >= 0])) == (e >= 0).sum() and i not in e for i, e in enumerate(edges))
    met, done = flat_graph.search(small, edges, flat_graph.medoid(small), small, flat_graph.BEAM, np.full((1500, 1500), 0.9, np.float32))
    true = unit @ unit.T >= 0.9
    assert (true & (met >= 0.9 - 1e-6)).sum() >= 0.99 * true.sum()
    assert done.sum(1).mean() < 300  # few of all nodes


# importance


def brute_importance(rows, target, longest, buckets, seed, least, percent):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(words) - k + 1))

    docs, wanted = [features(t) for _, t in rows], [features(t)[1] for t in target]
    s, t = sum((d[1] for d in docs), Counter()), sum(wanted, Counter())
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000.0 * math.log(float(t[b] + 1) * float(total_s + buckets) / (float(s[b] + 1) * float(total_t + buckets)))) for b in s}
    out = []
    for (key, _), (n, own) in zip(rows, docs):
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in own.items())
        out.append([key, sum(own.values()), n, weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((d for d in out if d[2] >= least), key=lambda d: (-d[4], d[0] is None, d[0] or 0))
    rank = {id(d): i + 1 for i, d in enumerate(order[: percent * len(order) // 100])}
    return sorted((tuple(d) + (rank.get(id(d)),) for d in out), key=repr)


@pytest.mark.parametrize("longest,buckets", [(1, 10000), (3, 50)])
def test_importance_equals_brute_force(spark, monkeypatch, longest, buckets):
    rng = random.Random(longest)
    words = ["Alpha", "béta", "gamma9", "한글", "delta", "x", "the"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(2, 7)]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "?!"), (None, "the x " * 20), (403, "the-x " * 30000), (7, rows[7][1]), (7, "other words " * 30), (8, rows[8][1]), (-9, "the x " * 20)]
    target = ["Alpha gamma9, delta", None, "", "한글 x x"]
    docs = spark.createDataFrame([(i, t, None, "a", "b", "c") for i, t in rows], DOCS).repartition(4)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    monkeypatch.setattr(importance, "SLICE_BYTES", 2000)
    got = importance.resample(docs, aim, 30, 20, longest, buckets, 77)
    want = brute_importance(rows, target, longest, buckets, 77, 20, 30)
    ranks = lambda found: sorted((r[-1] for r in found if r[-1]), key=repr)
    plain = [tuple(r) for r in got.collect()]
    # two equal rows of one id may change places
    assert sorted((r[:-1] for r in plain), key=repr) == sorted((r[:-1] for r in want), key=repr) and ranks(plain) == ranks(want)
    assert {(r[0], r[4], r[5]) for r in plain if r[0] != 7} == {(r[0], r[4], r[5]) for r in want if r[0] != 7}
    assert importance.drawn(docs, aim, 30, longest=longest, buckets=buckets, seed=77).count() == len(ranks(want))


def test_importance_of_nothing(spark):
    docs, aim = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20, None, None, None, None)], DOCS)
    assert importance.resample(docs, aim).count() == 0
    assert importance.resample(some, aim, percent=100).first().rank == 1
    assert byte_classes(b"a", b"b")[[97, 98, 99]].tolist() == [1, 2, 0]
