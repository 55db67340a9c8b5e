"""The corpus operators on small tables: brute force, and nulls, empty texts, repeats, empty tables and extra columns."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from compare import database, duck_rows, spark_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkspark.llm import decontaminate, html_text, packing, quality_rules, registry, sharding, substring_dedup, token_counts, toxicity, url_filter

SF = "/root/testdata/sf0.001"
ODD = [(1, "", "s", 0), (2, None, "s", 0), (3, " \n\t ", "s", 0), (None, "word", "s", 0), (4, "word", "s", 0), (4, "word", "s", 0), (5, "long " * 30_000, "s", 0)]
DOCS = "doc_id long, text string, source string, block long"


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE) - {"op7_hyperminhash_near_dedup"}))
def test_query_equals_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(database(SF), registry.ORACLE[name])


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Don't we'll they've I'RE 'tis ''s", "ÄÖ ﬁ İ Σς x²", "<|endoftext|> a<|startoftext|>b <|nothing|>", "日本語 テキスト 123,456.7", "é café", "a b c\x1cd", "", None, "x" * 5000, "🙂🙂!!!'s"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab'srevmtld 1é\n!<|>Ω") for _ in range(300)) for _ in range(60)]
    got = token_counts.token_counts(frame(spark, [(i, t, "s", 0) for i, t in enumerate(texts)]), path).collect()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_all_texts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got = token_counts.count_tokens(texts, path).tolist()
    assert got == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_long_and_look_alike_words_equal_the_library():
    import time

    path = public_tokenizers.path("word_bpe_49k.json")
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    rng = random.Random(7)
    words = [thue, thue.translate(str.maketrans("ab", "ba")), thue[:1024], thue[1024:2048], "ha" * 20_000, "x" * 50_000]
    words += ["".join(rng.choice(abc) for _ in range(n)) for abc in ("ab", "the in", "abcdefghijklmnopqrstuvwxyz", "é日a!") for n in (1, 2, 30, 3000)]
    got = token_counts.count_tokens(words, path).tolist()
    assert got == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)]
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.time()
    token_counts.count_tokens([long], path)
    assert time.time() - began < 10  # quadratic merging takes hours


def test_transducer_states_are_dropped_when_there_are_too_many(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    want = token_counts.count_tokens(words, path).tolist()
    token_counts.tokenizer.cache_clear()
    monkeypatch.setattr(token_counts, "STATES", 50)
    assert token_counts.count_tokens(words, path).tolist() == want
    token_counts.tokenizer.cache_clear()


def test_packing_holds_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([0, 1, 7, 300, 511, 513, 4096, 9000, rng.randint(1, 4096)]), "s", 0) for i in range(300)] + ODD[:6]
    placed = packing.pack(frame(spark, rows), packing.word_count(F.col("text"))).collect()
    assert sum(r.n_tokens for r in placed) == sum(len((t or "").split()) for _, t, *_ in rows)
    bins = {}
    for r in placed:
        if r.n_tokens:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.bin_id is None
    for group in bins.values():
        group.sort(key=lambda r: r.bin_offset)
        used = 0
        for r in group:
            assert r.bin_offset == used and r.bin_capacity == group[0].bin_capacity
            used += r.n_tokens
        assert group[0].bin_capacity == min(c for c in packing.CAPACITIES if c >= used)


def test_best_fit_of_counts_places_all():
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.random.default_rng(3).integers(1, 4096, 3000), return_counts=True))}
    groups = packing.best_fit(counts)
    found = {}
    for g in groups:
        for length, copies in g.placed:
            found[length] = found.get(length, 0) + g.bins * copies
    assert found == counts and all(g.room >= 0 for g in groups)
    waste = sum(g.bins * g.room for g in groups) / sum(k * v for k, v in counts.items())
    assert waste < 0.05


def test_shards_fit_their_limit(spark):
    rows = [(i, "x" * (50 + i % 90), "s", 0) for i in range(400)] + [(7, "same", "s", 0)] * 60 + ODD
    out = sharding.assign_shards(frame(spark, rows), 500).collect()
    assert len(out) == len(rows)
    sums = {}
    for r in out:
        k = (r.shard_depth, r.shard_prefix, r.page)
        n, b = sums.get(k, (0, 0))
        sums[k] = (n + 1, b + r.n_bytes)
    assert all(b <= 500 or n == 1 for n, b in sums.values())


def passages_corpus():
    rng = random.Random(4)
    make = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    common, rows = make(80), []
    for i in range(40):
        words = make(rng.randint(0, 200))
        if i % 4 == 1:
            copy = list(common)
            for k in rng.sample(range(80), 3):  # fuzzy copies
                copy[k] = "edit"
            at = rng.randint(0, len(words))
            words[at:at] = copy
        rows.append((i, " ".join(words), "s", 0))
    return rows + [(100, None, "s", 0), (101, "", "s", 0), (None, " ".join(common), "s", 0)]


def test_passages_are_found_in_all_but_the_first(spark):
    rows = passages_corpus()
    found = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in found} == {i for i in range(5, 40, 4)}
    assert all(70 <= r.passage_end - r.passage_start <= 90 for r in found)
    left = {r.doc_id: r.text for r in substring_dedup.without_passages(frame(spark, rows)).collect() if r.doc_id is not None}
    assert left[1] == rows[1][1] and all(len(left.get(i, "").split()) <= len(rows[i][1].split()) - 70 for i in range(5, 40, 4))
    assert left[0] == rows[0][1]


def test_chains_equal_quadratic_dynamic_programming():
    """The best chain's score equals that of trying every predecessor."""
    k, gap = substring_dedup.K, substring_dedup.GAP_COST
    rng = np.random.default_rng(5)

    def step(p, q, s, t):  # what a match at (q, t) adds after one at (p, s)
        fresh = min(k, q - p, t - s)
        return fresh - gap * (q - p + t - s - 2 * k) - 2 * gap * max(0, k - fresh)

    for _ in range(60):
        pos = np.sort(rng.integers(0, 300, 25))
        src = np.r_[pos[:15] + 7, rng.integers(0, 300, 10)]
        pairs = sorted(set(zip(pos.tolist(), src.tolist())))
        best = {}
        for q, t in pairs:
            best[q, t] = max([float(k), *(best[p, s] + step(p, q, s, t) for p, s in best if p < q and s < t)])
        a, b = np.array(pairs).T
        found = substring_dedup.chains(a, b)
        assert sorted(i for path in found for i in path.tolist()) == list(range(len(pairs)))
        for path in found:
            assert (np.diff(a[path]) > 0).all() and (np.diff(b[path]) > 0).all()
        first = found[0]
        score = k + sum(step(a[i], a[j], b[i], b[j]) for i, j in zip(first[:-1], first[1:]))
        assert abs(score - max(best.values())) < 1e-9


def test_leaks_are_found_verbatim_and_reworded(spark):
    rng = random.Random(6)
    vocab = [f"t{i}" for i in range(2000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(rng.choice([20, 30, 45])))) for i in range(12)]
    rows = [(i, " ".join(make(rng.randint(0, 300))), "s", 0) for i in range(120)]
    for i in range(12):
        words = items[i][1].split()
        if i % 2:
            for k in range(0, len(words) - 5, 6):  # one word in six changes
                words[k] = rng.choice(vocab)
        rows.append((200 + i, " ".join([*make(60), *words, *make(60)]), "s", 0))
    table = spark.createDataFrame(items + [(50, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows + ODD), table).collect()}
    assert got == {(200 + i, i) for i in range(12)}


def test_toxicity_on_held_out_labels(spark):
    rows = toxicity.op4_counterfactual_toxicity(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)


def test_toxicity_defined_results(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(frame(spark), labels).collect()
    assert len(out) == len(ODD) and {r.predicted for r in out} == {0}
    assert toxicity.swapped("The women sang") == "the men sang" and toxicity.swapped("no term") is None


def test_swap_penalty_shrinks_score_changes(spark):
    """Insults come more often with one group's terms; the penalty takes the terms' own weight away, the insults' stays."""
    rng = random.Random(9)
    filler = [f"word{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(600):
        bad = i % 2
        term = "women" if rng.random() < (0.8 if bad else 0.2) else "men"
        insult = [rng.choice(["vile", "scum", "filth"])] if bad and rng.random() < 0.7 else []
        body = rng.choices(filler, k=8) + insult
        rng.shuffle(body)
        rows.append((f"The {term}, {' '.join(body)}.", bad))
    table = spark.createDataFrame(rows, "text string, label int")
    models = [toxicity.fit(table, swap_weight=w) for w in (0.0, 1.0, 10.0)]
    tests = [f"the {t} " + " ".join(filler[:6]) for t in ("women", "men")]
    gaps = [abs(float(np.diff(toxicity.logits(tests, m))[0])) for m in models]
    print("\ngap of the log odds by swap weight", gaps)
    assert gaps[0] > 0.5 and gaps[1] < 0.5 * gaps[0] and gaps[2] < 0.2 * gaps[0]
    insulted = [toxicity.logits(["the men vile scum " + " ".join(filler[:6]), tests[1]], m) for m in models]
    assert all(a > b + 1 for a, b in insulted)


def test_toxicity_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(frame(spark, []), labels).count() == 0


def test_the_best_literal_equals_trying_all(spark):
    rng = np.random.default_rng(10)
    stats = quality_rules.STATS
    values = rng.integers(0, 12, (300, len(stats))).astype(float)
    bad = (values[:, 3] > 8) | (rng.random(300) < 0.1)
    rows = spark.createDataFrame([(*map(float, v), bool(b), 1) for v, b in zip(values, bad)], ", ".join(f"{s} double" for s in stats) + ", bad boolean, part int")
    grids = quality_rules._grids(rows)
    bins = F.array(*[sum((F.when(F.col(s) > t, 1).otherwise(0) for t in g), F.lit(0)) for s, g in zip(stats, grids)])
    literal, p, n = quality_rules._best(rows.select("bad", bins.alias("bins")), grids, int(bad.sum()), int((~bad).sum()), 5)
    gains = {}
    for s, grid in enumerate(grids):
        for t in grid:
            for above in (False, True):
                hit = values[:, s] > t if above else values[:, s] <= t
                q, m = int((hit & bad).sum()), int((hit & ~bad).sum())
                if q >= 5 and q + m < 300:
                    gains[s, t, above] = q * (np.log2(q / (q + m)) - np.log2(bad.mean())), q, m
    best = max(g for g, *_ in gains.values())
    got = gains[literal.stat, literal.threshold, literal.above]
    assert abs(got[0] - best) < 1e-9 and got[1:] == (p, n)


def test_quality_verdict_on_labels_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn, held = labels.where("doc_id % 4 <> 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 0 AND quality IS NOT NULL").collect()}
    found = [r for r in quality_rules.quality_verdicts(docs, learn).where("doc_id % 4 = 0").collect() if r.doc_id in held]
    right = sum(r.kept == (held[r.doc_id] == 1) for r in found)
    print("\nheld out:", right, "of", len(found), "right")
    assert len(found) > 300 and right >= 0.95 * len(found)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(i, "x" * (50 + i % 90), "s", i) for i in range(200)] + [(7, "same", "s", k) for k in range(300)] + ODD
    docs = frame(spark, rows).withColumn("shard", F.lit("mine"))
    sharding.write_shards(docs, f"{tmp_path}/out", 500)
    back = spark.read.parquet(f"{tmp_path}/out")
    got = sorted((repr(tuple(r)[:5]) for r in back.select("doc_id", "text", "source", "block", "shard").collect()))
    assert got == sorted(repr((*r, "mine")) for r in rows)
    sizes = back.groupBy("__shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert len(sizes) > 20 and all(r.b <= 500 or r.n == 1 for r in sizes)


def test_quality_defined_results(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.quality_verdicts(frame(spark), labels).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out)
    assert [r.n_repeat_words for r in out if r.doc_id == 5] == [30_000]


def test_main_text(spark):
    page = "<html><body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><article><h1>A title</h1><p>First  paragraph &amp; more.</p><p>Second one,\nwith words.</p></article><div class='comments'><p>Great post!</p></div><footer>Copyright</footer></body></html>"
    rows = [(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (4, "u", "<p>unclosed < stray", "x")]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "A title\n\nFirst paragraph & more.\n\nSecond one, with words." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and len(got) == 4


def test_url_filter_defined_results(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "nothing", "x"), (3, "http://WWW.Example.org/es/1?q", "x"), (4, "ftp://bad.net/x.html#y", "x"), (4, "ftp://bad.net/x.html#y", "x")], "page_id long, url string, block string")
    listed = spark.createDataFrame([("http://www.bad.net/x",), (None,)], "url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect() if r.rule is None)
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (4, "bad.net", "/x.html", None, "block"), (4, "bad.net", "/x.html", None, "block")]
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack(none, packing.word_count(F.col("text"))).count() == 0
    assert sharding.assign_shards(none, 500).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert quality_rules.quality_verdicts(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_words_of_the_pattern():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a b\x1cc d") == ["a b\x1cc", "d"]
