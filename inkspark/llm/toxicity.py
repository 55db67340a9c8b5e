"""Toxicity: a linear classifier over words and affixes, regularised by counterfactual identity swaps.

Fit: at most ``max_rows`` labelled documents (those with the smallest hash of the id) are looked at. Their features, hashed
into ``BUCKETS``, are counted by label per partition; the ``FEATURES`` with the largest z-score of the log odds (over ``LEAST_Z``) are
kept, and scaled by it. The documents' vectors over them are small and bounded, and the weights are fitted on the driver by
logistic regression. Sentences with identity terms are also vectorised with each term swapped for the next of its
group, and the squared difference of the two logits is added to the loss with the weight ``swap_weight``, so that a
mention of a group doesn't move the score.

Score: every whole text, a record batch at a time. Only distinct words are looked at; a text's score depends on nothing but its
words.

Defined results: a null or empty text has the score of the bias. Without labelled rows of both classes every score is the share
of label 1 among them (0 if there are none), below the decision threshold by definition. Repeated rows stay repeated;
null labels and labels without a document are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.store import source, written
from inkspark.llm.words import slices

BUCKETS = 1 << 20
SLICE = 1 << 19  # bytes of text at once: a word has up to seven features
FEATURES = 4096
MAX_ROWS = 20_000
LEAST_Z = 2.0
THRESHOLD = 0.7
PREFIXES, SUFFIXES = (4, 5, 6, 7), (4, 5)

#: Terms that may stand for each other in a sentence without changing whether it is toxic, by language.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"), ("immigrants", "natives", "refugees"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs"), ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos"),
)


def features(word: str) -> list[str]:
    """The word, and its prefixes and suffixes shorter than it."""
    n = len(word)
    return ["=" + word, *(f"<{word[:k]}" for k in PREFIXES if n > k), *(f">{word[-k:]}" for k in SUFFIXES if n > k)]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _letters(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters of each text, with empty strings at the ends of some."""
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\pL]+", " "))


class _Cache(dict):
    """word -> places of its features, bounded."""

    def __init__(self, places):
        super().__init__()
        self.places = places

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        got = self.places(word)
        self[word] = got
        return got


def _places(word: str, chosen: dict[int, int] | None) -> tuple[int, ...]:
    if not word:
        return ()
    all_buckets = dict.fromkeys(bucket(f) for f in features(word))
    return tuple(all_buckets) if chosen is None else tuple(chosen[b] for b in all_buckets if b in chosen)


def _vectors(texts: pa.Array, cache: _Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature place, value) of every feature a text has."""
    lists = _letters(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    enc = flat.dictionary_encode()
    uniq = enc.dictionary.to_pylist()
    codes = enc.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    real = np.array([bool(w) for w in uniq], bool)[codes] if len(uniq) else np.zeros(0, bool)
    n_words = np.bincount(owner[real], minlength=len(texts))
    # (text, word) counts first: a text repeats few words many times
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, count = np.unique(owner * len(uniq) + codes, return_counts=True)
    text, word = key // len(uniq), key % len(uniq)
    per_word = [cache[w] for w in uniq]
    size = np.array([len(p) for p in per_word])
    start = np.r_[0, np.cumsum(size)]
    places = np.fromiter((x for p in per_word for x in p), np.int64, start[-1])
    reps = size[word]
    within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    place = places[np.repeat(start[:-1][word], reps) + within]
    both, inverse = np.unique(np.repeat(text, reps) * BUCKETS + place, return_inverse=True)
    total = np.bincount(inverse, weights=np.repeat(count, reps), minlength=len(both))
    text, place = both // BUCKETS, both % BUCKETS
    return text, place, 0.5 + np.log1p(100 * total / (n_words[text] + 10))


def swapped(sentence: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> str | None:
    """The lower-cased sentence with every identity term replaced by the next of its group; None if it has none."""
    follow = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    words = _letters(pa.array([sentence])).flatten().to_pylist()
    return " ".join(follow.get(w, w) for w in words) if any(w in follow for w in words) else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that have a feature, by bucket: partial counts of this partition."""
    counts, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    cache = _Cache(partial(_places, chosen=None))
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            text, place, _ = _vectors(batch.column("text"), cache)
            rows += np.bincount(label, minlength=2)[:2]
            for y in (0, 1):
                counts[y] += np.bincount(place[label[text] == y], minlength=BUCKETS)
    some = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[some, -1]), pa.array(np.r_[counts[0, some], rows[0]]), pa.array(np.r_[counts[1, some], rows[1]])], names=["place", "n0", "n1"]
    )


def _rows(batches: Iterator[pa.RecordBatch], chosen: dict[int, int], groups) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of labelled documents (kind 0), and of sentences with identity terms and their swaps (1, 2)."""
    cache = _Cache(partial(_places, chosen=chosen))
    schema = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("place", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def packed(texts: pa.Array, kinds: list[int], labels: list[int]) -> pa.RecordBatch:
        text, place, value = _vectors(texts, cache)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kinds, pa.int32()),
                pa.array(labels, pa.int32()),
                pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32))),
            ],
            schema=schema,
        )

    terms = {t for g in groups for t in g}
    any_term = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, sorted(terms))) + r")(?![^\W\d_])") if terms else None
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            labels = [int(x) for x in batch.column("label").to_pylist()]
            yield packed(batch.column("text"), [0] * len(labels), labels)
            pairs, kinds, of = [], [], []
            for text, y in zip(batch.column("text").to_pylist(), labels):
                if text and any_term and any_term.search(text.lower()):
                    for sentence in text.replace("\n", ".").split("."):
                        if (other := swapped(sentence, groups)) is not None:
                            pairs += [sentence, other]
                            kinds += [1, 2]
                            of += [y, y]
            if pairs:
                yield packed(pa.array(pairs, pa.string()), kinds, of)


@dataclass
class Model:
    """Buckets of the features, their weights, and the bias."""

    chosen: dict[int, int]
    weights: np.ndarray
    bias: float


def logits(texts: list[str], model: Model) -> np.ndarray:
    """The model's log odds of each text."""
    text, place, value = _vectors(pa.array(texts, pa.string()), _Cache(partial(_places, chosen=model.chosen)))
    return np.bincount(text, weights=value * np.r_[model.weights, 0.0][place], minlength=len(texts)) + model.bias


def fit(labelled: DataFrame, swap_weight: float = 1.0, l2: float = 3e-5, steps: int = 300, groups=IDENTITY_TERMS) -> Model:
    """Fits (text, label) rows; the caller bounds their number."""
    stats = labelled.mapInArrow(_counted, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    stats = written(stats, "toxic-counts")
    total = stats.where("place = -1").first()
    if total is None or not total["n0"] or not total["n1"]:
        share = 0.0 if total is None or not total["n0"] + total["n1"] else total["n1"] / (total["n0"] + total["n1"])
        share = min(share, THRESHOLD - 0.01)
        return Model({}, np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    odds = lambda n, all_: F.log((F.col(n) + 0.5) / (F.lit(float(all_)) - F.col(n) + 0.5))
    z = F.abs(odds("n1", total["n1"]) - odds("n0", total["n0"])) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    clear = stats.where("place >= 0 AND n0 + n1 >= 4").select("place", z.alias("z")).where(F.col("z") > LEAST_Z)
    top = clear.orderBy(F.desc("z"), "place").limit(FEATURES).toArrow()
    chosen = {b: i for i, b in enumerate(top["place"].to_pylist())}
    strength = top["z"].to_numpy()
    strength = 3 * (strength / strength.max(initial=1e-9)) ** 1.5  # clear evidence weighs more: few labels suffice
    got = labelled.mapInArrow(partial(_rows, chosen=chosen, groups=groups), "kind int, label int, place array<int>, value array<float>").toArrow().combine_chunks()

    def flat(name: str) -> np.ndarray:
        return pc.list_flatten(got[name]).to_numpy()

    size = pc.list_value_length(got["place"]).to_numpy()
    kind, y = got["kind"].to_numpy(), got["label"].to_numpy().astype(float)
    row, col, val = np.repeat(np.arange(len(size)), size), flat("place"), flat("value").astype(float)
    val = val * strength[col]
    docs, one, two = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    one, two = _paired(one, two)
    weight = np.where(y[docs] == 1, np.sqrt((1 - y[docs].mean()) / y[docs].mean()), 1.0)
    weight /= weight.sum()
    theta, m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    theta[-1] = np.log(y[docs].mean() / (1 - y[docs].mean()))
    for t in range(1, steps + 1):
        z_all = np.bincount(row, weights=val * theta[:-1][col], minlength=len(size)) + theta[-1]
        pull = np.zeros(len(size))
        pull[docs] = (1 / (1 + np.exp(-np.clip(z_all[docs], -30, 30))) - y[docs]) * weight
        bias_pull = pull.sum()
        if len(one):
            gap = 2 * swap_weight * (z_all[one] - z_all[two]) / len(one)
            pull[one] += gap
            pull[two] -= gap
        g = np.r_[np.bincount(col, weights=val * pull[row], minlength=len(chosen)) + l2 * theta[:-1], bias_pull]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(chosen, theta[:-1] * strength, float(theta[-1]))


def _paired(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences and their swaps are written next to each other."""
    if not np.array_equal(one + 1, two):
        raise ValueError("a sentence without its swap")
    return one, two


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    cache = _Cache(partial(_places, chosen=model.chosen))
    weights = np.r_[model.weights, 0.0]
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            text, place, value = _vectors(batch.column("text"), cache)
            z = np.bincount(text, weights=value * weights[place], minlength=batch.num_rows) + model.bias
            yield batch.drop_columns(["text"]).append_column("score", pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled documents whose crc32(id) mod 3 is not 1."""
    ids = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
        .where(f"_id IS NOT NULL AND label IN (0, 1) AND NOT ({held_out_sql('_id')})")
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(max_rows)
    )
    ids = written(ids, "toxic-ids")  # at most max_rows of two numbers: a broadcast of known size
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    return written(found.select("text", "label").repartition(8), "toxic-sample")


def held_out_sql(id_col: str) -> str:
    return f"crc32(cast({id_col} AS string)) % 3 = 1"


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
    swap_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; ``keep`` names further columns to carry along."""
    model = fit(labelled_sample(docs, labels, label_col, max_rows, id_col, text_col), swap_weight)
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(k).alias(f"k_{k}") for k in keep])
    schema = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes if n != "text") + ", score double"
    out = wanted.mapInArrow(partial(_scored, model=model), schema)
    return out.select(
        "doc_id",
        F.coalesce(F.expr(held_out_sql("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        *[F.col(f"k_{k}").alias(k) for k in keep],
    )


def _clean(batches: Iterator[pa.RecordBatch], model: Model, text_col: str) -> Iterator[pa.RecordBatch]:
    """The rows whose score is under the threshold, unchanged."""
    cache, weights = _Cache(partial(_places, chosen=model.chosen)), np.r_[model.weights, 0.0]
    for whole in batches:
        for batch in slices(whole, text_col, SLICE):
            text, place, value = _vectors(batch.column(text_col), cache)
            z = np.bincount(text, weights=value * weights[place], minlength=batch.num_rows) + model.bias
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < THRESHOLD))


def without_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``score_toxicity`` would predict as 1; all their columns."""
    model = fit(labelled_sample(docs, labels, label_col, max_rows, id_col, text_col))
    return docs.mapInArrow(partial(_clean, model=model, text_col=text_col), docs.schema)


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text of ``documents``."""
    return score_toxicity(source(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
