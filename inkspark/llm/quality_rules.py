"""Quality rules: text statistics as expressions, and a learned decision list over them.

Learning is sequential covering with DataFrame aggregates only. Labelled rows are cut into bins once (approximate
quantiles and an even grid per statistic). A rule grows by the threshold literal of the best FOIL gain, read from one
small table of counts by (statistic, bin, label); it is then pruned from its end on rows that were held back
from growing, and the rows it covers leave. What comes out is an ordered conditional expression, which scores
all rows without a join.

What reaches the driver is bounded by the number of statistics times bins, whatever the data's size.

Defined results: a null or blank text has no words, all statistics 0, fails the base rule and isn't kept. With no labelled
rows the list is empty and keeps whatever passes the base rule. Repeated rows stay repeated. Labels for missing
ids, null labels and repeated labels are taken as they are (a document labelled twice counts twice).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.store import source, written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "mean_word", "symbols_word", "dup_line_share", "repeat_share", "upper_share", "marks_word", "digit_share")
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)
GRID = 12


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every whole text."""
    t = F.col("t")
    words = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "doc_id", "t", F.array_remove(F.split(t, BLANK), "").alias("words")
    )
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.slice(F.expr("transform(words, (w, i) -> concat_ws(' ', w, get(words, i + 1), get(words, i + 2)))"), F.lit(1), n - 2),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def less(pattern: str) -> Column:
        return (F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))).cast("long")

    wide = words.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, BLANK, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
        less(r"\p{Lu}+").alias("n_upper"),
        less(r"[!?]+").alias("n_marks"),
        less(r"[0-9]+").alias("n_digits"),
    )
    # windows found twice or more: neighbours in the sorted array; then the words they cover
    covered = F.expr(
        "size(array_distinct(flatten(transform(filter(ordered, (x, i) -> x.w = get(ordered, i - 1).w OR x.w = get(ordered, i + 1).w),"
        " x -> array(x.i, x.i + 1, x.i + 2)))))"
    )
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.expr("sort_array(transform(windows, (w, i) -> named_struct('w', w, 'i', i)))"),
    )
    return (
        wide.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("ordered", ordered)
        .withColumn("n_repeat_words", F.when(F.col("ordered").isNull(), 0).otherwise(covered).cast("long"))
        .drop("lines", "windows", "ordered")
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _features(df: DataFrame) -> DataFrame:
    """The statistics of ``STATS``, as shares that don't grow with the text."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return df.withColumns(
        {
            "mean_word": F.col("word_chars") / n,
            "symbols_word": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "upper_share": F.col("n_upper") / chars,
            "marks_word": F.col("n_marks") / n,
            "digit_share": F.col("n_digits") / chars,
        }
    )


@dataclass(frozen=True)
class Literal:
    """``stat > threshold`` if above, else ``stat <= threshold``; ``bin`` is the threshold's place in the grid."""

    stat: int
    bin: int
    above: bool
    threshold: float

    def on_bins(self) -> Column:
        c = F.col("bins")[self.stat]
        return c > self.bin if self.above else c <= self.bin

    def on_stats(self) -> Column:
        c = F.col(STATS[self.stat])
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{STATS[self.stat]} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rejecting rules; what none of them covers is kept."""

    rules: list[list[Literal]] = field(default_factory=list)

    def verdict(self) -> Column:
        """The number of the first rule that holds, null if the row is kept."""
        out = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            out = F.when(_all(x.on_stats() for x in self.rules[i - 1]), F.lit(i)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "; ".join(" AND ".join(map(str, r)) for r in self.rules) or "keep all"


def _all(conds) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def learn(
    labelled: DataFrame,
    max_rules: int = 8,
    max_literals: int = 3,
    min_cover: int = 5,
    min_precision: float = 0.8,
) -> DecisionList:
    """Learns from (STATS..., bad boolean, part int): rows of part 0 prune, the others grow."""
    grids = _grids(labelled)
    if grids is None:
        return DecisionList()
    bins = F.array(*[sum((F.when(F.col(s) > t, 1).otherwise(0) for t in g), F.lit(0)) for s, g in zip(STATS, grids)])
    rows = written(labelled.select("bad", "part", bins.alias("bins")), "quality-bins")
    found, left = DecisionList(), F.lit(True)
    while len(found.rules) < max_rules:
        rule: list[Literal] = []
        pos, neg = _count(rows.where(left & (F.col("part") != 0)), [F.lit(True)])[0]
        while pos and neg and len(rule) < max_literals:
            best = _best(rows.where(left & (F.col("part") != 0) & _all(x.on_bins() for x in rule)), grids, pos, neg, min_cover)
            if best is None:
                break
            rule.append(best[0])
            pos, neg = best[1:]
        if not rule:
            break
        # prune from the end by (p - n) / (p + n) on rows that growing hasn't seen
        prefixes = [_all(x.on_bins() for x in rule[: k + 1]) for k in range(len(rule))]
        held = _count(rows.where(left & (F.col("part") == 0)), prefixes)
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(held)]
        k = -max(worth)[1]
        p, n = held[k]
        if p == 0 or p / (p + n) < min_precision:
            break
        rule = rule[: k + 1]
        found.rules.append(rule)
        left = left & ~_all(x.on_bins() for x in rule)
    return found


def _grids(labelled: DataFrame) -> list[list[float]] | None:
    """Thresholds of every statistic: quantiles and an even grid, distinct and ordered."""
    cols = []
    for s in STATS:
        cols += [F.percentile_approx(F.col(s).cast("double"), F.array(*map(F.lit, QUANTILES)), F.lit(2000)), F.min(s), F.max(s)]
    row = labelled.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    if row[1] is None:
        return None
    out = []
    for i in range(len(STATS)):
        quantiles, lo, hi = row[3 * i : 3 * i + 3]
        even = [lo + (hi - lo) * k / GRID for k in range(1, GRID)]
        out.append(sorted({float(x) for x in [*quantiles, *even]}))
    return out


def _count(rows: DataFrame, conds: list[Column]) -> list[tuple[int, int]]:
    """(bad, good) rows that meet each condition."""
    cols = [F.count_if(c & (F.col("bad") == b)) for c in conds for b in (True, False)]
    got = rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [(got[2 * i], got[2 * i + 1]) for i in range(len(conds))]


def _best(rows: DataFrame, grids: list[list[float]], pos: int, neg: int, min_cover: int):
    """The literal of the highest FOIL gain with what it leaves, or None."""
    counts = rows.select("bad", F.posexplode("bins").alias("stat", "bin")).groupBy("stat", "bin", "bad").count().collect()
    table = [[[0, 0] for _ in range(len(g) + 1)] for g in grids]
    for r in counts:
        table[r["stat"]][r["bin"]][0 if r["bad"] else 1] += r["count"]
    before = math.log2(pos / (pos + neg))
    best = None
    for s, by_bin in enumerate(table):
        p = n = 0
        for b, (bp, bn) in enumerate(by_bin[:-1]):
            p, n = p + bp, n + bn  # rows with bin <= b, that is stat <= grid[b]
            for above, q, m in ((False, p, n), (True, pos - p, neg - n)):
                if q >= min_cover and q + m < pos + neg:
                    gain = q * (math.log2(q / (q + m)) - before)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Literal(s, b, above, grids[s][b]), q, m)
    return best and best[1:]


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, rule (of the learned list, null if none) and kept for every document."""
    stats = written(_features(with_statistics(docs, id_col, text_col)), "quality-stats")
    train = (
        labels.select(F.col("doc_id"), (F.col("quality") == 0).alias("bad"))
        .where("bad IS NOT NULL AND doc_id IS NOT NULL")
        .join(stats, "doc_id")
        .where(~F.col("base_failed"))
        .select(*STATS, "bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"))
    )
    rules = learn(train)
    return stats.withColumn("rule", rules.verdict()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every whole text of ``documents``."""
    out = quality_verdicts(source(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def llm_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics alone, which SQL can express."""
    out = with_statistics(source(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
       len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols,
       coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
       len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)
"""
