"""Recognition metrics: error rates, precision curves, consensus of runs, grouped totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from inkspark.operators.ordering import in_slices


@F.pandas_udf(IntegerType())
def wildcard_distance(truth: pd.Series, read: pd.Series) -> pd.Series:
    """Edit distance in which ``?`` of the truth matches any character."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            above, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y and x != "?"))
        return row[-1]

    return pd.Series([None if a is None or b is None else distance(a, b) for a, b in zip(truth, read)], dtype="Int32")


def edit_distance(truth: Column, read: Column) -> Column:
    """Levenshtein distance; the built-in where the truth has no wildcard."""
    return F.when(truth.contains("?"), wildcard_distance(truth, read)).otherwise(F.levenshtein(truth, read))


def error_report(rows: DataFrame, keys: list[str], truth: str, read: str, wildcards: bool = True) -> DataFrame:
    """n, cer (distance capped at the truth's length), exact, exact_ignoring_case and found rates per key; null without rows."""
    t, r = F.col(truth), F.coalesce(F.col(read), F.lit(""))
    d = F.least(edit_distance(t, r) if wildcards else F.levenshtein(t, r), F.length(t))
    rate = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(d).cast("double"), F.sum(F.length(t))).alias("cer"),
        rate(t == r).alias("exact"),
        rate(F.upper(t) == F.upper(r)).alias("exact_ignoring_case"),
        rate(F.col(read).isNotNull()).alias("found"),
    )


def average_precision(scored: DataFrame, keys: list[str], hit: str, score: str, tie: str) -> DataFrame:
    """Area under the precision envelope of predictions by falling score, then ``tie``; ``positives`` per key counts the truths.

    ``scored`` has keys, ``hit`` (boolean), ``positives``, a number ``score`` and ``tie``. Rows are written in order, in slices of about equal
    size: a row's place in its slice is known, and precision rises at hits only, so that the running steps read hits alone. What a
    slice needs of the others are two counts and a maximum for each, so that no task sorts a whole key.
    """
    rows = in_slices(scored.select(*keys, F.col(hit).alias("hit"), "positives", F.col(score).alias("score"), F.col(tie).alias("tie")), [*keys, F.desc("score"), "tie"], "precision-order")
    totals = rows.groupBy(*keys, "slice").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("rows"), F.min("place").alias("start"), F.max("positives").alias("positives"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    starts = totals.select(*keys, "slice", "start", F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy(*keys, "slice").orderBy("place")
    curve = rows.where("hit").select(*keys, "slice", "place").join(F.broadcast(starts), [*keys, "slice"])  # a row for each slice and key
    curve = curve.withColumn("precision", (F.row_number().over(within) + F.col("hits_before")) / (F.col("place") - F.col("start") + 1 + F.col("rows_before")))
    # from the last row back: Spark reads a frame that ends behind the last row anew for each row
    back = Window.partitionBy(*keys, "slice").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    curve = curve.select(*keys, "slice", "precision", F.max("precision").over(back).alias("envelope"))
    tops = curve.groupBy(*keys, "slice").agg(F.max("precision").alias("top"))
    later = F.max("top").over(Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*keys, "slice", later.alias("later"))
    area = curve.join(F.broadcast(tops), [*keys, "slice"]).groupBy(*keys).agg(F.sum(F.greatest("envelope", "later")).alias("area"))
    whole = totals.groupBy(*keys).agg(F.sum("rows").alias("n"), F.max("positives").alias("positives"))
    return whole.join(area, keys, "left").select(*keys, F.try_divide(F.coalesce("area", F.lit(0.0)), F.col("positives")).alias("ap"), "n")


def consensus(items: DataFrame, keys: list[str], run: str, item: str) -> DataFrame:
    """The run whose items are shared most: the sum over its distinct items of other runs with the item, less the
    number of items that no other run has; of equal runs the first."""
    distinct = items.select(*keys, run, item).distinct()
    counts = distinct.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("runs"))
    score = distinct.join(counts, [*keys, item]).groupBy(*keys, run).agg((F.sum(F.col("runs") - 1) - F.count_if(F.col("runs") == 1)).alias("score"))
    return score.groupBy(*keys).agg(F.max_by(run, F.struct("score", -F.col(run))).alias(run), F.max("score").alias("score"))


def consistency(readings: DataFrame, keys: list[str], reading: str) -> DataFrame:
    """Share of the most frequent whole reading among a key's runs, two digits; null for a single run."""
    counts = readings.groupBy(*keys, reading).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.max("n").alias("top"), F.sum("n").alias("runs"))
    return total.select(*keys, "runs", F.when(F.col("runs") > 1, F.bround(F.col("top") / F.col("runs"), 2)).alias("consistency"))


def agreement(first: DataFrame, second: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Share of first readings that the second reader has with the same value, two digits."""
    s = second.select(*keys, item, F.col(value).alias("other"))
    same = F.coalesce(F.col(value) == F.col("other"), F.lit(False))
    return first.join(s, [*keys, item], "left").groupBy(*keys).agg(F.bround(F.avg(same.cast("double")), 2).alias("agreement"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one digit; null if there is nothing to divide."""
    return F.bround(100 * F.try_divide(part.cast("double"), whole), 1)


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of several columns, the most frequent first within a column."""
    long = rows.unpivot([], columns, "field", "value")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def detection_metrics(matches: DataFrame, label: str) -> DataFrame:
    """tp, fp, fn, precision and recall per label and over all (``any``); ``kind`` is tp, fp or fn."""
    g = matches.withColumn("label", F.explode(F.array(F.col(label), F.lit("any")))).groupBy("label")
    out = g.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    return out.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


def length_weighted(prob: Column, length: Column) -> Column:
    """Mean probability of pieces weighted by their length."""
    return F.try_divide(F.sum(prob * length), F.sum(length))


def combined_strength(steps: Column) -> Column:
    """1 - product of (1 - strength) over an array of strengths, three digits."""
    return F.bround(1 - F.aggregate(steps, F.lit(1.0), lambda a, s: a * (1 - s)), 3)


def candidate_shares(candidates: DataFrame, keys: list[str], text: str, prob: str, n: int = 5, least: float = 0.02, order: list[str] | None = None) -> DataFrame:
    """Candidates merged by text, as shares of their sum; the ``n`` largest of at least ``least``, texts of equal sums by text, none last.

    Sums are decimal, so that texts of equal sums are equal whatever order they were added in; with ``order`` (columns that number the rows),
    they are of doubles, added in that order as SQL adds them, so that last digits decide as they do there. Where all is 0, shares are NaN;
    where it cancels to 0, they are infinite.
    """
    if order is None:
        merged = candidates.groupBy(*keys, text).agg(F.sum(F.col(prob).cast("decimal(28,18)")).alias("p"))
    else:
        so_far = Window.partitionBy(*keys, text).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = candidates.withColumn("so_far", F.sum(F.col(prob).cast("double")).over(so_far))
        merged = added.groupBy(*keys, text).agg(F.max_by("so_far", F.struct(*order)).alias("p"))
    w = Window.partitionBy(*keys)
    p, total = F.col("p").cast("double"), F.sum("p").over(w).cast("double")
    share = F.when(total == 0, p * float("inf")).otherwise(F.try_divide(p, total))
    ranked = merged.withColumn("share", share).withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), F.asc_nulls_last(text))))
    return ranked.where((F.col("rank") <= n) & (F.col("share") >= least)).select(*keys, text, "rank", "share")


def stage_progress(seconds: Column, scale: float, most: float = 0.92) -> Column:
    """How far a stage seems to be after some seconds: it nears ``most`` and never gets there."""
    return most * (1 - F.exp(-seconds / scale))
