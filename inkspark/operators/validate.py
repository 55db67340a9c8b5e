"""Integrity rules across tables: each rule is a query of the rows that break it; together they are one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key isn't null and isn't in ``known``."""
    keys = known.select(F.col(known_key).alias("_k")).distinct()
    return rows.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_k"), "left_anti")


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def report(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, n: how many rows break each rule; rules that nothing breaks are listed with 0."""
    parts = [broken.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n") for name, broken in rules.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the row rules that don't hold; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def dangling_refs(refs: Column, known: Column) -> Column:
    """References that aren't known, sorted."""
    return F.array_sort(F.array_except(refs, known))


def analysis_rules() -> dict[str, Column]:
    """Row rules over one analysis per row: text_ids, symbol_ids, char_probs_ok, first_candidate_ok, refs, known_ids, visual, db, reasoning,
    overall, threshold, passed, missing, review_targets, corrected, reader_error, has_reader, revision, has_context."""
    ids = F.concat("text_ids", "symbol_ids")
    return {
        "unique_ids": F.size(F.array_distinct(ids)) == F.size(ids),
        "char_probs_length": F.col("char_probs_ok"),
        "first_candidate": F.col("first_candidate_ok"),
        "refs_known": F.size(dangling_refs(F.col("refs"), F.col("known_ids"))) == 0,
        "error_without_reader": ~(F.col("reader_error") & F.col("has_reader")),
        "overall_is_least": F.col("overall") == F.least("visual", "db", "reasoning"),
        "passed_means_threshold": F.col("passed") == ((F.col("overall") >= F.col("threshold")) & (F.size("missing") == 0)),
        "missing_is_reviewed": F.size(F.array_except("missing", "review_targets")) == 0,
        "corrected_not_reviewed": F.size(F.array_intersect("corrected", "review_targets")) == 0,
        "revision_has_cause": (F.col("revision") > 1) == ((F.size("corrected") > 0) | F.col("has_context")),
    }


def dataset_lint(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of an annotation table with ``errors``: required fields, box order and bounds, labels of the dictionary, file name rule."""
    known = labels.select(F.col("code").alias("_code"), F.lit(True).alias("_known")).distinct()
    joined = rows.join(known, rows["label"] == F.col("_code"), "left")
    rules = {
        "image_missing": F.length(F.trim("image")) > 0,
        "split_unknown": F.col("split").isin("train", "eval"),
        "box_order": (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")),
        "box_bounds": (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= F.col("width")) & (F.col("y2") <= F.col("height")),
        "label_unknown": F.coalesce(F.col("_known"), F.lit(False)),
        "name_differs": F.regexp_replace("file", r"\.[^.]*$", "") == F.regexp_replace("image", r"\.[^.]*$", ""),
    }
    return joined.withColumn("errors", violations(rules)).drop("_code", "_known")
