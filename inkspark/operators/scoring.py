"""Confidence scores of a reading and the queue of what a person should check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the scores.
STRONG_CORRECTION, MAX_CORRECTION_PENALTY = 0.5, 0.2
SECOND_ONLY_CAP, SECOND_ONLY_SINGLE = 0.9, 0.6
UNMATCHED_WEIGHT, PART_NOT_FOUND, STANDARD_CONFLICT = 25, 40, 20
CONSISTENCY_CAP, SINGLE_RUN = 0.9, 60.0


def visual_score(prob: Column, agreement: Column, strength: Column, second_only: Column, consistency: Column) -> Column:
    """0..100: the lower of recognition probability and agreement, less up to 20 % for strong image correction.

    With neither, a second reader alone counts 0.9 of its consistency, or 0.6 for a single run; nothing read is 0.
    """
    alone = F.when(second_only, F.coalesce(SECOND_ONLY_CAP * consistency, F.lit(SECOND_ONLY_SINGLE)))
    base = F.coalesce(F.least(prob, agreement), alone)
    penalty = MAX_CORRECTION_PENALTY * F.greatest(F.lit(0.0), F.coalesce(strength, F.lit(0.0)) - STRONG_CORRECTION) / (1 - STRONG_CORRECTION)
    return F.coalesce(F.bround(100 * base * (1 - penalty)), F.lit(0.0))


def db_score(match_rate: Column, part_found: Column, conflicts: Column) -> Column:
    """100 less 25 for unmatched readings, 40 for a part that is known not to be in the tree, and 20 for each conflict; 0..100."""
    score = (
        100.0
        - UNMATCHED_WEIGHT * (1 - F.coalesce(match_rate, F.lit(1.0)))
        - F.when(part_found.eqNullSafe(F.lit(False)), PART_NOT_FOUND).otherwise(0)
        - STANDARD_CONFLICT * conflicts
    )
    return F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))


def reasoning_score(token_prob: Column, consistency: Column, used: Column, failed: Column) -> Column:
    """0 if the second reader failed, 100 if it wasn't used; else from token probability and consistency."""
    return (
        F.when(failed, 0.0)
        .when(~used, 100.0)
        .when(token_prob.isNotNull() & consistency.isNotNull(), F.bround(100 * (token_prob + consistency) / 2))
        .when(token_prob.isNotNull(), F.bround(100 * token_prob))
        .when(consistency.isNotNull(), F.bround(100 * CONSISTENCY_CAP * consistency))
        .otherwise(SINGLE_RUN)
    )


def is_rule_match(match: Column, meaning: Column) -> Column:
    """Whether a lookup outcome follows the dictionary or a marking rule."""
    return match.isin("exact", "alias", "candidate") | ((match == "none") & meaning.isNotNull())


def match_rate(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rule matches per key, two digits."""
    return matches.groupBy(*keys).agg(F.bround(F.avg(is_rule_match(F.col("match"), F.col("meaning")).cast("double")), 2).alias("match_rate"))


def least_prob(detections: DataFrame, keys: list[str], confirmed: Column) -> DataFrame:
    """The least probability of unconfirmed detections; 1 if all are confirmed."""
    return detections.groupBy(*keys).agg(F.coalesce(F.min(F.when(~confirmed, F.col("prob"))), F.lit(1.0)).alias("recognition_prob"))


def overall(visual: Column, db: Column, reasoning: Column) -> Column:
    return F.least(visual, db, reasoning)


def passed(score: Column, threshold: Column, missing: Column) -> Column:
    """At or over the threshold with no required value missing."""
    return (score >= threshold) & (F.size(missing) == 0)


def missing_required(assembly_path: Column, condition: Column, corrected: Column) -> Column:
    """Which of part and welding_condition are neither present nor corrected."""
    one = lambda name, value: F.when(value.isNull() & ~F.array_contains(corrected, name), F.lit(name))
    return F.array_compact(F.array(one("part", assembly_path), one("welding_condition", condition)))


def review_queue(missing: DataFrame, conflicts: DataFrame, detections: DataFrame, runs: DataFrame, corrected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position, target, reason: required values that are missing, conflicts by severity, improbable readings, an inconsistent
    second reader; one item per target, without corrected ones.

    ``missing``: keys, target, seq. ``conflicts``: keys, type, severity, target, seq. ``detections``: keys, target, prob, threshold, seq. ``runs``: keys,
    failed, consistency. ``corrected``: keys, target.
    """
    severity = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2)
    item = lambda df, stage, order, reason: df.select(*keys, "target", F.struct(stage.cast("int").alias("stage"), order.cast("double").alias("order"), F.col("seq").cast("long").alias("seq")).alias("place"), reason.alias("reason"))
    rows = (
        item(missing, F.lit(0), F.lit(0.0), F.lit("missing_required"))
        .unionByName(item(conflicts.where(severity.isNotNull()), severity, F.lit(0.0), F.col("type")))
        .unionByName(item(detections.where("prob < threshold / 100"), F.lit(3), F.col("prob"), F.lit("low_visual_confidence")))
        .unionByName(item(
            runs.where("failed OR consistency < 1").withColumn("target", F.lit("interpretation")).withColumn("seq", F.lit(0)),
            F.lit(4), F.lit(0.0), F.when(F.col("failed"), "reader_failed").otherwise("reader_inconsistent"),
        ))
    )
    rows = rows.join(corrected.select(*keys, "target").distinct(), [*keys, "target"], "left_anti")
    first = rows.groupBy(*keys, "target").agg(F.min(F.struct("place", "reason")).alias("m"))
    ordered = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m.place", "target", "m.reason"))).alias("items"))  # a photo's items
    return ordered.select(*keys, F.posexplode("items").alias("position", "i")).select(*keys, (F.col("position") + 1).alias("position"), "i.target", "i.reason")
