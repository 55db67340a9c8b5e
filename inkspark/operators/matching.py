"""Greedy one-to-one matching of predicted and true boxes.

Which truth a prediction takes depends on what was taken before, so the last step is a loop. An equi-join and the overlap predicate find the
candidate pairs; they are sorted by photo and order of taking, and tasks read them as a stream, which holds the ids taken in one photo.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.geometry import centre_inside, iou
from inkspark.operators.metrics import average_precision
from inkspark.sources.scratch import written


def _greedy(batches: Iterator[pa.RecordBatch], overlaps: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    """The pairs that are taken for each least overlap, of pairs in order."""
    group, taken = None, []
    for batch in batches:
        photo, label, pred, truth, overlap = (batch.column(n).to_pylist() for n in ("photo", "label", "pred", "truth", "overlap"))
        at, least = [], []
        for i, own in enumerate(zip(photo, label)):
            if own != group:
                group, taken = own, [(x, set(), set()) for x in overlaps]
            for x, preds, truths in taken:
                if overlap[i] >= x and pred[i] not in preds and truth[i] not in truths:
                    preds.add(pred[i])
                    truths.add(truth[i])
                    at.append(i)
                    least.append(x)
        rows = batch.select(["photo", "label", "pred", "truth", "overlap"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(least, pa.float64())], names=[*rows.schema.names, "least_overlap"])


def _taken(pairs: DataFrame, overlaps: tuple[float, ...]) -> DataFrame:
    """photo, label, pred, truth, overlap, least_overlap: for each least overlap the pairs taken by falling ``score``, then by pred, falling overlap and truth."""
    order = [F.desc("score"), F.asc("pred"), F.desc("overlap"), F.asc("truth")]
    pairs = pairs.select("photo", "label", "pred", "truth", "overlap", "score").repartition("photo", "label").sortWithinPartitions("photo", "label", *order)
    kinds = dict(pairs.dtypes)
    return pairs.mapInArrow(
        partial(_greedy, overlaps=overlaps), f"photo {kinds['photo']}, label {kinds['label']}, pred {kinds['pred']}, truth {kinds['truth']}, overlap double, least_overlap double"
    )


def iou_matches(preds: DataFrame, truths: DataFrame, least: float = 0.5) -> DataFrame:
    """photo, label, pred, truth, overlap: predictions by falling score, then by ``pred``, each take the free truth of the largest overlap.

    ``preds``: photo, label, pred, score, box. ``truths``: photo, label, truth, box. Of equal overlaps the first ``truth`` is taken.
    """
    t = truths.select("photo", "label", "truth", F.col("box").alias("truth_box"))
    pairs = preds.join(t, ["photo", "label"]).withColumn("overlap", iou(F.col("box"), F.col("truth_box"))).where(F.col("overlap") >= least)
    return _taken(pairs, (least,)).drop("least_overlap")


def decisions(preds: DataFrame, truths: DataFrame, overlaps: tuple[float, ...]) -> DataFrame:
    """photo, group, least_overlap, pred, score, hit: whether each prediction takes a truth, among its label's boxes and among all (``any``).

    Predictions are tried by falling score, so that what one takes depends on higher scores only: the decisions above any least score are a
    prefix of these, and one matching serves them all. A photo's boxes meet in one equi-join with the overlap predicate.
    """
    t = truths.select("photo", F.col("label").alias("truth_label"), "truth", F.col("box").alias("truth_box"))
    pairs = preds.join(t, "photo").withColumn("overlap", iou(F.col("box"), F.col("truth_box"))).where(F.col("overlap") >= min(overlaps))
    own = F.col("label") == F.col("truth_label")
    pairs = pairs.withColumn("label", F.explode(F.when(own, F.array("label", F.lit("any"))).otherwise(F.array(F.lit("any")))))
    hits = _taken(pairs, overlaps).select("photo", F.col("label").alias("group"), "least_overlap", "pred")
    every = preds.select("photo", F.explode(F.array("label", F.lit("any"))).alias("group"), "pred", "score", F.explode(F.array(*map(F.lit, overlaps))).alias("least_overlap"))
    return every.join(hits.withColumn("hit", F.lit(True)), ["photo", "group", "least_overlap", "pred"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def threshold_report(preds: DataFrame, truths: DataFrame, overlaps: tuple[float, ...], scores: tuple[float, ...]) -> DataFrame:
    """label (and ``any``), least_overlap, least_score, gt, tp, fp, fn, recall, precision (three digits) and ap (four digits) from one matching.

    Shares are null where nothing is counted; ap is null without truths and 0 without predictions.
    """
    keys = ["group", "least_overlap"]
    decided = written(decisions(preds, truths, overlaps), "decisions")  # read by three steps
    gt = truths.select(F.explode(F.array("label", F.lit("any"))).alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("gt"))
    at = [F.struct(F.lit(s).alias("least_score"), F.count_if(F.col("score") >= s).alias("kept"), F.count_if((F.col("score") >= s) & F.col("hit")).alias("tp")) for s in scores]
    counts = decided.groupBy(*keys).agg(F.array(*at).alias("at")).select(*keys, F.explode("at").alias("at")).select(*keys, "at.*")
    scored = decided.join(F.broadcast(gt), "group", "left").select(*keys, "hit", "score", F.struct("photo", "pred").alias("tie"), F.coalesce("gt", F.lit(0)).alias("positives"))  # a row for each label
    ap = average_precision(scored, keys, "hit", "score", "tie").select(*keys, F.bround("ap", 4).alias("ap"))
    labels = gt.select("group").union(decided.select("group").distinct()).union(preds.sparkSession.range(1).select(F.lit("any"))).distinct()
    grid = labels.select("group", F.explode(F.array(*map(F.lit, overlaps))).alias("least_overlap")).select("*", F.explode(F.array(*map(F.lit, scores))).alias("least_score"))
    rows = grid.join(gt, "group", "left").join(counts, [*keys, "least_score"], "left").join(ap, keys, "left").fillna(0, ["gt", "kept", "tp"])
    share = lambda part, whole: F.bround(F.try_divide(F.col(part).cast("double"), F.col(whole)), 3)
    return rows.select(
        F.col("group").alias("label"), "least_overlap", "least_score", "gt", "tp", (F.col("kept") - F.col("tp")).alias("fp"), (F.col("gt") - F.col("tp")).alias("fn"),
        share("tp", "gt").alias("recall"), share("tp", "kept").alias("precision"), F.when(F.col("gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"),
    )


def centre_matches(preds: DataFrame, truths: DataFrame, margin: float = 0.1) -> DataFrame:
    """photo, truth, preds, found: the truths of a photo in order take the free predictions whose centre lies in their widened box.

    A prediction goes to the first truth that holds it: no loop is needed. ``preds``: photo, pred (in reading order), box. ``truths``: photo,
    truth (in order), box. A truth or prediction of several boxes counts once, with all of them.
    """
    t = truths.select("photo", "truth", F.col("box").alias("truth_box"))
    pairs = preds.join(t, "photo").where(centre_inside(F.col("box"), F.col("truth_box"), margin))
    taken = pairs.groupBy("photo", "pred").agg(F.min("truth").alias("truth"))
    parts = taken.groupBy("photo", "truth").agg(F.array_sort(F.collect_list("pred")).alias("preds"))
    return truths.select("photo", "truth").distinct().join(parts, ["photo", "truth"], "left").withColumn("found", F.col("preds").isNotNull())
