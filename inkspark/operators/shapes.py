"""Shapes of records: detector outputs as detections, text lists, structs of conditions and conflicts, status rows, ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import geometry as G
from inkspark.functions.text import POSITION

CONDITION = ("joint_type", "process", "position", "current_a", "voltage_v", "speed_cm_min")


def text_detections(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Detected lines (points array<array<double>>, text, score, seq) as detections: box, polygon, prob, source; blank texts are left out."""
    rows = lines.where(F.trim("text") != "")
    return rows.select(*keys, "seq", F.trim("text").alias("text"), F.col("score").alias("prob"), G.polygon_box(F.col("points")).alias("box"), F.col("points").alias("polygon"), F.lit("ocr").alias("source"))


def symbol_detections(found: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Detected phrases (phrase, score, box, width, height) as symbols: the phrase's code, the box cut to the image; others are left out."""
    known = codes.select("phrase", "code").dropDuplicates(["phrase"])
    rows = found.join(known, "phrase").withColumn("clipped", G.clipped(F.col("box"), F.col("width"), F.col("height"))).where("clipped IS NOT NULL")
    return rows.select(*keys, F.col("code").alias("label"), F.col("score").alias("prob"), F.col("clipped").alias("box"))


def search_texts(*columns: str) -> Column:
    """The texts that a search looks into, without nulls, in lower case."""
    return F.transform(F.array_compact(F.array(*[F.col(c).cast("string") for c in columns])), lambda t: F.lower(t))


def condition_of(row: str, source: str, **more: Column) -> Column:
    """A standard's row as a condition, with where it comes from; null if there is no row."""
    fields = [F.col(f"{row}.{c}").alias(c) for c in CONDITION]
    return F.when(F.col(row).isNotNull(), F.struct(*fields, *[v.alias(k) for k, v in more.items()], F.lit(source).alias("source")))


def conflict(kind: str, severity: Column | str, message: Column, refs: Column) -> Column:
    """A conflict's struct."""
    s = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(kind).alias("type"), s.alias("severity"), message.alias("message"), refs.alias("ref_ids"))


def by_severity(conflicts: str) -> tuple[Column, Column]:
    """(errors and warnings, the rest) of an array of conflicts."""
    loud = lambda c: c.severity.isin("error", "warning")
    return F.filter(conflicts, loud), F.filter(conflicts, lambda c: ~loud(c))


def status_row(settings: DataFrame, secrets: list[str]) -> DataFrame:
    """Settings as booleans for secrets (whether they are set) and as they are for the rest."""
    return settings.select(*[F.coalesce(F.trim(F.col(c)) != "", F.lit(False)).alias(f"{c}_set") if c in secrets else F.col(c) for c in settings.columns])


def stored_or(images: DataFrame, asked: DataFrame, keys: list[str], fallback: str) -> DataFrame:
    """Asked rows with the stored ``data`` of their image, else their fallback."""
    return asked.join(images.select(*keys, "data"), keys, "left").withColumn("data", F.coalesce("data", fallback))


def leaves(nodes: DataFrame, level: str = "PART") -> DataFrame:
    """The paths of the nodes of the last level."""
    return nodes.where(F.col("level") == level).select("path")


def distinct_marks(rows: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """(keys, values, several): the distinct values of a key in their order, and whether there are several."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(seq, value))), lambda r: r[value])
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_distinct(listed).alias("values")).withColumn("several", F.size("values") > 1)


def positions_in(meaning: Column | str) -> Column:
    """Welding positions named in a meaning."""
    return F.regexp_extract_all(F.col(meaning) if isinstance(meaning, str) else meaning, F.lit(POSITION), F.lit(1))


def only_second(ref: Column | str) -> Column:
    """Whether a reading's id is one that only the second reader has."""
    return (F.col(ref) if isinstance(ref, str) else ref).startswith("v")


def only_first(ref: Column, corrected: Column) -> Column:
    """Whether only the first reader has it and no person has confirmed it."""
    return ref.startswith("t") & ~corrected
