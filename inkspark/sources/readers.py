"""Readers with declared schemas. Every reader keeps the order of a file in ``seq`` where order means something."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STANDARDS = "joint_type string, thickness_min_mm double, thickness_max_mm double, leg_min_mm double, leg_max_mm double, process string, position string, current_a string, voltage_v string, speed_cm_min string"
TREE = "node_id string, parent_id string, level string, path string"
ENTRY = "id string, code string, kind string, meaning string, aliases array<string>, welding_joint_type string"
ANNOTATION = "image string, split string, conditions array<string>, texts array<struct<text:string,style:string,bbox:array<double>>>, symbols array<struct<label:string,bbox:array<double>>>"
#: Text that marks an unreadable label.
UNREADABLE = "###"
SCHEMES = {"sqlite": "sqlite", "postgres": "postgres", "postgresql": "postgres", "parquet": "parquet", "file": "parquet"}


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, emptyValue="", nullValue="")


def standards(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, STANDARDS)


def tree(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, TREE)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The entries of JSON files ``{"entries": [...]}`` in their order, with ``seq``."""
    rows = spark.read.json(path, schema=f"entries array<struct<{ENTRY.replace(' array', ':array').replace(' string', ':string')}>>", multiLine=True)
    return rows.select(F.posexplode("entries").alias("seq", "e")).select("seq", "e.*")


def _found(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """The files of a pattern; an empty table if there are none."""
    try:
        return read()
    except Exception as error:  # noqa: BLE001  Spark has no class of its own for a missing path here
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def _folder(name: str) -> Column:
    return F.regexp_extract("_path", rf"/{name}/([^/]+)/", 1)


def project_files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """CSV files ``<root>/workspaces/<id>/projects/<id>/<name>`` with the ids of their folders and ``place``, the order of a file's rows.

    A file may be read in pieces by several tasks: a row's place is where its piece starts, then its number in the task. No file, no rows.
    """
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    path, start = F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")
    read = lambda: spark.read.csv(f"{root}/workspaces/*/projects/*/{name}", schema=schema, header=True, emptyValue="", nullValue="").select(path, start, *columns)
    rows = _found(read, spark, f"_path string, _start long, {schema}")
    place = F.struct("_start", F.monotonically_increasing_id().alias("row")).alias("place")
    return rows.select(_folder("workspaces").alias("workspace_id"), _folder("projects").alias("project_id"), place, *columns)


def project_trees(spark: SparkSession, root: str) -> DataFrame:
    """The nodes of all projects with ``seq`` from 1 in a project: of rows with one node_id the last counts, at the place of the first."""
    rows = project_files(spark, root, "assembly_tree.csv", TREE).where("node_id IS NOT NULL")
    keys = ["workspace_id", "project_id", "node_id"]
    rest = [c for c in rows.columns if c not in (*keys, "place")]
    last = rows.groupBy(*keys).agg(F.min("place").alias("place"), F.max_by(F.struct(*rest), "place").alias("r"))
    seq = F.row_number().over(Window.partitionBy(*keys[:2]).orderBy("place"))
    return last.select(*keys, seq.alias("seq"), *[F.col("r")[c].alias(c) for c in rest])


def project_documents(spark: SparkSession, root: str, name: str, schema: str, items: str | None = None) -> DataFrame:
    """JSON files ``<root>/workspaces/<id>/projects/<id>/<name>``, one document each, with the ids of their folders, which win over fields of
    these names; with ``items`` the elements of that field, numbered by ``seq`` from 1."""
    inner = f"{items} array<{spark.createDataFrame([], schema).schema.simpleString()}>" if items else schema
    names = [c for c in spark.createDataFrame([], schema).columns if c not in ("workspace_id", "project_id")]
    read = lambda: spark.read.json(f"{root}/workspaces/*/projects/*/{name}", schema=inner, multiLine=True).select(F.col("_metadata.file_path").alias("_path"), "*")
    rows = _found(read, spark, f"_path string, {inner}")
    ids = [_folder("workspaces").alias("workspace_id"), _folder("projects").alias("project_id")]
    if items is None:
        return rows.select(*ids, *names)
    each = rows.select(*ids, F.posexplode(items).alias("seq", "e"))
    return each.select("workspace_id", "project_id", (F.col("seq") + 1).alias("seq"), *[F.col("e")[c].alias(c) for c in names])


def projects(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``project.json`` of every project, numbered by ``position`` in the order of the folders' names."""
    rows = project_documents(spark, root, "project.json", schema)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("workspace_id").orderBy("project_id")))


def project_jobs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The jobs of ``jobs.json`` of every project in their order; projects without the file have none."""
    return project_documents(spark, root, "jobs.json", schema, "jobs")


def collection(docs: DataFrame, name: str, schema: str) -> DataFrame:
    """The documents of one collection as typed rows in their order of insertion: key, seq and the schema's columns.

    ``docs``: collection, key, seq, value (JSON).
    """
    rows = docs.where(F.col("collection") == name).select("key", "seq", F.from_json("value", schema).alias("v"))
    return rows.select("key", "seq", "v.*")


def key_parts(key: Column | str, *names: str) -> list[Column]:
    """The parts of a composite ``a/b/...`` key, by name."""
    k = F.col(key) if isinstance(key, str) else key
    return [F.split_part(k, F.lit("/"), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]


def source_of(url: Column | str) -> Column:
    """struct(kind, location) of a source's address without its ``#`` comment; a null kind if the scheme isn't known."""
    u = F.trim(F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"\s*#.*$", ""))
    kinds = F.create_map(*[F.lit(x) for kv in SCHEMES.items() for x in kv])
    return F.struct(F.try_element_at(kinds, F.lower(F.regexp_extract(u, r"^([A-Za-z]+)(?:\+[a-z0-9]+)?://", 1))).alias("kind"), F.regexp_extract(u, r"^[^:]*://(.*)$", 1).alias("location"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with the format and size of ``image_headers``."""
    return image_headers(spark.read.format("binaryFile").load(path).select("path", "length", "content"))


def image_headers(rows: DataFrame) -> DataFrame:
    """(path, length, content) with the format and size that the first bytes give; ``format`` is null where they are no image."""
    head = lambda a, n: F.hex(F.substring("content", a, n))
    png = head(1, 8) == "89504E470D0A1A0A"
    number = lambda a, n: F.conv(head(a, n), 16, 10).cast("int")
    return rows.select(
        "path", "length", F.when(png, "png").when(head(1, 3) == "FFD8FF", "jpeg").alias("format"), F.when(png, number(17, 4)).alias("width"), F.when(png, number(21, 4)).alias("height"), "content"
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line): non-blank lines numbered within their file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    rows = rows.where(F.trim("line") != "")
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("seq"), "line")


def detection_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``image <tab> JSON list``: file, seq, image, n, text, unreadable and the bounding box of the points."""
    items = F.from_json(F.split_part("line", F.lit("\t"), F.lit(2)), "array<struct<transcription:string,points:array<array<double>>,difficult:boolean>>")
    rows = _lines(spark, path).select("file", "seq", F.split_part("line", F.lit("\t"), F.lit(1)).alias("image"), F.posexplode(items).alias("n", "i"))
    at = lambda k: F.transform("i.points", lambda p: F.get(p, k))
    return rows.select(
        "file", "seq", "image", "n", F.col("i.transcription").alias("text"), ((F.col("i.transcription") == UNREADABLE) | F.coalesce("i.difficult", F.lit(False))).alias("unreadable"),
        F.array_min(at(0)).alias("x1"), F.array_min(at(1)).alias("y1"), F.array_max(at(0)).alias("x2"), F.array_max(at(1)).alias("y2"),
    )


def recognition_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``image <tab> text``: file, seq, image, text."""
    return _lines(spark, path).select("file", "seq", F.split_part("line", F.lit("\t"), F.lit(1)).alias("image"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("text"))


def quad_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines of eight numbers and a text that may hold commas; unreadable ones are left out. file, seq, text, box."""
    parts = F.split("line", ",", 9)
    xy = lambda ks: F.array(*[F.get(parts, k).try_cast("double") for k in ks])
    xs, ys = xy(range(0, 8, 2)), xy(range(1, 8, 2))
    rows = _lines(spark, path).withColumn("line", F.regexp_replace("line", "^﻿", "")).select(
        "file", "seq", F.get(parts, 8).alias("text"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )
    return rows.where(F.col("text").isNotNull() & (F.col("text") != UNREADABLE))


def annotations(spark: SparkSession, path: str, split: str | None = "eval") -> DataFrame:
    """Annotation files (one JSON object each), of one split if given."""
    rows = spark.read.json(path, schema=ANNOTATION, multiLine=True)
    return rows if split is None else rows.where(F.col("split") == split)
