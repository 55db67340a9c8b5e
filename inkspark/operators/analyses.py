"""Analyses of jobs: fields that a job takes over, revisions with their corrections, ids that stay, runs of a reader, and the states of a run.

An analysis is one row: job_id, image_id, revision, created_at, and what each stage found. Everything is keyed by job (and photo); what
depends on order folds the few rows of one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.geometry import valid_box
from inkspark.functions.text import normalize
from inkspark.functions.values import json_text
from inkspark.operators.broadcasts import small
from inkspark.operators.ordering import sized_slices
from inkspark.operators.validate import violations
from inkspark.sources.scratch import written

# The fields of a welding condition, what an approval and an export need, who approves by rule.
CONDITION_FIELDS = ("joint_type", "process", "position", "current_a", "voltage_v", "speed_cm_min")
REQUIRED_FOR_APPROVAL = ("assembly_path", "marking", "welding_condition")
REQUIRED_FOR_EXPORT = ("assembly_path", "marking", "welding_condition", "confidence", "approved_by")
AUTO_APPROVER = "auto"
ERROR_CHARS = 1000
SLICE_BYTES = 1 << 30
DICTIONARY_BYTES = 1 << 20  # Parquet's default for the dictionary page of a column


# --- job fields ----------------------------------------------------------------------


def job_fields(analyses: DataFrame) -> DataFrame:
    """The columns that a job takes from an analysis, beside it: status, path, condition, interpretation.

    ``analyses``: passed, corrections map<string,string>, assembly_path, condition (struct), reader_interpretation, meanings array<string>.
    Corrected values come first; without a reader the meanings of the matches are the interpretation.
    """
    fixed = lambda target, value: F.coalesce(F.nullif(F.try_element_at("corrections", F.lit(target)), F.lit("")), value)
    said = F.coalesce(F.col("reader_interpretation"), F.array_join(F.filter("meanings", lambda m: m != ""), ", "))
    return analyses.select(
        "*",
        F.when(F.coalesce("passed", F.lit(False)), "awaiting_approval").otherwise("needs_review").alias("status"),
        fixed("part", F.col("assembly_path")).alias("job_path"),
        F.when(F.col("condition").isNotNull(), F.struct(*[F.col(f"condition.{f}").alias(f) for f in CONDITION_FIELDS if f in analyses.schema["condition"].dataType.names])).alias("job_condition"),
        fixed("interpretation", said).alias("interpretation"),
    )


def merged_job(jobs: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """Jobs with the named columns of their analysis, and the progress columns cleared; jobs without one stay as they are."""
    new = fields.select("job_id", *[F.col(n).alias(f"new_{n}") for n in names], F.lit(True).alias("has_new"))
    rows = jobs.join(new, "job_id", "left")
    has = F.coalesce("has_new", F.lit(False))
    cleared = ("analysis_error", "analysis_stage", "analysis_stage_at")
    cols = [F.when(has, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.when(~has, F.col(c)).alias(c) if c in cleared else F.col(c) for c in jobs.columns]
    return rows.select(*cols)


def raw_text(boxed: DataFrame, unplaced: DataFrame, keys: list[str]) -> DataFrame:
    """The text of a photo: readings in reading order (``line``, ``position``, value), then those without a place in their order."""
    rows = boxed.select(*keys, F.lit(0).alias("late"), F.col("position").cast("long").alias("n"), "value").unionByName(unplaced.select(*keys, F.lit(1).alias("late"), F.col("seq").cast("long").alias("n"), "value"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("late", "n", "value"))), lambda r: r.value)
    return rows.groupBy(*keys).agg(F.array_join(texts, " ").alias("raw_text"))


def context_input(jobs: DataFrame, entries: DataFrame, nodes: DataFrame, standards: DataFrame, key: str = "workspace_id", shown: dict[str, Column] | None = None) -> DataFrame:
    """One row per job with everything that its interpretation reads: the workspace's dictionary, tree and the standards, each in order.

    The lists are per workspace; they are small reference data and are joined by their key. ``shown`` names columns derived from
    ``symbols``, ``tree`` and ``standards``, to have in their place: they are computed once for each workspace, not for each job.

    The output grows with jobs times entries, but repeats a workspace's lists. Jobs of a workspace stand together, in slices of about ``SLICE_BYTES``
    with few workspaces each, so that Parquet writes lists that fit its dictionary page once for each slice, and not for each job.
    """
    listed = lambda df, name, cols: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *cols))), lambda r: F.struct(*[r[c].alias(c) for c in cols])).alias(name))
    rules = standards.agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in standards.columns if c != "seq"]))).alias("standards"))
    asked = jobs.select(key).distinct()
    spaces = asked.join(listed(entries, "symbols", ["code", "meaning"]), key, "left").join(listed(nodes, "tree", ["path"]), key, "left").crossJoin(F.broadcast(rules))
    if shown is not None:
        spaces = spaces.select(key, *[c.alias(n) for n, c in shown.items()])
    spaces = written(spaces, "workspaces").withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    sizes = spaces.select("_key", F.octet_length(F.to_json(F.struct(*spaces.columns))).cast("long").alias("size"))
    told = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(sizes, same).agg(F.sum(F.col("n") * F.col("size")).alias("out"), F.sum("size").alias("once")).first()
    slices = max(1, -(-(told.out or 0) // SLICE_BYTES), -(-2 * (told.once or 0) // DICTIONARY_BYTES))
    placed = jobs.repartitionByRange(slices, key, F.xxhash64(*jobs.columns)).sortWithinPartitions(key)  # a number given is kept as it is
    return placed.join(small(spaces, 64 << 20), same, "left").drop("_key")


def manual_condition(values: DataFrame, standards: DataFrame, fields: tuple[str, ...] = CONDITION_FIELDS) -> DataFrame:
    """Conditions that a person gave, with ``standard_matched``: whether some standard has all the same values (nulls equal nulls)."""
    known = standards.select(*fields).distinct().withColumn("standard_matched", F.lit(True)).alias("s")
    v = values.alias("v")
    same = [F.col(f"v.{f}").eqNullSafe(F.col(f"s.{f}")) for f in fields]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return v.join(known, cond, "left").select("v.*", F.coalesce("s.standard_matched", F.lit(False)).alias("standard_matched"), F.lit("manual").alias("source"))


# --- revisions -----------------------------------------------------------------------------


def revision_chain(reviews: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, revision, target, value, previous, position): the corrections of every revision, piled up.

    ``reviews``: keys, seq, target, value, in one revision each; revision 1 is the first analysis, so that the n-th review makes
    revision n + 1. A corrected target keeps its first position and takes the last value; ``previous`` is the value before that
    correction: an earlier one, else what the analysis had (``current``: keys, target, value).
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    numbered = reviews.withColumn("revision", F.row_number().over(w) + 1)
    before = Window.partitionBy(*keys, "target").orderBy("seq")
    numbered = numbered.withColumn("earlier", F.lag("value").over(before)).withColumn("first", F.min("seq").over(Window.partitionBy(*keys, "target")))
    had = current.select(*keys, "target", F.col("value").alias("had"))
    rows = numbered.join(had, [*keys, "target"], "left").withColumn("previous", F.coalesce("earlier", "had")).withColumn("until", F.lead("revision").over(Window.partitionBy(*keys, "target").orderBy("revision")))
    last = rows.groupBy(*keys).agg(F.max("revision").alias("last"))
    spread = rows.join(last, keys).withColumn("revision", F.explode(F.sequence("revision", F.coalesce(F.col("until") - 1, F.col("last")))))
    return spread.select(*keys, "revision", "target", "value", "previous", F.dense_rank().over(Window.partitionBy(*keys, "revision").orderBy("first")).alias("position"))


def flow_errors(first: DataFrame, second: DataFrame) -> DataFrame:
    """(job_id, errors): what is wrong between a revision and the next one of a job.

    Columns: job_id, workspace_id, project_id, image_id, revision, vision, status.
    """
    names = ("workspace_id", "project_id", "image_id", "revision", "vision", "status")
    a = first.select("job_id", *[F.col(c).alias(f"a_{c}") for c in names])
    b = second.select("job_id", *[F.col(c).alias(f"b_{c}") for c in names])
    rules = {
        "workspace_changed": F.col("a_workspace_id").eqNullSafe(F.col("b_workspace_id")),
        "project_changed": F.col("a_project_id").eqNullSafe(F.col("b_project_id")),
        "image_changed": F.col("a_image_id").eqNullSafe(F.col("b_image_id")),
        "revision_number": F.col("b_revision") == F.col("a_revision") + 1,
        "vision_changed": F.col("a_vision").eqNullSafe(F.col("b_vision")),
        "status_order": (F.col("a_status") == "needs_review") & (F.col("b_status") == "awaiting_approval"),
    }
    return a.join(b, "job_id").select("job_id", violations(rules).alias("errors"))


def correction_errors(corrections: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections with ``error``: unknown_target, empty_value, unknown_ref or null. ``known``: keys, ref_id of the analysis."""
    refs = known.select(*keys, F.col("ref_id").alias("target"), F.lit(True).alias("there")).distinct()
    is_ref = F.col("target").rlike("^[tsv][0-9]+$")
    names = ("part", "welding_condition", "interpretation", "cell", "leg_lengths")
    error = F.when(~is_ref & ~F.col("target").isin(*names), "unknown_target").when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty_value").when(is_ref & F.col("there").isNull(), "unknown_ref")
    return corrections.join(refs, [*keys, "target"], "left").withColumn("error", error).drop("there")


# --- runs of a second reader -----------------------------------------------------------------


def parsed_response(text: Column | str, schema: str) -> Column:
    """struct(data, error) of a reader's answer: a fence around the JSON is cut off; ``no_json``, ``no_interpretation`` or null."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    bare = F.when(t.startswith("```"), F.regexp_replace(t, r"(?s)^```[^\n]*\n(.*)```.*$", "$1")).otherwise(t)
    data = F.from_json(bare, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    error = F.when(data.isNull() | data["_broken"].isNotNull() | ~F.trim(bare).startswith("{"), "no_json").when(data.interpretation.isNull(), "no_interpretation")
    return F.struct(F.when(error.isNull(), data).alias("data"), error.alias("error"))


def reading_key(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reading_key): a run's items without order and places; ids that only the second reader has count as ``v``."""
    ref = F.when(F.col("ref_id").startswith("v"), "v").otherwise(F.col("ref_id"))
    return items.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", ref, normalize("value")))), ";").alias("reading_key"))


def reader_probability(token_prob: Column, consistency: Column) -> Column:
    """Token probability, else consistency, else 0.5."""
    return F.coalesce(token_prob, consistency, F.lit(0.5))


def mean_probability(log_probs: Column) -> Column:
    """The geometric mean of token probabilities from their logarithms, four digits; null without tokens."""
    total = F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(log_probs) > 0, F.bround(F.exp(total / F.size(log_probs)), 4))


def stable_ids(items: DataFrame, previous: DataFrame, known: DataFrame, echoes: DataFrame, keys: list[str]) -> DataFrame:
    """Second readings with their ids: a first-reader id once, else the id that the same marking had before, else the smallest free v.

    ``items``: keys, seq, ref_id, kind, value, has_box. ``previous``: keys, seq, ref_id, kind, value of the revision before (v ids; of several for
    one marking the last counts, and only its number is taken). ``known``:
    keys, ref_id of the first reader. ``echoes``: keys, kind, value that a person gave: an item without a box that repeats one is dropped.
    """
    rows = items.where(F.trim("value") != "").withColumn("norm", normalize("value"))
    there = known.select(*keys, "ref_id", F.lit(True).alias("is_known")).distinct()
    rows = rows.join(there, [*keys, "ref_id"], "left")
    told = echoes.select(*keys, "kind", normalize("value").alias("norm"), F.lit(True).alias("echo")).distinct()
    rows = rows.join(told, [*keys, "kind", "norm"], "left").where("is_known OR has_box OR echo IS NULL").drop("echo")
    first = F.row_number().over(Window.partitionBy(*keys, "ref_id").orderBy("seq")) == 1
    rows = rows.withColumn("own", F.when(F.col("is_known") & first, F.col("ref_id")))
    old = previous.where(F.col("ref_id").startswith("v")).groupBy(*keys, "kind", normalize("value").alias("norm")).agg(F.max_by("ref_id", "seq").alias("old"))
    rows = rows.join(old, [*keys, "kind", "norm"], "left")
    again = F.row_number().over(Window.partitionBy(*keys, "old", F.col("own").isNull()).orderBy("seq"))
    rows = rows.withColumn("new_id", F.coalesce("own", F.when(F.col("old").isNotNull() & (again == 1), F.col("old"))))
    # new ids: the n-th free number for the n-th item that needs one
    nth = F.row_number().over(Window.partitionBy(*keys, F.col("new_id").isNull()).orderBy("seq"))
    rows = rows.withColumn("nth", F.when(F.col("new_id").isNull(), nth))
    used = old.groupBy(*keys).agg(F.collect_set(F.substring("old", 2, 18).cast("int")).alias("used"))
    rows = rows.join(used, keys, "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.size("used") + F.coalesce("nth", F.lit(1))), "used")
    return rows.select(*keys, "seq", "kind", "value", F.coalesce("new_id", F.concat(F.lit("v"), F.get(free, F.col("nth") - 1).cast("string"))).alias("ref_id"), F.col("ref_id").alias("said"))


def resolved(items: DataFrame, previous: DataFrame, known: DataFrame, echoes: DataFrame, meanings: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, kind, value, ref_id, box, meaning: a second reader's answer with ids as ``stable_ids``, boxes of the original image and the meanings
    that it gave, which name its own temporary ids.

    ``items``: as there, with box array<double> instead of has_box. ``meanings``: keys, seq, ref_id, meaning; the last of an id counts. ``sizes``: keys,
    width, height, scale_x, scale_y from the image that was sent to the original. A box that isn't four numbers from 0 on is null.
    """
    boxed = items.withColumn("has_box", valid_box(F.col("box")))
    ids = stable_ids(boxed.drop("box"), previous, known, echoes, keys)
    box = lambda i, scale, most: F.least(F.bround(F.col("box")[i] * F.col(scale)), F.col(most).cast("double"))
    same = (F.col("scale_x") == 1) & (F.col("scale_y") == 1)
    moved = F.when(same, F.col("box")).otherwise(F.array(box(0, "scale_x", "width"), box(1, "scale_y", "height"), box(2, "scale_x", "width"), box(3, "scale_y", "height")))
    rows = ids.join(boxed.select(*keys, "seq", "box", "has_box"), [*keys, "seq"]).join(sizes, keys).withColumn("box", F.when(F.col("has_box"), moved))
    named = ids.where("said <> ref_id").groupBy(*keys, F.col("said").alias("ref_id")).agg(F.max_by("ref_id", "seq").alias("now"))
    told = meanings.where("trim(meaning) <> ''").join(named, [*keys, "ref_id"], "left").groupBy(*keys, F.coalesce("now", "ref_id").alias("ref_id")).agg(F.trim(F.max_by("meaning", "seq")).alias("meaning"))
    return rows.join(told, [*keys, "ref_id"], "left").select(*keys, "seq", "kind", "value", "ref_id", "box", "meaning")


def kept_corrected(resolved: DataFrame, previous: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Resolved items and the corrected v ids of the revision before that this run didn't read again."""
    wanted = previous.where(F.col("ref_id").startswith("v")).join(corrections.select(*keys, F.col("target").alias("ref_id")).distinct(), [*keys, "ref_id"], "left_semi")
    lost = wanted.join(resolved.select(*keys, "ref_id"), [*keys, "ref_id"], "left_anti")
    cols = [*keys, "ref_id", "kind", "value"]
    return resolved.select(*cols, F.lit(False).alias("kept")).unionByName(lost.select(*cols, F.lit(True).alias("kept")))


def last_reader_error(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error): the error of the last run that the reader took part in; cleared by a success. ``outcome``: failed, ok or disabled."""
    real = runs.where("outcome <> 'disabled'")
    return real.groupBy(*keys).agg(F.max_by(F.struct(F.when(F.col("outcome") == "failed", F.col("error")).alias("error")), "seq").alias("r")).select(*keys, "r.error")


# --- running and approving ---------------------------------------------------------------------


def photo_runs(runs: DataFrame) -> DataFrame:
    """(job_id, stored, status, error): the photos of a job in order; earlier failures are passed over, the last photo decides.

    ``runs``: job_id, position, ok, status, error, before (the job's status before the run).
    """
    g = runs.groupBy("job_id").agg(F.count_if("ok").alias("stored"), F.max_by(F.struct("ok", "status", "error", "before"), "position").alias("last"))
    return g.select("job_id", "stored", F.when(F.col("last.ok"), F.col("last.status")).otherwise(F.col("last.before")).alias("status"), F.when(~F.col("last.ok"), F.substring(F.col("last.error"), 1, ERROR_CHARS)).alias("error"))


def stage_changes(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The stage events that change something: those during an analysis whose stage isn't the one before.

    ``events``: keys, event (start, stage, end), stage. A start sets its stage.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event") != "stage", F.col("event")), ignorenulls=True).over(upto)
    rows = events.withColumn("running", F.coalesce(last == "start", F.lit(False)))
    rows = rows.where("running AND event IN ('start', 'stage')")
    before = F.lag("stage").over(w)
    return rows.withColumn("before", before).where((F.col("event") == "start") | ~F.col("stage").eqNullSafe(F.col("before"))).drop("running", "before")


def approvals(requests: DataFrame, jobs: DataFrame, order: list[str]) -> DataFrame:
    """Requests to approve with ``outcome``: approved (the first valid one of a job), not_acknowledged, wrong_status or not_found.

    ``requests``: job_id, acknowledge. ``jobs``: job_id, status.
    """
    requests = requests.transform(sized_slices, "job_id")  # the sorts below hold a slice of at most some rows, however many there are
    rows = requests.join(jobs.select("job_id", "status"), "job_id", "left")
    valid = (F.col("status") == "awaiting_approval") | ((F.col("status") == "needs_review") & F.col("acknowledge"))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    earlier = F.coalesce(F.max(F.col("valid").cast("int")).over(Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcome = F.when(F.col("status").isNull(), "not_found").when((earlier == 1) | ~F.col("status").isin("awaiting_approval", "needs_review"), "wrong_status").when(F.col("valid"), "approved").otherwise("not_acknowledged")
    return rows.withColumn("outcome", outcome).drop("valid", "status")


def auto_completed(jobs: DataFrame) -> DataFrame:
    """Jobs after a new analysis: an earlier approval is void; one that awaits approval with all required values is approved by rule."""
    whole = F.lit(True)
    for name in REQUIRED_FOR_APPROVAL:
        whole = whole & F.col(name).isNotNull()
    done = (F.col("status") == "awaiting_approval") & whole
    return jobs.withColumn("approved_by", F.when(done, AUTO_APPROVER)).withColumn("status", F.when(done, "approved").otherwise(F.col("status")))


def robot_export(jobs: DataFrame, columns: list[str]) -> DataFrame:
    """(job_id, document, error): the export of approved jobs with all required values as JSON; else why there is none."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_FOR_EXPORT]))
    error = F.when(F.col("status") != "approved", F.concat(F.lit("not approved: "), "status")).when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    doc = F.struct("job_id", *columns, F.lit(True).alias("approved"), "approved_by")
    return jobs.select("job_id", F.when(error.isNull(), json_text(doc)).alias("document"), error.alias("error"))
