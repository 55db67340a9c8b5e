"""Interpretation of a photo's readings: which value counts, what is known, the part, leg lengths, cell features and conflicts.

Tables of one photo each row: ``readings`` (keys, ref_id, seq, kind ``text`` or ``symbol``, value, prob, candidates array<struct<text,prob>>),
``corrections`` (keys, target, value, meaning), ``second`` (keys, ref_id, seq, kind, value: what a second reader saw), ``matches`` (the
dictionary's answers: keys, ref_id, seq, raw, code, meaning, match, score). ``keys`` name a photo and its workspace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.text import CODE_VALUE, DIMENSION, PART_LIKE, POSITION, normalize, ocr_variants, plausible_leg, read_thickness, suffix
from inkspark.functions.values import short_number
from inkspark.operators import folds, tree
from inkspark.operators.lookup import RIVAL_MARGIN, keyed
from inkspark.sources.scratch import written

# The probability under which a second reader is preferred, that of a corrected reading, the cell features in order.
TRUSTED, CORRECTED_PROB = 0.9, 1.0
CELL_FEATURES = ("slit", "slot", "collar_front", "collar_back", "scallop")

_CANDIDATES = "array<struct<text:string,prob:double>>"


def first_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


# --- what is known -------------------------------------------------------------------


def known_values(values: DataFrame, entries: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, known) of distinct values: a plate thickness, or one of the value's forms is a code, an alias, a text code with a
    plausible number, or a tree node."""
    distinct = written(values.select(*keys, "value").distinct(), "values")  # readings repeat: few rows, read five times
    forms = distinct.select(*keys, "value", read_thickness("value").isNotNull().alias("thick"), F.explode(F.concat(F.array(normalize("value")), ocr_variants("value"))).alias("form"))
    dictionary = keyed(entries, keys)
    whole = dictionary.select(*keys, F.col("key").alias("form"))
    own = tree.index(nodes, keys).select(*keys, F.col("key").alias("form"))
    plain = forms.withColumn("form", F.explode(F.array_distinct(F.array("form", F.replace("form", F.lit("-"), F.lit(""))))))
    hit = forms.join(whole, [*keys, "form"], "left_semi").select(*keys, "value").unionByName(plain.join(own, [*keys, "form"], "left_semi").select(*keys, "value"))
    letters = forms.select(*keys, "value", F.regexp_extract("form", CODE_VALUE, 1).alias("key"), F.regexp_extract("form", CODE_VALUE, 2).alias("digits")).where("key <> ''")
    texts = dictionary.where("how = 'exact' AND entry.kind = 'text'").select(*keys, "key", F.col("entry.is_leg").alias("is_leg"))
    valued = letters.join(texts, [*keys, "key"]).where(~F.col("is_leg") | plausible_leg("digits").isNotNull()).select(*keys, "value")
    hits = hit.unionByName(valued).unionByName(forms.where("thick").select(*keys, "value")).distinct().withColumn("known", F.lit(True))
    return distinct.join(hits, [*keys, "value"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def prefers_second(prob: Column, second: Column, first_known: Column, second_known: Column) -> Column:
    """Whether a second reading replaces the first: only it is known, or the first is improbable and no better known."""
    return (second != "unknown") & ((second_known & ~first_known) | ((prob < TRUSTED) & (second_known | ~first_known)))


# --- readings -------------------------------------------------------------------------


def collected(readings: DataFrame, corrections: DataFrame, second: DataFrame, known: DataFrame, keys: list[str], dict_keys: list[str]) -> DataFrame:
    """All readings with the value that counts: correction, then preferred second reading, then the first.

    ``second`` also has ``second_prob``; ``known`` is (dict_keys, value, known). Adds corrected, meaning, second_used and first_value, and the
    rows that only the second reader saw (ids with v), behind the others.
    """
    place = F.when(F.col("kind") == "text", 0).otherwise(1)
    seen = readings.select(*keys, *[k for k in dict_keys if k not in keys], "ref_id", "kind", "value", "prob", "candidates", F.struct(place.alias("group"), "seq").alias("place"))
    more = second.where(F.col("ref_id").startswith("v"))
    only = more.select(*keys, *[k for k in dict_keys if k not in keys], "ref_id", "kind", "value", F.col("second_prob").alias("prob"), F.array().cast(_CANDIDATES).alias("candidates"), F.struct((place + 2).alias("group"), "seq").alias("place"))
    rows = seen.unionByName(only)
    fixed = corrections.select(*keys, F.col("target").alias("ref_id"), F.col("value").alias("fixed"), "meaning", F.lit(True).alias("is_fixed"))
    other = second.where(~F.col("ref_id").startswith("v")).select(*keys, "ref_id", F.col("value").alias("other"), "second_prob")
    rows = rows.join(fixed, [*keys, "ref_id"], "left").join(other, [*keys, "ref_id"], "left")
    for name in ("value", "other"):
        rows = rows.join(known.select(*dict_keys, F.col("value").alias(name), F.col("known").alias(f"{name}_known")), [*dict_keys, name], "left")
    corrected = F.coalesce("is_fixed", F.lit(False))
    differs = normalize("other") != normalize("value")
    use = F.coalesce(~corrected & differs & prefers_second(F.col("prob"), F.col("other"), F.coalesce("value_known", F.lit(False)), F.coalesce("other_known", F.lit(False))), F.lit(False))
    rows = rows.withColumn("second_used", use)
    first = F.array(F.struct(F.col("value").alias("text"), F.col("prob").alias("prob")))
    rest = F.filter(F.coalesce("candidates", F.array().cast(_CANDIDATES)), lambda c: normalize(c.text) != normalize("other"))
    return rows.select(
        *keys, *[k for k in dict_keys if k not in keys], "ref_id", "kind", "place",
        F.when(corrected, F.col("fixed")).when(F.col("second_used"), F.col("other")).otherwise(F.col("value")).alias("value"),
        F.when(corrected, F.lit(CORRECTED_PROB)).when(F.col("second_used"), F.col("second_prob")).otherwise(F.col("prob")).alias("prob"),
        F.when(corrected, F.array().cast(_CANDIDATES)).when(F.col("second_used"), F.concat(first, rest).cast(_CANDIDATES)).otherwise(F.coalesce("candidates", F.array().cast(_CANDIDATES))).alias("candidates"),
        corrected.alias("corrected"), "meaning", "second_used", F.when(F.col("second_used"), F.col("value")).alias("first_value"),
    )


def marked_used(second: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """The second reader's rows with ``used``: whether theirs is the value that counts."""
    used = readings.where("second_used").select(*keys, "ref_id", F.lit(True).alias("used")).distinct()
    return second.drop("used").join(used, [*keys, "ref_id"], "left").withColumn("used", F.coalesce("used", F.lit(False)))


def segmented(readings: DataFrame, entries: DataFrame, nodes: DataFrame, keys: list[str], dict_keys: list[str]) -> DataFrame:
    """Text lines cut into markings: a known line stays, else neighbouring words that are known together (up to three) are joined.

    Adds ``line`` (the whole line) and ``piece`` (its number); cut pieces have no candidates.
    """
    # readings repeat: a line is cut once for each distinct one of a dictionary
    words = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    several = readings.where("kind = 'text'").select(*dict_keys, "value").distinct().withColumn("words", words).where(F.size("words") > 1)
    several = written(several, "lines")
    spans = lambda k: F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.array_join(F.slice("words", i, k), " "))).otherwise(F.array().cast("array<string>"))
    asked = several.select(*dict_keys, F.explode(F.concat(F.array("value"), spans(2), spans(3))).alias("value"))
    known = known_values(asked, entries, nodes, dict_keys).where("known").select(*dict_keys, F.col("value").alias("span"))
    mine = several.select(*dict_keys, "value", F.explode(F.concat(F.array("value"), spans(2), spans(3))).alias("span"))
    lists = mine.join(known, [*dict_keys, "span"]).groupBy(*dict_keys, "value").agg(F.collect_set("span").alias("spans"))  # the spans of one line
    lines = several.join(lists, [*dict_keys, "value"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<string>")))
    lines = lines.where(~F.array_contains("spans", F.col("value"))).select(*dict_keys, "value", F.lit("text").alias("kind"), folds.segments(F.col("words"), F.col("spans")).alias("cut"))
    rows = readings.join(written(lines, "cuts"), [*dict_keys, "kind", "value"], "left")
    out = rows.withColumn("line", F.col("value")).select("*", F.posexplode(F.coalesce("cut", F.array("value"))).alias("piece", "text"))
    out = out.withColumn("value", F.col("text")).withColumn("candidates", F.when(F.col("cut").isNotNull(), F.array().cast(_CANDIDATES)).otherwise(F.col("candidates")))
    return out.drop("cut", "text")


# --- the part --------------------------------------------------------------------------


def part_of(photos: DataFrame, readings: DataFrame, nodes: DataFrame, corrections: DataFrame, keys: list[str], tree_keys: list[str]) -> DataFrame:
    """One part per photo: the corrected path, else the deepest tree node that a reading names, else a reading that looks like a
    part's number, else the path that the job names, else nothing.

    ``photos``: keys, tree_keys, job_path. Adds source (correction, tree, part_like, job, none), found_in_tree, ref_ids, and ``conflict``: ambiguous
    (readings of other branches), repaired, not_in_tree or null.
    """
    texts = readings.where("kind = 'text'")
    hits = tree.hits(texts, nodes, keys, tree_keys)
    best = tree.best_part(hits, keys).select(*keys, F.struct("node_id", "assembly_path", "level", "ref_ids", "other_ref_ids").alias("hit"))
    own = hits.where("fixed IS NOT NULL").join(best.select(*keys, F.col("hit.assembly_path").alias("own_path")), keys)
    repaired = own.where(tree.on_path(F.col("node.path"), F.col("own_path"))).select(*keys, F.lit(True).alias("repaired")).distinct()
    fixed = corrections.where("target = 'part'").select(*keys, F.col("value").alias("fixed_path"))
    like = first_by(texts.where(normalize("value").rlike(PART_LIKE)).select(*keys, "value", "ref_id", "seq"), keys, "seq").select(*keys, F.struct("value", "ref_id").alias("like"))
    rows = photos
    for more in (fixed, best, like, repaired):
        rows = rows.join(more, keys, "left")
    rows = rows.withColumn("path", F.coalesce("fixed_path", F.when(F.col("hit").isNull() & F.col("like").isNull(), F.col("job_path"))))
    at = first_by(nodes.select(*tree_keys, "path", "seq", F.col("node_id").alias("own_id"), F.col("level").alias("own_level")), [*tree_keys, "path"], "seq").drop("seq")
    rows = rows.join(at, [*tree_keys, "path"], "left")
    on = hits.select(*keys, "ref_id", "seq", F.col("node.path").alias("node_path")).join(fixed, keys).where(tree.on_path(F.col("node_path"), F.col("fixed_path")))
    refs = on.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("seq", "ref_id"))).alias("r")).select(*keys, F.array_distinct(F.transform("r", lambda x: x.ref_id)).alias("fixed_refs"))
    rows = rows.join(refs, keys, "left")
    source = F.when(F.col("fixed_path").isNotNull(), "correction").when(F.col("hit").isNotNull(), "tree").when(F.col("like").isNotNull(), "part_like").when(F.col("job_path").isNotNull(), "job").otherwise("none")
    rows = rows.withColumn("source", source)
    named, none = F.col("source").isin("correction", "job"), F.array().cast("array<string>")
    pick = lambda mine, hit, like: F.when(named, mine).when(F.col("source") == "tree", hit).when(F.col("source") == "part_like", like)
    null = F.lit(None).cast("string")
    found = F.when(named, F.col("own_id").isNotNull()).otherwise(F.col("source") == "tree")
    return rows.select(
        *keys, "source",
        pick(F.coalesce("own_id", suffix("path")), F.col("hit.node_id"), F.col("like.value")).alias("node_id"),
        pick(F.col("path"), F.col("hit.assembly_path"), null).alias("assembly_path"),
        pick(F.col("own_level"), F.col("hit.level"), null).alias("level"),
        found.alias("found_in_tree"),
        F.coalesce(pick(F.when(F.col("source") == "correction", F.col("fixed_refs")), F.col("hit.ref_ids"), F.array("like.ref_id")), none).alias("ref_ids"),
        F.when(F.col("source") == "tree", F.when(F.size("hit.other_ref_ids") > 0, "ambiguous").when(F.col("repaired"), "repaired"))
        .when((F.col("source") == "part_like") | ((F.col("source") == "job") & ~found), "not_in_tree").alias("conflict"),
    )


# --- dictionary: joint types, positions, legs, cells, conflicts ----------------------------


def joint_marks(matches: DataFrame, entries: DataFrame, keys: list[str], dict_keys: list[str]) -> DataFrame:
    """(keys, joint_type, top_score, first_seq, ref_ids) of the matches whose entry has a joint type."""
    types = entries.where("joint_type IS NOT NULL").groupBy(*dict_keys, "code").agg(F.max_by("joint_type", "seq").alias("joint_type"))
    found = matches.join(types, [*dict_keys, "code"])
    return found.groupBy(*keys, "joint_type").agg(F.max("score").alias("top_score"), F.min("seq").alias("first_seq"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "ref_id"))), lambda r: r.ref_id).alias("ref_ids"))


def position_marks(matches: DataFrame, entries: DataFrame, keys: list[str], dict_keys: list[str]) -> DataFrame:
    """(keys, positions, ref_ids): welding positions named by the meanings of matched entries."""
    found = F.regexp_extract_all("meaning", F.lit(POSITION), F.lit(1))
    named = entries.groupBy(*dict_keys, "code").agg(F.max_by("meaning", "seq").alias("meaning")).select(*dict_keys, "code", found.alias("p")).where(F.size("p") > 0)
    rows = matches.join(named, [*dict_keys, "code"])
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("positions"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "ref_id"))), lambda r: r.ref_id).alias("ref_ids"))


def leg_fix(code: Column, digits: Column) -> Column:
    """A leg marking with its lost decimal point restored; null if there is nothing to restore."""
    fixed = plausible_leg(digits)
    return F.when(fixed != digits, F.concat(code, fixed))


def implausible_leg(digits: Column) -> Column:
    """The size of a leg marking that no restored point makes plausible, else null."""
    return F.when(plausible_leg(digits).isNull(), digits.try_cast("double"))


def seen_by_second(second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, size_mm): codes with a number anywhere in the second reader's texts."""
    found = F.regexp_extract_all(normalize("value"), F.lit(r"([A-Z]+[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    rows = second.where("kind = 'text'").select(*keys, F.explode(found).alias("m"))
    return rows.select(*keys, F.regexp_extract("m", "^([A-Z]+)", 1).alias("code"), F.regexp_extract("m", r"([0-9.]+)$", 1).cast("double").alias("size_mm")).distinct()


def leg_lengths(pairs: DataFrame, entries: DataFrame, second: DataFrame, attached: DataFrame, keys: list[str], dict_keys: list[str]) -> DataFrame:
    """(keys, ref_id, seq, code, size_mm, raw_text, meaning, used): leg markings among the matches.

    One that only the first reader saw counts only if the second reader, where it saw the photo (``attached``: keys), has it too. ``pairs`` are
    matches with ``corrected``.
    """
    legs = entries.groupBy(*dict_keys, "code").agg(F.max_by(F.struct("meaning", "is_leg"), "seq").alias("e")).where("e.is_leg")
    raw = normalize("raw")
    rows = pairs.where("match <> 'none'").join(legs, [*dict_keys, "code"]).where(raw.rlike(CODE_VALUE))
    rows = rows.withColumn("size_mm", F.regexp_extract(raw, CODE_VALUE, 2).cast("double"))
    have = seen_by_second(second, keys).withColumn("seen", F.lit(True))
    rows = rows.join(have, [*keys, "code", "size_mm"], "left").join(attached.select(*keys).distinct().withColumn("looked", F.lit(True)), keys, "left")
    first_only = F.col("ref_id").startswith("t") & ~F.col("corrected")
    return rows.select(
        *keys, "ref_id", "seq", "code", "size_mm", raw.alias("raw_text"), F.trim(F.substring_index("e.meaning", "(", 1)).alias("meaning"),
        (~(first_only & F.coalesce("looked", F.lit(False)) & F.col("seen").isNull())).alias("used"),
    )


def cells(pairs: DataFrame, boxes: DataFrame, second_boxes: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, ref_ids, unplaced): cell features by the side of the photo's middle on which their box lies.

    ``pairs``: keys, ref_id, seq, kind, code. ``boxes``, ``second_boxes``: keys, ref_id, x1, x2 (the second reader's win); ``sizes``: keys, width.
    """
    own = boxes.select(*keys, "ref_id", F.struct("x1", "x2").alias("own"))
    theirs = second_boxes.select(*keys, "ref_id", F.struct("x1", "x2").alias("theirs"))
    placed = own.join(theirs, [*keys, "ref_id"], "full_outer").select(*keys, "ref_id", F.coalesce("theirs", "own").alias("box"))
    rows = pairs.where((F.col("kind") == "symbol") & F.col("code").isin(*CELL_FEATURES)).join(placed, [*keys, "ref_id"], "left").join(sizes, keys)
    side = F.when(F.col("box").isNotNull(), F.when((F.col("box.x1") + F.col("box.x2")) / 2 < F.col("width") / 2, "left").otherwise("right"))
    rows = rows.withColumn("side", side)
    of = lambda name: F.collect_set(F.when(F.col("side") == name, F.col("code")))
    ordered = lambda c: F.filter(F.array(*map(F.lit, CELL_FEATURES)), lambda x: F.array_contains(c, x))
    refs = lambda cond: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", "ref_id")))), lambda r: r.ref_id))
    g = rows.groupBy(*keys).agg(of("left").alias("l"), of("right").alias("r"), refs(F.col("side").isNotNull()).alias("ref_ids"), refs(F.col("side").isNull()).alias("unplaced"))
    return g.select(*keys, ordered(F.col("l")).alias("left"), ordered(F.col("r")).alias("right"), "ref_ids", "unplaced")


def reading_keys(values: DataFrame, entries: DataFrame, dict_keys: list[str]) -> DataFrame:
    """(dict_keys, value, reading_key): the code, with the number for a code with a plausible number; values that the dictionary lacks don't appear."""
    distinct = values.select(*dict_keys, "value").where("value IS NOT NULL").distinct().withColumn("key", normalize("value"))
    dictionary = keyed(entries, dict_keys)
    whole = dictionary.groupBy(*dict_keys, "key").agg(F.min_by("entry.code", F.col("how") != "exact").alias("code"))
    texts = dictionary.where("how = 'exact' AND entry.kind = 'text'").select(*dict_keys, F.col("key").alias("letters"), F.col("entry.is_leg").alias("is_leg"))
    rows = distinct.join(whole, [*dict_keys, "key"], "left").withColumn("letters", F.regexp_extract("key", CODE_VALUE, 1)).withColumn("digits", F.regexp_extract("key", CODE_VALUE, 2))
    rows = rows.join(texts, [*dict_keys, "letters"], "left")
    number = F.when(F.col("is_leg"), plausible_leg("digits")).when(F.col("is_leg").isNotNull(), F.col("digits"))
    return rows.select(*dict_keys, "value", F.coalesce("code", F.when(number.isNotNull(), F.concat_ws(" ", "letters", short_number(number)))).alias("reading_key")).where("reading_key IS NOT NULL")


def dictionary_conflicts(pairs: DataFrame, entries: DataFrame, keys: list[str], dict_keys: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ref_id, kind, severity) and the ``carried`` columns: what a person should know about each match that isn't corrected, and readings with a rival
    candidate within ``RIVAL_MARGIN`` that the dictionary reads otherwise.

    ``pairs``: matches with the reading's value, prob, kind, candidates and corrected.
    """
    letters = entries.where("is_leg").select(*dict_keys, normalize("code").alias("letters"), F.lit(True).alias("leg")).distinct()
    norm, raw = normalize("value"), normalize("raw")
    rows = pairs.where("NOT corrected").withColumns({"norm": norm, "raw_norm": raw, "letters": F.regexp_extract(norm, CODE_VALUE, 1), "digits": F.regexp_extract(norm, CODE_VALUE, 2)})
    rows = rows.join(letters, [*dict_keys, "letters"], "left")
    leg, none = F.coalesce("leg", F.lit(False)), F.col("match") == "none"
    fixed = leg & leg_fix(F.col("letters"), F.col("digits")).isNotNull()
    what = (
        F.when(none & F.col("raw_norm").rlike(DIMENSION), None)
        .when((F.col("match") == "fuzzy") & fixed, "point_restored:warning")
        .when(none & leg & implausible_leg(F.col("digits")).isNotNull(), "implausible_leg:warning")
        .when((F.col("match") == "fuzzy") & (F.col("raw_norm") != F.col("norm")), "repaired:info")
        .when(F.col("match") == "fuzzy", "similar:info")
        .when(F.col("match") == "vlm", "second_meaning:info")
        .when(none & (F.coalesce("meaning", F.lit("")) != ""), "rule:info")
        .when(none & F.col("ref_id").startswith("v") & (F.col("reading_kind") == "symbol"), "unknown_symbol:info")
        .when(none, "unmatched:warning")
    )
    own = rows.withColumn("w", what).where("w IS NOT NULL").select(*keys, "ref_id", *carried, F.substring_index("w", ":", 1).alias("kind"), F.substring_index("w", ":", -1).alias("severity"))
    more = [c for c in ("raw", "prob", *carried) if c not in keys]
    close = rows.select(*keys, *[k for k in dict_keys if k not in keys], "ref_id", *dict.fromkeys(more), F.explode("candidates").alias("c")).where(F.col("c.prob") >= F.col("prob") - RIVAL_MARGIN)
    close = close.withColumn("said", F.col("c.text"))
    raws = close.select(*dict_keys, F.explode(F.array("said", "raw")).alias("value"))
    known = written(reading_keys(raws, entries, dict_keys), "reading-keys")
    rival = close.join(known.withColumnRenamed("value", "said"), [*dict_keys, "said"]).join(known.select(*dict_keys, F.col("value").alias("raw"), F.col("reading_key").alias("chosen")), [*dict_keys, "raw"], "left")
    rivals = rival.where(~F.col("reading_key").eqNullSafe(F.col("chosen"))).select(*keys, "ref_id", *carried).distinct()
    return own.unionByName(rivals.withColumn("kind", F.lit("rival")).withColumn("severity", F.lit("warning")))


def second_conflicts(readings: DataFrame, second: DataFrame, keys: list[str], carried: tuple[str, ...] = (), second_carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ref_id, kind, severity) and the carried columns of either: where two readers differ.

    used (the second's value counts), differ, second_only, first_only; corrected readings aren't listed.
    """
    first = readings.select(*keys, "ref_id", "value", "corrected", "second_used", *carried)
    theirs = second.select(*keys, "ref_id", F.col("value").alias("other"), F.lit(True).alias("in_second"), *second_carried)
    rows = first.join(theirs, [*keys, "ref_id"], "left").where(~F.coalesce("corrected", F.lit(False)))
    what = (
        F.when(F.col("in_second").isNull(), F.when(~F.col("ref_id").startswith("v"), "first_only:info"))
        .when(F.col("ref_id").startswith("v"), "second_only:info")
        .when(F.col("second_used"), "used:info")
        .when(normalize("other") != normalize("value"), "differ:warning")
    )
    return rows.withColumn("w", what).where("w IS NOT NULL").select(*keys, "ref_id", *carried, *second_carried, F.substring_index("w", ":", 1).alias("kind"), F.substring_index("w", ":", -1).alias("severity"))


def evidence(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, layer, severity, message): short sentences about the three scores of a photo.

    ``scores``: keys, visual, db, reasoning, recognition_prob, agreement, match_rate, part_found, conflicts, reader_failed, consistency.
    """
    pct = lambda c: F.concat(F.bround(F.col(c) * 100).cast("long").cast("string"), F.lit("%"))
    item = lambda layer, severity, message, cond: F.when(cond, F.struct(F.lit(layer).alias("layer"), severity.alias("severity") if isinstance(severity, Column) else F.lit(severity).alias("severity"), message.alias("message")))
    word = F.when(F.col("visual") < 50, "warning").otherwise("info")
    rows = F.array_compact(F.array(
        item("visual", word, F.concat(F.lit("least recognition probability "), pct("recognition_prob")), F.col("recognition_prob").isNotNull()),
        item("visual", "info", F.concat(F.lit("readers agree in "), pct("agreement")), F.col("agreement").isNotNull()),
        item("db", "info", F.concat(F.lit("matched by rule "), pct("match_rate")), F.col("match_rate").isNotNull()),
        item("db", "warning", F.lit("part isn't in the tree"), F.col("part_found").eqNullSafe(F.lit(False))),
        item("db", "warning", F.concat(F.lit("conflicts with standards: "), F.col("conflicts").cast("string")), F.col("conflicts") > 0),
        item("reader", "error", F.lit("second reader failed"), F.col("reader_failed")),
        item("reader", F.when(F.col("consistency") < 1, "warning").otherwise("info"), F.concat(F.lit("runs agree in "), pct("consistency")), F.col("consistency").isNotNull() & ~F.col("reader_failed")),
    ))
    return scores.select(*keys, F.posexplode(rows).alias("position", "e")).select(*keys, (F.col("position") + 1).alias("position"), "e.layer", "e.severity", "e.message")


def phrase_prompts(phrases: DataFrame, prompts: DataFrame, phrase: str, code: str, prompt: str) -> DataFrame:
    """Each phrase with the code of the prompt that shares most words with it, the first of equals; null without a common word."""
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != "")
    p = prompts.select(code, "seq", F.explode(F.array_distinct(words(prompt))).alias("word"))
    asked = phrases.select(phrase).distinct()
    shared = asked.select(phrase, F.explode(F.array_distinct(words(phrase))).alias("word")).join(p, "word").groupBy(phrase, code, "seq").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(phrase).agg(F.max_by(code, F.struct("n", -F.col("seq"))).alias(code))
    return asked.join(best, phrase, "left")

