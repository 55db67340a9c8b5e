"""Assembly trees as materialised ``/`` paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.text import normalize, ocr_variants
from inkspark.operators.broadcasts import small
from inkspark.sources.scratch import written

LEVELS = ("BLOCK", "LARGE", "MID", "SUB", "PART")


def depth_of(level: Column) -> Column:
    """Rank of a level name, the root 0."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def prefixes(path: Column) -> Column:
    """The path and all its ancestors, root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def on_path(node: Column, path: Column) -> Column:
    """Whether ``node`` is ``path`` or one of its ancestors."""
    return (path == node) | path.startswith(F.concat(node, F.lit("/")))


def with_ancestors(rows: DataFrame, tree: DataFrame, path: str, node_path: str = "path") -> DataFrame:
    """Each row with every tree node on its path: an equi-join on exploded prefixes instead of a prefix test on all pairs."""
    nodes = tree.select([F.col(c).alias(f"node_{c}") for c in tree.columns])
    return rows.withColumn("_prefix", F.explode(prefixes(F.col(path)))).join(nodes, F.col("_prefix") == F.col(f"node_{node_path}")).drop("_prefix")


def has_children(tree: DataFrame, path: str = "path") -> DataFrame:
    """The tree with ``has_children``: whether another node's path goes through it."""
    inner = tree.select(F.explode(F.slice(prefixes(F.col(path)), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)))).alias("_p"), F.col(path).alias("_own"))
    inner = inner.where("_p <> _own").select("_p").distinct().withColumn("has_children", F.lit(True))
    return tree.join(inner, tree[path] == inner["_p"], "left").drop("_p").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def united(trees: DataFrame, keys: list[str], path: str, order: list[str]) -> DataFrame:
    """Union of several trees: of nodes with one path the first by ``order`` stays."""
    rest = [c for c in trees.columns if c not in [*keys, path]]
    best = trees.groupBy(*keys, path).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, path, *[F.col("r")[c].alias(c) for c in rest])


def index(tree: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """(keys, key, node): normalised ids and paths, with and without dashes; the first node of a key wins."""
    forms = F.array(normalize("node_id"), F.replace(normalize("node_id"), F.lit("-"), F.lit("")), normalize("path"), F.replace(normalize("path"), F.lit("-"), F.lit("")))
    rows = tree.select(*keys, F.posexplode(forms).alias("form", "key"), F.struct("node_id", "path", "level").alias("node"), F.col(seq).alias("seq"))
    return rows.groupBy(*keys, "key").agg(F.min_by("node", F.struct("seq", "form")).alias("node"))


def hits(readings: DataFrame, tree: DataFrame, keys: list[str], tree_keys: list[str], seq: str = "seq") -> DataFrame:
    """Readings that name a node: keys, ref_id, seq, place, value, prob, fixed, node; ``place`` counts a reading's candidates.

    ``readings`` has keys (a photo), tree_keys (whose tree), ref_id, seq, value, prob and candidates array<struct<text, prob>>. A reading is
    tried as it is, then in its repaired forms (probability times 0.9). Only where no reading of a photo hits, its candidates
    are tried.
    """
    idx = index(tree, tree_keys, seq)
    plain = lambda form: F.array_distinct(F.array(form, F.replace(form, F.lit("-"), F.lit(""))))
    forms = F.concat(F.array(normalize("value")), ocr_variants("value"))
    own = list(dict.fromkeys([*keys, "ref_id", "seq", "value", "prob", *tree_keys]))
    # readings repeat: forms and their node are found once for each distinct value of a tree
    values = readings.select(*tree_keys, "value").distinct()
    tried = values.select(*tree_keys, "value", F.posexplode(forms).alias("place", "form")).withColumn("key", F.explode(plain(F.col("form"))))
    named = F.min_by(F.struct("place", "form", "node", (F.col("key") != F.col("form")).alias("dashed")), F.struct("place", F.col("key") != F.col("form"))).alias("t")
    known = small(written(tried.join(idx, [*tree_keys, "key"]).groupBy(*tree_keys, "value").agg(named), "tree-values"))
    rows = readings.select(*own).join(known, [*tree_keys, "value"]).groupBy(*keys, "ref_id").agg(
        F.min_by(F.struct("seq", "value", "prob", "t.place", "t.form", "t.node"), F.struct("t.place", "t.dashed")).alias("r")
    )
    place = F.col("r.place")
    direct = rows.select(
        *keys, "ref_id", "r.seq", F.lit(0).alias("place"), "r.value", (F.col("r.prob") * F.when(place > 0, 0.9).otherwise(1.0)).alias("prob"), F.when(place > 0, F.col("r.form")).alias("fixed"), "r.node"
    )
    left = readings.join(direct.select(*keys).distinct(), keys, "left_anti")
    second = left.select(*keys, *[k for k in tree_keys if k not in keys], "ref_id", "seq", F.posexplode("candidates").alias("place", "c"))
    second = second.withColumn("form", normalize("c.text")).withColumn("key", F.explode(plain(F.col("form"))))
    second = second.join(idx, [*tree_keys, "key"]).groupBy(*keys, "ref_id", "place").agg(
        F.min_by(F.struct("seq", F.col("c.text").alias("value"), F.col("c.prob").alias("prob"), "node"), F.col("key") != F.col("form")).alias("r")
    )
    return direct.unionByName(second.select(*keys, "ref_id", "r.seq", "place", "r.value", "r.prob", F.lit(None).cast("string").alias("fixed"), "r.node"))


def best_part(found: DataFrame, keys: list[str]) -> DataFrame:
    """The deepest, then most probable, then first hit of each group, with the refs on its path and off it."""
    depth = depth_of(F.col("node.level"))
    best = found.groupBy(*keys).agg(F.max_by("node", F.struct(depth, "prob", -F.col("seq"))).alias("best"))
    joined = found.join(best, keys)
    same = on_path(F.col("node.path"), F.col("best.path"))
    refs = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", "ref_id")))), lambda r: r.ref_id)
    return joined.groupBy(*keys, "best").agg(refs(same).alias("refs"), refs(~same).alias("other_refs")).select(
        *keys, F.col("best.node_id").alias("node_id"), F.col("best.path").alias("assembly_path"), F.col("best.level").alias("level"), F.array_distinct("refs").alias("ref_ids"), F.array_distinct("other_refs").alias("other_ref_ids")
    )


def addable(requests: DataFrame, tree: DataFrame) -> DataFrame:
    """Requests (parent_path, name, level) to add a node, with ``error``: no_parent, too_deep, level_above_parent, path_exists or null."""
    parents = tree.select(F.col("path").alias("parent_path"), F.col("level").alias("parent_level"))
    taken = tree.select(F.col("path").alias("new_path"), F.lit(True).alias("taken"))
    r = requests.withColumn("new_path", F.when(F.col("parent_path").isNull(), F.col("name")).otherwise(F.concat_ws("/", "parent_path", "name")))
    r = r.join(parents, "parent_path", "left").join(taken, "new_path", "left")
    depth = F.size(F.split("new_path", "/")) - 1
    level = F.coalesce(F.col("level"), F.get(F.array(*map(F.lit, LEVELS)), depth))
    error = (
        F.when(F.col("parent_path").isNotNull() & F.col("parent_level").isNull(), "no_parent")
        .when(depth >= len(LEVELS), "too_deep")
        .when(depth_of(level) < depth, "level_above_parent")
        .when(F.col("taken"), "path_exists")
    )
    return r.withColumn("level", level).withColumn("error", error).drop("parent_level", "taken")


def deletable(requests: DataFrame, tree: DataFrame) -> DataFrame:
    """Requests (path) to delete a node, with ``error``: not_found, has_children or null."""
    nodes = has_children(tree.select("path").distinct())
    return requests.join(nodes, "path", "left").withColumn(
        "error", F.when(F.col("has_children").isNull(), "not_found").when(F.col("has_children"), "has_children")
    ).drop("has_children")


def from_codes(codes: DataFrame, code: str, root: str) -> DataFrame:
    """A three-level tree from part codes: the root, the group before the last dash, and the code."""
    group = F.regexp_extract(code, "^(.*)-[^-]*$", 1)
    rows = codes.select(F.col(code).alias("code"), group.alias("g")).where("code IS NOT NULL")
    parts = rows.select(F.when(F.col("g") == "", F.concat_ws("/", F.lit(root), "code")).otherwise(F.concat_ws("/", F.lit(root), "g", "code")).alias("path"), F.lit("PART").alias("level"))
    groups = rows.where("g <> ''").select(F.concat_ws("/", F.lit(root), "g").alias("path"), F.lit("SUB").alias("level"))
    top = codes.sparkSession.range(1).select(F.lit(root).alias("path"), F.lit("BLOCK").alias("level"))
    return parts.unionByName(groups).unionByName(top).distinct()
