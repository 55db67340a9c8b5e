"""The library's operators applied to whole tables, each with SQL that gives the same rows.

Every query takes (spark, sf_dir) and reads ``<sf_dir>/<table>.parquet``; nothing is sampled or cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.functions import geometry as G
from inkspark.functions import text as T
from inkspark.operators import folds, lookup, matching, metrics, ranges, scoring, search, tree, validate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- search, logs, revisions -------------------------------------------------


@query("""
SELECT o_orderkey, c_name, o_orderdate, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'O' AND (contains(lower(c_name), 'urgent') OR contains(lower(o_orderpriority), 'urgent') OR contains(lower(c_mktsegment), 'urgent'))
ORDER BY o_orderdate DESC, o_orderkey LIMIT 20
""")
def search_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = search.search(rows, ["c_name", "o_orderpriority", "c_mktsegment"], " URGENT ", {"o_orderstatus": "O", "c_mktsegment": None}, "o_orderdate", "o_orderkey", 20)
    return found.select("o_orderkey", "c_name", "o_orderdate", "o_orderpriority")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def membership_semi(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return search.members_only(table(spark, d, "customer"), members, "c_custkey", F.col("o_orderpriority") == "1-URGENT").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_skip(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return search.without(table(spark, d, "customer"), used, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    return search.latest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", "ts")


@query("""
WITH g AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS gone FROM events GROUP BY user_id)
SELECT e.user_id, min(event_id) AS position, arg_max(props, event_id) AS value
FROM events e JOIN g USING (user_id) WHERE gone IS NULL OR event_id > gone GROUP BY e.user_id
""")
def doc_upsert(spark: SparkSession, d: str) -> DataFrame:
    return search.upserted(table(spark, d, "events"), ["user_id"], "props", "event_id", F.col("event_type") == "error")


@query("SELECT user_id, event_type AS target, arg_max(value, event_id) AS value, min(event_id) AS position FROM events GROUP BY ALL")
def merge_corrections(spark: SparkSession, d: str) -> DataFrame:
    return search.merged_corrections(table(spark, d, "events").withColumnRenamed("event_type", "target"), ["user_id"], "target", "value", "event_id")


@query("""
SELECT user_id, coalesce(arg_max(value, event_id) FILTER (event_type = 'purchase'), arg_max(value, event_id) FILTER (event_type = 'click'),
                         arg_max(value, event_id) FILTER (event_type = 'view')) AS value FROM events GROUP BY user_id
""")
def correction_precedence(spark: SparkSession, d: str) -> DataFrame:
    last = lambda kind: F.max_by("value", F.when(F.col("event_type") == kind, F.col("event_id")))
    rows = table(spark, d, "events").groupBy("user_id").agg(last("purchase").alias("correction"), last("click").alias("second"), last("view").alias("first"))
    return rows.select("user_id", search.preferred("correction", "second", "first").alias("value"))


_BY_USER = "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, floor(arg_max(value, event_id) / 20) AS v FROM events WHERE event_type = '{k}' GROUP BY ALL"


def _by_user(spark: SparkSession, d: str, kind: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type") == kind)
    return e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.floor(F.max_by("value", "event_id") / 20).cast("double").alias("v"))


@query(f"""
WITH a AS ({_BY_USER.format(k="view")}), b AS ({_BY_USER.format(k="click")})
SELECT user_id, day, a.v AS left_value, b.v AS right_value,
       CASE WHEN b.v IS NULL THEN 'only_left' WHEN a.v IS NULL THEN 'only_right' WHEN a.v = b.v THEN 'same' ELSE 'mismatch' END AS outcome
FROM a FULL JOIN b USING (user_id, day)
""")
def outer_compare(spark: SparkSession, d: str) -> DataFrame:
    return search.compared(_by_user(spark, d, "view"), _by_user(spark, d, "click"), ["user_id", "day"], "v")


@query(f"""
WITH a AS ({_BY_USER.format(k="view")}), b AS ({_BY_USER.format(k="click")})
SELECT user_id, round_even(avg(coalesce(a.v = b.v, false)::DOUBLE), 2) AS agreement FROM a LEFT JOIN b USING (user_id, day) GROUP BY user_id
""")
def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.agreement(_by_user(spark, d, "view"), _by_user(spark, d, "click"), ["user_id"], "day", "v")


# --- trees --------------------------------------------------------------------

_PATHS = "SELECT c_custkey, c_mktsegment, c_acctbal, r_name, n_name, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_NODES = "SELECT r_name AS path FROM region UNION SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT path FROM p"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select("c_custkey", "c_mktsegment", "c_acctbal", "r_name", "n_name", F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    nations = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    return r.select(F.col("r_name").alias("path")).union(nations).union(_paths(spark, d).select("path")).distinct()


@query(f"""
WITH p AS ({_PATHS})
SELECT path, arg_min(project, (project, c_custkey)) AS project, arg_min(c_acctbal, (project, c_custkey)) AS c_acctbal FROM (
  SELECT path, 1 AS project, c_custkey, c_acctbal FROM p WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT path, 2, c_custkey, -c_acctbal FROM p) GROUP BY path
""")
def tree_union(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    one = p.where("c_mktsegment = 'BUILDING'").select("path", F.lit(1).alias("project"), "c_custkey", "c_acctbal")
    two = p.select("path", F.lit(2).alias("project"), "c_custkey", (-F.col("c_acctbal")).alias("c_acctbal"))
    return tree.united(one.unionByName(two), [], "path", ["project", "c_custkey"]).select("path", "project", "c_acctbal")


@query(f"WITH p AS ({_PATHS}), t AS ({_NODES}) SELECT t.path AS node_path, count(*) AS n FROM t JOIN p ON p.path = t.path OR starts_with(p.path, t.path || '/') GROUP BY t.path")
def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    rows = tree.with_ancestors(_paths(spark, d).select("path"), _nodes(spark, d), "path")
    return rows.groupBy("node_path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS ({_PATHS}), t AS ({_NODES}) SELECT path, EXISTS (SELECT 1 FROM t u WHERE starts_with(u.path, t.path || '/')) AS has_children FROM t")
def tree_children_guard(spark: SparkSession, d: str) -> DataFrame:
    return tree.has_children(_nodes(spark, d))


@query("""
WITH r AS (
  SELECT c_custkey, r_name || '/' || n_name AS path, n_name AS node_id, 'LARGE' AS level, c_custkey % 4 = 0 AS missing
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
SELECT c_custkey, CASE WHEN missing THEN split_part(path, '/', 1) ELSE node_id END AS node_id, CASE WHEN missing THEN split_part(path, '/', 1) ELSE path END AS assembly_path,
       CASE WHEN missing THEN 'BLOCK' ELSE level END AS level FROM r
""")
def tree_deepest(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a region and, for three of four customers, a nation with look-alike characters; the deepest hit wins."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    joined = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    nodes = r.select(F.lit(1).alias("ws"), F.col("r_regionkey").alias("seq"), F.col("r_name").alias("node_id"), F.col("r_name").alias("path"), F.lit("BLOCK").alias("level"))
    nodes = nodes.union(joined.select(F.lit(1), F.col("n_nationkey") + 100, "n_name", F.concat_ws("/", "r_name", "n_name"), F.lit("LARGE")))
    c = table(spark, d, "customer").join(joined, F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.array().cast("array<struct<text:string,prob:double>>")
    first = c.select("c_custkey", F.lit(1).alias("ws"), F.lit("t1").alias("ref_id"), F.lit(1).alias("seq"), F.lower("r_name").alias("value"), F.lit(0.9).alias("prob"), none.alias("candidates"))
    second = c.where("c_custkey % 4 <> 0").select("c_custkey", F.lit(1), F.lit("t2"), F.lit(2), F.concat(F.lit(" "), F.translate("n_name", "_", "‐")), F.lit(0.5), none)
    found = tree.hits(first.union(second), nodes, ["c_custkey"], ["ws"])
    return tree.best_part(found, ["c_custkey"]).select("c_custkey", "node_id", "assembly_path", "level")


@query("SELECT p_brand, row_number() OVER (ORDER BY split_part(p_brand, '#', 1), CAST(split_part(p_brand, '#', 2) AS INT)) AS position FROM (SELECT DISTINCT p_brand FROM part)")
def natural_path_order(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").select("p_brand").distinct()  # a vocabulary of a few dozen
    return brands.select("p_brand", F.row_number().over(Window.orderBy(T.natural_key("p_brand"))).alias("position"))


# --- strings and lookups --------------------------------------------------------

_DAMAGED = "CASE p_partkey % 3 WHEN 0 THEN translate(p_brand, '10', 'IO') WHEN 1 THEN ' ' || lower(p_brand) ELSE p_brand END"


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr("CASE p_partkey % 3 WHEN 0 THEN translate(p_brand, '10', 'IO') WHEN 1 THEN concat(' ', lower(p_brand)) ELSE p_brand END")
    return table(spark, d, "part").withColumn("value", value)


@query(f"""
WITH v AS (SELECT p_partkey, upper(trim({_DAMAGED})) AS key FROM part), w AS (SELECT p_partkey, key, translate(substr(key, 6), 'ODQIL|!ZSGB,', '00011112568.') AS tail FROM v)
SELECT p_partkey, CASE WHEN 'BRAND' || tail = key THEN 'BRAN0' || tail ELSE 'BRAND' || tail || '|BRAN0' || tail END AS variants
FROM w
""")
def ocr_variants(spark: SparkSession, d: str) -> DataFrame:
    return _damaged(spark, d).select("p_partkey", F.array_join(T.ocr_variants("value"), "|").alias("variants"))


@query(f"""
SELECT p_partkey, CASE WHEN how = 'fuzzy' THEN p_brand_up ELSE value END AS raw, p_brand AS code, p_brand AS meaning, how AS match, round_even(prob * CASE WHEN how = 'fuzzy' THEN 0.9 ELSE 1.0 END, 2) AS score FROM (
  SELECT p_partkey, p_brand, upper(p_brand) AS p_brand_up, {_DAMAGED} AS value, 0.4 + p_size / 100.0::DOUBLE AS prob,
         CASE WHEN upper(trim({_DAMAGED})) = upper(p_brand) THEN 'exact' ELSE 'fuzzy' END AS how FROM part)
""")
def code_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The cascade over damaged brands: exact where only case and blanks differ, repaired where digits look like letters."""
    parts = _damaged(spark, d)
    entries = parts.select("p_brand").distinct().select(F.lit(1).alias("ws"), F.xxhash64("p_brand").alias("seq"), F.col("p_brand").alias("code"), F.lit("text").alias("kind"), F.col("p_brand").alias("meaning"), F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("is_leg"))
    readings = parts.select(F.lit(1).alias("ws"), F.col("p_partkey").alias("ref_id"), "value", (F.lit(0.4) + F.col("p_size") / 100).cast("double").alias("prob"), F.array().cast("array<struct<text:string,prob:double>>").alias("candidates"), F.lit(None).cast("string").alias("second_meaning"), F.lit(None).cast("double").alias("second_prob"))
    return lookup.matched(readings, entries, ["ws"]).select(F.col("ref_id").alias("p_partkey"), "raw", "code", "meaning", "match", "score")


@query()
def fuzzy_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of each part's name to its colour-less form (no SQL equivalent of this measure)."""
    return table(spark, d, "part").select("p_partkey", T.similarity(F.upper("p_name"), F.upper(F.regexp_replace("p_name", r"^\w+ ", ""))).alias("ratio"))


@query("SELECT p_partkey, CASE WHEN p_size >= 2 AND p_size <= 25 THEN p_size::VARCHAR WHEN length(p_size::VARCHAR) = 2 AND (p_size // 10 || '.' || p_size % 10)::DOUBLE BETWEEN 2 AND 25 THEN p_size // 10 || '.' || p_size % 10 END AS leg FROM part")
def plausible_legs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.plausible_leg(F.col("p_size").cast("string")).alias("leg"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size::DOUBLE END AS mm FROM part")
def thickness_reading(spark: SparkSession, d: str) -> DataFrame:
    size = F.translate(F.col("p_size").cast("string"), "10", "IO")
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("t = "), size)).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit("t"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.read_thickness(value).mm.alias("mm"))


_LETTERS, _DIGITS = (T.LEG_LETTER_FROM, T.LEG_LETTER_TO), (T.LEG_DIGIT_FROM, T.LEG_DIGIT_TO)


@query(f"""
WITH v AS (SELECT p_partkey, p_partkey % 4 AS kind, substr('{_LETTERS[1]}', p_partkey % 16 + 1, 1) AS l, substr('{_LETTERS[0]}', p_partkey % 16 + 1, 1) AS raw,
  substr('{_DIGITS[1]}', p_partkey % 22 + 1, 1) AS a, p_size % 10 AS n FROM part)
SELECT p_partkey, CASE kind WHEN 0 THEN l || a || n WHEN 1 THEN l || n || '.' || a WHEN 2 THEN CASE WHEN raw = '5' THEN NULL ELSE l END END AS marking FROM v
""")
def marking_repair(spark: SparkSession, d: str) -> DataFrame:
    """Every look-alike of a letter and of a digit, both points, lone letters, and readings without a marking."""
    at = lambda chars, n: F.substring(F.lit(chars), (F.col("p_partkey") % n + 1).cast("int"), F.lit(1))
    letter, digit, n = at(_LETTERS[0], 16), at(_DIGITS[0], 22), F.col("p_size") % 10
    kind = F.col("p_partkey") % 4
    point = F.when(F.col("p_partkey") % 8 == 1, ",").otherwise("·")
    value = F.when(kind == 0, F.concat(F.lit("→ -"), letter, digit, n, F.lit("x"))).when(kind == 1, F.concat(letter, F.lit(" "), n, point, digit)).when(kind == 2, letter).otherwise("xw 12")
    return table(spark, d, "part").select("p_partkey", T.to_marking(value).alias("marking"))


_FORMS = ("Ⅴ5", "F5.5①", "ﬁ", "½", "ｆ５．５", "P—1", "㎜", "a\u2003b")
_FOLDED = ("V5", "F5.51", "FI", "1⁄2", "F5.5", "P-1", "MM", "AB")


@query(f"SELECT p_partkey, list_extract({list(_FOLDED)!r}, p_partkey % 8 + 1) || upper(p_brand) AS key FROM part")
def normalised_forms(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*map(F.lit, _FORMS))
    value = F.concat(F.get(forms, (F.col("p_partkey") % 8).cast("int")), F.lit(" "), "p_brand")
    return table(spark, d, "part").select("p_partkey", T.normalize(value).alias("key"))


@query("SELECT p_partkey, 'F5.5|V' || p_size AS legs FROM part")
def leg_values(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", F.lit("f5.5,"), "p_name", F.concat(F.lit("(v"), F.col("p_size").cast("string"), F.lit(")")), F.lit("F123"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.leg_values(line), "|").alias("legs"))


@query("SELECT page_id, CASE WHEN list_reduce(list_transform(range(0, 5), lambda k: ('0x' || substr(sha1(url), 1 + 8 * k, 8))::BIGINT), lambda a, b: (a % 1000 * 296 + b) % 1000) % 1000 < 200 THEN 'eval' ELSE 'train' END AS split FROM pages")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.split_of("url").alias("split"))


_KNOWN = ("the of", "of the", "and the", "de la", "is", "to a in")


@query(f"""
WITH t AS (SELECT conv_id, turn, string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+') AS w FROM conversations),
g AS (SELECT conv_id, turn, array_to_string(w[i : i + k - 1], ' ') AS span FROM (SELECT conv_id, turn, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, range(1, 4) r(k)))
SELECT t.conv_id, t.turn, count(DISTINCT CASE WHEN span IN ({", ".join(repr(k) for k in _KNOWN)}) THEN span END) AS hits FROM t LEFT JOIN g ON t.conv_id = g.conv_id AND t.turn = g.turn GROUP BY ALL
""")
def ngram_hits(spark: SparkSession, d: str) -> DataFrame:
    spans = T.spans(F.split(F.lower("text"), r"\s+"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_intersect(spans, F.array(*map(F.lit, _KNOWN)))).cast("long").alias("hits"))


@query("SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count((props->>'$.k')::BIGINT) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "struct<k: bigint>")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(props.k).alias("total"), F.count(props.k).alias("n"))


# --- ranges ---------------------------------------------------------------------

_BANDS = ((1, 1.0, 10.0), (2, 10.0, 25.0), (3, 25.0, 25.0), (4, 25.0, 40.0), (5, 42.0, None))
_BANDS_SQL = "(VALUES " + ", ".join(f"({s}, {lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)" for s, lo, hi in _BANDS) + ") b(seq, lo, hi)"


@query(f"""
SELECT p_partkey, seq AS band FROM part JOIN {_BANDS_SQL} ON p_size BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY p_size < hi DESC, CASE WHEN p_size < hi THEN seq ELSE -seq END) = 1
""")
def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "seq int, lo double, hi double")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return ranges.band_of(parts, bands, "size", "lo", "hi", "seq", row_id=["p_partkey"]).select("p_partkey", F.col("seq").alias("band"))


_LEGS = ((1, "N", 3.0, 5.0, "1F"), (2, "N", 5.0, 8.0, "2F"), (3, "N", 12.0, 20.0, "3F"), (4, "R", 4.0, 4.0, "1F"), (5, "R", 30.0, 45.0, "2F"))
_LEGS_SQL = "(VALUES " + ", ".join(f"({s}, '{f}', {lo}::DOUBLE, {hi}::DOUBLE, '{p}')" for s, f, lo, hi, p in _LEGS) + ") b(seq, flag, lo, hi, position)"


@query(f"""
SELECT DISTINCT l_returnflag, l_quantity, seq AS band, l_quantity BETWEEN lo AND hi AS matched
FROM (SELECT DISTINCT l_returnflag, l_quantity FROM lineitem) JOIN {_LEGS_SQL} ON flag = l_returnflag
QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_quantity ORDER BY greatest(lo - l_quantity, 0, l_quantity - hi), CASE WHEN l_quantity BETWEEN lo AND hi THEN 0 ELSE -lo END,
  CASE position WHEN '2F' THEN 1 WHEN '1F' THEN 2 ELSE 3 END, seq) = 1
""")
def nearest_lookup(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(_LEGS, "seq int, l_returnflag string, lo double, hi double, position string")
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity").distinct()
    found = ranges.nearest_band(rows, bands, "l_quantity", "lo", "hi", ranges.position_rank(F.col("position")), "seq", ["l_returnflag"], ["l_returnflag", "l_quantity"])
    return found.select("l_returnflag", "l_quantity", F.col("seq").alias("band"), "matched")


# --- scores ---------------------------------------------------------------------

_FACTORS = """
SELECT l_orderkey, 1 - max(l_discount) AS prob, CASE WHEN count(*) > 1 THEN round_even(sum((l_linestatus = 'F')::INT) / count(*)::DOUBLE, 2) END AS agreement, max(l_tax) * 10 AS strength,
       round_even(sum((l_returnflag = 'N')::INT) / count(*)::DOUBLE, 2) AS match_rate, CASE WHEN min(l_quantity) < 5 THEN false WHEN min(l_quantity) >= 10 THEN true END AS found,
       count(*) FILTER (l_quantity > 47) AS conflicts, CASE WHEN l_orderkey % 3 > 0 THEN 1 - min(l_discount) END AS token, CASE WHEN l_orderkey % 2 = 0 THEN 1 - max(l_tax) END AS consistency,
       l_orderkey % 11 = 0 AS failed, l_orderkey % 5 > 0 AS used
FROM lineitem GROUP BY l_orderkey
"""


@query(f"""
WITH f AS ({_FACTORS}), s AS (
  SELECT *, round_even(100 * least(prob, agreement) * (1 - 0.2 * greatest(0, strength - 0.5) / 0.5), 0) AS visual,
         round_even(least(100, greatest(0, 100 - 25 * (1 - match_rate) - CASE WHEN found IS FALSE THEN 40 ELSE 0 END - 20 * conflicts)), 0) AS db,
         CASE WHEN failed THEN 0 WHEN NOT used THEN 100 WHEN token IS NOT NULL AND consistency IS NOT NULL THEN round_even(100 * (token + consistency) / 2, 0)
              WHEN token IS NOT NULL THEN round_even(100 * token, 0) WHEN consistency IS NOT NULL THEN round_even(100 * 0.9 * consistency, 0) ELSE 60 END::DOUBLE AS reasoning
  FROM f)
SELECT l_orderkey, visual::DOUBLE AS visual, db::DOUBLE AS db, reasoning, least(visual, db, reasoning)::DOUBLE AS overall, least(visual, db, reasoning) >= 70 AND found IS NOT NULL AS passed FROM s
""")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.bround(F.sum(c.cast("int")) / F.count(F.lit(1)), 2)
    k = F.col("l_orderkey")
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        (1 - F.max("l_discount")).alias("prob"),
        F.when(F.count(F.lit(1)) > 1, share(F.col("l_linestatus") == "F")).alias("agreement"),
        (F.max("l_tax") * 10).alias("strength"),
        share(F.col("l_returnflag") == "N").alias("match_rate"),
        F.when(F.min("l_quantity") < 5, False).when(F.min("l_quantity") >= 10, True).alias("found"),
        F.count_if(F.col("l_quantity") > 47).alias("conflicts"),
        (1 - F.min("l_discount")).alias("token"),
        (1 - F.max("l_tax")).alias("consistency"),
    )
    f = f.withColumn("token", F.when(k % 3 > 0, F.col("token"))).withColumn("consistency", F.when(k % 2 == 0, F.col("consistency")))
    f = f.withColumn("visual", scoring.visual_score(F.col("prob"), F.col("agreement"), F.col("strength"), F.lit(False), F.col("consistency")))
    f = f.withColumn("db", scoring.db_score(F.col("match_rate"), F.col("found"), F.col("conflicts")))
    f = f.withColumn("reasoning", scoring.reasoning_score(F.col("token"), F.col("consistency"), k % 5 > 0, k % 11 == 0))
    f = f.withColumn("overall", scoring.overall(F.col("visual"), F.col("db"), F.col("reasoning")))
    missing = F.array_compact(F.array(F.when(F.col("found").isNull(), F.lit("part"))))
    return f.select("l_orderkey", "visual", "db", "reasoning", "overall", scoring.passed(F.col("overall"), F.lit(70.0), missing).alias("passed"))


@query("""
WITH items AS (
  SELECT o_orderkey, 'part' AS target, 0 AS stage, 0.0::DOUBLE AS ord, 0 AS seq, 'missing_required' AS reason FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT l_orderkey, 'welding_condition', CASE WHEN l_tax >= 0.07 THEN 1 ELSE 2 END, 0.0, l_partkey, 'standard_conflict' FROM lineitem WHERE l_tax >= 0.05
  UNION ALL SELECT l_orderkey, 't' || l_linenumber, 3, l_quantity / 50, l_partkey, 'low_visual_confidence' FROM lineitem WHERE l_quantity / 50 < 0.4
  UNION ALL SELECT o_orderkey, 'interpretation', 4, 0.0, 0, CASE WHEN o_orderkey % 7 = 0 THEN 'reader_failed' ELSE 'reader_inconsistent' END FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 2 = 0
), firsts AS (
  SELECT * FROM items i WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l_returnflag = 'A' AND l_orderkey = i.o_orderkey AND 't' || l_linenumber = i.target)
  QUALIFY row_number() OVER (PARTITION BY o_orderkey, target ORDER BY stage, ord, seq, reason) = 1
)
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY stage, ord, seq, target) AS position, target, reason FROM firsts
""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").withColumn("target", F.concat(F.lit("t"), F.col("l_linenumber")))
    missing = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("part").alias("target"), F.lit(0).alias("seq"))
    conflicts = li.where("l_tax >= 0.05").select("o_orderkey", F.lit("standard_conflict").alias("type"), F.when(F.col("l_tax") >= 0.07, "error").otherwise("warning").alias("severity"), F.lit("welding_condition").alias("target"), F.col("l_partkey").alias("seq"))
    seen = li.select("o_orderkey", "target", (F.col("l_quantity") / 50).alias("prob"), F.lit(40.0).alias("threshold"), F.col("l_partkey").alias("seq"))
    runs = o.select("o_orderkey", (F.col("o_orderkey") % 7 == 0).alias("failed"), F.when(F.col("o_orderkey") % 2 == 0, 0.5).otherwise(1.0).alias("consistency"))
    return scoring.review_queue(missing, conflicts, seen, runs, li.where("l_returnflag = 'A'").select("o_orderkey", "target"), ["o_orderkey"])


# --- geometry and folds -----------------------------------------------------------

_BOX = "l_quantity AS x1, l_extendedprice / 1000 AS y1, l_quantity + 10 + 50 * l_discount AS x2, l_extendedprice / 1000 + 6 + 100 * l_tax AS y2"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey",
        G.box(c("l_quantity"), c("l_extendedprice") / 1000, c("l_quantity") + 10 + 50 * c("l_discount"), c("l_extendedprice") / 1000 + 6 + 100 * c("l_tax")).alias("box"),
    )


@query(f"""
WITH RECURSIVE b AS (SELECT l_orderkey, l_partkey, {_BOX} FROM lineitem),
o AS (SELECT *, (y1 + y2) / 2 AS c, y2 - y1 AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY (y1 + y2) / 2, x1, l_partkey, y2 - y1) AS rn FROM b),
f AS (
  SELECT l_orderkey, l_partkey, x1, rn, 1 AS line, c AS lc, h AS lh FROM o WHERE rn = 1
  UNION ALL
  SELECT o.l_orderkey, o.l_partkey, o.x1, o.rn, CASE WHEN abs(o.c - f.lc) <= f.lh / 2 THEN f.line ELSE f.line + 1 END,
         CASE WHEN abs(o.c - f.lc) <= f.lh / 2 THEN f.lc ELSE o.c END, CASE WHEN abs(o.c - f.lc) <= f.lh / 2 THEN f.lh ELSE o.h END
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.rn = f.rn + 1
)
SELECT l_orderkey, l_partkey, line, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, x1, l_partkey) AS position FROM f
""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).select("l_orderkey", "l_partkey", "box.*")
    return folds.reading_order(b, ["l_orderkey"], "l_partkey", "x1", "y1", "y2")


@query(f"""
WITH b AS (SELECT l_orderkey, l_partkey, {_BOX} FROM lineitem)
SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b, round(i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i), 9) AS iou
FROM (SELECT a.*, b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey) a
WHERE i > 0
""")
def iou_join(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    left, right = b.select("l_orderkey", F.col("l_partkey").alias("a"), F.col("box").alias("p")), b.select("l_orderkey", F.col("l_partkey").alias("b"), F.col("box").alias("q"))
    pairs = left.join(right, "l_orderkey").where("a < b").withColumn("iou", G.iou(F.col("p"), F.col("q")))
    return pairs.where("iou > 0").select("l_orderkey", "a", "b", F.round("iou", 9).alias("iou"))


@query(f"""
WITH b AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS id, l_linenumber % 2 = 0 AS pred, {_BOX} FROM lineitem),
m AS (SELECT p.l_orderkey, p.id AS pred, min(t.id) AS truth FROM b p JOIN b t ON p.l_orderkey = t.l_orderkey AND p.pred AND NOT t.pred
  AND (p.x1 + p.x2) / 2 BETWEEN t.x1 - (t.x2 - t.x1) * 0.1 AND t.x2 + (t.x2 - t.x1) * 0.1 AND (p.y1 + p.y2) / 2 BETWEEN t.y1 - (t.y2 - t.y1) * 0.1 AND t.y2 + (t.y2 - t.y1) * 0.1 GROUP BY ALL)
SELECT b.l_orderkey AS photo, b.id AS truth, string_agg(m.pred::VARCHAR, '|' ORDER BY m.pred) AS preds, count(m.pred) > 0 AS found
FROM (SELECT DISTINCT l_orderkey, id FROM b WHERE NOT pred) b LEFT JOIN m ON m.l_orderkey = b.l_orderkey AND m.truth = b.id GROUP BY ALL
""")
def centre_match(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("id", F.col("l_partkey") * 10 + F.col("l_linenumber")).withColumn("photo", F.col("l_orderkey"))
    preds = b.where("l_linenumber % 2 = 0").select("photo", F.col("id").alias("pred"), "box")
    truths = b.where("l_linenumber % 2 = 1").select("photo", F.col("id").alias("truth"), "box")
    found = matching.centre_matches(preds, truths)
    return found.withColumn("preds", F.array_join(F.transform("preds", lambda x: x.cast("string")), "|"))


@query()
def greedy_iou_match(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of an order's even lines matched with those of its odd lines (a greedy loop: no SQL)."""
    b = _boxes(spark, d).withColumn("photo", F.col("l_orderkey")).withColumn("label", F.lit("box"))
    preds = b.where("l_linenumber % 2 = 0").select("photo", "label", F.col("l_partkey").alias("pred"), (F.col("l_suppkey") / 1000).alias("score"), "box")
    truths = b.where("l_linenumber % 2 = 1").select("photo", "label", F.col("l_partkey").alias("truth"), "box")
    return matching.iou_matches(preds, truths, 0.2)


_STEP = """CASE WHEN e = 'start' AND status <> 'analyzing' THEN 'analyzing' WHEN e = 'passed' AND status = 'analyzing' THEN 'awaiting_approval' WHEN e = 'unsure' AND status = 'analyzing' THEN 'needs_review'
  WHEN e = 'failed' AND status = 'analyzing' THEN before WHEN e = 'approve' AND status = 'awaiting_approval' THEN 'approved' END"""


@query(f"""
WITH RECURSIVE ev AS (
  SELECT user_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'passed' WHEN 'click' THEN 'unsure' WHEN 'error' THEN 'failed' ELSE 'approve' END AS e,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
), f AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, 'draft' AS status, 'draft' AS before, 0 AS accepted, 0 AS rejected FROM ev
  UNION ALL
  SELECT user_id, rn, coalesce(nxt, status), CASE WHEN nxt IS NOT NULL AND e = 'start' THEN status ELSE before END, accepted + (nxt IS NOT NULL)::INT, rejected + (nxt IS NULL)::INT
  FROM (SELECT f.user_id, ev.rn, ev.e, f.status, f.before, f.accepted, f.rejected, {_STEP.replace("e = ", "ev.e = ")} AS nxt FROM f JOIN ev ON ev.user_id = f.user_id AND ev.rn = f.rn + 1)
)
SELECT user_id, status, accepted, rejected FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1
""")
def job_state_fold(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "start", "view": "passed", "click": "unsure", "error": "failed", "purchase": "approve"}.items() for x in kv])
    e = table(spark, d, "events").withColumn("event", F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("approve")))
    return folds.job_states(e, ["user_id"], "event", ["ts", "event_id"])


@query("""
WITH g AS (SELECT user_id, event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS gap FROM events)
SELECT user_id, event_id, round(0.92 * (1 - exp(-gap / 86400.0)), 9) AS progress FROM g WHERE gap IS NOT NULL
""")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    g = table(spark, d, "events").withColumn("gap", (micros - F.lag(micros).over(w)) / 1e6).where("gap IS NOT NULL")
    return g.select("user_id", "event_id", F.round(metrics.stage_progress(F.col("gap"), 86400.0), 9).alias("progress"))


# --- metrics ------------------------------------------------------------------------


@query("""
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type FROM events GROUP BY ALL), c AS (SELECT day, event_type, count(*) AS runs FROM d GROUP BY ALL),
s AS (SELECT day, user_id, sum(runs - 1) - count(*) FILTER (runs = 1) AS score FROM d JOIN c USING (day, event_type) GROUP BY ALL)
SELECT day, user_id, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, user_id) = 1
""")
def consensus_pick(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type")
    return metrics.consensus(e, ["day"], "user_id", "event_type").select("day", "user_id", "score")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS runs, CASE WHEN sum(n) > 1 THEN round_even(max(n) / sum(n)::DOUBLE, 2) END AS consistency FROM c GROUP BY user_id
""")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.consistency(table(spark, d, "events"), ["user_id"], "event_type")


@query("""
WITH r AS (SELECT p_brand, p_name AS truth, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE translate(p_name, 'oel', '0e1') END AS got FROM part)
SELECT p_brand, count(*) AS n, sum(least(levenshtein(truth, coalesce(got, '')), length(truth)))::DOUBLE / sum(length(truth)) AS cer, avg((truth = coalesce(got, ''))::INT::DOUBLE) AS exact,
       avg((upper(truth) = upper(coalesce(got, '')))::INT::DOUBLE) AS exact_ignoring_case, avg((got IS NOT NULL)::INT::DOUBLE) AS found FROM r GROUP BY p_brand
""")
def cer_report(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select("p_brand", F.col("p_name").alias("truth"), F.when(F.col("p_partkey") % 5 != 0, F.translate("p_name", "oel", "0e1")).alias("got"))
    return metrics.error_report(r, ["p_brand"], "truth", "got", wildcards=False)


@query("""
WITH s AS (SELECT lang, d.doc_id, n_chars, toxic, sum(toxic) OVER (PARTITION BY lang) AS positives FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT *, sum(toxic) OVER w / row_number() OVER w::DOUBLE AS prec, sum(toxic) OVER w / positives::DOUBLE AS rec, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)),
e AS (SELECT *, max(prec) OVER (PARTITION BY lang ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, rec - lag(rec, 1, 0) OVER (PARTITION BY lang ORDER BY rn) AS step FROM c)
SELECT lang, round(sum(env * step), 9) AS ap, count(*) AS n FROM e GROUP BY lang
""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id").withColumn("hit", F.col("toxic") == 1)
    positives = rows.groupBy("lang").agg(F.sum("toxic").alias("positives"))
    ap = metrics.average_precision(rows.join(positives, "lang"), ["lang"], "hit", "n_chars", "doc_id")
    return ap.select("lang", F.round("ap", 9).alias("ap"), "n")


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, sum((l_discount > 0.05)::INT)::BIGINT AS discounted, round_even(100 * (sum((l_discount > 0.05)::INT) / count(*)::DOUBLE), 1) AS pct
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
""")
def group_totals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    g = li.groupingSets([[li["l_returnflag"]], [li["l_linestatus"]], []], li["l_returnflag"], li["l_linestatus"])
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted")).withColumn("pct", metrics.percent(F.col("discounted"), F.col("n")))


@query("SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def multi_profile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.profile(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""
WITH m AS (SELECT user_id, event_type, sum(value) AS p FROM events GROUP BY ALL), r AS (SELECT *, p / sum(p) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS rank FROM m)
SELECT user_id, event_type, rank, round(share, 9) AS share FROM r WHERE rank <= 5 AND share >= 0.02
""")
def candidate_shares(spark: SparkSession, d: str) -> DataFrame:
    return metrics.candidate_shares(table(spark, d, "events"), ["user_id"], "event_type", "value", order=["event_id"]).withColumn("share", F.round("share", 9))


@query("""
WITH k AS (SELECT l_returnflag AS label, CASE WHEN l_discount > 0.05 THEN 'tp' WHEN l_tax > 0.04 THEN 'fp' ELSE 'fn' END AS kind FROM lineitem), a AS (SELECT * FROM k UNION ALL SELECT 'any', kind FROM k),
c AS (SELECT label, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM a GROUP BY label)
SELECT *, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall FROM c
""")
def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_discount") > 0.05, "tp").when(F.col("l_tax") > 0.04, "fp").otherwise("fn")
    return metrics.detection_metrics(table(spark, d, "lineitem").select("l_returnflag", kind.alias("kind")), "l_returnflag")


# --- integrity -------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return validate.dangling(table(spark, d, "lineitem"), "l_orderkey", known, "o_orderkey").select("l_orderkey", "l_partkey", "l_suppkey").distinct()


@query("""
SELECT 'order_customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'line_number_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.09)
""")
def integrity_rules(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    ok = validate.violations({"discount_range": F.col("l_discount").between(0, 0.09)})
    return validate.report({
        "order_customer": validate.dangling(t("orders"), "o_custkey", t("customer"), "c_custkey"),
        "line_order": validate.dangling(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        "label_document": validate.dangling(t("labels"), "doc_id", t("documents"), "doc_id"),
        "line_number_unique": validate.duplicated(t("lineitem"), ["l_orderkey", "l_linenumber"]),
        "discount_range": t("lineitem").where(F.size(ok) > 0),
    })


from inkspark.plans import evaluation, files, interpretation, lifecycle, photos, service, shapes, streams  # noqa: E402, F401  they register their queries
