"""Queries of value functions and of the records of a workspace store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import values as V
from inkspark.operators import records
from inkspark.plans.queries import query, table


def _sql_number(x: str) -> str:
    return f"printf('%g', {x}::DOUBLE)"


@query(f"""
SELECT p_partkey, {_sql_number("p_retailprice")} AS price, {_sql_number("p_retailprice * 1000 + p_partkey / 7.0")} AS large, {_sql_number("-p_size / 700000.0")} AS little, CAST(round_even(p_size / 50.0::DOUBLE * 100, 0)::BIGINT AS VARCHAR) || '%' AS share, lpad(p_partkey::VARCHAR, 6, '0') AS number FROM part
""")
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", V.short_number("p_retailprice").alias("price"), V.short_number(F.col("p_retailprice") * 1000 + F.col("p_partkey") / 7.0).alias("large"), V.short_number(-F.col("p_size") / 700000.0).alias("little"), V.whole_percent(F.col("p_size") / 50).alias("share"), V.padded("p_partkey").alias("number"))


@query(f"""
SELECT p_partkey, concat_ws(' ', p_brand, CASE WHEN p_size % 3 > 0 THEN 'thickness ' || CASE WHEN p_size % 2 = 0 THEN {_sql_number("p_size::DOUBLE")} ELSE {_sql_number("p_size::DOUBLE")} || '~' || {_sql_number("p_size + 1.5::DOUBLE")} END || 'mm' END,
       CASE WHEN p_size % 5 > 0 THEN 'leg ' || {_sql_number("p_size / 4.0::DOUBLE")} || 'mm' END, p_type, 'F') AS line FROM part
""")
def range_texts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    low, high = F.when(s % 3 > 0, s), F.when(s % 3 > 0, F.when(s % 2 == 0, s).otherwise(s + 1.5))
    leg = F.when(s % 5 > 0, s / 4)
    return table(spark, d, "part").select("p_partkey", V.standard_line("p_brand", low, high, leg, leg, "p_type", F.lit("F")).alias("line"))


_NAMES = {"view": "seen", "click": "opened", "purchase": "bought"}


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'opened' WHEN 'purchase' THEN 'bought' ELSE event_type END || ' x' AS label,
       CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'left a/b' WHEN 2 THEN 'right c' ELSE 'left a/b, right c' END AS sides,
       CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'even' ELSE '' END AS first FROM events
""")
def label_texts(spark: SparkSession, d: str) -> DataFrame:
    u, none = F.col("user_id") % 4, F.array().cast("array<string>")
    left = F.when(u.isin(1, 3), F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    right = F.when(u.isin(2, 3), F.array(F.lit("c"))).otherwise(none)
    first = V.first_text(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" "), F.when(F.col("event_id") % 2 == 0, "even"))
    return table(spark, d, "events").select("event_id", V.labelled("event_type", _NAMES, " x").alias("label"), V.sides_summary(left, right).alias("sides"), first.alias("first"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'c_acctbal: ' || 'negative' ELSE '' END || CASE WHEN c_acctbal < 0 AND c_nationkey < 5 THEN ' / ' ELSE '' END || CASE WHEN c_nationkey < 5 THEN 'home' ELSE '' END AS errors FROM customer
""")
def error_texts(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("c_acctbal") < 0, F.struct(F.lit("c_acctbal").alias("field"), F.lit("negative").alias("message")))
    home = F.when(F.col("c_nationkey") < 5, F.struct(F.lit(None).cast("string").alias("field"), F.lit("home").alias("message")))
    return table(spark, d, "customer").select("c_custkey", V.joined_errors(F.array_compact(F.array(bad, home))).alias("errors"))


@query("""
SELECT event_id, 1::BIGINT AS keys, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS words, CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS strings FROM events
""")
def json_token_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of texts with escaped quotes, words and brackets."""
    text = F.when(F.col("user_id") % 2 == 0, '{"a \\" b" : [true, {}]}').otherwise('{"k": "x: {y}, \\"true\\" 7"}')
    e = table(spark, d, "events").select("event_id", V.json_tokens(text).alias("t"))
    count = lambda kind: F.size(F.filter("t", lambda x: x.kind == kind)).cast("long")
    return e.select("event_id", count("key").alias("keys"), count("word").alias("words"), count("string").alias("strings"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, date_trunc('second', ts) AS back,
       CASE WHEN ts::DATE = DATE '2024-01-15' THEN 'today' WHEN ts::DATE = DATE '2024-01-14' THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events
""")
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", V.utc_text("ts"))
    return e.select("event_id", "at", V.from_utc_text("at").cast("timestamp_ntz").alias("back"), V.relative_day("ts", F.lit("2024-01-15 08:00:00").cast("timestamp")).alias("day"))


@query("""
SELECT o_orderkey, 'job_' || substr(sha256(o_custkey::VARCHAR || '|' || o_orderkey::VARCHAR), 1, 12) AS job_id, sha256('7|' || o_orderkey::VARCHAR) AS shuffle_key,
       CASE row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) % 2 WHEN 0 THEN 'eval' ELSE 'train' END AS split FROM orders
""")
def natural_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = records.parity_split(table(spark, d, "orders"), [F.col("o_orderkey")], ["o_orderpriority"])
    return records.shuffled(rows, "o_orderkey", 7).select("o_orderkey", V.natural_id("job", "o_custkey", "o_orderkey").alias("job_id"), "shuffle_key", "split")


@query()
def crc_seeds(spark: SparkSession, d: str) -> DataFrame:
    """CRC-32 seeds of users and event types (DuckDB has no CRC)."""
    return table(spark, d, "events").select("user_id", "event_type").distinct().select("user_id", "event_type", V.seed_of(F.col("user_id").cast("string"), "event_type").alias("seed"))


@query("SELECT turn, conv_id, turn % 3 <> 2 AS ref, (CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::INTEGER AS free FROM conversations")
def ref_ids(spark: SparkSession, d: str) -> DataFrame:
    """Which ids are refs, and the smallest free number among used ones."""
    k = F.col("turn") % 3
    value = F.when(k == 0, F.concat(F.lit("t"), F.col("turn"))).when(k == 1, "v12").otherwise("vx1")
    used = F.when(k == 0, F.array(*map(F.lit, (2, 1, 4, 2)))).when(k == 1, F.array().cast("array<int>")).otherwise(F.array(*map(F.lit, (1, 3))))
    return table(spark, d, "conversations").select("turn", "conv_id", V.is_ref(value).alias("ref"), V.smallest_free(used).alias("free"))


@query("""
SELECT o_orderkey, to_json({'id': o_orderkey, 'status': CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'name': 'é ' || o_orderpriority,
  'items': coalesce((SELECT list({'line': l_linenumber, 'flag': l_returnflag} ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), [])})::VARCHAR AS document FROM orders
""")
def prompt_documents(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag")))).alias("items"))
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<struct<line:int,flag:string>>")
    doc = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.concat(F.lit("é "), "o_orderpriority").alias("name"), F.coalesce("items", none).alias("items"))
    return o.select("o_orderkey", V.json_text(doc).alias("document"))


@query("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'status' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 THEN 'path' END, CASE WHEN o_orderkey % 5 = 0 THEN 'legs' END) AS changed FROM orders
""")
def form_differences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    old = F.struct(F.col("o_orderstatus").alias("status"), F.when(k % 6 != 0, F.lit("a/b")).alias("path"), F.array(F.lit(1), F.lit(2)).alias("legs"))
    new = F.struct(F.when(k % 2 == 0, "?").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 3 != 0, F.lit("a/b")).alias("path"), F.when(k % 5 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("legs"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(V.changed_fields(old, new, ["status", "path", "legs"]), ",").alias("changed"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'b|c' ELSE '' END AS others, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE 'old' END || '|1' AS merged, CASE WHEN p_size % 4 = 0 THEN 'slit|scallop' ELSE 'slit' END AS toggled,
       CASE WHEN p_size % 5 = 0 THEN 'team' ELSE 'own|team' END AS names, CASE WHEN p_size % 5 = 0 THEN 'team' ELSE 'own' END AS first, CASE WHEN p_size % 2 = 0 THEN 'P1' ELSE 'P' END AS doubtful FROM part
""")
def array_values(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    lits = lambda *xs: F.array(*map(F.lit, xs))
    cands = F.when(s % 3 == 0, lits("a", "b", "c")).when(s % 3 == 1, lits("x", "b", "c")).otherwise(lits("b"))
    merged = V.overridden(F.create_map(F.lit("k"), F.lit("old"), F.lit("n"), F.lit("1")), F.when(s % 2 == 0, F.create_map(F.lit("k"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>")))
    chosen = F.when(s % 4 == 0, lits("scallop")).otherwise(lits("scallop", "slit"))
    cell = ("slit", "slot", "collar_front", "collar_back", "scallop")
    item = F.when(s % 4 == 0, "slit").otherwise("scallop")
    names, first = V.renamed(F.when(s % 5 == 0, lits("w9", "team")).otherwise(lits("w1", "w9")), {"w1": "own", "w9": "team"}, "none")
    low = F.filter(V.doubtful(F.lit("P-1"), F.array(F.lit(0.5), F.lit(0.9), F.when(s % 2 == 0, 0.79).otherwise(0.8))), lambda x: x.doubtful)
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(V.other_candidates(cands, F.when(s % 3 == 0, "b").otherwise("x")), "|").alias("others"),
        F.concat_ws("|", V.by_ref(merged, F.lit("k"), F.lit("-")), V.by_ref(merged, F.lit("n"), F.lit("-"))).alias("merged"),
        F.array_join(V.toggled(chosen, item, cell), "|").alias("toggled"), F.array_join(names, "|").alias("names"), first.alias("first"),
        F.array_join(F.transform(low, lambda x: x.char), "").alias("doubtful"),
    )


# --- records --------------------------------------------------------------------------


@query("""
WITH asked AS (SELECT DISTINCT o_custkey + 3 AS c_custkey FROM orders)
SELECT a.c_custkey, c_name, c_name IS NOT NULL AS found FROM asked a LEFT JOIN customer c USING (c_custkey)
""")
def point_lookups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(1).alias("seq"))
    rows = rows.unionByName(rows.withColumn("seq", F.lit(0)).withColumn("c_name", F.lit("overwritten")))
    return records.looked_up(table(spark, d, "orders").select((F.col("o_custkey") + 3).alias("c_custkey")).distinct(), rows, ["c_custkey"])


@query("""
SELECT ' Mail' || c_custkey || '@X.org ' AS email, (c_custkey // 2) * 2 AS user_id FROM customer WHERE c_custkey > 1
UNION ALL SELECT 'nobody', NULL
""")
def email_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_custkey > 1")
    mail = lambda key: F.concat(F.lit("mail"), key, F.lit("@x.org"))
    users = c.select(mail(F.col("c_custkey")).alias("email"), (F.floor(F.col("c_custkey") / 2) * 2).alias("user_id"), F.lit(1).alias("seq")).union(c.select(F.upper(mail(F.col("c_custkey"))), F.lit(-1).cast("long"), F.lit(2)))
    asked = c.select(F.concat(F.lit(" Mail"), "c_custkey", F.lit("@X.org ")).alias("email")).union(spark.createDataFrame([("nobody",)], "email string"))
    return records.by_email(asked, users).select("email", "user_id")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN event_id ELSE NULL END AS user_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN event_id IN (SELECT c_custkey FROM customer) ELSE false END AS known FROM events
""")
def current_users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    asked = table(spark, d, "events").select("event_id", F.when(k == 0, " ").when(k == 1, F.col("event_id").cast("string")).otherwise("x-y").alias("header"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return records.current_user(asked, users, 1).select("event_id", "user_id", "known")


_MEMBERS = "SELECT c_nationkey AS workspace_id, c_custkey AS user_id, CASE WHEN c_custkey % 10 = 3 THEN 'owner' ELSE 'member' END AS role, c_acctbal AS joined_at, c_custkey AS seq FROM customer"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_nationkey AS workspace_id", "c_custkey AS user_id", "CASE WHEN c_custkey % 10 = 3 THEN 'owner' ELSE 'member' END AS role", "c_acctbal AS joined_at", "c_custkey AS seq")


@query(f"""
WITH m AS ({_MEMBERS})
SELECT workspace_id, user_id, c_name AS name, row_number() OVER (PARTITION BY workspace_id ORDER BY role <> 'owner', joined_at, seq) AS position FROM m JOIN customer ON c_custkey = user_id
""")
def member_list(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("email"))
    rows = records.with_user_names(_members(spark, d), users)
    return records.numbered(rows, ["workspace_id"], records.member_order()).select("workspace_id", "user_id", "name", "position")


@query(f"WITH m AS ({_MEMBERS}) SELECT n_nationkey AS workspace_id, (SELECT count(*) FROM m WHERE workspace_id = n_nationkey AND user_id % 3 = 0) AS member_count FROM nation")
def member_counts(spark: SparkSession, d: str) -> DataFrame:
    spaces = table(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"))
    return records.member_counts(spaces, _members(spark, d).where("user_id % 3 = 0"))


@query("""
SELECT o_orderkey AS job_id, p AS position, r AS related_id, j.path AS related_path
FROM (SELECT o_orderkey, unnest([o_orderkey + 1, -1, o_orderkey - 2]) AS r, unnest([0, 1, 2]) AS p FROM orders) JOIN (SELECT o_orderkey AS id, 'p/' || o_custkey AS path FROM orders) j ON j.id = r
""")
def related_jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    jobs = table(spark, d, "orders").select(k.alias("job_id"), F.concat(F.lit("p/"), "o_custkey").alias("assembly_path"), F.array(k + 1, F.lit(-1).cast("long"), k - 2).alias("related"))
    return records.related(jobs)


@query("SELECT 99 AS workspace_id, 'sym_' || substr(sha256('99|' || p_partkey::VARCHAR), 1, 12) AS entry_id, p_brand AS code, p_partkey AS seq FROM part WHERE p_size = 7")
def dictionary_copy(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "part").select(F.col("p_size").alias("workspace_id"), F.col("p_partkey").alias("entry_id"), F.col("p_brand").alias("code"), F.col("p_partkey").alias("seq"))
    return records.copied(entries, 7, 99)


@query("""
SELECT o_orderpriority, count(*) AS jobs, count(*) FILTER (o_orderstatus <> 'F') AS open_jobs, count(*) FILTER (o_orderstatus = 'P') AS to_review FROM orders GROUP BY ALL
""")
def job_counters(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "needs_review").otherwise("draft")
    return records.counters(table(spark, d, "orders").withColumn("status", status), ["o_orderpriority"])


@query("""
SELECT page_id, n, row_number() OVER (ORDER BY n NULLS LAST, page_id) AS position FROM (SELECT page_id, try_cast(nullif(regexp_extract(regexp_extract(url, '^[^?#]*'), '([0-9]+)(\\.[^.]*)?$', 1), '') AS BIGINT) AS n FROM pages)
QUALIFY position <= 30
""")
def suffix_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first thirty pages by the number that ends their address: a limit that is the feature (LIM)."""
    from pyspark.sql import Window

    rows = table(spark, d, "pages").withColumn("n", records.numeric_suffix(F.regexp_extract("url", "^[^?#]*", 0)))
    order = [F.col("n").asc_nulls_last(), F.asc("page_id")]
    top = rows.select("page_id", "n").orderBy(*order).limit(30)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query("""
WITH RECURSIVE ev AS (
  SELECT user_id % 50 AS ws, CASE event_type WHEN 'view' THEN 'invite' WHEN 'click' THEN 'invite' WHEN 'error' THEN 'personal' ELSE 'team' END AS e, (value::BIGINT % 4)::VARCHAR AS u, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS rn FROM events
), f AS (
  SELECT DISTINCT ws, 0::BIGINT AS rn, 'personal' AS kind, ['0'] AS users, 0 AS accepted, 0 AS conflicts FROM ev
  UNION ALL
  SELECT ws, rn, CASE WHEN NOT ok THEN kind WHEN e = 'personal' THEN 'personal' ELSE 'team' END, CASE WHEN ok AND e = 'invite' THEN list_append(users, u) ELSE users END, accepted + ok::INT, conflicts + (NOT ok)::INT
  FROM (SELECT f.ws, ev.rn, ev.e, ev.u, f.kind, f.users, f.accepted, f.conflicts, CASE ev.e WHEN 'invite' THEN NOT list_contains(f.users, ev.u) WHEN 'team' THEN true ELSE len(f.users) = 1 END AS ok FROM f JOIN ev ON ev.ws = f.ws AND ev.rn = f.rn + 1)
)
SELECT ws, kind, len(users)::INT AS members, accepted, conflicts FROM f QUALIFY row_number() OVER (PARTITION BY ws ORDER BY rn DESC) = 1
""")
def workspace_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "invite").when(F.col("event_type") == "error", "personal").otherwise("team")
    e = table(spark, d, "events").select((F.col("user_id") % 50).alias("ws"), kind.alias("event"), F.bround("value").cast("long").alias("v"), "ts", "event_id", F.lit("0").alias("owner")).withColumn("user", F.col("v") % 4)
    return records.invitations(e, ["ws"], ["ts", "event_id"])
