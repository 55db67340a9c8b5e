"""Records of a workspace store: lookups, members, projects, splits and orders, set at a time.

The tables carry ``seq``, their order of insertion. Orders are given as sort columns or as a numbered column, so that a caller sorts once,
at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each asked key with its row, the last written of equal keys, and ``found``; keys without a row stay with nulls."""
    rest = [c for c in rows.columns if c not in [*keys, "seq"]]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    joined = asked.join(last, keys, "left")
    return joined.select(*asked.columns, *[F.col("r")[c].alias(c) for c in rest], F.col("r").isNotNull().alias("found"))


def by_email(asked: DataFrame, users: DataFrame) -> DataFrame:
    """Each asked ``email`` with the id of the first user whose e-mail is equal but for case and blanks around it."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    first = users.groupBy(plain("email").alias("mail")).agg(F.min_by("user_id", "seq").alias("user_id"))
    return asked.withColumn("mail", plain("email")).join(first, "mail", "left").drop("mail")


def current_user(requests: DataFrame, users: DataFrame, default: str | int) -> DataFrame:
    """Requests with ``user_id`` and ``known``: a blank header is the default user; a header that names nobody isn't known."""
    kind = dict(users.dtypes)["user_id"]
    wanted = requests.withColumn("user_id", F.coalesce(F.nullif(F.trim("header"), F.lit("")), F.lit(str(default))).try_cast(kind))
    have = users.select("user_id", F.lit(True).alias("known")).distinct()
    return wanted.join(have, "user_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def with_user_names(members: DataFrame, users: DataFrame) -> DataFrame:
    """Members with the name and e-mail of their user."""
    return members.join(users.select("user_id", "name", "email"), "user_id", "left")


def member_order() -> list[Column]:
    """Owners first, then by the time of joining."""
    return [F.when(F.col("role") == "owner", 0).otherwise(1), F.asc("joined_at"), F.asc("seq")]


def member_counts(workspaces: DataFrame, members: DataFrame) -> DataFrame:
    """Workspaces with their ``member_count``, 0 without members."""
    n = members.groupBy("workspace_id").agg(F.count_distinct("user_id").alias("member_count"))
    return workspaces.join(n, "workspace_id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0)))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Rows with their place within their key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def related(jobs: DataFrame, ids: str = "related") -> DataFrame:
    """(job_id, position, related_id, related_path): the related jobs that exist, in their order."""
    known = jobs.select(F.col("job_id").alias("related_id"), F.col("assembly_path").alias("related_path"))
    asked = jobs.select("job_id", F.posexplode(ids).alias("position", "related_id"))
    return asked.join(known, "related_id").select("job_id", "position", "related_id", "related_path")


def copied(entries: DataFrame, source: object, target: object) -> DataFrame:
    """The entries of one workspace as new entries of another: fresh ids of the natural key, the order kept."""
    from inkspark.functions.values import natural_id

    rows = entries.where(F.col("workspace_id") == source)
    return rows.withColumn("workspace_id", F.lit(target)).withColumn("entry_id", natural_id("sym", F.lit(target), "entry_id"))


def parity_split(rows: DataFrame, order: list[Column], groups: list[str]) -> DataFrame:
    """Every other row of a group, by its sorted place, is ``eval``, the rest ``train``."""
    return numbered(rows, groups, order, "place").withColumn("split", F.when(F.col("place") % 2 == 0, "eval").otherwise("train")).drop("place")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with ``shuffle_key``, an order that only the seed and the key decide."""
    return rows.withColumn("shuffle_key", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256))


def numeric_suffix(name: Column | str) -> Column:
    """The number that ends a name without its extension; null without one."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(c, r"([0-9]+)(?:\.[^.]*)?$", 1).try_cast("long")


def counters(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: all jobs, open ones (not approved) and those to review."""
    return jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") != "approved").alias("open_jobs"), F.count_if(F.col("status") == "needs_review").alias("to_review")
    )


def invitations(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, kind, members, accepted, conflicts) after a workspace's events in order.

    ``event``: ``invite`` (of ``user``; one who is a member already conflicts, anyone else makes the workspace a team), ``personal`` (allowed
    with one member only) and ``team``. A workspace starts personal with its owner, ``owner``.
    """
    kind = "struct<kind:string,users:array<string>,accepted:int,conflicts:int>"
    start = F.struct(F.lit("personal").alias("kind"), F.array("owner").alias("users"), F.lit(0).alias("accepted"), F.lit(0).alias("conflicts"))

    def step(a, r):
        fresh = (r.event == "invite") & ~F.array_contains(a.users, r.user)
        ok = fresh | (r.event == "team") | ((r.event == "personal") & (F.size(a.users) == 1))
        to = F.when(fresh | (r.event == "team"), "team").when(ok, "personal").otherwise(a.kind)
        users = F.when(fresh, F.concat(a.users, F.array(r.user))).otherwise(a.users)
        return F.struct(to.alias("kind"), users.alias("users"), (a.accepted + ok.cast("int")).alias("accepted"), (a.conflicts + (~ok).cast("int")).alias("conflicts"))

    own = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "event", F.col("user").cast("string").alias("user")))).alias("e"), F.min(F.col("owner").cast("string")).alias("owner"))
    done = own.select(*keys, F.aggregate("e", start.cast(kind), lambda a, r: step(a, r).cast(kind)).alias("s"))
    return done.select(*keys, "s.kind", F.size("s.users").alias("members"), "s.accepted", "s.conflicts")
