"""Search, membership, change logs and latest revisions.

Spark rows have no order of their own: every table here carries ``seq``, its order of insertion, and ties are settled by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(
    rows: DataFrame,
    text_cols: list[str],
    q: str | None = None,
    equal: dict[str, object] | None = None,
    newest: str | None = None,
    seq: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows that meet all given equalities and hold ``q`` in one of ``text_cols``, newest first.

    A blank ``q`` and null equalities are no filter. The equalities reach the scan; the substring test doesn't care
    about case.
    """
    for name, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if q and q.strip():
        wanted = q.strip().lower()
        rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(wanted), F.lit(False)) for c in text_cols]))
    order = [F.desc(newest)] if newest else []
    order += [F.asc(seq)] if seq else []
    if order:
        rows = rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows


def members_only(rows: DataFrame, members: DataFrame, key: str, user: Column | None = None) -> DataFrame:
    """Rows whose key has a member row (of ``user``, if given)."""
    found = members if user is None else members.where(user)
    return rows.join(found.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among ``used``."""
    return rows.join(used.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], by: str, seq: str) -> DataFrame:
    """The newest row of each key; of equally new ones the first inserted. One partial aggregate, no window sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), -F.col(seq))).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def upserted(log: DataFrame, keys: list[str], value: str, seq: str, deleted: Column | None = None) -> DataFrame:
    """The state of a change log: first position and last value of each key, without keys whose last change deletes them.

    Positions restart after a deletion.
    """
    gone = F.lit(False) if deleted is None else deleted
    marked = log.select(*keys, F.col(value).alias("value"), F.col(seq).alias("seq"), gone.alias("gone"))
    last_gone = marked.groupBy(*keys).agg(F.max(F.when(F.col("gone"), F.col("seq"))).alias("last_gone"))
    live = marked.join(last_gone, keys).where("last_gone IS NULL OR seq > last_gone")
    return live.groupBy(*keys).agg(F.min("seq").alias("position"), F.max_by("value", "seq").alias("value"))


def merged_corrections(corrections: DataFrame, keys: list[str], target: str, value: str, seq: str) -> DataFrame:
    """The last value of each target at the place of its first correction."""
    return corrections.groupBy(*keys, target).agg(F.max_by(value, seq).alias("value"), F.min(seq).alias("position"))


def preferred(*columns: str) -> Column:
    """The first that isn't null: correction, then second reading, then first reading."""
    return F.coalesce(*columns)


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two readings: ``same``, ``mismatch``, ``only_left`` or ``only_right`` by key."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    return a.join(b, keys, "full_outer").select(
        *keys,
        "left_value",
        "right_value",
        F.when(F.col("in_right").isNull(), "only_left")
        .when(F.col("in_left").isNull(), "only_right")
        .when(F.col("left_value").eqNullSafe(F.col("right_value")), "same")
        .otherwise("mismatch")
        .alias("outcome"),
    )


def partial_update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the sent columns replaced; ``changes`` has the flag ``sent_<column>`` beside each."""
    c = changes.select(F.col(key), *[F.col(x).alias(f"new_{x}") for x in columns], *[f"sent_{x}" for x in columns])
    joined = rows.join(c, key, "left")
    return joined.select(*[
        F.when(F.coalesce(F.col(f"sent_{x}"), F.lit(False)), F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x)
        for x in rows.columns
    ])


def sampled(rows: DataFrame, key: str, n: int, seed: int, seq: str) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their key, in their own order; the feature is the sample."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n).orderBy(seq)
