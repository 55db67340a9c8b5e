"""A blocked Bloom filter as a table of 512-bit blocks, in DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_LONGS = 8
BITS_PER_KEY = 16
HASHES = 6
BROADCAST_BYTES = 8 << 20


def block_count(n_keys: int) -> int:
    """Blocks for so many keys."""
    return max(1, -(-n_keys * BITS_PER_KEY // (64 * BLOCK_LONGS)))


def _bits(key: Column) -> list[Column]:
    """Positions 0..511 inside the block: nine bits each of a second hash."""
    h = F.xxhash64(key, F.lit(0x5BD1E995))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(511) for i in range(HASHES)]


def masks(key: Column) -> list[Column]:
    """The eight longs with the key's bits set."""
    bits = _bits(key)
    words = []
    for w in range(BLOCK_LONGS):
        parts = [
            F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))
            for b in bits
        ]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), parts))
    return words


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7) of the blocks that hold a listed key; ``listed`` has the column ``key``."""
    bits = masks(F.col("key"))
    rows = listed.select(
        F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(bits)]
    )
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_LONGS)])


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any case, for columns that are dropped again."""
    taken, out = {c.lower() for c in df.columns}, f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def _tested(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, str] | None:
    """``rows`` with one more column, named beside them: false where the key is surely not among ``keys``; None if the filter would be too large."""
    n_blocks = block_count(keys.count())
    if n_blocks * (BLOCK_LONGS + 1) * 8 > BROADCAST_BYTES:
        return None
    filters = bloom_blocks(keys.select(F.col(key).alias("key")), n_blocks)
    mine = {c: unused(rows, c) for c in [*filters.columns, "maybe"]}
    blocks = F.broadcast(filters.withColumnsRenamed(mine))
    test = reduce(lambda a, b: a & b, [F.col(mine[f"w{i}"]).bitwiseAND(m) == m for i, m in enumerate(masks(F.col(key)))])
    tested = (
        rows.withColumn(mine["block"], F.pmod(F.xxhash64(key), F.lit(n_blocks)))
        .join(blocks, mine["block"], "left")
        .withColumn(mine["maybe"], F.coalesce(test, F.lit(False)))
        .drop(*[mine[c] for c in filters.columns])
    )
    return tested, mine["maybe"]


def with_keys_of(rows: DataFrame, keys: DataFrame, key: str, exact: bool = True) -> DataFrame:
    """The rows whose ``key`` is among ``keys`` (distinct, not null): a left semi join that shuffles few other rows.

    A Bloom filter of the keys drops most other rows where they are read, if its blocks stay under
    ``BROADCAST_BYTES`` (about four million keys); with more keys the join alone does the work. Without
    ``exact`` the join is left out, for callers that join with the keys themselves.
    """
    tested = _tested(rows, keys, key)
    if tested is not None:
        rows = tested[0].where(F.col(tested[1])).drop(tested[1])
    return rows.join(keys.select(key), key, "left_semi") if exact else rows


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that need a join with ``keys``, rows whose key is surely not among them)."""
    tested = _tested(rows, keys, key)
    if tested is None:
        return rows, rows.limit(0)
    rows, maybe = tested
    return rows.where(F.col(maybe)).drop(maybe), rows.where(~F.col(maybe)).drop(maybe)


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` isn't among ``keys``.

    Keys of at most ``BROADCAST_BYTES`` (by count, 24 bytes each) are broadcast; of more, the Bloom filter lets surely
    absent rows pass and only possible hits are shuffled to the anti join.
    """
    theirs = unused(rows, "theirs")
    other = keys.select(F.col(key).alias(theirs))
    if keys.count() * 24 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), F.col(key) == F.col(theirs), "left_anti")
    maybe, sure = split_by_keys(rows, keys, key)
    return sure.unionByName(maybe.join(other, F.col(key) == F.col(theirs), "left_anti"))
