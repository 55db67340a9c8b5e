"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest capacity are cut into full pieces, each a sequence of its own, and a rest. Rests are integers of
at most that capacity, so packing needs only how many there are of each length: a histogram whose size the capacity
bounds, whatever the data's. Best-fit decreasing runs on those counts, over groups of equal sequences at once: items
of a length go to the open group with the least room that still fits; where none fits, sequences of the permitted
length with the least cost per token are opened (cost: capacity plus ``OVERHEAD``; tokens: what the remaining items could
fill greedily). In the end each sequence shrinks to the smallest permitted length that holds its contents.

The plan that rows look themselves up in has a row of 40 bytes per placement. A length splits few groups, so that their number follows
the number of lengths (a few thousand) and not the rows: 8,916 placements for three million rests of 4,095 lengths.

Rows then look up their place: each row is numbered within its length, in cells of ``CELL_ROWS`` rows and prefix sums over them (one
length may hold any share of the rows), and the number decides the sequence and the offset.

Defined results: a null or blank text has no tokens and a row with a null sequence; rows that share an id are packed
separately; nothing is dropped or cut off. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspark.llm.store import source, written

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 8
CELL_ROWS, MAX_CELLS = 500, 1 << 16  # rows numbered in one group, and groups of one length


@dataclass
class Group:
    """``bins`` equal sequences: how much room is left, and (length, copies) in the order of placing."""

    bins: int
    room: int
    placed: tuple


def _filled(room: int, lengths: list[int], counts: dict[int, int]) -> int:
    """Tokens that the remaining items put into ``room``, the largest first."""
    got, used = 0, defaultdict(int)
    i = bisect_left(lengths, room + 1) - 1
    while i >= 0 and got < room:
        length = lengths[i]
        n = min(counts[length] - used[length], (room - got) // length)
        if n > 0:
            got += n * length
            used[length] += n
        i = min(i - 1, bisect_left(lengths, room - got + 1) - 1)
    return got


def best_fit(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[Group]:
    """Packs ``counts[length]`` items of each length; the groups with their shrunken capacity as ``room + contents``."""
    sizes = sorted(capacities)
    counts = {k: v for k, v in counts.items() if v}
    if counts and max(counts) > sizes[-1]:
        raise ValueError("an item is longer than the largest capacity")
    left = sorted(counts)
    rooms: list[int] = []  # the distinct rooms of open groups
    open_: dict[int, list[Group]] = {}

    def put(g: Group) -> None:
        if g.room not in open_:
            insort(rooms, g.room)
            open_[g.room] = []
        open_[g.room].append(g)

    while left:
        length = left.pop()
        n = counts.pop(length)
        while n:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                g = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                m = min(n, g.bins)
                # the same items come back to these sequences at once: what room is left there is now the least that fits
                copies = max(1, min(n // m, room // length)) if m == g.bins else 1
                put(Group(m, room - copies * length, (*g.placed, (length, copies))))
                if g.bins > m:
                    put(Group(g.bins - m, room, g.placed))
                n -= m * copies
                continue
            # the least cost per token; of equals the smaller
            counts_left = {**counts, length: n - 1}
            pool = [*left, length] if n > 1 else left
            size = min(
                (s for s in sizes if s >= length),
                key=lambda s: ((s + overhead) / (length + _filled(s - length, pool, counts_left)), s),
            )
            per = size // length
            whole, rest = divmod(n, per)
            if whole:
                put(Group(whole, size - per * length, ((length, per),)))
            if rest:
                put(Group(1, size - rest * length, ((length, rest),)))
            n = 0
    out = []
    for groups in open_.values():
        for g in groups:
            used = sum(a * b for a, b in g.placed)
            out.append(Group(g.bins, next(s for s in sizes if s >= used) - used, g.placed))
    return out


@dataclass
class Plan:
    """For items numbered within their length: sorted starts of ranges, and each range's sequences."""

    key: np.ndarray  # length << 40 | first number of the range
    first_bin: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    capacity: np.ndarray
    n_bins: int


def plan_of(groups: list[Group]) -> Plan:
    """Numbers the sequences and gives each placement its range of items."""
    rows, next_item, next_bin = [], defaultdict(int), 0
    for g in sorted(groups, key=lambda g: (g.placed, g.room)):
        at = 0
        capacity = g.room + sum(a * b for a, b in g.placed)
        for length, copies in g.placed:
            rows.append(((length << 40) | next_item[length], next_bin, copies, at, capacity))
            next_item[length] += g.bins * copies
            at += length * copies
        next_bin += g.bins
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*cols, next_bin)


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan, largest: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "n_tokens", "bin_id", "bin_capacity", "bin_offset"]
    for batch in batches:
        n, full, rest, number, full_before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "full", "rest", "number", "full_before"))
        has = np.flatnonzero(rest > 0)
        at = np.searchsorted(plan.key, (rest[has] << 40) | number[has], side="right") - 1
        within = number[has] - (plan.key[at] & ((1 << 40) - 1))
        rest_bin = plan.first_bin[at] + within // plan.copies[at]
        rest_offset = plan.offset[at] + within % plan.copies[at] * rest[has]
        owner = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        none = np.flatnonzero(n == 0)
        zero = lambda like: np.zeros(len(like), np.int64)
        parts = {
            "piece": (piece, full[has], zero(none)),
            "n_tokens": (np.full(len(owner), largest), rest[has], zero(none)),
            "bin_id": (plan.n_bins + full_before[owner] + piece, rest_bin, zero(none)),
            "bin_capacity": (np.full(len(owner), largest), plan.capacity[at], zero(none)),
            "bin_offset": (zero(owner), rest_offset, zero(none)),
        }
        rows = np.concatenate([owner, has, none]).astype(np.int64)
        blank = np.arange(len(rows)) >= len(owner) + len(has)
        cols = [batch.column("doc_id").take(pa.array(rows))]
        for k in names[1:]:
            v = np.concatenate(parts[k]).astype(np.int64)
            cols.append(pa.array(v, mask=blank if k.startswith("bin") else None))
        yield pa.RecordBatch.from_arrays(cols, names=names)


def word_count(text: Column) -> Column:
    """Words (runs without ASCII white space) of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, n_tokens: Column, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_capacity, bin_offset: where each piece of each document goes.

    Piece k of a document are its tokens from ``k * max(capacities)`` on.
    """
    largest = max(capacities)
    items = docs.select(F.col(id_col).alias("doc_id"), n_tokens.alias("n")).select(
        "doc_id", "n", F.floor(F.col("n") / largest).alias("full"), (F.col("n") % largest).alias("rest")
    )
    items = written(items, "pack-items")
    histogram = items.groupBy("rest").count().toArrow()  # at most max(capacities) rows
    counts = dict(zip(histogram["rest"].to_pylist(), histogram["count"].to_pylist()))
    plan = plan_of(best_fit({k: v for k, v in counts.items() if k}, capacities, overhead))
    # the rows of a length are numbered in cells of bounded size; a cell has a row in the tables of offsets
    per_cell = max(CELL_ROWS, -(-sum(counts.values()) // MAX_CELLS))
    cells = items.sparkSession.createDataFrame([(k, -(-v // per_cell)) for k, v in counts.items()], "rest long, cells long")
    spread = F.when(F.col("doc_id").isNull(), F.rand(5)).otherwise(0.0)  # rows without an id have only their number of tokens
    salted = items.withColumn("spread", spread).join(F.broadcast(cells), "rest").withColumn("salt", F.pmod(F.xxhash64("doc_id", "n", "spread"), "cells"))
    salted = written(salted.drop("cells", "spread"), "pack-cells")
    sums = salted.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("rows"), F.sum("full").alias("pieces"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    by_length = sums.withColumn("rows_before", upto("rows", before("rest", "salt"))).withColumn("inside_before", upto("pieces", before("rest", "salt")))
    lengths = sums.groupBy("rest").agg(F.sum("pieces").alias("p"))  # at most max(capacities) rows
    lengths = lengths.select("rest", upto("p", Window.orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)).alias("length_before"))
    offsets = by_length.join(F.broadcast(lengths), "rest").select("rest", "salt", "rows_before", (F.col("inside_before") + F.col("length_before")).alias("pieces_before"))
    w = Window.partitionBy("rest", "salt").orderBy("doc_id", "n")
    numbered = (
        salted.withColumn("i", F.row_number().over(w) - 1)
        .withColumn("f", upto("full", w.rowsBetween(Window.unboundedPreceding, -1)))
        .join(offsets, ["rest", "salt"])
        .select("doc_id", "n", "full", "rest", (F.col("i") + F.col("rows_before")).cast("long").alias("number"), (F.col("f") + F.col("pieces_before")).cast("long").alias("full_before"))
    )
    kind = dict(items.dtypes)["doc_id"]
    return numbered.mapInArrow(
        partial(_placed, plan=plan, largest=largest), f"doc_id {kind}, piece long, n_tokens long, bin_id long, bin_capacity long, bin_offset long"
    )


def op6_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the words of all of ``documents`` into sequences of the permitted lengths."""
    return pack(source(spark, sf_dir, "documents"), word_count(F.col("text")))
