"""Long histories of the job state machine: transitions compose, so that pieces of one job's history fold apart.

A piece of history is a map: for every state a job may come in with, the state it leaves in and how many events were accepted and rejected. Maps
compose associatively. Events are range-partitioned by job and order, each task composes what it has of a job into one map, pairs of
neighbours at a time, and a job's maps (one for each partition that holds some of it) are applied in order. No task holds a whole history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESTING = ("draft", "needs_review", "awaiting_approval", "approved")
#: A job at rest, or in analysis with the state that a failure restores.
STATES = (*((s, s) for s in RESTING), *(("analyzing", s) for s in RESTING))
N = len(STATES)


def after(event: str | None, status: str, before: str) -> tuple[str, str] | None:
    """(status, state that a failure restores) after an event, or None if the event doesn't fit."""
    if event == "start" and status != "analyzing":
        return "analyzing", status
    if event in ("passed", "unsure", "failed") and status == "analyzing":
        to = {"passed": "awaiting_approval", "unsure": "needs_review", "failed": before}[event]
        return to, to
    if event == "approve" and status == "awaiting_approval" or event == "acknowledge" and status in ("needs_review", "awaiting_approval"):
        return "approved", "approved"
    return None


def _maps(event: str | None) -> tuple[list[int], list[int]]:
    """(state after the event, whether it was accepted) for every state before."""
    to = [after(event, *s) for s in STATES]
    return [i if t is None else STATES.index(t) for i, t in enumerate(to)], [int(t is not None) for t in to]


def _composed(to: np.ndarray, taken: np.ndarray, size: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One map for each run of neighbours: every round composes the pairs of each run."""
    while len(run) > 1 and (run[1:] == run[:-1]).any():
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        place = np.arange(len(run)) - np.repeat(first, np.diff(np.r_[first, len(run)]))
        left = np.flatnonzero(place % 2 == 0)
        right = left + 1
        paired = right < len(run)
        paired[paired] = run[right[paired]] == run[left[paired]]
        a, b = left[paired], right[paired]
        taken[a] += np.take_along_axis(taken[b], to[a], 1)
        to[a] = np.take_along_axis(to[b], to[a], 1)
        size[a] += size[b]
        to, taken, size, run = to[left], taken[left], size[left], run[left]
    return to, taken, size


def _pieces(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The task's maps, one for each job; its rows come sorted by job and order."""
    tables: dict[str | None, tuple[list[int], list[int]]] = {}
    carried: pa.RecordBatch | None = None
    names: list[str] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(n_keys).dictionary_encode()
        events = coded.dictionary.to_pylist() + [None]
        for e in events:
            tables.setdefault(e, _maps(e))
        code = coded.indices.fill_null(len(events) - 1).to_numpy(zero_copy_only=False)
        to, taken = (np.array([tables[e][i] for e in events], np.int64)[code] for i in (0, 1))
        rows = [batch.column(i) for i in range(n_keys)]
        names = batch.schema.names[:n_keys]
        size = np.ones(len(code), np.int64)
        if carried is not None:  # the last job of the batch before may go on
            rows = [pa.concat_arrays([carried.column(i), r]) for i, r in enumerate(rows)]
            old = lambda c: np.array(carried.column(n_keys + c).to_pylist(), np.int64)
            to, taken, size = np.concatenate([old(0), to]), np.concatenate([old(1), taken]), np.r_[old(2), size]
        changed = np.zeros(len(size), bool)
        for r in rows:
            same = pc.fill_null(pc.equal(r[1:], r[:-1]), False).to_numpy(zero_copy_only=False) | (r[1:].is_null().to_numpy(zero_copy_only=False) & r[:-1].is_null().to_numpy(zero_copy_only=False))
            changed[1:] |= ~same
        run = np.cumsum(changed)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        to, taken, size = _composed(to, taken, size, run)
        lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (to, taken)]
        whole = pa.RecordBatch.from_arrays([*[r.take(pa.array(starts)) for r in rows], *lists, pa.array(size)], names=[*names, "to", "taken", "size"])
        carried = whole.slice(whole.num_rows - 1)
        if whole.num_rows > 1:
            yield whole.slice(0, whole.num_rows - 1)
    if carried is not None:
        yield carried


def job_states(events: DataFrame, keys: list[str], event: str, order: list[str]) -> DataFrame:
    """keys, status, accepted, rejected: each job's state after its events in order, as ``folds.job_states``, for histories of any length."""
    rows = events.select(*keys, F.col(event).cast("string").alias("_event"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    by = [*keys, *[f"_order{i}" for i in range(len(order))]]
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["to array<long>", "taken array<long>", "size long"])
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, "_event")
    pieces = ordered.mapInArrow(lambda batches: _pieces(batches, len(keys)), schema).withColumn("part", F.spark_partition_id())
    lists = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "to", "taken", "size"))).alias("maps"))  # at most one for each partition
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("events"))
    at = lambda values, state: F.get(values, state.cast("int"))
    step = lambda a, m: F.struct(at(m.to, a.state).alias("state"), (a.accepted + at(m.taken, a.state)).alias("accepted"), (a.events + m["size"]).alias("events"))
    done = lists.select(*keys, F.aggregate("maps", start, step).alias("s"))
    status = F.get(F.array(*[F.lit(s) for s, _ in STATES]), F.col("s.state").cast("int"))
    return done.select(*keys, status.alias("status"), F.col("s.accepted").cast("int").alias("accepted"), (F.col("s.events") - F.col("s.accepted")).cast("int").alias("rejected"))
