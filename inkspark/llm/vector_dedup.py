"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards, with audited recall and exact cosines.

1. Equal vectors become one node with its number of copies. Pivots (random nodes, thinned so that no two are near each other) deal
   nodes into cells; cells are cut into blocks of bounded size.
2. Balls: inside a block, nodes within half the threshold's angle of a leader become one ball. All members of a ball are linked with each
   other for certain, so that a group of copies costs a few nodes from here on, and its links are counted without any pair.
3. Graph: ball leaders go to the shards of their nearest pivots, several each. Each shard builds a pruned graph; a leader's adjacency lists
   of all its shards are united. In every shard all its leaders search the united graph from the shard's medoid; the search goes on while
   nodes are in range: the threshold's angle and both balls' radii.
4. Verify: the angles of two balls and their radii tell that all members are linked, or none; else the members are compared by double
   cosines, block against block. Only counts of links and one link of two balls leave a task.
5. Audit: a bounded sample of nodes is compared with all nodes by brute force. If less than ``recall`` of the true links was found, the search is
   repeated with twice the overlap and the beam, at last with every pivot's shard, which misses only what the graphs lose.

A shard over ``SHARD`` leaders is cut into blocks with a graph each, and all the shard's leaders search each of them.

Defined results: a vector is compared with those of its length only. Vectors that are null, empty, zero or hold null or non-finite components, and
null ids, are linked with nothing and kept; their component is the id. Rows that repeat an id share a component; each counts as a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.components import components
from inkspark.llm.flat_graph import BEAM, build, medoid, search
from inkspark.llm.store import source, written

BLOCK = 2048
SHARD = 2048
PER_PIVOT = 256
PIVOT_BYTES = 32 << 20
AUDIT_VALUES = 1 << 18
APART = math.cos(math.radians(45))
SLACK = 1e-9
MEMBERS = "node long, ball long, copies long, first long, vec array<double>, radius double, mass long"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(matrix.reshape(-1)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with vectors of length one; scaled by the largest component first, so that squares neither vanish nor overflow."""
    for batch in batches:
        at = batch.schema.get_field_index("vec")
        column = batch.column(at)
        sizes = np.diff(column.offsets.to_numpy())
        flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(sizes)[:-1]]
        if len(flat):
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), sizes)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), sizes)
        yield batch.set_column(at, batch.schema.field(at), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat)))


def _thinned(pivots: np.ndarray) -> np.ndarray:
    """The pivots without those near an earlier one: a crowd of near copies gets one."""
    kept = np.zeros((0, pivots.shape[1]))
    for i in range(0, len(pivots), 1024):
        part = pivots[i : i + 1024]
        part = part[(part @ kept.T >= APART).sum(1) == 0]
        near, live = part @ part.T >= APART, np.ones(len(part), bool)
        for j in range(len(part)):
            live[j] = not (near[j, :j] & live[:j]).any()
        kept = np.concatenate([kept, part[live]])
    return kept


def _cells(batches: Iterator[pa.RecordBatch], pivots: Broadcast, overlap: int) -> Iterator[pa.RecordBatch]:
    """The rows with the numbers of their nearest pivots' cells, nearest first."""
    for batch in batches:
        vectors = batch.column("vec")
        sizes = np.diff(vectors.offsets.to_numpy())
        cells: list[list[int] | None] = [None] * batch.num_rows
        for size in np.unique(sizes):
            rows, base = np.flatnonzero(sizes == size), int(size) << 32
            own = pivots.value.get(int(size))
            unit = _matrix(vectors.take(pa.array(rows)))
            for i in range(0, len(rows), 1024):
                part = rows[i : i + 1024]
                if own is None:
                    near = np.zeros((len(part), 1), np.int64)
                else:
                    sims, width = unit[i : i + 1024] @ own.T, min(overlap, len(own))
                    near = np.argpartition(-sims, width - 1, 1)[:, :width] if width < len(own) else np.argsort(-sims, 1)
                for row, numbers in zip(part.tolist(), (near + base).tolist()):
                    cells[row] = numbers
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])


def _balls(rows: pa.Table, half: float) -> pa.Table:
    """The nodes of a block with their balls; leaders also get the ball's radius and number of vectors."""
    node, copies, first = (rows[c].to_numpy() for c in ("node", "copies", "first"))
    unit = _matrix(rows["vec"])
    sims = unit @ unit.T
    near = sims >= math.cos(half)
    ball, radius, mass = np.full(len(node), -1), np.full(len(node), np.nan), np.zeros(len(node), np.int64)
    smallest = first.copy()
    for i in np.lexsort((node, -near.sum(1))):
        if ball[i] < 0:
            own = np.flatnonzero(near[i] & (ball < 0))
            own = own if i in own else np.r_[own, i]
            ball[own] = i
            radius[i] = float(np.arccos(np.clip(sims[i, own].min(), -1, 1))) if len(own) > 1 else 0.0
            mass[i], smallest[i] = copies[own].sum(), first[own].min()
    leads = ~np.isnan(radius)
    return pa.Table.from_arrays(
        [pa.array(node), pa.array(node[ball]), pa.array(copies), pa.array(smallest), rows["vec"], pa.array(radius, mask=~leads), pa.array(mass, mask=~leads)],
        schema=pa.schema([("node", pa.int64()), ("ball", pa.int64()), ("copies", pa.int64()), ("first", pa.int64()), ("vec", pa.list_(pa.float64())), ("radius", pa.float64()), ("mass", pa.int64())]),
    )


def _edges(rows: pa.Table, beam: int) -> pa.Table:
    """Adjacency lists of a shard's graph."""
    rows = rows.sort_by("ball")
    ball = rows["ball"].to_numpy()
    edges = build(_matrix(rows["vec"]).astype(np.float32), beam=beam)
    lists = [ball[e[e >= 0]] for e in edges]
    return pa.Table.from_arrays([rows["ball"], pa.array(lists, pa.list_(pa.int64()))], schema=pa.schema([("ball", pa.int64()), ("near", pa.list_(pa.int64()))]))


def _found(rows: pa.Table, angle: float, beam: int) -> pa.Table:
    """Pairs of balls in range: the block's queries against the block's graph."""
    rows = rows.combine_chunks().sort_by("ball")
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64()), ("radius_a", pa.float64()), ("radius_b", pa.float64()), ("mass_a", pa.int64()), ("mass_b", pa.int64())])
    ball, radius, mass = (rows[c].to_numpy() for c in ("ball", "radius", "mass"))
    unit = _matrix(rows["vec"])
    inside = np.flatnonzero(~rows["asks"].to_numpy(zero_copy_only=False))
    if not len(inside):
        return kinds.empty_table()
    asks = np.flatnonzero(rows["asks"].to_numpy(zero_copy_only=False))
    asks = asks if len(asks) else inside
    lists = rows["near"].take(pa.array(inside)).combine_chunks()
    place = np.searchsorted(ball[inside], lists.flatten().to_numpy(zero_copy_only=False))
    place[place == len(inside)] = 0
    here = ball[inside][place] == lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(inside)), np.diff(lists.offsets.to_numpy()))[here]
    place = place[here]
    counts = np.bincount(owner, minlength=len(inside))
    edges = np.full((len(inside), max(1, counts.max(initial=0))), -1, np.int32)
    edges[owner, np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)] = place
    small = unit.astype(np.float32)
    graph, start, parts = small[inside], medoid(small[inside]), []
    for i in range(0, len(asks), 256):
        part = asks[i : i + 256]
        reach = np.cos(np.minimum(angle + radius[part][:, None] + radius[inside][None, :] + 1e-4, np.pi)) - 1e-5
        met, _ = search(graph, edges, start, small[part], beam, reach.astype(np.float32))
        q, g = np.nonzero(met >= reach)
        parts.append(np.stack([part[q], inside[g]], 1))
    pairs = np.concatenate(parts)
    pairs = pairs[ball[pairs[:, 0]] != ball[pairs[:, 1]]]
    pairs = np.unique(np.sort(pairs, 1), axis=0)  # rows are sorted by ball
    x, y = pairs[:, 0], pairs[:, 1]
    cosine = np.einsum("ij,ij->i", unit[x], unit[y])
    return pa.Table.from_arrays([pa.array(v) for v in (ball[x], ball[y], cosine, radius[x], radius[y], mass[x], mass[y])], schema=kinds)


def _between(rows: pa.Table, cosine: float) -> pa.Table:
    """Numbers of linked vectors of the members of two balls in the other one."""
    rows = rows.combine_chunks()
    unit, copies, node = _matrix(rows["vec"]), rows["copies"].to_numpy(), rows["node"].to_numpy()
    left = rows["ball"].to_numpy() == rows["a"].to_numpy()
    linked = unit[left] @ unit[~left].T >= cosine
    links = np.zeros(len(node), np.int64)
    links[left], links[~left] = linked @ copies[~left], copies[left] @ linked
    some = pa.array(np.flatnonzero(links))
    return pa.Table.from_arrays([rows["a"].take(some), rows["b"].take(some), pa.array(node).take(some), pa.array(links).take(some)], names=["a", "b", "node", "links"])


def _true_links(batches: Iterator[pa.RecordBatch], asked: Broadcast, cosine: float) -> Iterator[pa.RecordBatch]:
    """For the asked nodes, the number of linked vectors among the task's."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = np.diff(batch.column("vec").offsets.to_numpy())
        copies = batch.column("copies").to_numpy()
        for size, (nodes, unit) in asked.value.items():
            rows = np.flatnonzero(sizes == size)
            own = _matrix(batch.column("vec").take(pa.array(rows))) if len(rows) else np.zeros((0, size))
            total = sums.setdefault(size, np.zeros(len(nodes), np.int64))
            for i in range(0, len(rows), 1024):
                total += (unit @ own[i : i + 1024].T >= cosine) @ copies[rows[i : i + 1024]]
    for size, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(asked.value[size][0]), pa.array(total)], names=["node", "found"])


def _by_size(rows: pa.Table) -> dict[int, np.ndarray]:
    """Row numbers of each vector length."""
    sizes = np.diff(rows["vec"].combine_chunks().offsets.to_numpy())
    return {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}


def _cut(rows: DataFrame, most: int, key: str) -> DataFrame:
    """The rows with the number of blocks of their cell and their own block: about ``most`` rows each."""
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    return rows.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))  # a row for each pivot


def _nodes(rows: DataFrame) -> DataFrame:
    """node, key_a, key_b, first (smallest id), copies, vec (of length one) of the distinct vectors."""
    classes = rows.groupBy("key_a", "key_b").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    kind = "key_a long, key_b long, first long, copies long, vec array<double>"
    return written(classes.mapInArrow(_units, kind).withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def _pivots(nodes: DataFrame) -> tuple[Broadcast, int, int]:
    """(pivots by vector length, their number, the longest vector)."""
    n, width = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    most = max(1, min(-(-n // PER_PIVOT), PIVOT_BYTES // (8 * width)))
    rows = nodes.select("vec", F.xxhash64("node").alias("at")).orderBy("at").limit(most).select("vec").toArrow()
    found = {size: _thinned(_matrix(rows["vec"].combine_chunks().take(pa.array(at)))) for size, at in _by_size(rows).items()}
    return nodes.sparkSession.sparkContext.broadcast(found), max([1, *map(len, found.values())]), width


def _pairs(balls: DataFrame, pivots: Broadcast, overlap: int, beam: int, angle: float) -> DataFrame:
    """a, b, cosine, radii and masses of pairs of balls in range of each other."""
    kind = f"{', '.join(f'{c} {t}' for c, t in balls.dtypes)}, cells array<long>"
    dealt = balls.mapInArrow(partial(_cells, pivots=pivots, overlap=overlap), kind).select("*", F.explode("cells").alias("cell")).drop("cells")
    dealt = written(_cut(dealt, SHARD, "ball"), "vector-shards")
    lists = dealt.select("cell", "block", "ball", "vec").groupBy("cell", "block").applyInArrow(lambda rows: _edges(rows, beam), "ball long, near array<long>")
    flat = written(lists.groupBy("ball").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "vector-graph")
    # every block of a shard asks every graph of it; rows that only ask carry no edges
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    base = ["cell", "ball", "vec", "radius", "mass"]
    graphs = dealt.join(flat, "ball").select(*base, "near", F.col("block").alias("graph"), all_blocks.alias("queries"), F.lit(False).alias("asks"))
    asking = dealt.where("blocks > 1").select(*base, F.lit(None).cast("array<long>").alias("near"), all_blocks.alias("graph"), F.col("block").alias("queries"), F.lit(True).alias("asks"))
    rows = graphs.unionByName(asking.where("graph <> queries"))
    kind = "a long, b long, cosine double, radius_a double, radius_b double, mass_a long, mass_b long"
    found = rows.groupBy("cell", "graph", "queries").applyInArrow(lambda rows: _found(rows, angle, beam), kind)
    return written(found.dropDuplicates(["a", "b"]), "vector-pairs")


def _links(pairs: DataFrame, members: DataFrame, cosine: float, angle: float) -> tuple[DataFrame, DataFrame]:
    """(node, n_links of every node; a, b of linked balls)."""
    between, spread = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine")))), F.col("radius_a") + F.col("radius_b")
    single = spread == 0
    sure = F.when(single, F.col("cosine") >= cosine).otherwise(between + spread <= angle - SLACK)
    open_pairs = pairs.where(~sure & ~single & (between - spread <= angle + SLACK)).select("a", "b")
    whole = pairs.where(sure)
    own = members.select("node", "ball", "copies", "vec")
    sides = open_pairs.join(own, F.col("a") == F.col("ball")).unionByName(open_pairs.join(own, F.col("b") == F.col("ball")))
    compared = written(sides.groupBy("a", "b").applyInArrow(lambda rows: _between(rows, cosine), "a long, b long, node long, links long"), "vector-between")
    edges = whole.select("a", "b").union(compared.select("a", "b").distinct())
    by_ball = whole.select(F.col("a").alias("ball"), F.col("mass_b").alias("links")).union(whole.select("b", "mass_a")).groupBy("ball").agg(F.sum("links").alias("ball_links"))
    by_node = compared.groupBy("node").agg(F.sum("links").alias("node_links"))
    mass = members.where("radius IS NOT NULL").select("ball", "mass")
    zero = F.lit(0).cast("long")
    counted = members.select("node", "ball").join(mass, "ball").join(by_ball, "ball", "left").join(by_node, "node", "left")
    n_links = F.col("mass") - 1 + F.coalesce("ball_links", zero) + F.coalesce("node_links", zero)
    return written(counted.select("node", "ball", n_links.alias("n_links")), "vector-links"), edges


def audited(nodes: DataFrame, links: DataFrame, cosine: float, width: int) -> float:
    """The share of the true links of a sample of nodes that ``links`` has; the sample is bounded by its number of components."""
    asked = nodes.select("node", "vec", "copies", F.xxhash64("node", F.lit(7)).alias("at")).orderBy("at").limit(max(64, AUDIT_VALUES // width))
    rows = asked.select("node", "vec").toArrow()
    ids = rows["node"].to_numpy()
    held = {size: (ids[at], _matrix(rows["vec"].combine_chunks().take(pa.array(at)))) for size, at in _by_size(rows).items()}
    spark = nodes.sparkSession
    true = nodes.select("copies", "vec").mapInArrow(partial(_true_links, asked=spark.sparkContext.broadcast(held), cosine=cosine), "node long, found long")
    true = true.groupBy("node").agg((F.sum("found") - 1).alias("links"))
    got, all_links = true.join(links, "node").agg(F.sum(F.least("links", "n_links")), F.sum("links")).first()
    return got / all_links if all_links else 1.0


def near_vectors(vectors: DataFrame, cosine: float = 0.9, overlap: int = 4, recall: float = 0.999, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; linked at ``cosine`` or more."""
    angle = math.acos(cosine)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    valid = rows.where(good).withColumns({"key_a": F.xxhash64("vec"), "key_b": F.xxhash64("vec", F.lit(1))})
    nodes = _nodes(valid)
    pivots, n_pivots, width = _pivots(nodes)
    one_cell = nodes.select("node", "copies", "first", "vec").mapInArrow(partial(_cells, pivots=pivots, overlap=1), "node long, copies long, first long, vec array<double>, cells array<long>")
    placed = written(one_cell.select("node", "copies", "first", "vec", F.element_at("cells", 1).alias("cell")), "vector-cells")
    members = _cut(placed, BLOCK, "node").select("cell", "block", "node", "copies", "first", "vec").groupBy("cell", "block").applyInArrow(lambda rows: _balls(rows, angle / 2 - SLACK), MEMBERS)
    members = written(members, "vector-members")
    leaders = members.where("radius IS NOT NULL")
    beam = BEAM
    while True:
        pairs = _pairs(leaders.select("ball", "vec", "radius", "mass"), pivots, overlap, beam, angle)
        links, edges = _links(pairs, members, cosine, angle)
        if overlap >= n_pivots or audited(nodes, links, cosine, width) >= recall:
            break
        overlap, beam = min(2 * overlap, n_pivots), 2 * beam
    twice = valid.groupBy("vec_id").agg(F.min("key_a").alias("lo"), F.max("key_a").alias("hi")).where("lo <> hi").select("vec_id")
    placed = nodes.select("key_a", "key_b", "node").join(links, "node")
    if not twice.isEmpty():
        several = valid.join(twice, "vec_id", "left_semi").select("vec_id", "key_a", "key_b").distinct().join(placed, ["key_a", "key_b"]).select("vec_id", "ball")
        one = several.groupBy("vec_id").agg(F.min("ball").alias("a"))
        edges = edges.union(several.join(one, "vec_id").where("ball <> a").select("a", F.col("ball").alias("b")).distinct())
    labels = components(edges)
    smallest = leaders.select("ball", "first").join(labels, F.col("ball") == F.col("node"), "left").select("ball", "first", F.coalesce("component", "ball").alias("group"))
    named = smallest.groupBy("group").agg(F.min("first").alias("component_id"))
    balls = smallest.join(named, "group").select("ball", "component_id")
    found = placed.join(balls, "ball").select("key_a", "key_b", "n_links", "component_id")
    linked = valid.select("vec_id", "key_a", "key_b").join(found, ["key_a", "key_b"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def without_near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", **options: float) -> DataFrame:
    """The kept rows' ids: one of each component."""
    return near_vectors(vectors, cosine, id_col=id_col, vec_col=vec_col, **options).where("kept").select("vec_id")


def op12_flat_graph_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all of ``embeddings`` at cosine 0.9."""
    return near_vectors(source(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of distinct vectors.
ORACLE_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), good AS (
  SELECT vec_id, v FROM rows WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach(vec_id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN edges e ON e.a = r.to_id
), c AS (SELECT vec_id, min(to_id) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
