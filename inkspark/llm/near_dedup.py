"""Near-duplicate classes by HyperMinHash sketches, banding, and exact confirmation.

1. Sketch: each distinct shingle's hash picks one of ``REGISTERS`` buckets; a bucket keeps its smallest value as a 16-bit
   register: six bits of leading zeros and ten bits of mantissa. Documents whose shingle sets are identical form
   one class at once (a 128-bit signature of the set), so that thousands of copies cost one row from then on.
2. Banding: registers (empty ones filled from others by a fixed probe sequence) are cut into bands. Classes that share a
   band are candidates. Every shared band gets a leader, the class with the largest sum of band populations, and each
   member is paired with the leader only: pairs grow with the members, not with their square.
3. Estimate: the share of equal registers, corrected for chance collisions of the compressed values, drops pairs that
   are more than six standard errors below ``threshold - 0.5``. Pairs between that and the threshold stay, for step 5.
   A dropped member and those that it may be linked with (by the triangle inequality of the Jaccard distance, members whose
   estimate may be under a half) get leaders among themselves: one for every two bands that they share, so that a text that is
   unlike them and merely shares a band with them doesn't lead again. Two linked texts share ten bands of 24 on average.
4. Verify: full shingle sets are rebuilt from the texts and compared exactly. The pair also keeps the member's
   difference from the leader (shingles removed and added).
5. Whole: in groups of one leader that aren't one component yet, members of different components are compared
   exactly through their differences, |x & y| = |L| - |Rx| - |Ry| + |Rx & Ry| + |Ax & Ay|, in bounded blocks. So no link
   between two texts of a leader group is lost, and no group is ever expanded into rows of pairs.

Defined results: documents without words have no shingles, are linked with nothing and are kept. Rows that repeat an id share a
component; if their texts differ, a link of any of them links the id. A null id is linked with nothing, has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.bloom import unused, with_keys_of, without_keys
from inkspark.llm.components import components
from inkspark.llm.store import dropped, source, written
from inkspark.llm.words import mix, shingles, signed, slices, word_hashes

BANDS = 24
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
PROBES = 512
BLOCK, BLOCK_TOKENS = 256, 200_000


def band_rows(threshold: float) -> int:
    """Registers to a band: the most that leave a pair at the threshold unseen less than 5 times in a million."""
    r = 1
    while (1 - threshold ** (r + 1)) ** BANDS < 5e-6:
        r += 1
    return r


def registers(offsets: np.ndarray, grams: np.ndarray, k: int) -> np.ndarray:
    """(texts, k) registers: leading zeros (six bits) over the mantissa (ten bits), EMPTY where no shingle fell."""
    n = len(offsets) - 1
    low = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bucket = ((grams >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    value = mix(grams ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(1)
    np.minimum.at(low, owner * k + bucket.astype(np.int64), value)
    empty = low == np.iinfo(np.uint64).max
    top = (low >> np.uint64(10)).astype(np.float64)  # 53 bits, exact
    bits = np.where(top > 0, np.frexp(top)[1], 0)
    zeros = np.where(empty, 0, 53 - bits)
    mantissa = np.where(bits > MANTISSA, (low >> np.uint64(10)) >> np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64), 0)
    out = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (mantissa.astype(np.uint16) & np.uint16((1 << MANTISSA) - 1))
    return np.where(empty, EMPTY, out).astype(np.uint16).reshape(n, k)


def _filled(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the first non-empty one in their own probe sequence."""
    n, k = regs.shape
    out = regs.copy()
    todo = np.flatnonzero((regs == EMPTY).any(1) & (regs != EMPTY).any(1))
    rng = np.random.default_rng(20240607)
    probe = rng.integers(0, k, (PROBES, k))
    for step in range(PROBES):
        if not len(todo):
            return out
        part = out[todo]
        hole = part == EMPTY
        part[hole] = regs[todo][:, probe[step]][hole]
        out[todo] = part
        todo = todo[(part == EMPTY).any(1)]
    for i in todo:  # sets of a few shingles: whatever is left takes the smallest register
        out[i][out[i] == EMPTY] = regs[i].min()
    return out


def _bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """(texts, BANDS) hashes of the band number and its registers."""
    full = _filled(regs)
    out = np.empty((len(regs), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(regs), b + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(rows):
                h = (h ^ full[:, b * rows + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
        out[:, b] = mix(h)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], words: int, rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, grams = shingles(*word_hashes(batch.column("text")), words)
            sets = [np.unique(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            sizes = np.array([len(s) for s in sets], np.int64)
            offsets = np.r_[0, np.cumsum(sizes)]
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            with np.errstate(over="ignore"):
                one = [int(mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                two = [int(np.bitwise_xor.reduce(mix(s * np.uint64(0xC2B2AE3D27D4EB4F)))) if len(s) else 0 for s in sets]
            regs = registers(offsets, flat, BANDS * rows)
            bands = signed(np.ascontiguousarray(_bands(regs, rows)).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array(signed(np.array(one, np.uint64))),
                    pa.array(signed(np.array(two, np.uint64))),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), pa.array(bands)),
                ],
                names=["doc_id", "n_shingles", "sig_a", "sig_b", "registers", "bands"],
            )


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[float, float]:
    """(Jaccard estimate corrected for chance collisions, its standard error) of two rows of registers."""
    both = (a != EMPTY) | (b != EMPTY)
    used = max(1, int(both.sum()))
    same = int(((a == b) & both).sum()) / used
    k = len(a)
    z = np.arange(40)
    def mass(size: int) -> np.ndarray:  # of each number of leading zeros, for the least of size / k values
        return (1 - 0.5 ** (z + 1)) ** (size / k) - (1 - 0.5**z) ** (size / k)
    chance = float(np.abs(mass(size_a) * mass(size_b)).sum()) / (1 << MANTISSA)
    j = max(0.0, (same - chance) / (1 - chance))
    return j, float(np.sqrt(max(j * (1 - j), 0.25 / used) / used))


def _estimated(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs with ``near``: not over six standard errors under ``threshold - 0.5``; and ``again``: linked, perhaps, with one that isn't."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ra, rb = batch.column("registers").to_pylist(), batch.column("leader_registers").to_pylist()
        na, nb = batch.column("n_shingles").to_pylist(), batch.column("leader_size").to_pylist()
        got = np.array([estimate(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), n, m) for a, b, n, m in zip(ra, rb, na, nb)])
        j, err = got[:, 0], got[:, 1]
        near = j + 6 * err >= threshold - 0.5
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("leader"), pa.array(near), pa.array(~near | (j - 6 * err < 0.5))], names=["class", "leader", "near", "again"])


def _led(ranked: DataFrame) -> DataFrame:
    """(band, class, weight, leader): members of each band with its leader, without the leader itself."""
    lead = ranked.groupBy("band").agg(F.max_by("class", F.struct("weight", -F.col("class"))).alias("leader"))
    return ranked.join(lead, "band").where("class <> leader")


def _judged(led: DataFrame, regs: DataFrame, threshold: float) -> DataFrame:
    """(class, leader, near, again) of the pairs of members and leaders, each once."""
    theirs = regs.select(F.col("class").alias("leader"), F.col("registers").alias("leader_registers"), F.col("n_shingles").alias("leader_size"))
    pairs = led.select("class", "leader").distinct().join(regs, "class").join(theirs, "leader")
    return written(pairs.mapInArrow(partial(_estimated, threshold=threshold), "class long, leader long, near boolean, again boolean"), "near-pairs")


def _near_pairs(ranked: DataFrame, regs: DataFrame, threshold: float) -> DataFrame:
    """(class, leader): members of a band with a leader that they may be compared with; ``ranked`` has band, class and weight."""
    led = _led(ranked)
    judged = _judged(led, regs, threshold)
    near = judged.where("near").select("class", "leader")
    if judged.where("NOT near").isEmpty():
        return near
    left = led.join(judged.where("again").select("class", "leader", "near"), ["class", "leader"]).select("band", "class", "weight", "near")
    open_bands = left.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.bool_or(~F.col("near")).alias("far")).where("far AND members > 1")
    left = left.join(open_bands.select("band"), "band", "left_semi").select("band", "class", "weight")
    other = ranked.select("class", F.col("band").alias("other"))
    both = F.xxhash64(F.least("band", "other"), F.greatest("band", "other")).alias("band")
    pairs_of_bands = written(left.join(other, "class").where("band <> other").select(both, "class", "weight").distinct(), "near-left")
    again = _judged(_led(pairs_of_bands), regs, threshold)
    return near.union(again.where("near").select("class", "leader")).distinct()


def _verify(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(class, leader, sizes, overlap, removed, added) of rows with both texts."""
    seen: dict[int, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, grams = shingles(*word_hashes(batch.column("text")), words)
            leaders, lines = batch.column("leader").to_pylist(), batch.column("leader_text")
            out = {k: [] for k in ("n", "m", "both", "removed", "added")}
            for i, lead in enumerate(leaders):
                if lead not in seen:
                    if len(seen) >= 64:
                        seen.clear()
                    seen[lead] = np.unique(shingles(*word_hashes(lines.slice(i, 1)), words)[1])
                x, y = np.unique(grams[offsets[i] : offsets[i + 1]]), seen[lead]
                removed, added = np.setdiff1d(y, x, True), np.setdiff1d(x, y, True)
                for k, v in zip(out, (len(x), len(y), len(y) - len(removed), signed(removed), signed(added))):
                    out[k].append(v)
            ints = lambda k: pa.array(np.array(out[k], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("leader"), ints("n"), ints("m"), ints("both"), pa.array(out["removed"], pa.list_(pa.int64())), pa.array(out["added"], pa.list_(pa.int64()))],
                names=["class", "leader", "n", "leader_size", "both", "removed", "added"],
            )


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every x with every y, by runs of equal tokens."""
    out = np.zeros((len(xs), len(ys)), np.int32)
    tokens = np.concatenate([*xs, *ys, np.zeros(0, np.int64)])
    owner = np.r_[np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.repeat(np.arange(len(ys)) + len(xs), [len(y) for y in ys])]
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
    for a, b in zip(starts, [*starts[1:], len(tokens)]):
        if b - a > 1:
            own = owner[a:b]
            left, right = own[own < len(xs)], own[own >= len(xs)] - len(xs)
            if len(left) and len(right):
                out[np.ix_(left, right)] += 1
    return out


def _cell(rows: pa.Table, percent: int) -> pa.Table:
    """Links between the x and the y rows of one block pair of a leader's group, a link per pair of components."""
    rows = rows.combine_chunks()
    flat = {c: rows[c].to_numpy() for c in ("role", "component", "n", "leader_size")}
    x, y = np.flatnonzero(flat["role"] == 0), np.flatnonzero(flat["role"] == 1)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not len(x) or not len(y):
        return kinds.empty_table()

    def sets(name: str) -> list[np.ndarray]:
        chunks = [c for c in rows[name].chunks if len(c)]
        return [v.values.to_numpy() for c in chunks for v in c]

    removed, added = sets("removed"), sets("added")
    part = lambda of, which: [of[i] for i in which.tolist()]
    less = np.array([len(v) for v in removed])
    both = int(flat["leader_size"][0]) - (less[x][:, None] + less[y][None, :])
    both = both + _overlaps(part(removed, x), part(removed, y)) + _overlaps(part(added, x), part(added, y))
    union = flat["n"][x][:, None] + flat["n"][y][None, :] - both
    c = flat["component"]
    i, j = np.nonzero((100 * both >= percent * union) & (c[x][:, None] != c[y][None, :]))
    links = np.unique(np.stack([c[x[i]], c[y[j]]], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    return pa.Table.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=kinds)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; linked at ``100 * intersection >= percent * union``."""
    t, rows = percent / 100, band_rows(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(
        texts.mapInArrow(
            partial(_sketch, words=words, rows=rows),
            "doc_id long, n_shingles long, sig_a long, sig_b long, registers binary, bands array<long>",
        ),
        "near-sketches",
    )
    linked = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    # a class is a set of equal documents; its id is the smallest of them
    sig = ["n_shingles", "sig_a", "sig_b"]
    classes = linked.groupBy(*sig).agg(F.min("doc_id").alias("class"), F.min_by("registers", "doc_id").alias("registers"), F.min_by("bands", "doc_id").alias("bands"))
    classes = written(classes, "near-classes")

    bands = classes.select("class", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    member = written(bands.join(shared, "band"), "near-bands")
    weight = member.groupBy("class").agg(F.sum("members").alias("weight"))
    ranked = written(member.join(weight, "class").select("band", "class", "weight"), "near-ranked")
    dropped(member)
    near = _near_pairs(ranked, classes.select("class", "registers", "n_shingles"), t)
    needed = near.select(F.col("class").alias("doc_id")).union(near.select("leader")).distinct()
    # no exact join here: both sides of the joins below are plain shuffles then, and a hot leader's rows can be split
    source = with_keys_of(texts.where("doc_id IS NOT NULL"), needed, "doc_id", exact=False)
    repeated = linked.groupBy("doc_id").count().where("count > 1")
    several = not repeated.limit(1).isEmpty()
    if several:
        source = source.distinct()
    star = (
        near.join(source.select(F.col("doc_id").alias("class"), "text"), "class")
        .join(source.select(F.col("doc_id").alias("leader"), F.col("text").alias("leader_text")), "leader")
        .select("class", "leader", "text", "leader_text")
        .mapInArrow(partial(_verify, words=words), "class long, leader long, n long, leader_size long, both long, removed array<long>, added array<long>")
    )
    union = F.col("n") + F.col("leader_size") - F.col("both")
    star = star.withColumn("linked", 100 * F.col("both") >= percent * union)
    if several:
        star = star.groupBy("class", "leader").agg(F.max_by(F.struct(*star.columns[2:]), F.col("both") / union).alias("s")).select("class", "leader", "s.*")
    star = written(star, "near-stars")
    edges = star.where("linked").select(F.col("class").alias("a"), F.col("leader").alias("b"))
    if several:
        own = linked.join(repeated, "doc_id", "left_semi").join(classes.select(*sig, "class"), sig).where("doc_id <> class")
        edges = edges.union(own.select(F.col("doc_id").alias("a"), F.col("class").alias("b")))
    labels = components(edges)
    rest = written(_rest(star, labels, percent), "near-rest")
    if not rest.limit(1).isEmpty():  # its nodes are components already
        higher = components(rest).withColumnsRenamed({"node": "was", "component": "higher"})
        within = labels.join(higher, labels["component"] == higher["was"], "left")
        alone_before = higher.join(labels, higher["was"] == labels["node"], "left_anti").select(F.col("was").alias("node"), F.col("higher").alias("component"))
        labels = within.select("node", F.coalesce("higher", "component").alias("component")).union(alone_before)

    named = (
        classes.select(*sig, "class")
        .join(labels, classes["class"] == labels["node"], "left")
        .select(*sig, F.coalesce("component", "class").alias("component"))
    )
    base = sketches.select("doc_id", *sig)
    alone = base.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    placed = base.where("doc_id IS NOT NULL AND n_shingles > 0").join(named, sig, "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return alone.unionByName(placed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _rest(star: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between components inside leader groups, from the members' differences from their leader."""
    none = F.array().cast("array<long>")
    leader = star.select("leader", "leader_size").distinct().select(
        F.col("leader").alias("class"), "leader", F.col("leader_size").alias("n"), "leader_size", none.alias("removed"), none.alias("added"), F.lit(True).alias("linked")
    )
    rows = star.select(*leader.columns).union(leader)
    rows = rows.join(labels, rows["class"] == labels["node"], "left").withColumn("component", F.coalesce("component", "class")).drop("node")
    open_groups = (
        rows.groupBy("leader")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"), F.count_if(~F.col("linked")).alias("others"), F.sum(F.size("removed") + F.size("added")).alias("tokens"))
        .where("lo <> hi AND others > 0 AND members > 2")
        .select("leader", "members", "others", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_TOKENS) * F.col("members") / F.greatest(F.lit(1), "tokens")))).alias("block"))
    )
    open_groups = written(open_groups, "near-open")  # both sides of the join are plain shuffles then: a hot leader's rows can be split
    rows = rows.join(open_groups, "leader")
    # a block holds so many rows that their differences stay within BLOCK_TOKENS on average
    blocks_y, blocks_x = F.ceil(F.col("members") / F.col("block")), F.ceil(F.col("others") / F.col("block"))
    slot = F.xxhash64("class", "leader")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cols = ["leader", "bx", "by", "role", "component", "n", "leader_size", "removed", "added"]
    # x: members that aren't linked to the leader; y: every member
    x = rows.where(~F.col("linked")).select("*", F.lit(0).alias("role"), F.pmod(slot, blocks_x).alias("bx"), upto(blocks_y).alias("by"))
    y = rows.select("*", F.lit(1).alias("role"), upto(blocks_x).alias("bx"), F.pmod(slot, blocks_y).alias("by"))
    cells = x.select(*cols).unionByName(y.select(*cols))
    return cells.groupBy("leader", "bx", "by").applyInArrow(lambda rows: _cell(rows, percent), "a long, b long").distinct()


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate component, the smallest id."""
    found = near_duplicates(docs, words, percent, id_col, text_col)
    key = unused(docs, "key")
    drop = written(found.where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "near-dropped")
    return without_keys(docs.withColumn(key, F.col(id_col).cast("long")), drop, key).drop(key)


def op7_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all of ``documents``: three-word shingles, 85 of 100."""
    return near_duplicates(source(spark, sf_dir, "documents"), words=3, percent=85)


#: Exact brute force: an inverted join of the whole sets, then everything reachable.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), edges AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach(doc_id, to_id) AS (
  SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.to_id
), c AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
