"""Near-duplicates among embeddings by collision-counting projections.

All vectors are projected on many fixed random directions. On one projection after another the vectors are
sorted, and the window centred at each of them, along the sorted values, gives the vectors that it may be
near to. A window on one projection alone holds a share of the whole table, so dense windows are subdivided
first: some more projections of each sorted one, cut at fixed steps, deal the vectors into groups, and
sorting and windows are each group's own. There are as many such tables as the recall needs. Of each pair
that a window brings together, the collisions on all counted projections are added up, where the two collide
if one lies in the window centred at the other; a pair that reaches the count, which the recall sets, goes to
the exact comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise, shuffle_partitions

#: Projections whose collisions are counted, and the half-width of a window in standard deviations of the
#: difference of two vectors at the threshold: such a pair collides on each with a probability of 0.866.
COUNTED, WINDOW = 32, 1.5
#: Half-width, in the same unit, of the windows that find pairs on a sorted projection: 0.988 of those at the threshold.
SORTED_WINDOW = 2.5
#: Chance that a pair at the threshold is lost: over all tables, and by the count.
MISS_TABLES, MISS_COUNT = 1e-3, 1e-5
#: Width of the steps of the projections that subdivide, in the same unit.
STEP = 5.0
#: Vectors that unrelated vectors may bring to a group on average; the number of subdividing projections follows from it.
GUESTS = 2000
#: Rows of a block of a large group; a task compares two blocks at a time, so many rows of the one at once.
BLOCK_ROWS, TILE_ROWS = 2048, 256


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _same_cell(width: float) -> float:
    """Chance that two values fall in one cell of this width, in deviations of their difference."""
    return 2 * _normal(width) - 1 - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def _collisions_needed(p: float) -> int:
    """The largest count that a pair with this chance on each projection misses rarely enough."""
    below = 0.0
    for k in range(COUNTED + 1):
        below += math.comb(COUNTED, k) * p**k * (1 - p) ** (COUNTED - k)
        if below > MISS_COUNT:
            return k
    return COUNTED


class Plan:
    """Widths, tables and counts for a threshold, a dimension and a number of vectors."""

    def __init__(self, cosine: float, dim: int, rows: int):
        self.cosine, self.dim = cosine, dim
        near = math.sqrt(max(2 * (1 - cosine), 1e-12))
        self.window, self.sorted_window, self.step = WINDOW * near, SORTED_WINDOW * near, STEP * near
        p_near, p_far = _same_cell(STEP), _same_cell(STEP * near / math.sqrt(2))
        self.cuts = max(0, math.ceil(math.log(max(rows, 2) / GUESTS) / -math.log(p_far)))
        met = p_near**self.cuts * (2 * _normal(SORTED_WINDOW) - 1)
        self.tables = math.ceil(math.log(MISS_TABLES) / math.log(1 - met))
        self.needed = _collisions_needed(2 * _normal(WINDOW) - 1)
        rng = np.random.default_rng(20240501)
        self.sorted = rng.standard_normal((dim, self.tables))
        self.lines = rng.standard_normal((dim, self.tables * self.cuts))
        self.shifts = rng.random(self.tables * self.cuts) * self.step
        self.counted = rng.standard_normal((dim, COUNTED))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit key of its group for each vector and table."""
        at = np.floor((unit @ self.lines + self.shifts) / self.step).astype(np.int64).reshape(len(unit), self.tables, self.cuts)
        with np.errstate(over="ignore"):
            key = np.broadcast_to((np.arange(self.tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), at.shape[:2]).copy()
            for i in range(self.cuts):
                key = (key ^ at[:, :, i].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _packed(kind: str):
    """(id, components as bytes); null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
                good = x is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                # scaled by a power of two, which changes no digit, so that no square overflows or vanishes
                out.append(np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])).astype(kind).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return run


def _dealt(plan: Plan, kind: str):
    def run(batches):
        for batch in batches:
            keys = plan.keys(_unit(batch.column(1).to_pylist(), kind))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), plan.tables)), pa.array(keys.ravel())], names=["cid", "key"])

    return run


def _merge(tie: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join what the links left - right connect: tie names each vector's least one known to be connected."""
    while True:
        low = np.minimum(tie[left], tie[right])
        before = tie.copy()
        tops = tie[left], tie[right]
        np.minimum.at(tie, tops[0], low)
        np.minimum.at(tie, tops[1], low)
        while not np.array_equal(flat := tie[tie], tie):
            tie[:] = flat
        if (tie == before).all():
            return


def _compared(plan: Plan, kind: str):
    """Links within groups.

    Link numbers are summed within the group, so rows grow with the vectors, not with the pairs: each row
    is (cid, linked vectors found here, a linked vector to tie it to). A pair counts in the first table
    whose windows bring it together only.
    """

    def group(key, i, j, cid, copies, raw, blk):
        unit = _unit(raw, kind)
        keys = plan.keys(unit)
        table = int(np.flatnonzero(keys[0] == key)[0])
        places = unit @ plan.sorted
        order = np.argsort(places[:, table], kind="stable")
        cid, copies, unit, keys, places, blk = (x[order] for x in (cid, copies, unit, keys, places, blk))
        along = places[:, table]
        lines = np.ascontiguousarray((unit @ plan.counted).T.astype(np.float32))
        n = len(cid)
        linked, tie = np.zeros(n, np.int64), np.arange(n)
        # windows are centred at each vector; as pairs are looked at once, only their upper halves are
        end = np.searchsorted(along, along + plan.sorted_window, side="right")
        for x in range(0, n, TILE_ROWS):
            tile, y = slice(x, min(x + TILE_ROWS, n)), int(end[min(x + TILE_ROWS, n) - 1])
            rows, cols = np.arange(x, tile.stop)[:, None], np.arange(x, y)[None, :]
            count = np.zeros((tile.stop - x, y - x), np.int8)
            for line in lines:
                count += np.abs(line[tile, None] - line[None, x:y]) <= plan.window
            met = (count >= plan.needed) & (cols > rows) & (cols < end[tile, None])
            if i != j:
                met &= blk[tile, None] != blk[None, x:y]
            a, b = np.nonzero(met)
            a, b = a + x, b + x
            if len(a) * 4 > met.size:  # most of the tile: the products are cheaper all at once
                sure = (unit[tile] @ unit[x:y].T)[a - x, b - x] >= plan.cosine
            else:
                sure = np.einsum("ij,ij->i", unit[a], unit[b]) >= plan.cosine
            a, b = a[sure], b[sure]
            if not len(a):
                continue
            _merge(tie, a, b)
            fresh = np.ones(len(a), bool)
            for t in range(table):
                fresh &= ~((keys[a, t] == keys[b, t]) & (np.abs(places[a, t] - places[b, t]) <= plan.sorted_window))
            a, b = a[fresh], b[fresh]
            linked += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
        some = (linked > 0) | (tie != np.arange(n))
        yield cid[some], linked[some], cid[tie[some]]

    def run(batches):
        held, last = [], None

        def out():
            if len(held) > 1:
                key, i, j, cid, copies, raw, blk = zip(*held)
                for arrays in group(key[0], i[0], j[0], np.array(cid), np.array(copies), raw, np.array(blk)):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["cid", "linked", "other"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if row[:3] != last:
                    yield from out()
                    held, last = [], row[:3]
                held.append(row)
        yield from out()

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors are linked when their cosine, in double precision, reaches the threshold. n_links counts
    the other vectors that one is linked with, exact copies among them; component_id is the smallest id
    reachable by links. Vectors that are null, empty or zero or hold a null or a non-finite component
    link with nothing, nor do vectors of another dimension than the most common one with those of that
    one. Rows without an id take part and have null as component_id only if none that they reach has one.
    An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    # single-precision components stay as they are; the comparison is in double precision
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = materialise(rows.mapInArrow(_packed(kind), f"id {rows.schema['id'].dataType.simpleString()}, vec binary"), "vectors")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "vector-classes")
    found, passing = [], [classes]
    # vectors of each dimension are compared among themselves
    for size, number in sorted(tuple(r) for r in classes.groupBy(F.octet_length("vec")).count().collect()):
        own = classes.where(F.octet_length("vec") == size)
        plan = Plan(cosine, size // int(kind[2]), number)
        dealt = materialise(own.select("cid", "vec").mapInArrow(_dealt(plan, kind), "cid long, key long"), "dealt")
        passing.append(dealt)
        full = dealt.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("k"), F.count(F.lit(1)).alias("m")).where("m > 1")
        dealt = dealt.join(full.select("key", "k"), "key").withColumn("blk", F.pmod(F.hash("cid"), F.col("k")))
        cells = dealt.join(own.select("cid", "copies", "vec"), "cid").select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
        cells = cells.select("key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "cid", "copies", "vec", "blk")
        cells = cells.repartition(shuffle_partitions(cells.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        found.append(materialise(cells.mapInArrow(_compared(plan, kind), "cid long, linked long, other long"), "found"))
    out = classes.select("cid", "vec", "copies", "rep")
    if found:
        ties = found[0]
        for more in found[1:]:
            ties = ties.union(more)
        comps = connected_components(ties.select(F.col("cid").alias("a"), F.col("other").alias("b")))
        out = out.join(ties.groupBy("cid").agg(F.sum("linked").alias("linked")), "cid", "left").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    else:
        out = out.withColumns({"linked": F.lit(0), "component": F.col("cid")})
    out = materialise(out.select("vec", "rep", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "labels")
    heads = out.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = materialise(out.join(heads, "component").select("vec", "n_links", "component_id"), "labels")
    for table in [*passing, *found]:
        discard(table)
    linked = rows.where("vec is not null").join(out, "vec").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
