"""MinHash near-deduplication with HyperMinHash registers.

Each distinct text's word shingles are hashed once. The hash picks a bucket; of each bucket's smallest
remaining hash, a register keeps the number of leading zeros and the mantissa bits that follow. Empty
buckets borrow from filled ones, so that short texts have full sketches. Bands of registers give the
candidate pairs, an estimate of the Jaccard similarity, corrected for accidental collisions of registers,
drops the hopeless ones, and the full sets of true shingles, without any hash, decide.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_core as tc
from .common import ROW_KEY, connected_components, discard, materialise, numbered, shuffle_partitions, small_batches

SHINGLE_WORDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 40 bands of 8 registers: a pair of similarity 0.85 is missed with a probability of 3e-6, 0.8 with 6e-4.
BANDS, ROWS_PER_BAND = 40, 8
REGISTERS = BANDS * ROWS_PER_BAND
MANTISSA_BITS = 10
#: Standard deviations that an estimate may lie below the threshold: at 4, a link at the very threshold is lost once in
#: 30,000 if the estimate is normally distributed; in a simulation of sets of 37 and 60 shingles 1 of 2,000 was.
SLACK = 4.0
#: Rows of a block of a large bucket; a task compares two blocks at a time.
CELL_ROWS, CELL_BYTES = 2048, 16_000_000
_U = np.uint64


@functools.cache
def _detour(step: int) -> np.ndarray:
    """The bucket that each empty bucket looks into at this step."""
    with np.errstate(over="ignore"):
        seed = (np.arange(REGISTERS, dtype=np.uint64) + _U(1)) * _U(1000003) + _U(step + 1) * _U(0x9E3779B97F4A7C15)
        return (tc.mix(seed) % _U(REGISTERS)).astype(np.int64)


def sketch(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers (uint16) of the texts' shingle sets, one row for each; the rows of empty sets are 0."""
    n = len(counts)
    least = np.full((n, REGISTERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bucket = (((values >> _U(40)) * _U(REGISTERS)) >> _U(24)).astype(np.int64)
        rest = tc.mix(values * _U(0xA24BAED4963EE407))
    cell = np.repeat(np.arange(n), counts) * REGISTERS + bucket
    if len(cell):
        order = np.argsort(cell, kind="stable")
        cell, rest = cell[order], rest[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        least.ravel()[cell[starts]] = np.minimum.reduceat(rest, starts)
    filled = np.zeros((n, REGISTERS), dtype=bool)
    filled.ravel()[cell] = True
    # leading zeros from the float exponent: exact, as the value is first cut to 53 bits
    top = (least >> _U(11)).astype(np.float64)
    exponent = np.frexp(np.maximum(top, 1.0))[1]
    zeros = 53 - exponent
    shift = np.clip(exponent - 1 - MANTISSA_BITS, 0, 63).astype(np.uint64)
    mantissa = ((least >> _U(11)) >> shift) & _U((1 << MANTISSA_BITS) - 1)
    made = (np.minimum(zeros, 63).astype(np.uint16) << MANTISSA_BITS) | mantissa.astype(np.uint16)
    # borrowing: register j of an empty bucket looks into buckets by a fixed random sequence of its own
    source = np.where(filled, np.arange(REGISTERS), -1)
    r, c = np.nonzero(~filled & (counts > 0)[:, None])
    step = 0
    while len(r):
        pick = _detour(step)[c]
        ok = filled[r, pick]
        source[r[ok], c[ok]] = pick[ok]
        r, c = r[~ok], c[~ok]
        step += 1
    made = np.take_along_axis(made, np.maximum(source, 0), axis=1)
    made[counts == 0] = 0
    return made


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row; keys of different bands differ."""
    with np.errstate(over="ignore"):
        r = registers.reshape(len(registers), BANDS, ROWS_PER_BAND).astype(np.uint64)
        key = np.broadcast_to(tc.mix(np.arange(BANDS, dtype=np.uint64) + _U(11)), r.shape[:2]).copy()
        for i in range(ROWS_PER_BAND):
            key = tc.mix(key * _U(0x9E3779B97F4A7C15) + r[:, :, i])
    return key.view(np.int64)


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m shingles agree by accident."""
    a, b = np.maximum(n / REGISTERS, 1.0)[:, None], np.maximum(m / REGISTERS, 1.0)[:, None]
    hi, lo = 2.0 ** -np.arange(0, 40), 2.0 ** -np.arange(1, 41)
    in_a, in_b = (1 - lo) ** a - (1 - hi) ** a, (1 - lo) ** b - (1 - hi) ** b
    return (in_a * in_b).sum(axis=1) / 2**MANTISSA_BITS


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two arrays of registers, corrected for accidental collisions."""
    same = (x == y).mean(axis=1)
    by_chance = accidental(n, m)
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1)


def _profile(k: int):
    def run(batches):
        for batch in small_batches(batches):
            for at, raw in tc.slices(batch.column(2).to_pylist()):
                values, counts = tc.distinct(*tc.shingles(*tc.word_hashes(raw), k))
                sig = [tc.sequence_digest(t) for t in raw]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(counts)), batch.column(1).slice(at, len(counts)), pa.array(counts, pa.int64()), pa.array(sig, pa.binary()), pa.array([x.tobytes() for x in sketch(values, counts)], pa.binary())],
                    names=[ROW_KEY, "id", "n", "sig", "sketch"],
                )

    return run


def _bands(batches):
    for batch in small_batches(batches):
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(band_keys(regs).ravel())], names=["cid", "band"])


def _floor(threshold: float) -> float:
    """The estimate below which a pair isn't checked on its full sets."""
    return max(0.0, threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / REGISTERS)))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(threshold: float):
    def run(batches):
        for batch in small_batches(batches):
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found = estimate(_registers(col["sa"]), _registers(col["sb"]), col["na"].to_numpy(), col["nb"].to_numpy())
            ok = pa.array(found >= _floor(threshold))
            yield pa.RecordBatch.from_arrays([col["a"].filter(ok), col["b"].filter(ok)], names=["a", "b"])

    return run


def _tied(percent: int, k: int, exact: bool):
    """Components that belong together, found within cells of classes.

    Rows (cell key, i, j, cid, comp, n, sketch, blk, raw) come sorted by cell. Classes of different
    components are compared by the estimate and, where exact, by their full sets. What is tied already
    isn't compared again, and only the ties come out: fewer rows than the cell has components.
    """
    threshold = percent / 100

    def cell(i, j, cid, comp, n, regs, blk, raw):
        sets = tc.true_shingles(raw, k) if exact else []
        _, first, back = np.unique(comp, return_index=True, return_inverse=True)
        tie = first[back]
        begun = tie.copy()
        for x in range(len(cid) - 1):
            y = np.arange(x + 1, len(cid))
            y = y[(tie[y] != tie[x]) & ((i == j) | (blk[y] != blk[x]))]
            y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
            if len(y):
                y = y[estimate(regs[y], regs[x], n[y], np.full(len(y), n[x])) >= _floor(threshold)]
            for other in y:
                if tie[other] != tie[x] and (not exact or _similar(sets[x], sets[other], percent)):
                    low, high = sorted((tie[x], tie[other]))
                    tie[tie == high] = low
        moved = np.unique(begun[tie != begun])
        return comp[moved], comp[tie[moved]]

    def run(batches):
        held, last = [], None

        def out():
            if len(held) > 1:
                _, i, j, cid, comp, n, sk, blk, raw = zip(*held)
                regs = np.frombuffer(b"".join(sk), np.uint16).reshape(-1, REGISTERS)
                a, b = cell(i[0], j[0], *(np.array(v) for v in (cid, comp, n)), regs, np.array(blk), raw)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(9))):
                if row[:3] != last:
                    yield from out()
                    held, last = [], row[:3]
                held.append(row)
        yield from out()

    return run


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows out as cells of a key's blocks, two blocks to a cell, of a bounded number of rows and bytes."""
    held = F.greatest(F.count(F.lit(1)) / CELL_ROWS, F.sum(F.coalesce(F.octet_length("raw"), F.lit(0))) / CELL_BYTES)
    many = rows.groupBy(key).agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(held).cast("int").alias("k")).where("x < y")
    rows = rows.join(many.select(key, "k"), key).withColumn("blk", F.pmod(F.hash("cid"), F.col("k")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    rows = rows.select(key, F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "cid", "comp", "n", "sketch", "blk", "raw")
    return rows.repartition(shuffle_partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two sets, given as distinct numbers."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(both) - inter)


def _confirmed(percent: int, k: int):
    def run(batches):
        for batch in small_batches(batches):
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            good = pa.array([_similar(*tc.true_shingles([x, y], k), percent) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return run


def _raw(text: str):
    """A text with A-Z in lower case, as bytes; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER).cast("binary")


class _Search:
    """Distinct sequences of words (classes), their sketches and the means to check pairs of them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, k: int, key_col: str | None):
        self.percent, self.k = percent, k
        self.passing: list[DataFrame] = []
        own = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")]
        if key_col is None:
            self.base = numbered(docs.select(*own), "texts")
            self.passing.append(self.base)
        else:
            self.base = docs.select(F.col(key_col).alias(ROW_KEY), *own)
        schema = f"{ROW_KEY} long, id {self.base.schema['id'].dataType.simpleString()}, n long, sig binary, sketch binary"
        profiles = materialise(self.base.select(ROW_KEY, "id", "t").mapInArrow(_profile(k), schema), "profiles")
        with_id = F.min(F.when(F.col("id").isNotNull(), F.struct("id", ROW_KEY)))
        first = profiles.where("n > 0").groupBy("sig").agg(
            with_id.alias("head"), F.min(ROW_KEY).alias("any_row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        )
        first = first.select("sig", F.col("head")["id"].alias("rep"), F.coalesce(F.col("head")[ROW_KEY], "any_row").alias("first_row"), "n", "sketch")
        self.classes = materialise(first.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
        # sketches stay with the classes only
        self.rows = materialise(profiles.drop("sketch"), "rows")
        discard(profiles)
        self.members = self.classes.select("cid", "sketch").mapInArrow(_bands, "cid long, band long")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """A table that components() deletes once it is done."""
        self.passing.append(materialise(df, name))
        return self.passing[-1]

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a < b) whose estimates and then full sets are similar enough."""
        c, least = self.classes, F.least(F.col("na"), F.col("nb"))
        pairs = pairs.join(c.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        pairs = pairs.join(c.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        pairs = pairs.where(least * 100 >= F.greatest("na", "nb") * self.percent)
        return self.confirmed(pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_likely(self.percent / 100), "a long, b long"))

    def texts(self, used: DataFrame) -> DataFrame:
        """(cid, raw) of the classes; only their texts are read again."""
        used = used.join(self.classes.select("cid", F.col("first_row").alias(ROW_KEY)), "cid")
        return self.base.select(ROW_KEY, "t").join(used, ROW_KEY).select("cid", _raw("t").alias("raw"))

    def confirmed(self, likely: DataFrame) -> DataFrame:
        """Those of the pairs whose full sets are similar enough."""
        likely = self._written(likely, "likely")
        texts = self.texts(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        both = likely.join(texts.select(F.col("cid").alias("a"), F.col("raw").alias("x")), "a").join(texts.select(F.col("cid").alias("b"), F.col("raw").alias("y")), "b")
        return self._written(both.select("a", "b", "x", "y").mapInArrow(_confirmed(self.percent, self.k), "a long, b long"), "links")

    def components(self) -> DataFrame:
        """(node, component) of the classes that have links.

        First every class is checked against the smallest and the largest class of each of its buckets,
        which joins most of what belongs together at a cost in proportion to the table. Buckets that
        still hold several components are then looked through for likely pairs across them. These give
        clusters of components, and within each cluster all likely pairs across its components are
        checked on full sets. Pairs are compared in cells of bounded size and never become rows.
        """
        ends = self.members.groupBy("band").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi")
        shared = self._written(self.members.join(ends, "band"), "buckets")
        star = shared.select("cid", F.explode(F.array("lo", "hi")).alias("other")).where("cid != other")
        found = self.links(star.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct())
        seen = self.classes.select("cid", "n", "sketch")
        place = self.classes.select("cid").join(connected_components(found).withColumnRenamed("node", "cid"), "cid", "left")
        place = self._written(place.select("cid", F.coalesce("component", "cid").alias("comp")), "placed")
        at = shared.select("band", "cid").join(place, "cid")
        mixed = at.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band")
        at = at.join(mixed, "band").join(seen, "cid").withColumn("raw", F.lit(None).cast("binary"))
        ties = _cells(at, "band").mapInArrow(_tied(self.percent, self.k, exact=False), "a long, b long").distinct()
        clusters = connected_components(ties).select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
        inside = self._written(place.join(clusters, "comp"), "clustered")
        inside = inside.join(seen, "cid").join(self.texts(inside.select("cid")), "cid")
        more = _cells(inside, "cluster").mapInArrow(_tied(self.percent, self.k, exact=True), "a long, b long")
        labels = connected_components(found.union(more))
        for table in self.passing:
            discard(table)
        return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle_words: int = SHINGLE_WORDS, key_col: str | None = None) -> DataFrame:
    """One row per row of docs: row key, doc_id, n_shingles, component_id, kept, keeps_row.

    Texts are linked when their sets of word shingles have 100 * intersection >= percent * union.
    component_id is the smallest id reachable by links, kept tells whether it is the row's own;
    keeps_row is true for exactly one row of each component, also where ids repeat or are null.
    Null and empty texts and those without words have no shingles and are linked with nothing. A text
    of fewer words than a shingle has them all as its one shingle. An empty table gives no rows; other
    columns are ignored. Texts are read twice: key_col names a column of a written table that numbers its
    rows; without it, a numbered copy of ids and texts is written first.
    """
    s = _Search(docs, id_col, text_col, percent, shingle_words, key_col)
    comps = s.components()
    label = s.classes.select("sig", "cid", "rep", "first_row").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
    label = materialise(label.select("sig", "rep", "first_row", F.coalesce("component", "cid").alias("component")), "labels")
    first = F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "first_row")))
    heads = label.groupBy("component").agg(F.min("rep").alias("component_id"), first.alias("head"), F.min("first_row").alias("any_row"))
    label = materialise(label.join(heads, "component").select("sig", "component_id", F.coalesce(F.col("head")["first_row"], "any_row").alias("head_row")), "labels")
    rows = s.rows.select(ROW_KEY, "id", "n", "sig")
    linked = rows.where("n > 0").join(label, "sig").select(ROW_KEY, "id", "n", "component_id", (F.col(ROW_KEY) == F.col("head_row")).alias("keeps_row"))
    alone = rows.where("n = 0").select(ROW_KEY, "id", "n", F.col("id").alias("component_id"), F.lit(True).alias("keeps_row"))
    return linked.unionByName(alone).select(
        ROW_KEY, F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), "keeps_row",
    )
