"""Packing of token sequences by non-negative least squares.

Documents are cut into full windows and a rest. The rests' lengths make a histogram of at most one bin per
token of a window. Shallow combinations of lengths that fill a window exactly are enumerated, and their
repeat counts solved for against the histogram by non-negative least squares and rounded down. What the
rounded plan leaves over is packed greedily, one after another, cut wherever a window is full.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small_batches

#: Lengths of a combination at most, and the steps between its lengths for a window of 2048.
DEEPEST, STEPS = 5, {2: 1, 3: 48, 4: 80, 5: 112}
SWEEPS = 40


#: The faster library's matcher fails on about a million white spaces in a row; longer runs than this go to tokenizers.
LONGEST_RUN = 50_000
_RUN = re.compile(r"\s{%d}" % LONGEST_RUN)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    return tokenizers.Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary in a faster library, if the file is byte-level BPE of the form it takes; else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain or model.get("type") not in (None, "BPE") or model.get("dropout") or model.get("ignore_merges"):
        return None
    # byte-level files write each byte as a printable character: printable Latin-1 bytes as themselves
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(char[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    probe = "It's a test, isn't it?  3 × 4\n\n\tÜber 日本 \U0001f600 \x00 x'd   "
    if fast.encode_ordinary(probe) != _tokenizer(path).encode(probe, add_special_tokens=False).ids:
        return None
    return fast, tuple(special)


def token_ids(path: str, text: str) -> list[int]:
    """Ids of the tokenizers library for the text, without special tokens added."""
    fast = _fast(path)
    if fast is None or any(s in text for s in fast[1]) or (len(text) >= LONGEST_RUN and _RUN.search(text)):
        return _tokenizer(path).encode(text, add_special_tokens=False).ids
    return fast[0].encode_ordinary(text)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cut(path: str, window: int, end_id: int):
    """Full windows with their checksums, and the rests with their ids, numbered within the partition."""

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        met: dict[int, int] = {}
        for batch in small_batches(batches):
            names = ["task", "number", "met", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            ids_of, cols = batch.column(0), [[] for _ in names]
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*(token_ids(path, text) if text else []), end_id], np.uint32)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    length = len(piece)
                    number += 1
                    rows.append(i)
                    rest = length < window
                    rank = met.get(length, 0)
                    met[length] = rank + 1
                    for c, v in zip(cols, (task, number, rank, None, start, length, _crc(piece), len(ids), piece.astype("<u4" if piece.max() > 65535 else "<u2").tobytes() if rest else None)):
                        c.append(v)
                if len(rows) >= 4096:
                    yield _batch(names, cols, ids_of, rows)
                    rows, cols = [], [[] for _ in names]
            if rows:
                yield _batch(names, cols, ids_of, rows)

    return run


def _batch(names, cols, ids_of, rows):
    kinds = [pa.int32(), pa.int64(), pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([ids_of.take(pa.array(rows)) if k is None else pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def combinations(window: int) -> list[tuple[int, ...]]:
    """Combinations of two to DEEPEST lengths that fill the window, in falling order.

    The smallest length takes every value; the others rise from it in steps, but for the largest, which
    is what is left. Pairs so take every length.
    """
    made = []

    def extend(chosen: tuple[int, ...], parts: int, step: int) -> None:
        left = window - sum(chosen)
        if len(chosen) == parts - 1:
            made.append((left, *reversed(chosen)))
            return
        length = chosen[-1]
        while length * (parts - len(chosen)) <= left:
            extend((*chosen, length), parts, step)
            length += step

    for parts in range(2, DEEPEST + 1):
        step = max(1, window * STEPS[parts] // 2048)
        for smallest in range(1, window // parts + 1):
            extend((smallest,), parts, step)
    return made


def solve(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): a non-negative least-squares fit to the histogram, rounded and feasible.

    Coordinate descent on |A x - h|^2 with x >= 0; A has one column for each combination and few entries in
    each. The number of unknowns depends on the window only. Rounded counts are lowered where they would
    use more rests of a length than there are.
    """
    combos = combinations(window)
    deep = max(len(c) for c in combos)
    part = np.zeros((len(combos), deep), np.int64)
    weight = np.zeros((len(combos), deep))
    for k, c in enumerate(combos):
        lengths, times = np.unique(c, return_counts=True)
        part[k, : len(lengths)], weight[k, : len(lengths)] = lengths, times
    square = (weight**2).sum(axis=1)
    x, left = np.zeros(len(combos)), histogram.astype(float).copy()
    # lists: the sweeps take single elements
    terms = [[(int(p), float(w)) for p, w in zip(part[k], weight[k]) if w] for k in range(len(combos))]
    left, values = left.tolist(), x.tolist()
    norms = square.tolist()
    scale = max(1.0, float(histogram.sum()))
    for _ in range(SWEEPS):
        moved = 0.0
        for k, own in enumerate(terms):
            gain = sum(w * left[p] for p, w in own) / norms[k]
            new = values[k] + gain
            if new < 0.0:
                new = 0.0
            d = new - values[k]
            if d:
                values[k] = new
                moved += abs(d)
                for p, w in own:
                    left[p] -= d * w
        if moved < 2e-3 * scale:
            break
    have = histogram.astype(np.int64).copy()
    plan = []
    for k in np.argsort(-np.array(values), kind="stable"):
        uses = [(p, int(w)) for p, w in terms[k]]
        n = min([int(values[k] + 0.5), *(int(have[p]) // w for p, w in uses)])
        if n > 0:
            for p, w in uses:
                have[p] -= n * w
            plan.append((combos[k], n))
    return plan


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids and the end id are laid out over pieces; a null or empty text is the end id alone.
    Pieces of a sequence follow one another without gaps, and no sequence is longer than the window. Ids of
    documents may be null or repeat; other columns are ignored. An empty table gives no rows.

    Only the histogram of lengths reaches the driver; the plan's size depends on the window alone.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"task int, number long, met long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = materialise(own.mapInArrow(_cut(tokenizer_path, window, end_id), schema), "pieces")
    per_task = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("length", "task", "ahead")
    total = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row for each length up to the window
        total[length] = n
    full, rests = int(total[window]), total.copy()
    rests[window] = 0
    # the plan gives each length ranges of ranks: sequence = base + rank - first for ranks from first on
    ranges, used, base = [], np.zeros(window + 1, np.int64), full
    for combo, n in solve(rests, window):
        at = 0
        for length in combo:
            ranges.append((length, int(used[length]), int(used[length]) + n, base, at))
            used[length] += n
            at += length
        base += n
    ranges.append((window, 0, full, 0, 0))
    for length in range(1, window):
        ranges.append((length, int(used[length]), int(total[length]), -1, 0))
    plan = spark.createDataFrame([r for r in ranges if r[1] < r[2]] or [(0, 0, 0, 0, 0)], "length long, first long, beyond long, base long, at long")
    lists = F.broadcast(plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "beyond", "base", "at"))).alias("ranges")))
    # the counts grow with the partitions: joined by merging, never sent to all executors
    ranked = pieces.drop("ids").join(per_task.hint("merge"), ["length", "task"]).withColumn("rank", F.col("met") + F.col("ahead")).join(lists, "length")
    hit = F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["beyond"]))[0]
    ranked = materialise(ranked.select("*", hit.alias("r")).drop("ranges", "met", "ahead"), "ranked")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    planned = ranked.where("r.base >= 0").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("r.base") + F.col("rank") - F.col("r.first")).alias("sequence_id"), F.col("r.at").alias("offset")
    )
    # rests beyond the plan lie one after another in the order of (task, number)
    loose = ranked.where("r.base < 0").select("task", "number", "length")
    in_task = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each scan partition is summed up in one task, and joined by merging
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = loose.groupBy("task").agg(F.sum("length").alias("s")).select("task", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    loose = loose.withColumn("own", F.coalesce(F.sum("length").over(in_task), F.lit(0))).join(before.hint("merge"), "task")
    loose = loose.select("task", "number", (F.col("own") + F.col("before")).alias("pos"))
    loose = pieces.drop("met").join(materialise(loose, "loose"), ["task", "number"])
    tail = loose.select("doc_id", "start", "ids", "doc_tokens", "pos").mapInArrow(_laid(window, base), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return planned.select(*out).unionByName(tail.select(*out))


def _laid(window: int, base: int):
    """Cuts rests where the windows that they are laid over end."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            rows = []
            starts, blobs, tokens, places = (batch.column(c).to_pylist() for c in (1, 2, 3, 4))
            for i, (start, blob, n, pos) in enumerate(zip(starts, blobs, tokens, places)):
                rest = n - start
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * rest else "<u4")
                at = 0
                while at < rest:
                    offset = (pos + at) % window
                    length = min(rest - at, window - offset)
                    rows.append(i)
                    for c, v in zip(cols[1:], (start + at, length, _crc(ids[at : at + length]), n, base + (pos + at) // window, offset)):
                        c.append(v)
                    at += length
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run
