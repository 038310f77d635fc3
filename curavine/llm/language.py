"""Language identification by nearest centroids.

A text is a TF-IDF vector of its letters' three-byte runs, hashed to a fixed number of features and
normalised. Each language has several centroids, found by clustering its training vectors on the sphere.
The nearest centroid by cosine names the language; a text that lies farther from it than the language's
training texts do is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, crc32_of_id, discard, materialise, small_batches, with_row_key
from .text_core import SLICE_BYTES

FEATURES = 4096
#: Labelled texts of each language that the model is fitted on, about: a documented bound of the fit.
SAMPLE_PER_LANGUAGE = 400
CENTROIDS, ROUNDS = 4, 12
#: Texts of a language are rejected below this share of the cosine that all but one in a hundred of its
#: training texts reach; with fewer texts than that, of the cosine that each of them reaches without itself.
TOLERANCE = 0.5
#: Runs of letters from which a text's cosine no longer grows with its length; below, less is expected.
FULL_LENGTH = 400
UNKNOWN = "und"
_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x80:] = np.arange(0x80, 0x100)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[0] = 0


def has_letter(text: str) -> bool:
    """Whether a text has a character of one of Unicode's letter categories; numbers like ½ are none."""
    return any(map(str.isalpha, text))


def term_counts(texts: list[str]):
    """(first index, counts of features) for slices of the texts."""
    at = 0
    while at < len(texts):
        raw, size, end = [], 0, at
        while end < len(texts) and end - at < 512 and (end == at or size < SLICE_BYTES):
            raw.append(texts[end].lower().replace("\0", " ").encode("utf-8", "replace"))
            size += len(raw[-1])
            end += 1
        data = _MAP[np.frombuffer(b"\0" + b"\0".join(b" " + r + b" " for r in raw) + b"\0", np.uint8)]
        data = data[np.r_[True, (data[1:] != 0x20) | (data[:-1] != 0x20)]]
        owner = np.cumsum(data == 0)[:-2] - 1
        a, b, c = (data[k : len(data) - 2 + k].astype(np.uint32) for k in range(3))
        inside = (a != 0) & (b != 0) & (c != 0)
        code = ((a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(2654435761)) >> np.uint32(20)
        cell = owner[inside] * FEATURES + code[inside]
        yield at, np.bincount(cell, minlength=(end - at) * FEATURES).reshape(end - at, FEATURES).astype(np.float32)
        at = end


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _expected(counts: np.ndarray) -> np.ndarray:
    """How near texts of these lengths come to their centroids, as a share of what long ones do."""
    return np.sqrt(np.clip(counts.sum(axis=1), 1, FULL_LENGTH) / FULL_LENGTH)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _normal(np.log1p(counts) * idf)


def _cluster(x: np.ndarray) -> np.ndarray:
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(CENTROIDS, len(x)):  # the next seed is the vector farthest from all so far
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        c = _normal(sums)
    return c.astype(np.float32)


class Centroids:
    """idf, centroids, their languages and the least cosine of each language.

    fitted has a language, its centroids and its least cosine in each item: 64 KB a language at most.
    """

    def __init__(self, idf: np.ndarray, fitted: list[tuple[str, np.ndarray, float]]):
        self.idf, self.languages, least = idf, [f[0] for f in fitted], np.array([f[2] for f in fitted], np.float64)
        #: a language of which it isn't known is as tolerant as the most tolerant one
        self.least = np.where(np.isnan(least), np.nanmin(np.append(least, np.inf)) if not np.isnan(least).all() else 0.0, least)
        self.centres = np.concatenate([f[1] for f in fitted]) if fitted else np.zeros((0, FEATURES), np.float32)
        self.owner = np.repeat(np.arange(len(fitted)), [len(f[1]) for f in fitted])

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine of 0 to 1, and whether the text is too far from it."""
        if not len(self.centres):
            return np.zeros(len(counts), np.int64), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosines = _vectors(counts, self.idf) @ self.centres.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return self.owner[best], score, score < self.least[self.owner[best]] * _expected(counts)


def held_out(id_col: str | Column) -> Column:
    return crc32_of_id(id_col) % 3 == 1


def _dense(sample: pa.Table | pa.RecordBatch) -> np.ndarray:
    counts = np.zeros((sample.num_rows, FEATURES), np.float32)
    for row, at, tf in zip(counts, sample["at"].to_pylist(), sample["tf"].to_pylist()):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(tf, np.float32)
    return counts


def _occurrences(batches):
    """(feature, n): in how many of a partition's texts features occur; FEATURES itself stands for all texts."""
    n = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        n[FEATURES] += batch.num_rows
        for at in batch["at"].to_pylist():
            n[np.frombuffer(at, np.uint16)] += 1
    found = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found], pa.int64())], names=["feature", "n"])


def _without_itself(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The cosine of each vector with the nearest centroid of the others."""
    cosines = x @ c.T
    near = cosines.argmax(axis=1)
    for k in range(len(c)):
        rest = x[near == k].sum(axis=0) - x[near == k]
        cosines[near == k, k] = (x[near == k] * _normal(rest)).sum(axis=1) if len(rest) > 1 else 0
    return cosines.max(axis=1)


def _least(x: np.ndarray, c: np.ndarray, counts: np.ndarray) -> float:
    """The least cosine of a language's long texts; nan if one text alone tells nothing of others.

    The centroids of a few short texts aren't those of long ones, so length isn't allowed for there.
    """
    if len(x) >= 100:
        return TOLERANCE * float(np.sort((x @ c.T).max(axis=1) / _expected(counts))[len(x) // 100])
    return TOLERANCE * float(_without_itself(x, c).min()) if len(x) > 1 else float("nan")


def _fitted(idf: np.ndarray):
    def run(sample: pa.Table) -> pa.Table:
        counts = _dense(sample.sort_by([("at", "ascending"), ("tf", "ascending")]))
        own = _vectors(counts, idf)
        c = _cluster(own)
        least = pa.array([_least(own, c, counts)], pa.float64())
        return pa.table({"lang": sample["lang"][:1], "centres": pa.array([c.tobytes()], pa.binary()), "least": least})

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Centroids:
    """Fit on about per_language labelled texts of each language, chosen by a hash of their ids and texts.

    Every label is learned, however many there are. Held-out rows and rows without text, letters or label
    aren't used, repeated rows once. Whole texts are read. Each language is fitted in a task of its own; the driver gets the
    model, 64 KB a language at most, and 4096 document counts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out("id")).where("lang is not null and t is not null")
    steps = 1 << 30
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    limits = materialise(rows.groupBy("lang").count().select("lang", (share * steps).cast("long").alias("limit")), "language-limits")
    # the limits, a row for each label, are broadcast only if their written table is small enough
    rows = rows.join(limits, "lang").withColumn("h", F.xxhash64(F.lit("language sample"), "id", "t"))
    rows = rows.where(F.pmod("h", F.lit(steps)) < F.col("limit")).dropDuplicates(["lang", "h"])

    def count(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = [i for i, t in enumerate(texts) if has_letter(t)]
            for at, counts in term_counts([texts[i] for i in kept]):
                used = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[i] for i in kept[at : at + len(counts)]], pa.string()),
                        pa.array([u.astype(np.uint16).tobytes() for u in used], pa.binary()),
                        pa.array([c[u].tobytes() for c, u in zip(counts, used)], pa.binary()),
                    ],
                    names=["lang", "at", "tf"],
                )

    sample = materialise(rows.select("t", "lang").mapInArrow(count, "lang string, at binary, tf binary"), "language-sample")
    n = np.zeros(FEATURES + 1, np.int64)
    for feature, found in sample.select("at").mapInArrow(_occurrences, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        n[feature] = found
    idf = (np.log((1 + n[FEATURES]) / (1 + n[:FEATURES])) + 1).astype(np.float32)
    fitted = sample.groupBy("lang").applyInArrow(_fitted(idf), "lang string, centres binary, least double").collect()
    discard(sample)
    discard(limits)
    return Centroids(idf, [(lang, np.frombuffer(c, np.float32).reshape(-1, FEATURES), least) for lang, c, least in sorted(map(tuple, fitted))])


def _predicted(model: Centroids, texts: list[str]) -> tuple[list, list, list]:
    lang, score, rejected = [], [], []
    for at, counts in term_counts(texts):
        which, near, far = model.predict(counts)
        for t, w, s, r in zip(texts[at : at + len(counts)], which.tolist(), near.tolist(), far.tolist()):
            known = bool(model.languages) and has_letter(t)
            lang.append(model.languages[w] if known else UNKNOWN)
            score.append(s if known else 0.0)
            rejected.append(r or not known)
    return lang, score, rejected


def _labelled(model: Centroids):
    def run(batches):
        for batch in small_batches(batches):
            lang, score, rejected = _predicted(model, [t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[ROW_KEY, "doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Centroids | None = None) -> DataFrame:
    """One row per row of docs: row key, doc_id, held_out, lang_pred, score, rejected.

    lang_pred is a learned language, or und where the text is null or has no letter or nothing was
    learned. rejected marks those and the texts that are too far from every centroid of their language.
    Ids may be null (hashed like the empty text) or repeat; other columns are ignored. An empty table gives
    no rows. The model is of a fixed size for each language; it travels with the function.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    rows = with_row_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))).select(ROW_KEY, "id", "t")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_labelled(model), f"{ROW_KEY} long, doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select(ROW_KEY, "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Centroids | None = None) -> DataFrame:
    """The rows of docs that identify() doesn't reject, with all their columns; one pass and no shuffle."""
    model = model or fit(docs, id_col, text_col, lang_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in small_batches(batches):
            rejected = _predicted(model, [t or "" for t in batch.column(at).to_pylist()])[2]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
