"""Secrets in texts, found by one automaton for all rules."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .rule_automaton import Automaton, Rule

#: The kinds that every scan has, in this order. A run of hex digits counts from 16 on, so shorter ones needn't be met at all.
BASE = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", either_case=True, least=12),
    Rule("access", r"(AKIA[A-Z0-9]+)", least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further kinds: tokens of services, signed JSON tokens and the first lines of private keys.
MORE = (
    Rule("github", r"gh[pousr]_([A-Za-z0-9]+)", least=36),
    Rule("slack", r"xox[abprs]-([A-Za-z0-9-]+)", least=10),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", least=36),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@functools.lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton(rules)


def spans_of(raw: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a UTF-8 text's secrets in code points, end exclusive, by start and then kind."""
    found = automaton(rules).scan(raw)
    if not found:
        return []
    places, n, before = {}, 0, 0
    for at in sorted({x for _, *ends in found for x in ends}):
        n += len(raw[before:at].decode("utf-8", "surrogatepass"))
        places[at], before = n, at
    return [(rules[k].kind, places[a], places[b]) for k, a, b in found]


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of each row: the secrets of the whole text as structs of kind, start and end in code points.

    Spans of different kinds may overlap. Null and empty texts have none; ids may be null or repeat; other columns
    are ignored. The time grows with the text's length. An empty table gives no rows. Nothing is shuffled.
    """

    def run(batches):
        for batch in small_batches(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, rules)] for t in _raw(batch.column(1))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redacted(raw: bytes, rules: tuple[Rule, ...] = RULES) -> str:
    """The text with [kind] for each secret; spans that overlap are one, named after the first."""
    out, at, found = [], 0, automaton(rules).scan(raw)
    for k, start, end in found:
        if start >= at:
            out += [raw[at:start], b"[" + rules[k].kind.encode() + b"]"]
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of each row without its secrets; null texts stay null."""

    def run(batches):
        for batch in small_batches(batches):
            texts = [None if t is None else redacted(t, rules) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")


def digests(found: DataFrame) -> DataFrame:
    """Of found spans: doc_id, n_assign, n_access, n_hex, base_sha256 and spans as kind:start:end, comma-joined."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    return found.select("doc_id", *(n(r.kind) for r in BASE), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
