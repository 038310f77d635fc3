"""Ranked lexical search by pipelined term partitioning.

The terms of all queries are dealt out to owners, and each owner's postings are cut into shards of documents. A
bundle belongs to one query and one shard: it carries the query's terms and, for the shard's documents met so far,
their scores. Bundles pass through the owners one after another. At each, they are cogrouped with the owner's
postings of their shard, and the contributions of the terms that the owner has are added to the scores. Behind the
last owner, a bundle keeps its best documents, and those of a query's bundles are ranked.

A task holds one shard's documents (about DOCS_PER_SHARD, however often a term occurs) and the queries of one block
(ITEMS_PER_BLOCK at most), in whole numbers throughout, so that no order of additions changes a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, materialise, numbered, small_batches, with_row_key
from .text_core import split

OWNERS, DOCS_PER_SHARD, ITEM_BITS = 4, 2048, 8
ITEMS_PER_BLOCK = 1 << ITEM_BITS
#: The scan of the documents looks the queries' terms up in a set if these have so many bytes at most, else a join finds them.
WANTED_BYTES = 16_000_000
#: Every byte but letters, digits and those beyond ASCII parts terms; A-Z become a-z.
_TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_LISTS = "terms array<struct<owner:int,term:bigint,times:bigint>>, rows array<bigint>, ids array<bigint>, scores array<bigint>"
BUNDLE = f"shard bigint, block bigint, item bigint, {_LISTS}"
_TERM = pa.struct([("owner", pa.int32()), ("term", pa.int64()), ("times", pa.int64())])
_KINDS = pa.schema([*((c, pa.int64()) for c in ("shard", "block", "item")), ("terms", pa.list_(_TERM)), *((c, pa.list_(pa.int64())) for c in ("rows", "ids", "scores"))])


def term_counts(raw: bytes) -> tuple[int, Counter]:
    """The number of a text's terms, repeats included, and how often each occurs."""
    n, found = 0, Counter()
    for words in split(raw.translate(_TERMS)):
        n += len(words)
        found.update(words)
    return n, found


def _scan(df: DataFrame, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(row, id, n, term, tf) of numbered rows (row key, id, text): one row per distinct term, or wanted term, of a text.

    Each text that has terms also has a row without one, which alone has its id.
    """

    def run(batches):
        for batch in small_batches(batches):
            out: list[list] = [[], [], [], [], []]
            for row, id_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                n, found = term_counts(raw or b"")
                own = found.items() if wanted is None else [(t, found[t]) for t in found.keys() & wanted]
                more, told = len(own), [None] * (n > 0)
                for column, values in zip(out, ([row] * (more + len(told)), [id_] * len(told) + [None] * more, [n] * (more + len(told)), told + [t for t, _ in own], told + [k for _, k in own])):
                    column += values
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["row", "id", "n", "term", "tf"])

    return df.mapInArrow(run, "row long, id long, n long, term binary, tf long")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and flat values of a column of lists."""
    lists = column.combine_chunks()
    return np.asarray(lists.value_lengths()), lists.flatten()


def _add(owner: int, top: int | None):
    """A stage: bundles of one shard and block meet the owner's postings; with top, only so many best documents stay.

    Documents are their rows' numbers on the way. Only the last stage needs their ids: rows of the term -1 have them.
    """

    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        items, bundles = bundles.num_rows, bundles.cast(_KINDS)
        if not items or not postings.num_rows:
            return bundles
        (lengths, rows), (_, scores) = (_lists(bundles[c]) for c in ("rows", "scores"))
        rows, scores = np.asarray(rows), np.asarray(scores)
        order = np.lexsort((np.asarray(postings["row"]), np.asarray(postings["term"])))
        term, row, gain = (np.asarray(postings[c])[order] for c in ("term", "row", "gain"))
        docs = np.unique(np.concatenate([rows, row]))
        total = np.zeros((items, len(docs)), np.int64)
        total[np.repeat(np.arange(items), lengths), np.searchsorted(docs, rows)] = scores
        at = np.searchsorted(docs, row)
        counts, terms = _lists(bundles["terms"])
        which = np.repeat(np.arange(items), counts)
        own = np.asarray(terms.field("owner")) == owner
        asked, times, which = np.asarray(terms.field("term"))[own], np.asarray(terms.field("times"))[own], which[own]
        starts, ends = np.searchsorted(term, asked), np.searchsorted(term, asked, "right")
        for item, k, a, b in zip(which, times, starts, ends):
            total[item, at[a:b]] += k * gain[a:b]  # a document has one posting of a term
        found = [np.flatnonzero(line) for line in total]
        ids = np.zeros(len(docs), np.int64)
        if top:
            known = np.searchsorted(term, 0)  # rows of the term -1 come first
            ids[at[:known]] = np.asarray(postings["id"].fill_null(0))[order[:known]]
            found = [f[np.lexsort((docs[f], ids[f], docs[f] < 0, -line[f]))[:top]] for f, line in zip(found, total)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
        flat = np.concatenate(found)
        lists = {"rows": docs[flat], "scores": np.concatenate([line[f] for f, line in zip(found, total)])}
        for name, values in (lists | ({"ids": ids[flat]} if top else {})).items():
            bundles = bundles.set_column(bundles.column_names.index(name), name, pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64())))
        return bundles

    return run


def search(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           wanted_bytes: int = WANTED_BYTES, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): the top highest-scoring documents of each item, ranked from 1.

    Scores are those of whole texts and statistics over all documents; only scores above 0 count. Equal scores go
    by doc_id, null ids last. Every row of items is a query and every row of docs a document of its own, also with
    null or repeated ids. Null and empty texts have no terms. Empty tables give no rows; other columns are ignored.
    """
    queries = numbered(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), "search-items")
    asked = _scan(queries.select(ROW_KEY, F.lit(None).cast("long").alias("id"), "text")).where("term is not null")
    asked = materialise(asked.select(F.col("row").alias("item"), "term", F.col("tf").alias("times")), "search-asked")
    terms = numbered(asked.select("term").distinct(), "search-terms").withColumnRenamed(ROW_KEY, "number")
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    wanted = frozenset(bytes(r.term) for r in terms.select("term").collect()) if size <= wanted_bytes else None
    own = with_row_key(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    # a document without an id has a negative number
    own = own.select(F.when(F.col("id").isNull(), -F.col(ROW_KEY) - 1).otherwise(F.col(ROW_KEY)).alias("row"), "id", "text")
    found = materialise(_scan(own, wanted).join(terms, "term", "left").where("term is null or number is not null").drop("term"), "search-postings")
    texts = found.where("number is null")
    n_docs, n_terms = (x or 0 for x in texts.agg(F.count(F.lit(1)), F.sum("n")).first())

    df = found.where("number is not null").groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    owners = df.select("number", weight.alias("w"), F.pmod(F.xxhash64("number"), F.lit(OWNERS)).cast("int").alias("owner")).where("w > 0")
    block = F.shiftright("item", ITEM_BITS)
    uses = materialise(asked.join(terms, "term").join(owners, "number").select("item", block.alias("block"), "number", "times", "w", "owner"), "search-uses")
    # a term's row for each block that asks for it: a table whose size is known, so that Spark can tell whether to broadcast it
    asks = materialise(uses.select("number", "block", "w", "owner").distinct(), "search-asks")
    shards = max(1, -(-n_docs // docs_per_shard))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    m = F.expr(f"75L + (25L * n * {n_docs}L) div {max(n_terms, 1)}L")
    gain = F.expr("w * ((1000000000L * tf) div (1000L * tf + 12L * m))").alias("gain")
    gains = found.where("number is not null").join(asks, "number").withColumn("m", m).select(shard, "block", F.col("number").alias("term"), "row", gain, "owner")
    gains = materialise(gains.where("gain > 0"), "search-gains", by="owner")
    blocks = [r.block for r in asks.select("block").distinct().collect()]  # one for each ITEMS_PER_BLOCK queries
    known = texts.select(shard, F.explode(F.array(*map(F.lit, blocks)).cast("array<bigint>")).alias("block"), F.lit(-1).cast("long").alias("term"), "row", "id", F.lit(0).cast("long").alias("gain"))

    none = F.array().cast("array<bigint>")
    bundles = uses.groupBy("item", "block").agg(F.collect_list(F.struct("owner", F.col("number").alias("term"), "times")).alias("terms"))
    bundles = bundles.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "block", "item", "terms", none.alias("rows"), none.alias("ids"), none.alias("scores"))
    for owner in range(OWNERS):
        part, last = gains.where(F.col("owner") == owner).drop("owner"), owner == OWNERS - 1
        part = part.unionByName(known, allowMissingColumns=True) if last else part
        stage = _add(owner, top if last else None)
        bundles = bundles.groupBy("shard", "block").cogroup(part.groupBy("shard", "block")).applyInArrow(stage, BUNDLE)
    best = bundles.select("item", F.explode(F.arrays_zip("rows", "ids", "scores")).alias("d")).select("item", "d.*")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("scores").desc(), F.col("rows") < 0, "ids", "rows"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    named = best.join(queries.select(F.col(ROW_KEY).alias("item"), "item_id"), "item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("rows") >= 0, F.col("ids")).alias("doc_id"), F.col("scores").alias("score"))
