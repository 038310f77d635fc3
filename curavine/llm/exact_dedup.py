"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of fixed size. The distinct blocks are sorted within their partitions and
numbered; these integers are the blocks' names. Adjacent names are then paired, and the distinct pairs
are named in the same way, until one name is left for each text. Equal names at the same level mean equal
texts, without any chance of a collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, discard, materialise

#: Bytes of a block. Larger blocks need fewer rounds of pairing, smaller ones less memory for a row.
BLOCK_BYTES = 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _names(parts: DataFrame, key: list[str], value: list[str], level: str) -> DataFrame:
    """(key, name) of the distinct values; key is a short stand-in for value in joins."""
    chosen = parts.select(*key, *value).distinct().sortWithinPartitions(*value)
    return materialise(chosen.select(*key, F.monotonically_increasing_id().alias("name")), f"names-{level}")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_col: str | None = None) -> DataFrame:
    """Each row's (row key, id, text_sha256, level, name), as a table: texts are equal where level and name are.

    Null text counts as empty, an empty text is one empty block. Ids may be null or repeat; other
    columns of docs are ignored, whatever their names. key_col names a column of a written table that
    numbers its rows; without it, rows are numbered in the one job that writes the identities' rows.

    A block travels as two 64-bit hashes once it has a name. The names table tells whether two distinct
    blocks share both hashes; then the hashing is repeated with another salt, so the stand-in is exact.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER).cast("binary")
    key = F.monotonically_increasing_id() if key_col is None else F.col(key_col)
    base = docs.select(key.alias(ROW_KEY), F.col(id_col).alias("id"), text.alias("raw"))

    def cut(make) -> Column:
        """make(block) for each block. The text is a lambda's argument, so that it is lower-cased once only."""
        last = lambda r: F.greatest(F.lit(1), F.ceil(F.octet_length(r) / F.lit(block_bytes))).cast("int") - 1
        one = lambda r: F.transform(F.sequence(F.lit(0), last(r)), lambda i: make(F.substring(r, i * block_bytes + 1, F.lit(block_bytes))))
        return F.flatten(F.transform(F.array("raw"), one))

    blocks = base.select(F.explode(cut(lambda b: b)).alias("block"))
    for salt in range(0, 100, 2):
        stand_in = lambda b, s=salt: F.struct(F.xxhash64(F.lit(s), b).alias("h1"), F.xxhash64(F.lit(s + 1), b).alias("h2"))
        names = _names(blocks.select(stand_in(F.col("block")).alias("h"), "block").select("h.*", "block"), ["h1", "h2"], ["block"], "blocks")
        if names.groupBy("h1", "h2").count().where("count > 1").isEmpty():
            break
        discard(names)
    else:
        raise RuntimeError("no salt tells all distinct blocks apart")
    hashed = base.select(ROW_KEY, "id", F.sha2("raw", 256).alias("text_sha256"), cut(lambda b: stand_in(b)).alias("hs"))
    rows = materialise(hashed, "rows")
    passing = [names, rows]
    parts = rows.select(ROW_KEY, F.size("hs").alias("n"), F.posexplode("hs").alias("pos", "h")).select(ROW_KEY, "n", "pos", "h.h1", "h.h2")
    named = parts.join(names, ["h1", "h2"]).select(ROW_KEY, "n", "pos", "name")
    done, level = [], 0
    longest = rows.agg(F.max(F.size("hs"))).first()[0] or 1
    while True:
        named = materialise(named, f"level-{level}")
        passing.append(named)
        done.append(named.where("n = 1").select(ROW_KEY, F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        # an odd last name is paired with -1, which no block and no pair is called
        pairs = named.where("n > 1").groupBy(ROW_KEY, "n", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
        )
        pairs = materialise(pairs, f"pairs-{level}")
        both = _names(pairs, ["l", "r"], ["l", "r"], f"pairs-{level}")
        passing += [pairs, both]
        named = pairs.join(both, ["l", "r"]).select(ROW_KEY, F.ceil(F.col("n") / 2).cast("int").alias("n"), "pos", "name")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    out = materialise(rows.select(ROW_KEY, "id", "text_sha256").join(found, ROW_KEY), "identities")
    for table in passing:
        discard(table)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_col: str | None = None) -> DataFrame:
    """One row per row of docs: row key, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    id stays; of repeated rows with that id, the one that is numbered first. Rows without an id
    stay only if no equal text has one. An empty table gives no rows.
    """
    ids = identities(docs, id_col, text_col, block_bytes, key_col)
    groups = ids.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"),
        F.max(F.struct(F.col("id"), (-F.col(ROW_KEY)).alias("order"))).alias("top"),
    )
    groups = materialise(groups, "groups")
    return ids.join(groups, ["level", "name"]).select(
        ROW_KEY, F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col(ROW_KEY) == -F.col("top")["order"]).alias("kept"), "text_sha256",
    )
