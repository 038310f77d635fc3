"""Prefixes that conversations share, by ternary search trees over ranges of sorted conversations.

Turns become numbers of a dictionary, and conversations, as sequences of these, are sorted and cut into ranges. Each
range shard has a ternary search tree of its own, into which its sequences go median first, so that it is balanced.
A traversal without recursion adds up members, children, leaves and savings from the leaves on.

Only nodes on a shard's first and last sequence can have members in other shards. They are carried on with what is
known of them, as two spines, and everything else is finished. Spines of neighbouring shards are merged in the same
way, as sequences of a small tree, first within a task and then by groups of FAN neighbours, round after round, until
one group is left; in each round only the outermost spines stay open. So no task sees more than one shard, or the
spines of FAN ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, crc32_of_id, materialise, numbered, shuffle_partitions

#: Conversations and turns of a shard, about; ranges whose spines a task merges; conversations that share a first part, and how long it is at most.
SHARD_TURNS, FAN, FAMILY, SHARED = 65_536, 32, 20, 3
#: What is known of a node: members, the smallest of them, finished children, their leaves and savings.
_KNOWN = ("n", "low", "kids", "leaves", "saved")
_ROW = pa.schema(
    [
        ("kind", pa.string()), ("name", pa.binary()), ("depth", pa.int64()), ("parent_name", pa.binary()), ("parent_low", pa.int64()), *((k, pa.int64()) for k in _KNOWN), ("sha", pa.string()),
        ("part", pa.int64()), ("place", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), *(("open_" + k, pa.list_(pa.int64())) for k in _KNOWN), ("chunk", pa.string()),
    ]
)
_LISTS = ("ids", "words", *("open_" + k for k in _KNOWN))
_DDL = ", ".join(f"{f.name} {'array<bigint>' if f.name in _LISTS else {'string': 'string', 'binary': 'binary', 'int64': 'bigint'}[str(f.type)]}" for f in _ROW)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def medians(n: int) -> Iterator[int]:
    """The numbers below n: the middle one, then those of the halves, and so on."""
    left = [(0, n)]
    while left:
        a, b = left.pop()
        if a < b:
            yield (mid := (a + b) // 2)
            left += [(mid + 1, b), (a, mid)]


class Trie:
    """A ternary search tree: a node has a turn's number, smaller and larger siblings, and the first of its children.

    Node 0 is the root, without a turn. What is known of the nodes stands in lists, one for each of _KNOWN.
    """

    def __init__(self):
        self.key, self.words, self.parent, self.depth = [-1], [0], [-1], [0]
        self.smaller, self.larger, self.down = [-1], [-1], [-1]
        self.n, self.low, self.kids, self.leaves, self.saved = [0], [None], [0], [0], [0]

    def _new(self, key: int, words: int, parent: int) -> int:
        for column, value in ((self.key, key), (self.words, words), (self.parent, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        for column in (self.smaller, self.larger, self.down):
            column.append(-1)
        for column in (self.n, self.kids, self.leaves, self.saved):
            column.append(0)
        self.low.append(None)
        return len(self.key) - 1

    def insert(self, ids: list[int], words: list[int]) -> list[int]:
        """The nodes of a sequence, the root first."""
        at, nodes = 0, [0]
        for key, w in zip(ids, words):
            parent, at, side = at, self.down[at], self.down
            last = parent
            while at >= 0 and self.key[at] != key:
                side, last = (self.smaller if key < self.key[at] else self.larger), at
                at = side[at]
            if at < 0:
                side[last] = at = self._new(key, w, parent)
            nodes.append(at)
        return nodes

    def add(self, node: int, n: int, low: int | None, kids: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.n[node] += n
        self.kids[node] += kids
        self.leaves[node] += leaves
        self.saved[node] += saved
        if low is not None and (self.low[node] is None or low < self.low[node]):
            self.low[node] = low

    def traversal(self) -> list[int]:
        """All nodes, parents before their children."""
        order, left = [], [0]
        while left:
            order.append(at := left.pop())
            left += [x for x in (self.larger[at], self.down[at], self.smaller[at]) if x >= 0]
        return order

    def settle(self, open_: set[int]) -> list[int]:
        """Finish all nodes but the open ones, from the leaves on; they are returned."""
        done = []
        for v in reversed(self.traversal()):
            if v in open_:
                continue
            self.leaves[v] += self.kids[v] == 0
            self.saved[v] += (self.n[v] - 1) * self.words[v]
            if v:
                self.add(self.parent[v], self.n[v], self.low[v], 1, self.leaves[v], self.saved[v])
            done.append(v)
        return done

    def named(self, nodes) -> dict[int, bytes]:
        """Names of nodes and all above them that are the same in every shard: digests of the turns up to them."""
        names = {0: hashlib.sha256(b"root").digest()}
        for v in nodes:
            way = []
            while v not in names:
                way.append(v)
                v = self.parent[v]
            for x in reversed(way):
                names[x] = hashlib.sha256(names[self.parent[x]] + self.key[x].to_bytes(8, "little", signed=True)).digest()
        return names

    def finished(self, done: list[int], names: dict[int, bytes], open_: set[int], ends: dict[int, str] | None = None) -> Iterator[dict]:
        """Rows of finished nodes. ends are the digests of those that have none of their own name, else they are looked up later."""
        for v in done:
            p = self.parent[v]
            row = {"kind": "node", "depth": self.depth[v], **{k: getattr(self, k)[v] for k in _KNOWN}}
            row |= {"sha": ends.get(v, _NO_ENDS)} if ends is not None else {"name": names[v]}
            if p >= 0:
                row |= {"parent_name": names[p]} if p in open_ else {"parent_low": self.low[p]}
            yield row

    def spines(self, paths: list[list[int]]) -> list[dict]:
        """The first and the last of some sequences of nodes, with what is known of them; a node counts with the first of the two only."""
        out, told = [], set()
        for nodes in paths[:1] if paths[0] == paths[-1] else (paths[0], paths[-1]):
            row = {"ids": [self.key[v] for v in nodes[1:]], "words": [self.words[v] for v in nodes[1:]]}
            for k in _KNOWN:
                row["open_" + k] = [(None if k == "low" else 0) if v in told else getattr(self, k)[v] for v in nodes]
            told |= set(nodes)
            out.append(row)
        return out


def _shard(sequences: list[tuple[list[int], list[int], list[int]]], place: int) -> tuple[list[dict], list[dict]]:
    """Finished rows and spines of a shard: sorted distinct sequences, their turns' words and their conversations."""
    trie = Trie()
    paths: list[list[int]] = [[]] * len(sequences)
    for k in medians(len(sequences)):
        ids, words, members = sequences[k]
        paths[k] = trie.insert(ids, words)
        trie.add(paths[k][-1], len(members), members[0])
    open_ = {*paths[0], *paths[-1]}
    names, ends, rows = trie.named((paths[0][-1], paths[-1][-1])), {}, []
    for nodes, (_, _, members) in zip(paths, sequences):
        line, v = ",".join(map(str, members)), nodes[-1]
        if v in open_:
            rows.append({"kind": "ends", "name": names[v], "place": place, "chunk": line})
        else:
            ends[v] = hashlib.sha256(line.encode()).hexdigest()
    rows += trie.finished(trie.settle(open_), names, open_, ends)
    return rows, trie.spines(paths)


def _merged(spines: list[dict], last: bool = False) -> tuple[list[dict], list[dict]]:
    """Finished rows and outer spines of neighbouring ranges; nothing stays open with last."""
    trie = Trie()
    paths: list[list[int]] = [[]] * len(spines)
    for k in medians(len(spines)):
        s = spines[k]
        paths[k] = trie.insert(s["ids"], s["words"])
        for v, *known in zip(paths[k], *(s["open_" + x] for x in _KNOWN)):
            trie.add(v, *known)
    open_ = set() if last else {*paths[0], *paths[-1]}
    names = trie.named(p[-1] for p in paths)
    rows = list(trie.finished(trie.settle(open_), names, open_))
    return rows, [] if last else trie.spines(paths)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ROW)


def _shards(limit: int):
    """Sorted conversations of a range to its finished nodes and its two spines, one shard after another."""

    def run(batches):
        held: list[tuple[list[int], list[int], list[int]]] = []
        size, place, part, spines = 0, 0, None, []

        def close():
            nonlocal held, size, place, spines
            rows, own = _shard(held, place)
            more, spines = _merged(spines + own) if spines else ([], own)
            held, size, place = [], 0, place + 1
            return _batch([r | {"part": part} for r in rows + more])

        for batch in batches:
            for part, conv, ids, words in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= limit:
                    yield close()
                if held and held[-1][0] == ids:
                    held[-1][2].append(conv)
                else:
                    held.append((ids, words, [conv]))
                    size += len(ids)
                size += 1
        if held:
            yield close()
            yield _batch([s | {"kind": "spine", "part": part, "place": k} for k, s in enumerate(spines)])

    return run


def _rounds(last: bool):
    def run(key, table):
        spines = sorted(table.select(["part", "place", *_LISTS]).to_pylist(), key=lambda s: (s["part"], s["place"]))
        rows, own = _merged(spines, last)
        return pa.Table.from_batches([_batch(rows + [s | {"kind": "spine", "part": key[0].as_py(), "place": k} for k, s in enumerate(own)])])

    return run


def _ends(batches):
    """(name, sha) of chunks sorted by name and place: each name's chunks, joined with commas, as one digest."""
    name, digest = None, None
    for batch in batches:
        out = []
        for own, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != name:
                if name is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = own, hashlib.sha256(chunk.encode())
            else:
                digest.update(b"," + chunk.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["name", "ends"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["name", "ends"])


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words) of each rebuilt conversation: the numbers of its turns in a dictionary, and the words of their texts.

    Turns go by turn, null first, and at the same turn by the digest of role and text. Null roles and texts are
    empty. A conversation c starts with the first crc32(c) % 4 turns of conversation c - c % 20, as far as there are
    so many, in place of as many of its own. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    turns = materialise(turns, "trie-turns")
    numbers = numbered(turns.select("digest").distinct(), "trie-numbers").withColumnRenamed(ROW_KEY, "id")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "id", "words")
    own = turns.join(numbers, "digest").groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("s"))
    own = own.select("conv_id", F.transform("s", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("s"))
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("s", 1, SHARED).alias("head"))
    h = (crc32_of_id("conv_id") % (SHARED + 1)).cast("int")
    none = F.array().cast("array<struct<id:bigint,words:bigint>>")
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left").withColumn("h", h)
    built = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("s", F.col("h") + 1, F.greatest(F.size("s"), F.lit(1))))
    return both.select("conv_id", built.alias("s")).select("conv_id", F.col("s.id").alias("ids"), F.col("s.words").alias("words"))


def trie_nodes(rows: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """One row per node of the trie of (conv_id, ids, words), whose conv_ids are distinct.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A
    conversation's numbers of turns are one row; nothing else that belongs together has to be. No rows give no nodes.
    """
    rows = materialise(rows, "trie-sequences")
    parts = shuffle_partitions(rows.sparkSession)
    ordered = rows.repartitionByRange(parts, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "ids", "words")
    found = materialise(ordered.mapInArrow(_shards(shard_turns), _DDL), "trie-shards")
    nodes, chunks = found.where("kind = 'node'"), found.where("kind = 'ends'")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = parts <= fan
        group = F.floor(F.col("part") / fan).cast("long").alias("group")
        found = materialise(found.where("kind = 'spine'").groupBy(group).applyInArrow(_rounds(last), _DDL), "trie-spines")
        nodes = nodes.unionByName(found.where("kind = 'node'"))
        if last:
            break
        parts = -(-parts // fan)
    chunks = chunks.select("name", "chunk", "part", "place").repartition("name").sortWithinPartitions("name", "part", "place").select("name", "chunk")
    ends = chunks.mapInArrow(_ends, "name binary, ends string")
    parents = nodes.where("name is not null").select(F.col("name").alias("parent_name"), F.col("low").alias("found_low"))
    out = nodes.join(ends, "name", "left").join(parents, "parent_name", "left")
    return out.select(
        F.col("low").alias("conv_id"), "depth", F.coalesce("parent_low", "found_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", "ends", F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN) -> DataFrame:
    """The nodes of the rebuilt conversations' trie, see sequences() and trie_nodes(); other columns are ignored.

    The root stands for all conversations, also those without a turn left. An empty table gives no rows.
    """
    return trie_nodes(sequences(conversations), shard_turns, fan)
