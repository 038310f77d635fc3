"""Language-model scores by a weighted backoff automaton of order 3.

States are a root, words (the start of a text among them) and pairs of words that training has seen often
enough. A state has an arc for every word that followed it in training, weighted with its absolutely
discounted and smoothed probability, and a failure arc to the state of the history without its first word,
weighted with the mass that the discount has freed. The root has an arc for every word and one for unknown
ones. A word's arc leads to the longest state that the words read so far end in. Reading a text from left to
right, a word takes its arc at the present state or, where there is none, the failure arc and then its arc at
the shorter state; the log-probabilities on the way add up.

The automaton grows with the corpus and is never gathered in one place. Texts are dealt with in chunks, each
of which needs the states and arcs of its own words only. Chunks are written once, bucketed by their number.
For each order in turn, chunks ask the slices of the state space for their states' arcs, with the counts in
their own training texts; slices add these up over the corpus, and the answers join the chunks' buckets. A
chunk only asks about states that the answers before have shown to exist.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text_core as tc
from .common import crc32_of_id, discard, materialise, scratch_dir, shuffle_partitions

#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000
ORDER = 3
#: What is taken from the count of every arc, and how often training has to see a history that is a state.
DISCOUNT, LEAST = 0.75, 4
_U = np.uint64
_END, _START = _U(0x0123456789ABCDEF), _U(0xFEDCBA9876543210)
_ASK = "chunk long, slice int, states binary, arcs binary, words binary, counts binary"
_ANSWER = "chunk long, level int, slice int, a binary, b binary, n long, v long"
_ANSWERS = ["chunk", "level", "slice", "a", "b", "n", "v"]


def _bytes(x: np.ndarray) -> bytes:
    """Numbers from 0 on (or -1) as bytes of the narrowest type, which the first byte names."""
    if len(x) and x.min() < 0:
        return b"q" + x.astype("<i8").tobytes()
    most = int(x.max()) if len(x) else 0
    kind = "B" if most < 1 << 8 else "H" if most < 1 << 16 else "I" if most < 1 << 32 else "Q"
    return kind.encode() + x.astype("<" + kind).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<" + chr(raw[0]), offset=1).astype(np.int64)


def _slice_of(first: np.ndarray, second: np.ndarray, slices: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = tc.mix(first.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + tc.mix(second.astype(np.uint64) + _U(0x632BE59BD9B4E019)))
    return (((h >> _U(32)) * _U(slices)) >> _U(32)).astype(np.int64)


# --- chunks ---------------------------------------------------------------------------------------------


def _chunk(number: int, ids: list, train: list[bool], texts: list, kind: pa.DataType) -> pa.RecordBatch:
    """A chunk's distinct words, the start and the end among them, and its texts as numbers of these."""
    parts = [tc.word_hashes(raw) for _, raw in tc.slices(texts)]
    counts = np.concatenate([c for _, c in parts]) + 1
    tokens = np.full(int(counts.sum()), _END, np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(counts) - 1] = False
    tokens[inner] = np.concatenate([w for w, _ in parts])
    words, seq = np.unique(np.append(tokens, _START), return_inverse=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([train], pa.list_(pa.bool_())), pa.array([_bytes(counts)], pa.binary()),
            pa.array([words.tobytes()], pa.binary()), pa.array([_bytes(seq[:-1])], pa.binary()),
        ],
        names=["chunk", "ids", "train", "lengths", "words", "seq"],
    )


def _chunks(kind: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids, train, texts, size = [], [], [], 0
        for batch in batches:
            for i, t, x in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if texts and size + len(x or "") > CHUNK_BYTES:
                    yield _chunk(number, ids, train, texts, kind)
                    ids, train, texts, size, number = [], [], [], 0, number + 1
                ids.append(i)
                train.append(t)
                texts.append(x)
                size += len(x or "")
        if texts:
            yield _chunk(number, ids, train, texts, kind)

    return run


class _Arcs:
    """The states of one order that a chunk meets and their arcs for its words, without repeats.

    state names the state that each token is read in (a number within the chunk, -1: none of this order) and
    known tells which tokens' words training has. Only these can have arcs. The order of states and arcs,
    by slices, is that in which they are asked for and answered.
    """

    def __init__(self, state: np.ndarray, word: np.ndarray, known: np.ndarray, words: int, first: np.ndarray, second: np.ndarray, slices: int):
        self.read_in, self.places = state, np.flatnonzero((state >= 0) & known)
        self.names = np.unique(state[state >= 0])
        keys, arc = np.unique(state[self.places] * words + word[self.places], return_inverse=True)
        self.arc, self.word = arc.astype(np.int32), keys % words
        self.owner = np.searchsorted(self.names, keys // words)
        at = _slice_of(first[self.names], second[self.names], slices)
        self.order = np.argsort(at, kind="stable")
        self.cuts = np.searchsorted(at[self.order], np.arange(slices + 1))
        self.sizes = np.bincount(self.owner, minlength=len(self.names))
        begin = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[self.order]
        #: arcs in the order of the states
        self.dealt = np.repeat(begin[self.order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(keys))

    def asked(self, number: int, learned: np.ndarray, first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        counts = np.bincount(self.arc, weights=learned, minlength=len(self.word)).astype(np.int64)
        used = np.flatnonzero(self.cuts[1:] > self.cuts[:-1])
        ends = np.append(0, np.cumsum(self.sizes[self.order]))
        cols: list[list] = [[] for _ in range(4)]
        for s in used:
            a, b = self.cuts[s], self.cuts[s + 1]
            states, arcs = self.names[self.order[a:b]], self.dealt[ends[a] : ends[b]]
            for col, x in zip(cols, (np.concatenate((first[states], second[states])), self.sizes[self.order[a:b]], ids[self.word[arcs]], counts[arcs])):
                col.append(_bytes(x))
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(used), pa.int64()), pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["chunk", "slice", "states", "arcs", "words", "counts"]
        )

    def take(self, answers: list[tuple[bytes, bytes]]) -> None:
        """Distinct words that followed each state, and how often each arc was seen, from the slices' answers."""
        self.kinds, self.seen = np.zeros(len(self.names), np.int64), np.zeros(len(self.word), np.int64)
        if answers:
            self.kinds[self.order] = np.concatenate([_numbers(a) for a, _ in answers])
            self.seen[self.dealt] = np.concatenate([_numbers(b) for _, b in answers])


class _Chunk:
    """A chunk with the orders that the slices have answered so far."""

    def __init__(self, row: dict, slices: int, least: int, answered: int):
        self.words, self.seq = np.frombuffer(row["words"], np.uint64), _numbers(row["seq"])
        self.lengths, self.number = _numbers(row["lengths"]), row["chunk"]
        self.ids, self.train = row["ids"], np.array(row["train"], bool)
        self.slices, self.least = slices, least
        self.firsts = np.cumsum(self.lengths) - self.lengths
        self.start = int(np.searchsorted(self.words, _START))
        self.orders: list[_Arcs] = []
        answers: list[list] = [[] for _ in range(answered + 1)]
        for x in row.get("answers") or []:
            answers[x["level"]].append((x["a"], x["b"]))
        if answers[0]:
            self.count = np.concatenate([_numbers(a) for a, _ in answers[0]])
            self.id = np.concatenate([_numbers(b) for _, b in answers[0]])
        for level in range(1, answered + 1):
            arcs = self.arcs(level)
            arcs.take(answers[level])
            self.orders.append(arcs)

    def learned(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def asked_words(self) -> pa.RecordBatch:
        counts = np.bincount(self.seq, weights=self.learned(), minlength=len(self.words)).astype(np.int64)
        counts[self.start] = self.train.sum()
        at = ((self.words >> _U(32)) * _U(self.slices)) >> _U(32)
        cuts = np.searchsorted(at, np.arange(self.slices + 1, dtype=np.uint64))
        used = np.flatnonzero(cuts[1:] > cuts[:-1])
        n, none = len(used), pa.nulls(len(used), pa.binary())
        parts = [[self.words[cuts[s] : cuts[s + 1]].tobytes() for s in used], [_bytes(counts[cuts[s] : cuts[s + 1]]) for s in used]]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number] * n, pa.int64()), pa.array(used, pa.int32()), pa.array(parts[0], pa.binary()), none, none, pa.array(parts[1], pa.binary())],
            names=["chunk", "slice", "states", "arcs", "words", "counts"],
        )

    def names(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """A state's two numbers in the whole corpus, by its number within the chunk."""
        if level == 1:
            return self.id, np.zeros(len(self.id), np.int64)
        pairs = self.orders[0]
        return self.id[pairs.names[pairs.owner]], self.id[pairs.word] + 1

    def arcs(self, level: int) -> _Arcs:
        """The states of so many words that the tokens are read in, and their arcs."""
        state = np.full(len(self.seq), -1)
        if level == 1:
            state[1:] = self.seq[:-1]
            state[self.firsts] = self.start
            real = self.count[state] >= self.least
        else:
            # the state of two words is the arc that the second one took from the first
            pairs, at = self.orders[0], np.full(len(self.seq), -1)
            at[pairs.places] = pairs.arc
            state[1:] = at[:-1]
            state[self.firsts] = -1
            real = state >= 0
            real[real] = pairs.seen[state[real]] >= self.least
        return _Arcs(np.where(real, state, -1), self.seq, self.count[self.seq] > 0, len(self.words), *self.names(level), self.slices)


def _asked(level: int, slices: int, least: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                c = _Chunk(batch.slice(k, 1).to_pylist()[0], slices, least, max(level - 1, 0))
                if level == 0:
                    yield c.asked_words()
                else:
                    arcs = c.arcs(level)
                    yield arcs.asked(c.number, c.learned()[arcs.places], *c.names(level), c.id)

    return run


# --- slices ---------------------------------------------------------------------------------------------


def _grouped(batches):
    """(slice, its rows (chunk, states, arcs, words, counts)) from rows in the order of slices."""
    held, last = [], None
    for batch in batches:
        for chunk, s, *rest in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if s != last and held:
                yield last, held
                held = []
            last = s
            held.append((chunk, *rest))
    if held:
        yield last, held


def _answer(at: int, level: int, rows: list, a: list[bytes], b: list[bytes], n: int | None = None, v: int | None = None) -> pa.RecordBatch:
    extra = n is not None
    chunks = [r[0] for r in rows] + [-1] * extra
    size = len(chunks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(chunks, pa.int64()), pa.array([level] * size, pa.int32()), pa.array([at] * size, pa.int32()), pa.array(a + [None] * extra, pa.binary()), pa.array(b + [None] * extra, pa.binary()),
            pa.array([None] * len(rows) + [n] * extra, pa.int64()), pa.array([None] * len(rows) + [v] * extra, pa.int64()),
        ],
        names=_ANSWERS,
    )


def _word_totals(slices: int):
    """Of each chunk's words, their counts in training and numbers that hold for the whole corpus."""

    def run(batches):
        for at, rows in _grouped(batches):
            parts = [np.frombuffer(r[1], np.uint64) for r in rows]
            own, back = np.unique(np.concatenate(parts), return_inverse=True)
            totals = np.zeros(len(own), np.int64)
            np.add.at(totals, back, np.concatenate([_numbers(r[4]) for r in rows]))
            known = totals > 0
            ids = np.where(known, (np.cumsum(known) - 1) * slices + at, -1)
            cuts = np.cumsum([len(p) for p in parts])[:-1]
            word = own != _START  # no token, but a state
            yield _answer(at, 0, rows, [_bytes(x) for x in np.split(totals[back], cuts)], [_bytes(x) for x in np.split(ids[back], cuts)], int(totals[word].sum()), int((known & word).sum()))

    return run


def _arc_totals(level: int):
    """Of each chunk's states, how many words followed them in training, and of its arcs, how often."""

    def run(batches):
        for at, rows in _grouped(batches):
            names = [_numbers(r[1]).reshape(2, -1) for r in rows]
            first, second = (np.unique(np.concatenate([x[k] for x in names]), return_inverse=True)[1] for k in (0, 1))
            _, state = np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)
            sizes, words, counts = (np.concatenate([_numbers(r[k]) for r in rows]) for k in (2, 3, 4))
            distinct, word = np.unique(words, return_inverse=True)
            owner = np.repeat(state, sizes)
            keys, back = np.unique(owner * max(len(distinct), 1) + word, return_inverse=True)
            totals = np.zeros(len(keys), np.int64)
            np.add.at(totals, back, counts)
            kinds = np.bincount(keys[totals > 0] // max(len(distinct), 1), minlength=int(state.max()) + 1)
            per = np.cumsum([x.shape[1] for x in names])[:-1]
            arcs = np.cumsum([len(_numbers(r[3])) for r in rows])[:-1]
            yield _answer(at, level, rows, [_bytes(x) for x in np.split(kinds[state], per)], [_bytes(x) for x in np.split(totals[back], arcs)])

    return run


# --- scores ---------------------------------------------------------------------------------------------


def _walk(c: _Chunk, n: int, v: int, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each text of a chunk.

    All tokens take their steps at once: the state in which a token is read is the end of the arc that the
    token before it took, which is the longest suffix of the words read that is a state.
    """
    size = len(c.seq)
    root = (c.count[c.seq] + 1) / (n + v + 1)
    smoothed, score = root, np.zeros(size)
    arcs, failures = [], []  # for each order: weight of the token's arc (nan: none), weight of the failure arc
    for level, a in enumerate(c.orders, 1):
        inside = a.read_in >= 0
        state = a.read_in[inside]
        # how often training saw a state is how often it saw words after it
        total = (c.count if level == 1 else c.orders[0].seen)[state]
        failure, seen = np.ones(size), np.zeros(size, np.int64)
        failure[inside] = discount * a.kinds[np.searchsorted(a.names, state)] / total
        seen[a.places] = a.seen[a.arc]
        own = failure * smoothed
        own[inside] += np.maximum(seen[inside] - discount, 0) / total
        smoothed = own
        arcs.append(np.where(seen > 0, own, np.nan))
        failures.append(failure)
    # from the longest state down: failure arcs until the word has an arc
    open_ = np.ones(size, bool)
    for weight, failure in zip(reversed(arcs), reversed(failures)):
        took = open_ & ~np.isnan(weight)
        score[took] += np.log10(weight[took])
        open_ &= ~took
        score[open_] += np.log10(failure[open_])
    score[open_] += np.log10(root[open_])
    add = lambda x: np.add.reduceat(x, c.firsts)
    return add((c.count[c.seq] > 0).astype(np.int64)), add(np.log10(root)), add(score)


def _scored(kind: pa.DataType, n: int, v: int, slices: int, least: int, discount: float):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                c = _Chunk(batch.slice(k, 1).to_pylist()[0], slices, least, ORDER - 1)
                known, base, score = _walk(c, n, v, discount)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, kind), pa.array(~c.train), pa.array(c.lengths), pa.array(known), pa.array(np.full(len(c.ids), n, np.int64)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def held_out(id_col: str):
    return crc32_of_id(id_col) % 7 == 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, least: int = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and every text ends with an end token. Rows that
    aren't held out train the model. score is the log10 probability of the whole text: with c for counts in
    training, C for those of a history and K for the distinct words after it, p(w) = (c(w) + 1) / (N + V + 1),
    and p(w|h) = max(c(hw) - discount, 0) / C(h) + discount * K(h) / C(h) * p(w|h without its first word) for
    histories of one and two words seen at least so often; others count as their last word, or none. Null and
    empty texts are their end token; with nothing to train on, every word is unknown. Ids may be null (hashed
    like the empty text) or repeat; other columns are ignored. An empty table gives no rows.

    Words are told apart by 64 bits of a cryptographic hash, states and arcs by the words' numbers. The texts
    are read once. Two numbers reach the driver.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), (~held_out(id_col)).alias("train"), F.col(text_col).cast("string").alias("t"))
    parts, kind = shuffle_partitions(spark), own.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(own.schema["id"].dataType)
    name = "lm_chunks_" + uuid.uuid4().hex
    chunks = own.mapInArrow(_chunks(arrow), f"chunk long, ids array<{kind}>, train array<boolean>, lengths binary, words binary, seq binary")
    # answers join their chunks bucket by bucket, so that chunks are never shuffled
    chunks.write.bucketBy(parts, "chunk").options(path=f"{scratch_dir(spark)}/{name}", compression="zstd").saveAsTable(name)
    chunks, answers = spark.table(name), []

    def answered() -> DataFrame:
        if not answers:
            return chunks
        given = answers[0]
        for more in answers[1:]:
            given = given.unionByName(more)
        given = given.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("level", "slice", "a", "b"))).alias("answers"))
        return chunks.join(given, "chunk", "left")

    for level in range(ORDER):
        asked = answered().mapInArrow(_asked(level, parts, least), _ASK).repartitionById(parts, F.col("slice"))
        answers.append(materialise(asked.mapInArrow(_word_totals(parts) if level == 0 else _arc_totals(level), _ANSWER), f"lm-answers-{level}"))
    n, v = answers[0].where("chunk = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    scores = answered().mapInArrow(
        _scored(arrow, n, v, parts, least, discount),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    scores = materialise(scores, "lm-scores")
    for table in (chunks, *answers):
        discard(table)
    spark.sql(f"DROP TABLE {name}")
    return scores
