"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where no piece of the vocabulary can reach across: before each run of spaces and, if no piece
holds both, between letters and other characters. Each distinct part is encoded once: its adjacent symbol pairs form an agenda ordered by the score of the piece that they
make, the leftmost first among equals; the best is merged and its neighbours' pairs are entered anew. Short
parts are worked off together in arrays, one merge of each at a time, long ones with a heap. Every distinct
part of an Arrow batch is checked against the sentencepiece library, decoding for all new ones at once.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .text_core import SLICE_BYTES

SPACE = "▁"
#: Parts of more symbols than this go to the heap.
LONG = 48
#: Short parts that are worked off together: their arrays stay in a processor's cache.
TOGETHER = 10_000
#: Parts, and bytes of them and their ids, of a generation that a Python worker remembers; the one before is kept as well.
REMEMBERED, REMEMBERED_BYTES = 300_000, 48_000_000
_PARTS = re.compile(r" +[^ ]*")
#: Letters, or other characters, and the spaces before them. Raised digits are no letters: "²." is a piece.
#: Possessive, so that a long run leaves nothing to go back to in memory.
_RUNS = re.compile(r" *(?:[^\W\d_¹²³]+|(?:[^\w ]|[\d_¹²³])++)| +")
_LETTER = re.compile(r"[^\W\d_¹²³]")
#: Stands before a part that doesn't begin with a space when the library encodes it, as that would put a space there.
LEAD = "\x01"
_NONE = np.int64(1 << 40)


class Pieces:
    """Encoder and decoder of one model file: merge-type, identity normaliser, byte fallback."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        text = [lib.id_to_piece(i) for i in range(self.size)]
        kinds = np.array([2 if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) else 1 if lib.is_byte(i) else 0 for i in range(self.size)])
        plain = [i for i in range(self.size) if kinds[i] == 0]
        if any(SPACE in text[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece holds a space after its start: parts can't be encoded on their own")
        joins = {pair for i in plain for pair in pairwise(text[i])}
        letter = {c: _LETTER.match(c) is not None for c in set(chain.from_iterable(joins))}
        reach = any(a != SPACE and letter[a] != letter[b] or LEAD in (a, b) for a, b in joins)
        self.cut = _PARTS if reach else _RUNS
        self.lead = len(lib.encode(LEAD))
        probe = "Aé  ①ﬁ́  "
        if lib.decode(lib.encode(probe)) != probe or lib.encode("") != []:
            raise ValueError("the model normalises texts; this encoder takes the identity only")
        self.end = lib.eos_id()
        self.id_text = [str(i) for i in range(self.size)]
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_text = {text[i]: i for i in plain}
        # symbols that aren't pieces get numbers after the pieces, as they may be part of one
        extra = sorted({c for t in self.by_text for c in t} - set(self.by_text))
        self.symbol = {t: i for t, i in self.by_text.items() if len(t) == 1} | {c: self.size + k for k, c in enumerate(extra)}
        known = self.by_text | {c: self.symbol[c] for c in extra}
        self.score = {i: lib.get_score(i) for i in plain}
        made: dict[tuple[int, int], int] = {}
        for t, i in self.by_text.items():
            for cut in range(1, len(t)):
                left, right = known.get(t[:cut]), known.get(t[cut:])
                if left is not None and right is not None:
                    made[left, right] = i
        self.made = made
        levels = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = ranks = {i: levels[s] for i, s in self.score.items()}
        self.wide = self.size + len(extra) + 1  # the last number is that of symbols outside the vocabulary
        self.of_char = np.full(0x110000, self.wide - 1, np.int64)
        for c, i in self.symbol.items():
            self.of_char[ord(c)] = i
        keys = np.array([a * self.wide + b for a, b in made], np.int64)
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        values = list(made.values())
        self.to = np.array([values[k] for k in order] + [0], np.int64)
        self.ranks = np.array([ranks[values[k]] for k in order] + [0], np.int64)
        self.text = text
        self.kinds = kinds
        self.as_bytes = [t.replace(SPACE, " ").encode() if kinds[i] == 0 else b"" for i, t in enumerate(text)]
        for b, i in enumerate(self.byte_id):
            self.as_bytes[i] = bytes([b])
        self.seen: dict[str, tuple[str, str]] = {}
        self.before: dict[str, tuple[str, str]] = {}
        self.held = 0

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part, its spaces written as in the text."""
        out: list = [None] * len(parts)
        short = []
        for i, p in enumerate(parts):
            if len(p) <= LONG:
                short.append(i)
            else:
                out[i] = self._by_heap(p.replace(" ", SPACE))
        short.sort(key=lambda i: len(parts[i]))  # parts of like lengths are done at about the same time
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            for i, ids in zip(some, self._together([parts[i].replace(" ", SPACE) for i in some])):
                out[i] = ids
        return out

    def _finished(self, symbols, chars: str) -> list[int]:
        """Ids of (number, first, last) symbols; those outside the vocabulary become their bytes."""
        ids = []
        for number, a, b in symbols:
            if number < self.size:
                ids.append(number)
            else:
                ids += [self.byte_id[x] for x in chars[a:b].encode()]
        return ids

    def _by_heap(self, chars: str) -> list[int]:
        outside = self.wide - 1
        number = [self.symbol.get(c, outside) for c in chars]
        n = len(chars)
        before, after, stop = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        agenda: list = []

        def enter(a: int) -> None:
            b = after[a]
            if a >= 0 and b < n and (to := self.made.get((number[a], number[b]))) is not None:
                heapq.heappush(agenda, (self.rank[to], a, number[a], number[b], to))

        for a in range(n - 1):
            enter(a)
        while agenda:
            _, a, x, y, to = heapq.heappop(agenda)
            b = after[a]
            if number[a] != x or b >= n or number[b] != y:
                continue  # one of the two has been merged meanwhile
            number[a], number[b], stop[a], after[a] = to, -1, stop[b], after[b]
            if after[b] < n:
                before[after[b]] = a
            if before[a] >= 0:
                enter(before[a])
            enter(a)
        return self._finished(((number[a], a, stop[a]) for a in range(n) if number[a] >= 0), chars)

    def _pairs(self, left: np.ndarray, right: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Rank and product of adjacent symbols, and a last column for the symbol that has no right one."""
        key = left * self.wide + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & valid
        found = np.full((2, len(key) + 1), _NONE, np.int64)
        found[0, :-1][hit], found[1, :-1][hit] = self.ranks[at[hit]], self.to[at[hit]]
        return found

    def _together(self, texts: list[str]) -> list[list[int]]:
        counts = np.array([len(t) for t in texts], np.int64)
        sym = self.of_char[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), counts)
        place = np.arange(len(sym))  # of a symbol's first character
        done_sym, done_place, done_owner = [], [], []
        order, to = self._pairs(sym[:-1], sym[1:], owner[:-1] == owner[1:])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(order, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            where = np.flatnonzero((order == np.repeat(best, lengths)) & (order < _NONE))
            first = where[np.r_[True, owner[where[1:]] != owner[where[:-1]]]] if len(where) else where
            sym[first] = to[first]
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            finished = np.repeat(best == _NONE, lengths)
            if finished.any():
                done_sym.append(sym[finished])
                done_place.append(place[finished])
                done_owner.append(owner[finished])
                keep &= ~finished
            merged = np.zeros(len(sym), bool)
            merged[first] = True
            sym, place, owner, order, to, merged = (x[keep] for x in (sym, place, owner, order, to, merged))
            # only the pairs on either side of a merged symbol are new
            merged[:-1] |= merged[1:]
            new = np.flatnonzero(merged)
            right = np.minimum(new + 1, len(sym) - 1)
            order[new], to[new] = self._pairs(sym[new], sym[right], (owner[new] == owner[right]) & (right > new))[:, : len(new)]
        if not done_sym:
            return [[] for _ in texts]
        s, p, o = (np.concatenate(x) for x in (done_sym, done_place, done_owner))
        order = np.argsort(p, kind="stable")
        s, p, o = s[order], p[order], o[order]
        cuts = np.searchsorted(o, np.arange(len(texts) + 1))
        begin = np.cumsum(counts) - counts
        strange = np.zeros(len(texts), bool)
        strange[o[s >= self.size]] = True
        flat = s.tolist()
        out = []
        for i, t in enumerate(texts):
            ids = flat[cuts[i] : cuts[i + 1]]
            if strange[i]:
                at = (p[cuts[i] : cuts[i + 1]] - begin[i]).tolist()
                ids = self._finished(zip(ids, at, [*at[1:], len(t)]), t)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; without the space that the encoder puts before every text."""
        text = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if self.kinds[i] != 2), None)
        return text[1:] if first is not None and self.text[first].startswith(SPACE) else text

    def parts_of(self, text: str) -> list[str]:
        """The parts of a text, with the space that comes before every text."""
        return self.cut.findall(" " + text.replace(SPACE, " "))

    def learn(self, parts: Iterable[str]) -> None:
        """Encode parts that aren't known yet and check them against the library, both ways."""
        if len(self.seen) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.before, self.seen, self.held = self.seen, {}, 0
        parts = dict.fromkeys(filterfalse(self.seen.__contains__, parts))
        again = [p for p in parts if p in self.before]
        self.seen.update(zip(again, map(self.before.__getitem__, again)))
        parts = [p for p in parts if p not in self.before]
        ids = self.encode_parts(parts)
        # the library puts a space before a text itself, but none before an empty one
        spaced = [p[:1] == " " for p in parts]
        right = self.library.encode([p[1:] if own else LEAD + p for p, own in zip(parts, spaced)], num_threads=1)
        for k, p in enumerate(parts):
            if not spaced[k]:
                right[k] = right[k][self.lead :]
            elif p == " ":
                right[k] = [self.by_text[SPACE]]
        if ids != right:
            bad = next(p for p, a, b in zip(parts, ids, right) if a != b)
            raise AssertionError(f"encoding differs from the library's for {bad[:200]!r}")
        back = [b"".join(map(self.as_bytes.__getitem__, x)).decode("utf-8", "replace") for x in ids]
        # the parts one after another are a text as well: the library decodes them at once
        if back != parts or "".join(back)[bool(parts) and spaced[0] :] != self.library.decode(list(chain.from_iterable(ids))):
            raise AssertionError("decoding differs from the library's")
        for p, x, b in zip(parts, ids, back):
            self.seen[p] = " ".join(map(self.id_text.__getitem__, x)), b
        self.held += sum(len(self.seen[p][0]) + 4 * (len(p) + len(self.seen[p][1])) + 200 for p in (*parts, *again))


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _digests(path: str):
    def run(batches):
        model = pieces(path)
        for batch in small_batches(batches, 2048):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_out, ids_out, text_out = [], [], []
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
                    size += len(texts[end])
                    end += 1
                cut = [model.parts_of(t) if t else [] for t in texts[at:end]]
                model.learn(chain.from_iterable(cut))
                seen = model.seen.__getitem__
                for own in cut:
                    known = list(map(seen, own))
                    line = " ".join([*[k[0] for k in known], model.id_text[model.end]])
                    n_out.append(line.count(" ") + 1)
                    ids_out.append(hashlib.sha256(line.encode()).hexdigest())
                    text_out.append(hashlib.sha256("".join([k[1] for k in known])[1:].encode()).hexdigest())
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_out, pa.int64()), pa.array(ids_out, pa.string()), pa.array(text_out, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _encoded(path: str):
    def run(batches):
        model = pieces(path)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                out.append([i for ids in model.encode_parts(model.parts_of(t) if t else []) for i in ids] + [model.end])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _decoded(path: str):
    def run(batches):
        model = pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else model.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return run


def _typed(df: DataFrame, id_col: str, other: str) -> tuple[DataFrame, str]:
    own = df.select(F.col(id_col).alias("id"), F.col(other).alias("x"))
    return own, own.schema["id"].dataType.simpleString()


def piece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each row: the ids of the whole text and the end id; null and empty texts have the end id only."""
    own, kind = _typed(docs, id_col, text_col)
    return own.mapInArrow(_encoded(model_path), f"id {kind}, ids array<int>")


def piece_decode(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null ids give a null text, no ids an empty one."""
    own, kind = _typed(encoded, id_col, ids_col)
    return own.mapInArrow(_decoded(model_path), f"id {kind}, text string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, end id included.

    Null counts as empty: one token. Ids may be null or repeat; other columns are ignored. Whole texts are
    encoded, long ones in time of about their length. An empty table gives no rows.
    """
    own, kind = _typed(docs, id_col, text_col)
    return own.mapInArrow(_digests(model_path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
