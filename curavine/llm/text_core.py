"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

#: Bytes of text that one vectorised step holds; a longer text is a step of its own.
SLICE_BYTES = 2_000_000
#: Bytes of a long text that are split into words at a time, and words whose hashes a worker remembers.
PIECE_BYTES, KNOWN_WORDS = 1_000_000, 200_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    """Hash of each word met: BLAKE2b cut to 64 bits, so that no one can easily make two words that share it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_words = _Words()


def split(raw: bytes) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order, some at a time; at least one list, which may be empty."""
    at = 0
    while len(raw) - at > PIECE_BYTES and (m := _SPACE.search(raw, at + PIECE_BYTES)):
        yield raw[at : m.start()].split()
        at = m.end()
    yield (raw[at:] if at else raw).split()


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, A-Z lower-cased UTF-8 texts) in steps of bounded size; null counts as empty."""
    start, size, held = 0, 0, []
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass").lower() if t else b""
        if held and size + len(raw) > SLICE_BYTES:
            yield start, held
            start, size, held = i, 0, []
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield start, held


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    own, counts = [], []
    for text in raw:
        n = 0
        for words in split(text):
            own.append(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
            n += len(words)
        counts.append(n)
    return np.concatenate(own) if own else np.zeros(0, np.uint64), np.array(counts, np.int64)


def sequence_digest(text: bytes) -> bytes:
    """A 128-bit digest of the sequence of words."""
    h = hashlib.blake2b(digest_size=16)
    for words in split(text):
        if words:
            h.update(b" ".join(words) + b" ")
    return h.digest()


def _places(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words: shingles each, words left up to the text's end, and where a shingle starts."""
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    at = np.arange(int(counts.sum()))
    left = np.repeat(ends, counts) - at
    return made, left, np.repeat(counts, counts) - left < np.repeat(made, counts)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, repeats included, and their number for each text.

    A text of fewer than k words has its whole sequence as one shingle; without words it has none.
    """
    made, left, starts = _places(counts, k)
    n = len(words)
    with np.errstate(over="ignore"):
        total = np.minimum(np.repeat(counts, counts), k).astype(np.uint64)
        for i in range(min(k, n)):
            more = mix(total[: n - i] * _MULT + words[i:])
            total[: n - i] = more if i == 0 else np.where(left[: n - i] > i, more, total[: n - i])
    return total[starts], made


class _Numbers(dict):
    """Words as numbers from 1 on, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def true_shingles(raw: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text, as numbers that texts of this list share and no hash is part of.

    Words are numbered, then runs of two, three, up to k words: a run is a shorter run and a word, and
    distinct pairs of their numbers are numbered anew.
    """
    numbers = _Numbers()
    parts = [[np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in split(text)] for text in raw]
    counts = np.array([sum(map(len, p)) for p in parts], np.int64)
    words = np.concatenate([w for p in parts for w in p]) if raw else np.zeros(0, np.int64)
    made, left, starts = _places(counts, k)
    name, n = words, len(words)
    for i in range(1, k):
        after = np.zeros(n, np.int64)
        after[: max(n - i, 0)] = np.where(left[: max(n - i, 0)] > i, words[i:], 0)
        name = np.unique(name * (len(numbers) + 1) + after, return_inverse=True)[1]
    values, sizes = distinct(name[starts], made)
    return np.split(values, np.cumsum(sizes)[:-1]) if raw else []


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, one text after another, and their number."""
    if not len(values):
        return values, counts.copy()
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner)) if len(counts) > 1 else np.argsort(values)
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], np.bincount(o[new], minlength=len(counts))
