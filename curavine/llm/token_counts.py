"""Token counts that follow edits, by segment trees over pre-tokens.

A text is cut into leaves, runs of whole pre-tokens, where the tokenizer's pre-tokens cannot reach across:
before a space that something other than white space follows. A tree over the leaves keeps the characters
and tokens of every subtree. An edit finds its leaves by the characters' sums; only their new text is
encoded again, with the leaf before it where the edit made the start of a leaf unsafe, and the sums on the
way to the root are brought up to date.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import token_ids

#: Characters of a leaf, about; a longer stretch without a safe place to cut is one leaf.
LEAF_CHARS = 400
_SAFE = re.compile(r" (?=\S)")
_DIGITS = re.compile(r"\d{7,}")


def cut(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Leaves of a text; all but the first start with a space before a character that is none."""
    out, at = [], 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class TokenTree:
    """A document's leaves and the sums of their characters and tokens, as a heap-ordered binary tree."""

    def __init__(self, text: str, count, leaf_chars: int = LEAF_CHARS):
        self.count, self.leaf_chars = count, leaf_chars
        #: Characters that edits have had encoded again.
        self.encoded = 0
        self._build(cut(text, leaf_chars))

    def _build(self, leaves: list[str], known: dict[int, int] | None = None) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(leaves):
            self.chars[self.width + k] = len(leaf)
            self.tokens[self.width + k] = known[k] if known and k in known else self.count(leaf)
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds a character position, or ends at it, and the position within."""
        k = 1
        while k < self.width:
            k *= 2
            if pos > self.chars[k] or (pos == self.chars[k] and self.chars[k + 1]):
                pos -= self.chars[k]
                k += 1
        return min(k - self.width, len(self.leaves) - 1), pos

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replace delete characters from pos on; both are cut to the text's ends."""
        pos = max(0, min(pos, self.n_chars))
        delete = max(0, min(delete, self.n_chars - pos))
        first, offset = self._find(pos)
        last = self._find(pos + delete)[0] if delete else first
        old = "".join(self.leaves[first : last + 1])
        new = old[:offset] + insert + old[offset + delete :]
        # an emptied leaf is no boundary, so what came before it is looked at again as well
        while first > 0 and not _SAFE.match(new):
            first -= 1
            new = self.leaves[first] + new
        parts = cut(new, self.leaf_chars)
        self.encoded += len(new)
        room = last - first + 1
        if len(parts) > room or len(new) > 8 * room * self.leaf_chars:
            # more leaves than places: the tree is laid out anew, with the counts that are known
            counts = [self.tokens[self.width + k] for k in range(len(self.leaves))]
            counts[first : last + 1] = [self.count(p) for p in parts]
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :], dict(enumerate(counts)))
            return
        for k, part in enumerate(parts + [""] * (room - len(parts)), first):
            self.leaves[k] = part
            self.chars[self.width + k] = len(part)
            self.tokens[self.width + k] = self.count(part) if part else 0
        low, high = self.width + first, self.width + last
        while low > 1:
            low, high = low // 2, high // 2
            for k in range(low, high + 1):
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits (position, characters, replacement) that mask e-mail addresses and runs of seven digits or more.

    They come from the end of the text to its start, so that each one's position holds when it is made.
    """
    spans, at = [], text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in ".-_"):
            b += 1
        if a < at and "." in text[at:b]:
            spans.append((a, b, "<mail>"))
        at = text.find("@", b)
    masked, k = [(s[0], s[1]) for s in spans], 0
    for m in _DIGITS.finditer(text):
        while k < len(masked) and masked[k][1] <= m.start():  # starts and ends of addresses both grow
            k += 1
        if k == len(masked) or masked[k][0] >= m.end():
            spans.append((m.start(), m.end(), "<number>"))
    return [(a, b - a, to) for a, b, to in sorted(spans, reverse=True)]


def _counted(path: str, leaf_chars: int):
    def run(batches):
        count = lambda t: len(token_ids(path, t)) if t else 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                tree = TokenTree(text or "", count, leaf_chars)
                before, leaves = tree.n_tokens, len(tree.leaves)
                edits = redactions(text or "")
                for e in edits:
                    tree.edit(*e)
                for c, v in zip(cols, (before, leaves, len(edits), tree.n_tokens, tree.n_chars, tree.encoded)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_tokens", "n_leaves", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Token counts before and after redactions: one row per row of docs.

    Returns doc_id, n_tokens, n_leaves, n_edits, n_tokens_edited, n_chars_edited and n_chars_encoded, the
    characters that the edits had encoded again. Null counts as empty, which has one empty leaf and no
    tokens. Ids may be null or repeat; other columns are ignored. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(
        _counted(tokenizer_path, leaf_chars),
        f"doc_id {kind}, n_tokens long, n_leaves long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long",
    )


def edited_counts(docs: DataFrame, edits: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, text) after given edits (doc_id, seq, pos, delete, insert), by seq.

    Edits of unknown documents are left out, documents without edits keep their count; a null number counts
    as 0 and a null insert as empty. Edits with equal seq are made in the order of (pos, delete, insert). A
    document's edits are brought together, as each depends on those before; ids should be unique.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    each = F.struct(*(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("seq", "pos", "delete")), F.coalesce(F.col("insert").cast("string"), F.lit("")).alias("insert"))
    lists = edits.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(each)).alias("edits"))
    both = own.join(lists, "doc_id", "left").select("doc_id", "t", "edits")

    def run(batches):
        count = lambda t: len(token_ids(tokenizer_path, t)) if t else 0
        for batch in batches:
            before, after, texts = [], [], []
            for text, own_edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = TokenTree(text or "", count, leaf_chars)
                before.append(tree.n_tokens)
                for e in own_edits or []:
                    tree.edit(e["pos"], e["delete"], e["insert"])
                after.append(tree.n_tokens)
                texts.append(tree.text())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int64()), pa.array(after, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "n_tokens_edited", "text"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_tokens_edited long, text string")
