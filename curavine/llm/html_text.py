"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks of text, in page order. A block is seen as its hashed tag path (names,
class and id words of the open elements), its hashed words and a few sizes. A bidirectional LSTM reads a
page's blocks in both directions and labels each as article or not, with the whole page as context. It is
trained here, on invented pages of many layouts.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_core as tc

PATH_FEATURES, WORD_FEATURES, SIZES = 384, 32, 6
INPUTS = PATH_FEATURES + WORD_FEATURES + SIZES
HIDDEN = 24
TRAIN_PAGES, EPOCHS, BATCH = 3000, 8, 16
#: Blocks, padding included, that are labelled at once.
CELLS = 40_000
#: Blocks of a long page whose inputs are held at a time.
STRETCH = 8192
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?", re.S)
_NAMED = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
#: Fixed values of HTML: elements whose content isn't markup, those without content, those within a line.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: An opening tag ends the elements of these names that are open within the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}


def _bit(word: str) -> int:
    return 1 << zlib.crc32(word.encode()) % PATH_FEATURES


@functools.lru_cache(maxsize=100_000)
def _element(name: str, attributes: str) -> tuple[str, int, str | None]:
    """An opening tag's name, the features of its name and of its class and id words as bits, and its label."""
    mask, label = _bit(name), None
    for key, *values in _NAMED.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() == "data-y":
            label = value
        else:
            for w in _WORD.findall(value.lower()):
                mask |= _bit(f"{key.lower()}:{w}" if key.lower() == "role" else f".{w}")
    return name, mask, label


class Block:
    """A leaf block: its text, features of all elements that it lies in as bits, the innermost one's name, linked characters."""

    __slots__ = ("label", "leaf", "linked", "path", "text")

    def __init__(self, text: str, path: int, leaf: str, linked: int, label: str | None):
        self.text, self.path, self.leaf, self.linked, self.label = text, path, leaf, linked, label


class _Open:
    """The open elements. Each carries the features of all around it, so that depth costs nothing; where the
    elements of a name are is known, so that no tag looks through the others."""

    def __init__(self):
        self.stack: list[tuple[str, int, str | None]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of the elements that aren't inline

    def push(self, name: str, mask: int, label: str | None) -> None:
        _, around, outer = self.stack[-1] if self.stack else ("", 0, None)
        self.at[name].append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, mask | around, outer if label is None else label))

    def drop(self, k: int) -> None:
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def last(self, names) -> int:
        """The place of the innermost element of these names, or -1."""
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def first_after(self, names, k: int) -> int | None:
        """The outermost element of these names within the one at k."""
        found = [own[i] for n in names if (i := bisect_right(own := self.at[n], k)) < len(own)]
        return min(found, default=None)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page: white space made one space, character references decoded, none empty.

    Time grows with the page's length, however deep its elements are nested.
    """
    page = page or ""
    made: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    linked = at = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                leaf, path, label = open_.stack[-1] if open_.stack else ("", 0, None)
                made.append(Block(text, path, leaf, linked, label))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if open_.at["a"]:
                linked += len(text)

    lower = None
    pos, size = 0, len(page)
    while pos < size:
        m = _TAG.search(page, pos)
        if m is None:
            break
        take(page[at : m.start()])
        at = pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        closing = m[1] or m[4]
        if closing:
            if name in VOID or name in RAW:
                continue
            if open_.at[name]:
                if name not in INLINE:
                    end_block()
                    open_.drop(open_.at[name][-1])
                # an inline element ends within its block only, with those opened in it
                elif open_.at[name][-1] > (open_.blocks[-1] if open_.blocks else -1):
                    open_.drop(open_.at[name][-1])
            elif name not in INLINE:
                end_block()
            continue
        if name in RAW:
            lower = page.lower() if lower is None or len(lower) != size else lower
            end = (lower if len(lower) == size else page).find("</" + name, at)
            at = pos = size if end < 0 else end
            continue
        if name not in INLINE:
            end_block()
            # a paragraph ends where a block begins, with the inline elements left open in it
            if open_.blocks and open_.stack[open_.blocks[-1]][0] == "p" and name != "br":
                open_.drop(open_.blocks[-1])
            own, limit = CLOSES.get(name, ((), ()))
            first = open_.first_after(own, open_.last(limit))
            if first is not None:
                open_.drop(first)
        if name not in VOID:
            open_.push(*_element(name, m[3] if m[3] is not None else m[6] or ""))
    take(page[at:])
    end_block()
    return made


@functools.lru_cache(maxsize=50_000)
def _path_vector(path: int, leaf: str) -> np.ndarray:
    bits = path | (_bit("leaf " + leaf) if leaf else 0)
    return np.unpackbits(np.frombuffer(bits.to_bytes(PATH_FEATURES // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


def inputs(pages: list[list[Block]], begin: int = 0, total: int = 0) -> np.ndarray:
    """One row of features for each block of the pages, one page after another.

    With a total, the blocks are a stretch of a longer page of so many, which begins at a place in it.
    """
    own = [b for p in pages for b in p]
    x = np.zeros((len(own), INPUTS), np.float32)
    if not own:
        return x
    x[:, :PATH_FEATURES] = np.stack([_path_vector(b.path, b.leaf) for b in own])
    n_words = []
    at = 0
    for _, raw in tc.slices([b.text for b in own]):
        hashes, counts = tc.word_hashes(raw)
        cell = np.repeat(np.arange(len(counts)), counts) * WORD_FEATURES + (hashes % np.uint64(WORD_FEATURES)).astype(np.int64)
        bag = np.bincount(cell, minlength=len(counts) * WORD_FEATURES).reshape(-1, WORD_FEATURES)
        x[at : at + len(counts), PATH_FEATURES : PATH_FEATURES + WORD_FEATURES] = np.minimum(bag, 3) / np.sqrt(np.maximum(counts, 1))[:, None]
        n_words.append(counts)
        at += len(counts)
    words = np.concatenate(n_words)
    place = np.concatenate([(begin + np.arange(len(p))) / max(total or len(p), 1) for p in pages])
    chars = np.array([len(b.text) for b in own])
    sizes = (np.log1p(words) / 4, np.log1p(chars) / 6, np.array([b.linked for b in own]) / np.maximum(chars, 1), place, 1 - place, np.array([b.text[-1] in ".!?:;\"'»”" for b in own]))
    x[:, -SIZES:] = np.stack([s.astype(np.float32) for s in sizes], axis=1)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p["W" + d], self.p["U" + d] = draw(INPUTS, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # gates open: what was read is kept at first
            self.p["b" + d] = bias
        self.p["V"], self.p["c"] = draw(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states (T, B, H) of one direction, what gradients need, and the last state; padding leaves the state as it is."""
        steps, batch, _ = x.shape
        h, c = state or (np.zeros((batch, HIDDEN), np.float32),) * 2
        a = x @ self.p["W" + d] + self.p["b" + d]
        out, memo = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = a[t] + h @ self.p["U" + d]
            i, f, o, z = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * z
            s = np.tanh(c_new)
            if keep:
                memo.append((t, i, f, o, z, c, s, h))
            c, h = np.where(m, c_new, c), np.where(m, o * s, h)
            out[t] = h
        return out, memo, (h, c)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return h @ self.p["V"] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        h = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        error = np.where(mask, _sigmoid(h @ self.p["V"] + self.p["c"]) - y, 0).astype(np.float32) / mask.sum()
        g = {"V": np.einsum("tbh,tb->h", h, error), "c": np.array([error.sum()], np.float32)}
        for k, d in enumerate("fb"):
            into = error[:, :, None] * self.p["V"][k * HIDDEN : (k + 1) * HIDDEN]
            da = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            du = np.zeros_like(self.p["U" + d])
            for t, i, f, o, z, c, s, before in reversed(runs[d][1]):
                m = mask[t][:, None]
                dh = dh + into[t]
                own, dct = np.where(m, dh, 0), np.where(m, dc, 0)
                dct = dct + own * o * (1 - s * s)
                da[t] = np.concatenate([dct * z * i * (1 - i), dct * c * f * (1 - f), own * s * o * (1 - o), dct * i * (1 - z * z)], axis=1)
                du += before.T @ da[t]
                dh = da[t] @ self.p["U" + d].T + np.where(m, 0, dh)
                dc = dct * f + np.where(m, 0, dc)
            flat = da.reshape(-1, 4 * HIDDEN)
            g |= {"W" + d: x.reshape(-1, INPUTS).T @ flat, "U" + d: du, "b" + d: flat.sum(axis=0)}
        return g

    def stretched(self, page: list[Block]) -> np.ndarray:
        """Scores of a long page's blocks, a stretch at a time in each direction, with the state carried on: no more than a stretch's inputs are held."""
        score = np.full(len(page), self.p["c"][0], np.float32)
        for k, d in enumerate("fb"):
            own, state = self.p["V"][k * HIDDEN : (k + 1) * HIDDEN], None
            starts = range(0, len(page), STRETCH)
            for a in starts if d == "f" else reversed(starts):
                part = page[a : a + STRETCH]
                out, _, state = self._run(inputs([part], a, len(page))[:, None], np.ones((len(part), 1), bool), d, False, state)
                score[a : a + STRETCH] += out[:, 0] @ own
        return score

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is of the article; pages of like length go together, long ones by stretches."""
        lengths = np.array([len(p) for p in pages])
        found: list = [np.zeros(0, bool)] * len(pages)
        order = [int(k) for k in np.argsort(lengths, kind="stable") if lengths[k]]
        while order:
            group, top = [], 0
            if lengths[order[0]] > STRETCH:
                found[order[0]] = self.stretched(pages[order[0]]) > 0
                order.pop(0)
                continue
            while order and len(group) < 256 and (not group or (len(group) + 1) * lengths[order[0]] <= CELLS):
                group.append(order.pop(0))
                top = int(lengths[group[-1]])
            x = inputs([pages[k] for k in group])
            inp, mask = padded(np.split(x, np.cumsum(lengths[group])[:-1]), top)
            score = self.scores(inp, mask)
            for b, k in enumerate(group):
                found[k] = score[: lengths[k], b] > 0
        return found


def padded(rows: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((top, len(rows), rows[0].shape[1]), np.float32), np.zeros((top, len(rows)), bool)
    for b, r in enumerate(rows):
        x[: len(r), b], mask[: len(r), b] = r, True
    return x, mask


#: Words that class and id names are made of, for the invented pages; the labeller sees them hashed.
CONTENT_NAMES = "content article post entry story body text main entry-content post-body article-body page-content post-content story-body article__body".split()
NEUTRAL_NAMES = "wrap wrapper container row col inner page site layout block section grid box c1 x7 left center module region view".split()
OUTSIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-menu topnav links toc", "header": "header masthead topbar site-header logo branding site-title top",
    "footer": "footer site-footer copyright bottom colophon legal footer-links", "aside": "sidebar aside widget related recommended trending popular more-stories rail recent side",
    "div": "ad ads advert advertisement sponsor sponsored promo banner adsbygoogle cookie cookies consent notice gdpr alert popup modal newsletter subscribe share social sharing tags pagination cookie-notice cookie-banner site-notice ad-slot",
    "form": "search login signup subscribe form newsletter contact search-form", "section": "comments comment reply discussion responses disqus commentlist comment-list user-comments",
}
SMALL = {
    "div": "Advertisement|We use cookies to improve this site. Accept|Subscribe to our newsletter|Share this|Sponsored content|This site uses cookies|Sign up now",
    "form": "Search|Log in|Your e-mail|Subscribe|Send|Password", "footer": "© {w} · All rights reserved|Privacy|Terms of use|Contact|Imprint|© {w}",
    "section": "Comments|Reply|{w} says:|Leave a comment|Posted by {w}", "aside": "Related|Most read|You may also like", "header": "{w}|Home|Welcome to {w}", "nav": "Home|News|About|Contact|{w}",
}


class _Writer:
    """Invents pages; elements carry their label in an attribute that the features leave out."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouäéó") for _ in range(self.r.randint(1, 2))) for _ in range(120)]

    def words(self, n: int) -> str:
        r = self.r
        out = " ".join("".join(r.choice(self.syllables) for _ in range(r.randint(1, 3))) for _ in range(n))
        return out.capitalize() + r.choice([".", ".", ".", "", "!", "?"])

    def prose(self) -> str:
        n = self.r.choice([1, 2, 4, 8, 15, 30, 60])
        text = self.words(self.r.randint(n, 2 * n))
        if self.r.random() < 0.25:
            text = f"{text} <{(t := self.r.choice(['a href=x', 'b', 'em', 'span', 'code']))}>{self.words(2)}</{t.split()[0]}> {self.words(3)}"
        return text

    def named(self, name: str, p: float = 0.5) -> str:
        return f' {self.r.choice(["class", "class", "id"])}="{name}"' if self.r.random() < p else ""

    def outside(self, kind: str | None = None) -> str:
        r = self.r
        kind = kind or r.choice(list(OUTSIDE))
        name = r.choice(OUTSIDE[kind].split())
        plain = kind in ("div", "section") or r.random() < 0.35
        tag = r.choice(["div", "section", "div", "ul"] if kind == "nav" else ["div", "section", "div"]) if plain else kind
        if plain and kind == "section" and r.random() < 0.3:
            tag = "ol"
        attr = self.named(name, 1.0) if plain else self.named(name, 0.5)
        fill = lambda: r.choice(SMALL[kind].split("|")).replace("{w}", self.words(2)) if r.random() < 0.4 else self.words(r.randint(1, 9))
        n = r.randint(1, 7)
        if kind == "nav" or (kind in ("footer", "aside") and r.random() < 0.5):
            inner = "".join(f"<li><a href=x>{fill()}</a></li>" for _ in range(n))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "section":
            inner = (f"<h2>{fill()}</h2>" if r.random() < 0.6 else "") + "".join(
                f'<{(t := r.choice(["div", "article", "li"]))}{self.named("comment", 0.7)}><p>{self.prose()}</p></{t}>' for _ in range(n)
            )
        elif kind == "form":
            inner = f"<label>{fill()}</label><input name=q><button>{fill()}</button>" + (f"<p>{fill()}</p>" if r.random() < 0.5 else "")
        else:
            wrap = lambda: r.choice(["<p>{}</p>", "<div>{}</div>", "{}<br>", "<span>{}</span>", "<h3>{}</h3>", "<a href=x>{}</a>"])
            inner = "".join(wrap().format(self.prose() if r.random() < 0.3 else fill()) for _ in range(r.randint(1, 4)))
        return f'<{tag}{attr} data-y="0">{inner}</{tag}>'

    def inside(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><i>{}</i></p>", "<div>{}</div>"]).format(self.prose())
        if kind < 0.72:
            return f"<h{(k := r.randint(2, 4))}>{self.words(r.randint(1, 7))}</h{k}>"
        if kind < 0.80:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{self.prose()}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>"
        if kind < 0.86:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if kind < 0.90:
            return "<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(3)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if kind < 0.94:
            return f"<figure><img src=x><figcaption>{self.words(6)}</figcaption></figure>"
        if kind < 0.96:
            return f"<pre>{self.words(9)}</pre>"
        return f'<div class="{r.choice(NEUTRAL_NAMES)}"><p>{self.prose()}</p></div>'

    def page(self) -> str:
        r = self.r
        body = [f"<h1>{self.words(r.randint(1, 12))}</h1>"] if r.random() < 0.85 else []
        if body and r.random() < 0.2:
            body = [f"<header>{body[0]}</header>"]
        for _ in range(r.choice([0, 1, 2, 4, 8, 16, 30])):
            body.append(self.inside())
            if r.random() < 0.07:
                body.append(self.outside(r.choice(["div", "aside", "form", "div"])))
        if r.random() < 0.12:
            body.append(self.outside("section"))
        form = r.random()
        if form < 0.5:
            core = f'<article{self.named(r.choice(CONTENT_NAMES), 0.4)} data-y="1">{"".join(body)}</article>'
        elif form < 0.65:
            core = f'<main data-y="1">{"".join(body)}</main>'
        else:
            t = r.choice(["div", "section", "td", "div"])
            core = f'<{t} {r.choice(["class", "id"])}="{r.choice(CONTENT_NAMES)}" data-y="1">{"".join(body)}</{t}>'
        if r.random() < 0.25:
            core = f"<main>{core}</main>"
        pick = lambda kinds, p: [self.outside(k) for k in kinds if r.random() < p]
        before, after = pick(["header", "nav", "div", "form", "div"], 0.45), pick(["aside", "section", "div", "footer", "div", "form"], 0.4)
        r.shuffle(before)
        parts = [*before, core, *after]
        for _ in range(r.choice([0, 0, 1, 2])):
            a = r.randint(0, len(parts) - 1)
            b = r.randint(a + 1, len(parts))
            parts[a:b] = [f'<div class="{r.choice(NEUTRAL_NAMES)}">{"".join(parts[a:b])}</div>']
        return f"<html><head><title>{self.words(3)}</title></head><body>{''.join(parts)}</body></html>"


@functools.cache
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """A labeller fitted with Adam on invented pages; the same on every call."""
    model, writer, rng = Labeller(seed), _Writer(seed), np.random.default_rng(seed)
    examples = []
    for _ in range(pages):
        own = blocks(writer.page())
        if own:
            examples.append((inputs([own]), np.array([b.label == "1" for b in own], np.float32)))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, last = 0, epochs * (len(examples) // BATCH)
    for _ in range(epochs):
        # batches of like lengths waste little on padding; their order is drawn anew each time
        order = sorted(range(len(examples)), key=lambda k: len(examples[k][1]) + rng.random() * 6)
        groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            chosen = [examples[k] for k in groups[g]]
            top = max(len(y) for _, y in chosen)
            x, mask = padded([e[0] for e in chosen], top)
            y = padded([e[1][:, None] for e in chosen], top)[0][:, :, 0]
            step += 1
            rate = 0.012 * min(1.0, 1.2 - step / max(last, 1))
            for k, d in model.gradients(x, mask, y).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.99 * s[k] + 0.01 * d * d
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """The article's blocks of each page, one to a line."""
    own = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, y in zip(p, label) if y) for p, label in zip(own, model.label(own))]


def _extracted(model: Labeller):
    def run(batches):
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            texts, at = [], 0
            while at < len(htmls):
                end, size = at, 0
                while end < len(htmls) and end - at < 1024 and (end == at or size < 4_000_000):
                    size += len(htmls[end] or "")
                    end += 1
                texts += main_texts(htmls[at:end], model)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages, and those without an article, have an empty text. Ids and URLs may be null or
    repeat; other columns are ignored. Pages of any length are read whole. An empty table gives no rows.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = [own.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return own.mapInArrow(_extracted(model or trained()), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
