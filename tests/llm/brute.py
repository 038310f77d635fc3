"""Plain Python versions of the operators' results."""

import re
from collections import Counter, defaultdict
from math import log10
from zlib import crc32


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(docs, percent):
    sets = {i: shingle_set(t) for i, t in docs.items()}
    by_shingle = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].add(i)
    links, done = [], set()
    for i, s in sets.items():
        shared = Counter(j for x in s for j in by_shingle[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    return components(list(docs), links)


class Backoff:
    """Counts of a training corpus and the smoothed probabilities of words after a history."""

    def __init__(self, docs, discount, least):
        self.c, self.after, self.discount, self.least = Counter(), defaultdict(Counter), discount, least
        self.text = {i: [*words(t), None] for i, t in docs}
        for i, _ in docs:
            if crc32(("" if i is None else str(i)).encode()) % 7 != 2:
                self.c.update(self.text[i])
                own = ["start", *self.text[i]]
                for k in range(1, len(own)):
                    self.after[own[k - 1],][own[k]] += 1
                    if k > 1:
                        self.after[own[k - 2], own[k - 1]][own[k]] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)

    def p(self, w, h=()):
        if not h:
            return (self.c[w] + 1) / (self.n + self.v + 1)
        seen = self.after.get(h, {})
        total = sum(seen.values())
        if total < self.least:
            return self.p(w, h[1:])
        return max(seen.get(w, 0) - self.discount, 0) / total + self.discount * len(seen) / total * self.p(w, h[1:])


def lm(docs, discount, least):
    m = Backoff(docs, discount, least)
    out = {}
    for i, own in m.text.items():
        base = sum(log10(m.p(w)) for w in own)
        score = sum(log10(m.p(w, tuple(["start", *own][max(0, k - 1) : k + 1]))) for k, w in enumerate(own))
        out[i] = (len(own), sum(m.c[w] > 0 for w in own), m.n, base, score)
    return out
