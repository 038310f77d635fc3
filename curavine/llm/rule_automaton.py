"""Several regular expressions as one deterministic automaton over bytes.

Each rule's expression becomes a nondeterministic automaton. Subset construction runs them all at once: a state
holds, for each rule, the sets of places that are reached from each start still open, the earliest start first.
A rule's match begins at the earliest start that leads to one and takes all that it can; while it grows, no other
start of its rule is followed. Equal states are merged (Moore's partition refinement), and what is left are
transition arrays: the next state for each state and byte, and the rules whose match ends before that byte.

Ends come from one pass over the bytes, whatever the number of rules. A match's start is found from its end by
the rule's reversed automaton, which reads the match backwards.
"""

from __future__ import annotations

import functools
import re
from re import _constants as C
from re import _parser
from typing import NamedTuple

import numpy as np

_MARK = 1 << 40


class Rule(NamedTuple):
    """A kind of match: its expression, whether letters count in either case, and how long its last group is at least.

    After each character that makes a match longer, the match has to be one already (as with a last "+"), so that
    it ends at the first byte that does not fit; expressions without this property are refused.
    """

    kind: str
    pattern: str
    either_case: bool = False
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.encode(), re.I if self.either_case else 0)


class _Nfa:
    """Arcs of a nondeterministic automaton: bytes as the bits of a number, and steps that read nothing."""

    def __init__(self, rule: Rule):
        self.arcs: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.either_case = rule.either_case
        self.start = self._state()
        self.end = self._grow(_parser.parse(rule.pattern.encode()), self.start)

    def _state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def _bytes(self, op, arg) -> int:
        if op is C.LITERAL:
            swapped = bytes([arg]).swapcase()[0] if self.either_case else arg
            return 1 << arg | 1 << swapped
        if op is C.RANGE:
            return sum(1 << b for c in range(arg[0], arg[1] + 1) for b in {c, bytes([c]).swapcase()[0] if self.either_case else c})
        if op is C.IN:
            negated = arg[0][0] is C.NEGATE
            found = 0
            for o, a in arg[negated:]:
                found |= self._bytes(o, a)
            return (1 << 256) - 1 ^ found if negated else found
        raise ValueError(f"{op} in a rule")

    def _grow(self, tree, at: int) -> int:
        for op, arg in tree:
            if op is C.SUBPATTERN:
                at = self._grow(arg[3], at)
            elif op is C.BRANCH:
                end = self._state()
                for way in arg[1]:
                    self.free[self._grow(way, at)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                least, most, what = arg
                for _ in range(least):
                    at = self._grow(what, at)
                if most is C.MAXREPEAT:
                    loop, end = self._state(), self._state()
                    self.free[at] += [loop, end]
                    self.free[self._grow(what, loop)] += [loop, end]
                    at = end
                else:
                    ways = [at]
                    for _ in range(most - least):
                        at = self._grow(what, at)
                        ways.append(at)
                    for way in ways[:-1]:
                        self.free[way].append(at)
            else:
                self.arcs[at].append((self._bytes(op, arg), new := self._state()))
                at = new
        return at

    def closure(self, places) -> frozenset[int]:
        found, left = set(places), list(places)
        while left:
            for p in self.free[left.pop()]:
                if p not in found:
                    found.add(p)
                    left.append(p)
        return frozenset(found)

    def step(self, places, byte: int) -> frozenset[int]:
        return self.closure({to for p in places for mask, to in self.arcs[p] if mask >> byte & 1})

    def reversed(self) -> _Nfa:
        back = object.__new__(_Nfa)
        back.arcs, back.free = [[] for _ in self.arcs], [[] for _ in self.arcs]
        for p, own in enumerate(self.arcs):
            for mask, to in own:
                back.arcs[to].append((mask, p))
        for p, own in enumerate(self.free):
            for to in own:
                back.free[to].append(p)
        back.start, back.end = self.end, self.start
        return back


def _classes(nfas: list[_Nfa]) -> tuple[list[int], list[int]]:
    """The class of each byte, and a byte of each class: bytes that no arc tells apart share one."""
    masks = sorted({mask for n in nfas for own in n.arcs for mask, _ in own})
    known: dict[tuple, int] = {}
    of = [known.setdefault(tuple(m >> b & 1 for m in masks), len(known)) for b in range(256)]
    return of, [of.index(k) for k in range(len(known))]


def _follow(nfa: _Nfa, starts: tuple, byte: int) -> tuple[tuple, bool]:
    """The open starts of a rule after a byte, and whether its match has ended before the byte."""
    growing = bool(starts) and nfa.end in starts[0]
    moved: list[frozenset[int]] = []
    for fresh in (False, True):
        own, met = (starts if growing and not fresh else (*(() if fresh else starts), nfa.closure([nfa.start]))), set()
        for places in own:
            new = nfa.step(places, byte) - met
            met |= new
            if new:
                moved.append(new)
        if moved or not growing:
            break
    ended = growing and fresh
    reached = [k for k, places in enumerate(moved) if nfa.end in places]
    if reached[:1] > [0] or growing and not ended and not reached:
        raise ValueError("a rule's match has to be one again after each further character")
    return tuple(moved[:1] if reached else moved), ended


def _minimal(after: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge states that no input tells apart; state 0 stays the first."""
    block = np.unique(last, return_inverse=True)[1]
    while True:
        seen = np.column_stack([block, block[after], ends])
        new = np.unique(seen, axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    order = np.argsort(np.unique(block, return_index=True)[1])  # blocks in the order of their first states
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    block = place[block]
    firsts = np.unique(block, return_index=True)[1]
    return block[after[firsts]], ends[firsts], last[firsts]


class Automaton:
    """The transition arrays of some rules, and the scan."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfas = [_Nfa(r) for r in rules]
        of, byte_of = _classes(nfas)
        follow = functools.cache(lambda k, own, byte: _follow(nfas[k], own, byte))  # a rule by itself has few states
        begin = tuple(() for _ in rules)
        states, rows, ends = {begin: 0}, [], []
        todo = [begin]
        while todo:
            state = todo.pop()
            row, end = [], []
            for byte in byte_of:
                steps = [follow(k, own, byte) for k, own in enumerate(state)]
                new = tuple(s for s, _ in steps)
                if new not in states:
                    states[new] = len(states)
                    todo.append(new)
                row.append(states[new])
                end.append(sum(1 << k for k, (_, e) in enumerate(steps) if e))
            rows.append((states[state], row))
            ends.append((states[state], end))
        last = [sum(1 << k for k, (n, own) in enumerate(zip(nfas, s)) if own and n.end in own[0]) for s in states]
        self.built = len(states)
        after, end, self.last = _minimal(np.array([r for _, r in sorted(rows)]), np.array([e for _, e in sorted(ends)]), np.array(last))
        self.states = len(after)
        # next state times 256, and above a mark the rules whose match ends before the byte
        self.table = (after * 256 + end * _MARK)[:, of].reshape(-1).tolist()
        self.back = [self._backward(n.reversed()) for n in nfas]
        self.compiled = [r.compiled() for r in rules]

    @staticmethod
    def _backward(nfa: _Nfa) -> tuple[list[list[int]], list[bool]]:
        """Transitions of a reversed rule (-1: none), and the states at which its match may start."""
        begin = nfa.closure([nfa.start])
        states, rows, todo = {begin: 0}, {}, [begin]
        while todo:
            places = todo.pop()
            row = []
            for byte in range(256):
                new = nfa.step(places, byte)
                if new and new not in states:
                    states[new] = len(states)
                    todo.append(new)
                row.append(states[new] if new else -1)
            rows[states[places]] = row
        return [rows[k] for k in range(len(states))], [nfa.end in s for s in states]

    def _ends(self, raw: bytes):
        """(rule, end) of all matches, in the order of their ends: the one pass over the bytes."""
        table, s = self.table, 0
        for at, byte in enumerate(raw):
            s = table[s + byte]
            if s >= _MARK:
                which, s = divmod(s, _MARK)
                for k in range(which.bit_length()):
                    if which >> k & 1:
                        yield k, at
        which = int(self.last[s // 256])
        for k in range(which.bit_length()):
            if which >> k & 1:
                yield k, len(raw)

    def scan(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by start and then rule: leftmost longest matches, without overlaps within a rule.

        Matches whose last group is too short are left out, but what they took is not looked at again.
        """
        found, before = [], [0] * len(self.rules)
        for k, end in self._ends(raw):
            rows, starts = self.back[k]
            s, at, start = 0, end, -1
            while at > before[k] and (s := rows[s][raw[at - 1]]) >= 0:
                at -= 1
                if starts[s]:
                    start = at
            m = self.compiled[k].fullmatch(raw, start, end) if start >= 0 else None
            if m is None:
                raise AssertionError("the automaton and its rule disagree")
            before[k] = end
            if m.lastindex is None or m.end(m.lastindex) - m.start(m.lastindex) >= self.rules[k].least:
                found.append((k, start, end))
        return sorted(found, key=lambda f: (f[1], f[0]))
