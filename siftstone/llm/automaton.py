"""Byte automata from regular expressions: parse, subset construction, minimisation, transition arrays.

The language is the regular part of the usual syntax: literals, ``\\xHH`` and escaped punctuation, ``[...]``
and ``[^...]`` over bytes, groups, ``|``, ``? * + {m} {m,} {m,n}`` and ``(?i:...)`` for ASCII letters in either case.
Matches are leftmost-longest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))


class _Reader:
    """Recursive descent over a pattern; nodes are ("set", bytes), ("cat", nodes), ("alt", nodes), ("rep", node, least, most)."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self):
        return self.pattern[self.at] if self.at < len(self.pattern) else None

    def take(self):
        self.at += 1
        return self.pattern[self.at - 1]

    def choice(self, fold=False):
        options = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence(fold))
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self, fold):
        parts = []
        while self.peek() not in (None, "|", ")"):
            parts.append(self.repeated(self.atom(fold)))
        return ("cat", parts)

    def repeated(self, node):
        while self.peek() in ("?", "*", "+", "{"):
            mark = self.take()
            if mark == "{":
                end = self.pattern.index("}", self.at)
                low, comma, high = self.pattern[self.at : end].partition(",")
                self.at = end + 1
                node = ("rep", node, int(low), int(high) if high else (None if comma else int(low)))
            else:
                node = ("rep", node, int(mark == "+"), 1 if mark == "?" else None)
        return node

    def atom(self, fold):
        c = self.take()
        if c == "(":
            for prefix, value in (("?:", fold), ("?i:", True)):
                if self.pattern.startswith(prefix, self.at):
                    self.at += len(prefix)
                    fold = value
                    break
            node = self.choice(fold)
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.pattern!r}")
            return node
        if c == "[":
            return ("set", self.members(fold))
        if c == ".":
            return ("set", ANY - {10})
        return ("set", self.either(self.byte(c), fold))

    def byte(self, c):
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.pattern[self.at - 2 : self.at], 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} is not supported")
        if ord(c) > 127:
            raise ValueError("patterns are ASCII; write bytes as \\xHH")
        return ord(c)

    def either(self, b, fold):
        letter = chr(b)
        return frozenset({ord(letter.lower()), ord(letter.upper())}) if fold and letter.isascii() and letter.isalpha() else frozenset({b})

    def members(self, fold):
        negated, found, first = self.peek() == "^", set(), True
        if negated:
            self.take()
        while first or self.peek() != "]":
            first = False
            low = self.byte(self.take())
            high = low
            if self.peek() == "-" and self.pattern[self.at + 1] != "]":
                self.take()
                high = self.byte(self.take())
            for b in range(low, high + 1):
                found |= self.either(b, fold)
        self.take()
        return ANY - found if negated else frozenset(found)


def parse(pattern: str):
    reader = _Reader(pattern)
    node = reader.choice()
    if reader.peek() is not None:
        raise ValueError(f"unbalanced group in {pattern!r}")
    return node


def backwards(node):
    """The expression of the reversed strings."""
    kind = node[0]
    if kind == "cat":
        return ("cat", [backwards(n) for n in reversed(node[1])])
    if kind == "alt":
        return ("alt", [backwards(n) for n in node[1]])
    return ("rep", backwards(node[1]), *node[2:]) if kind == "rep" else node


class _Nfa:
    def __init__(self):
        self.empty, self.moves, self.accepts = [], [], {}

    def state(self):
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start):
        """Appends ``node`` behind ``start``; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for option in node[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(option, own)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, states):
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """A minimal deterministic automaton: ``table[state, class]``, byte to class, and the rules each state accepts (bits)."""

    table: np.ndarray
    classes: bytes
    accepts: np.ndarray
    dead: int  # the state without way to an accepting one, or -1

    def rows(self) -> list[list]:
        """Linked rows for a fast byte loop: ``row[class]`` is the next row, ``row[-2]`` its rules, ``row[-1]`` whether it is dead."""
        rows = [[None] * self.table.shape[1] + [int(a), i == self.dead] for i, a in enumerate(self.accepts)]
        for row, targets in zip(rows, self.table.tolist()):
            row[: len(targets)] = [rows[t] for t in targets]
        return rows


def compile_rules(nodes: list, anywhere: bool) -> Automaton:
    """One automaton for all expressions; rule i sets bit i. ``anywhere``: a match may begin at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    for i, node in enumerate(nodes):
        own = nfa.state()
        nfa.empty[start].append(own)
        nfa.accepts[nfa.add(node, own)] = 1 << i
    classes, samples = _byte_classes([s for moves in nfa.moves for s, _ in moves])
    first = nfa.closure([start])
    numbers, order, table = {first: 0}, [first], []
    for states in order:  # grows while it runs
        row = []
        for b in samples:
            reached = nfa.closure([to for s in states for members, to in nfa.moves[s] if b in members])
            reached = reached | first if anywhere else reached
            if reached not in numbers:
                numbers[reached] = len(order)
                order.append(reached)
            row.append(numbers[reached])
        table.append(row)
    accepts = np.array([sum(nfa.accepts.get(s, 0) for s in states) for states in order], np.int64)
    return _minimal(np.array(table, np.int64), classes, accepts)


def _byte_classes(sets) -> tuple[bytes, list[int]]:
    """Bytes that no set tells apart share a class; returns byte to class and one byte of each class."""
    distinct = sorted(set(sets), key=sorted)
    names: dict[tuple, int] = {}
    classes = bytes(names.setdefault(tuple(b in s for s in distinct), len(names)) for b in range(256))
    return classes, [classes.index(c) for c in range(len(names))]


def _minimal(table, classes, accepts) -> Automaton:
    """Moore's refinement: states stay together while they accept the same rules and lead to the same groups."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    # state 0 stays the start
    order = np.argsort(np.unique(group, return_index=True)[1], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    group = rank[group]
    sample = np.unique(group, return_index=True)[1]
    small, bits = group[table[sample]], accepts[sample]
    dead = np.flatnonzero((small == np.arange(len(small))[:, None]).all(1) & (bits == 0))
    return Automaton(small, classes, bits, int(dead[0]) if len(dead) else -1)
