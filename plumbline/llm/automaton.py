"""Regular expressions over bytes to one minimal deterministic automaton.

The syntax taken: literals, classes with ranges, groups, |, * + ? {m} {m,} {m,n} and \\xHH or escaped characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Recursive descent to a tree of ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, low, high)."""

    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def tree(self):
        node = self.alt()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return node

    def alt(self):
        parts = [self.cat()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "*+?{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def folded(self, chars: set[int]):
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}
        return ("set", frozenset(chars))

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            node = self.alt()
            if self.p[self.i : self.i + 1] != ")":
                raise ValueError("unclosed group")
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            chars: set[int] = set()
            while self.p[self.i] != "]":
                a = self.char()
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    chars |= set(range(a, self.char() + 1))
                else:
                    chars.add(a)
            self.i += 1
            return self.folded(chars)
        return self.folded({self.char()})


def _reversed(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if kind == "rep" else node


def _shortest(node):
    """Ends with the fewest turns of a closing repetition: it occurs where node does, and its first end is the same."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], _shortest(node[1][-1])])
    return ("rep", node[1], node[2], node[2]) if node[0] == "rep" and node[2] else node


class _Nfa:
    def __init__(self):
        self.free: list[set[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append(set())
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, a: int) -> int:
        """Lay node behind state a; the state where it ends."""
        kind = node[0]
        if kind == "set":
            b = self.state()
            self.moves[a].append((node[1], b))
            return b
        if kind == "cat":
            for x in node[1]:
                a = self.add(x, a)
            return a
        if kind == "alt":
            b = self.state()
            for x in node[1]:
                s = self.state()
                self.free[a].add(s)
                self.free[self.add(x, s)].add(b)
            return b
        _, inner, low, high = node
        for _ in range(low):
            a = self.add(inner, a)
        if high is None:
            loop, out = self.state(), self.state()
            self.free[a].add(loop)
            self.free[self.add(inner, loop)].add(loop)
            self.free[loop].add(out)
            return out
        out = self.state()
        for _ in range(high - low):
            self.free[a].add(out)
            a = self.add(inner, a)
        self.free[a].add(out)
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """Transition arrays: state s on byte b goes to next[s + byte_class[b]]; states are multiples of width."""

    byte_class: bytes
    width: int
    next: np.ndarray
    label: np.ndarray  # by state number: the accepted rules as bits; the first states accept nothing
    start: int
    first_accepting: int
    dead: int

    def __post_init__(self):
        self._lists = None

    def __getstate__(self):
        return {**self.__dict__, "_lists": None}

    def tables(self):
        if self._lists is None:
            self._lists = self.next.tolist(), self.label.tolist()
        return self._lists

    def classes(self, data: bytes) -> bytes:
        return data.translate(self.byte_class)

    def hits(self, data: bytes) -> int:
        """The rules, as bits, of which some match ends in data: one pass, all rules together."""
        nxt, label = self.tables()
        s, accepting, width, out = self.start, self.first_accepting, self.width, 0
        for c in self.classes(data):
            s = nxt[s + c]
            if s >= accepting:
                out |= label[s // width]
        return out

    def first_end(self, classes: bytes, lo: int) -> int:
        """Where the first match that starts at lo or after ends, in translated data; -1 if there is none."""
        nxt, _ = self.tables()
        s, accepting = self.start, self.first_accepting
        for k in range(lo, len(classes)):
            s = nxt[s + classes[k]]
            if s >= accepting:
                return k + 1
        return -1

    def longest(self, data: bytes, lo: int) -> int:
        """End of the longest match that starts at lo; -1 if none."""
        nxt, _ = self.tables()
        s, best = self.start, lo if self.start >= self.first_accepting else -1
        cls = self.byte_class
        for k in range(lo, len(data)):
            s = nxt[s + cls[data[k]]]
            if s == self.dead:
                break
            if s >= self.first_accepting:
                best = k + 1
        return best

    def furthest_start(self, data: bytes, lo: int, end: int) -> int:
        """Of an automaton of reversed patterns: the leftmost start, from lo on, of a match that ends at end."""
        nxt, _ = self.tables()
        s, best, cls = self.start, end, self.byte_class
        for k in range(end - 1, lo - 1, -1):
            s = nxt[s + cls[data[k]]]
            if s == self.dead:
                break
            if s >= self.first_accepting:
                best = k
        return best


def sum_or(values, start: int = 0) -> int:
    for v in values:
        start |= v
    return start


def compiled(patterns: list[tuple[str, bool]], search: bool, backward: bool = False) -> Automaton:
    """Subset construction over all patterns at once, then minimisation by partition refinement."""
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for rule, (pattern, fold) in enumerate(patterns):
        node = _Parser(pattern, fold).tree()
        node = _shortest(node) if search else node
        s = nfa.state()
        nfa.free[root].add(s)
        ends[nfa.add(_reversed(node) if backward else node, s)] = 1 << rule
    # bytes that no set tells apart are one class
    sets = list({chars for moves in nfa.moves for chars, _ in moves})
    kinds: dict[tuple, int] = {}
    byte_class = bytes(kinds.setdefault(tuple(b in x for x in sets), len(kinds)) for b in range(256))
    width = len(kinds)
    sample = [byte_class.index(c) for c in range(width)]
    # sets of NFA states are integers, one bit a state
    reach = [sum(1 << x for x in nfa.closure([s])) for s in range(len(nfa.free))]
    step = [[sum_or(reach[t] for chars, t in moves if b in chars) for b in sample] for moves in nfa.moves]
    begin, again = reach[root], reach[root] if search else 0
    number, todo, rows, labels = {begin: 0}, [begin], [], []
    for now in todo:
        inside = [s for s in range(len(nfa.free)) if now >> s & 1]
        labels.append(sum_or(ends[s] for s in inside if s in ends))
        moving = [step[s] for s in inside if nfa.moves[s]]
        row = []
        for to in (sum_or(x, again) for x in zip(*moving)) if moving else [again] * width:
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    table, labels = np.array(rows), np.array(labels)
    part = np.unique(labels, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # accepting states last, so that one comparison finds them
    count = int(part.max()) + 1
    label = np.zeros(count, np.int64)
    label[part] = labels
    order = np.argsort(label > 0, kind="stable")
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    small = np.zeros((count, width), np.int64)
    small[rank[part]] = rank[part[table]]
    label = label[order]
    accepting = int((label == 0).sum())
    loops = [s for s in range(accepting) if (small[s] == s).all()]
    return Automaton(byte_class, width, (small * width).astype(np.int64).ravel(), label, int(rank[part[0]]) * width, accepting * width, (loops[0] if loops else -1) * width)
