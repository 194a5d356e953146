"""One deterministic automaton for a set of byte regexes.

Rules are compiled backwards: the automaton reads a text from its end and reports, at each byte, which rules have a match
that starts there. Construction: syntax tree, position automaton, subset construction over byte classes, minimisation by
partition refinement, then transition arrays. Supported syntax: literals, ``\\xHH``, classes with ranges, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,n}`` and ``{m,}``; each rule may ignore the case of some of its letters by
writing both in a class.
"""

from __future__ import annotations

from collections import defaultdict

EMPTY = ("cat", ())


class _Parser:
    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def peek(self) -> str:
        return self.s[self.i:self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", tuple(parts))

    def repeated(self):
        node = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body = ""
                while self.peek() != "}":
                    body += self.take()
                self.take()
                a, comma, b = body.partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            tail = (("star", node),) if high is None else (("alt", (node, EMPTY)),) * (high - low)
            node = ("cat", (node,) * low + tail)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            self.take()
            return node
        if c == "[":
            return ("set", self.members())
        if c == "\\":
            return ("set", frozenset([self.escaped()]))
        return ("cat", tuple(("set", frozenset([b])) for b in c.encode()))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def members(self) -> frozenset:
        negated, chosen = self.peek() == "^", set()
        if negated:
            self.take()
        while self.peek() != "]":
            low = self.escaped() if self.take_if("\\") else ord(self.take())
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                high = self.escaped() if self.take_if("\\") else ord(self.take())
                chosen |= set(range(low, high + 1))
            else:
                chosen.add(low)
        self.take()
        return frozenset(set(range(256)) - chosen if negated else chosen)

    def take_if(self, c: str) -> bool:
        if self.peek() == c:
            self.i += 1
            return True
        return False


def parse(pattern: str):
    return _Parser(pattern).alternatives()


def _positions(tree, backwards: bool):
    """Position automaton: byte set of each position, followers, first, last and whether the empty text matches."""
    sets: list[frozenset] = []
    follow: dict[int, set] = defaultdict(set)

    def walk(node):
        kind, body = node
        if kind == "set":
            sets.append(body)
            own = {len(sets) - 1}
            return own, own, False
        if kind == "star":
            first, last, _ = walk(body)
            for p in last:
                follow[p] |= first
            return first, last, True
        parts = [walk(x) for x in (body[::-1] if backwards and kind == "cat" else body)]
        if kind == "alt":
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        first, last, empty = set(), set(), True
        for f, l, e in parts:
            for p in last:
                follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else set(l)
            empty = empty and e
        return first, last, empty

    first, last, empty = walk(tree)
    return sets, follow, first, last, empty


def compile_rules(patterns: list[str], backwards: bool = True, anywhere: bool = True):
    """(classes, rows, marks): byte -> class, state -> class -> state, state -> bits of the rules accepted there.

    State 0 is the start. With ``anywhere`` a match may begin at each byte read.
    """
    sets: list[frozenset] = []
    follow: dict[int, set] = {}
    accept: dict[int, int] = defaultdict(int)
    start: set = set()
    for number, pattern in enumerate(patterns):
        own, after, first, last, _ = _positions(parse(pattern), backwards)
        base = len(sets)
        sets += own
        for p in range(len(own)):
            follow[base + p] = {base + q for q in after[p]}
        start |= {base + p for p in first}
        for p in last:
            accept[base + p] |= 1 << number
    kinds: dict[tuple, int] = {}
    classes = [kinds.setdefault(tuple(p for p, s in enumerate(sets) if byte in s), len(kinds)) for byte in range(256)]
    members = sorted(kinds, key=kinds.get)

    begin = frozenset([-1])
    numbers, queue, rows, marks = {begin: 0}, [begin], [], []
    for state in queue:
        reach = set(start) if anywhere or state is begin else set()
        for p in state:
            reach |= follow.get(p, set())
        row = []
        for kind in members:
            to = frozenset(reach.intersection(kind))
            if to not in numbers:
                numbers[to] = len(numbers)
                queue.append(to)
            row.append(numbers[to])
        rows.append(row)
        mark = 0
        for p in state:
            mark |= accept.get(p, 0)
        marks.append(mark)
    return _minimised(classes, rows, marks)


def _minimised(classes, rows, marks):
    block = list(marks)
    size = 0
    while len(set(block)) != size:
        size = len(set(block))
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(rows)]
    order = {b: i for i, b in enumerate(dict.fromkeys(block))}  # the start keeps number 0
    small, kept = [None] * len(order), [0] * len(order)
    for s, row in enumerate(rows):
        i = order[block[s]]
        small[i] = [order[block[t]] for t in row]
        kept[i] = marks[s]
    return classes, small, kept


class Scanner:
    """Transition arrays for one pass over the bytes of a text, last byte first.

    A state is a list with the next state of each of 256 bytes and, at 256, its rule bits.
    """

    def __init__(self, patterns: list[str]):
        classes, rows, marks = compile_rules(patterns)
        states = [[None] * 257 for _ in rows]
        for state, row, mark in zip(states, rows, marks):
            state[:256] = [states[row[c]] for c in classes]
            state[256] = mark
        self.start = states[0]
        self.n_states = len(states)
        self._forward = []
        for pattern in patterns:
            kinds, steps, ends = compile_rules([pattern], backwards=False, anywhere=False)
            dead = next((i for i, r in enumerate(steps) if set(r) == {i} and not ends[i]), -1)
            self._forward.append((kinds, steps, ends, dead))

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, rule bits) of every byte at which a match starts, last first."""
        state, out, at = self.start, [], len(data)
        for byte in data[::-1]:
            at -= 1
            state = state[byte]
            if state[256]:
                out.append((at, state[256]))
        return out

    def end(self, rule: int, data: bytes, at: int) -> int:
        """End of the longest match of the rule that starts at ``at``."""
        kinds, steps, ends, dead = self._forward[rule]
        state, best = 0, at
        for i in range(at, len(data)):
            state = steps[state][kinds[data[i]]]
            if state == dead:
                break
            if ends[state]:
                best = i + 1
        return best

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes: leftmost, longest, and not overlapping within a rule."""
        found = self.starts(data)
        if not found:
            return []
        after: dict[int, int] = {}
        out = []
        for at, bits in reversed(found):
            rule = 0
            while bits:
                if bits & 1 and at >= after.get(rule, 0):
                    after[rule] = self.end(rule, data, at)
                    out.append((rule, at, after[rule]))
                bits >>= 1
                rule += 1
        return out
