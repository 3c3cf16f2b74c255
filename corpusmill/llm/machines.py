"""Weighted finite-state machines over short alphabets: a notation for rules, sequential transducers, composition.

A rule is written over symbols, one character each: [AB] one of them, [^AB] any other, . any, | either,
{m,n} ? * + repeats, (?:...) a group, <name> another machine; ^ and $ are the ends of a clause. Blanks
are for reading.
"""

from __future__ import annotations

import re

ENDS = "^$"
PIECE = re.compile(r"\(\?:|\)|\||\[\^?[^\]]*\]|<\w+>|\{\d+,\d+\}|[?*+.]|\S")


class Acceptor:
    """Weighted rules as one nondeterministic machine, run as a deterministic one whose states are made when met.

    The weight of a rule is that of its last arc; a clause has, by category, the greatest weight of a rule
    that accepts a stretch of it.
    """

    def __init__(self, rules: list[tuple[str, float, str]], categories: tuple[str, ...], named: dict[str, str]):
        self.arcs: list[list[tuple[str, int]]] = []  # state -> (symbols, next); symbols start with ~ for "any but"
        self.free: list[list[int]] = []  # state -> states reached without a symbol
        self.named, self.size = named, len(categories)
        self.finals: dict[int, tuple[int, float]] = {}
        self.first = self.state()
        for category, weight, rule in rules:
            start, end = self.parse(PIECE.findall(rule))
            self.free[self.first].append(start)
            self.finals[end] = categories.index(category), weight
        self.sets: list[frozenset[int]] = []
        self.numbers: dict[frozenset[int], int] = {}
        self.weights: list[tuple[float, ...]] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self.number(self.close({self.first}))

    def state(self) -> int:
        self.arcs.append([])
        self.free.append([])
        return len(self.arcs) - 1

    def parse(self, pieces: list[str]) -> tuple[int, int]:
        """States where a rule starts and ends."""
        pieces = list(pieces)

        def either() -> tuple[int, int]:
            options = [row()]
            while pieces and pieces[0] == "|":
                pieces.pop(0)
                options.append(row())
            start, end = self.state(), self.state()
            for a, b in options:
                self.free[start].append(a)
                self.free[b].append(end)
            return start, end

        def row() -> tuple[int, int]:
            start = end = self.state()
            while pieces and pieces[0] not in ("|", ")"):
                build = one()
                low, high = 1, 1
                if pieces and (m := re.fullmatch(r"\{(\d+),(\d+)\}|[?*+]", pieces[0])):
                    sign = pieces.pop(0)
                    low, high = (int(m[1]), int(m[2])) if m[1] else {"?": (0, 1), "*": (0, -1), "+": (1, -1)}[sign]
                for k in range(max(high, low, 1)):
                    a, b = build()
                    self.free[end].append(a)
                    if k >= low:
                        self.free[end].append(b)
                    if high < 0:
                        self.free[b].append(a)
                    end = b
            return start, end

        def one():  # noqa: ANN202
            piece = pieces.pop(0)
            if piece == "(?:":
                inside, depth = [], 1
                while depth:
                    x = pieces.pop(0)
                    depth += (x == "(?:") - (x == ")")
                    inside.append(x)
                return lambda: self.parse(inside[:-1])
            if piece[0] == "<":
                return lambda: self.parse(PIECE.findall(self.named[piece[1:-1]]))
            symbols = "~" + ENDS if piece == "." else "~" + ENDS + piece[2:-1] if piece[:2] == "[^" else piece[1:-1] if piece[0] == "[" else piece

            def arc() -> tuple[int, int]:
                a, b = self.state(), self.state()
                self.arcs[a].append((symbols, b))
                return a, b

            return arc

        return either()

    def close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return frozenset(states)

    def number(self, states: frozenset[int]) -> int:
        known = self.numbers.get(states)
        if known is None:
            known = self.numbers[states] = len(self.sets)
            self.sets.append(states)
            best = [0.0] * self.size
            for s in states:
                if s in self.finals:
                    k, weight = self.finals[s]
                    best[k] = max(best[k], weight)
            self.weights.append(tuple(best))
        return known

    def step(self, state: int, symbol: str) -> int:
        after = self.moves.get((state, symbol))
        if after is None:
            hit = {t for s in self.sets[state] for symbols, t in self.arcs[s] if (symbol in symbols) != (symbols[0] == "~")}
            after = self.moves[state, symbol] = self.number(self.close(hit | {self.first}))
        return after


class Transducer:
    """A sequential transducer: (state, symbol) -> (state, output); * stands for any other symbol and, as an
    output, for the symbol itself. A clause that ends in a state has its weights multiplied by the state's factor."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]], factors: dict[int, float]):
        self.arcs = {(s, x): to for (s, xs), to in arcs.items() for x in (xs if xs != "*" else ["*"])}
        self.factors = factors
        self.start = 0

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        after, out = self.arcs.get((state, symbol)) or self.arcs.get((state, "*")) or (state, "*")
        return after, symbol if out == "*" else out

    def factor(self, state: int) -> float:
        return self.factors.get(state, 1.0)


class Composition:
    """Two transducers one after the other, as one."""

    def __init__(self, first, second):  # noqa: ANN001
        self.first, self.second = first, second
        self.start = first.start, second.start
        self.known: dict = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str]:
        found = self.known.get((state, symbol))
        if found is None:
            a, out = self.first.step(state[0], symbol)
            b, out = self.second.step(state[1], out)
            found = self.known[state, symbol] = (a, b), out
        return found

    def factor(self, state: tuple) -> float:
        return self.first.factor(state[0]) * self.second.factor(state[1])


def run(clause: str, through, rules: Acceptor) -> tuple[float, ...]:  # noqa: ANN001
    """The weights of a clause by category, after the transducers: the composition with the rules, state by state."""
    best, state, at = rules.weights[rules.start], through.start, rules.start
    for symbol in ("^", *clause, "$"):
        state, out = through.step(state, symbol)
        at = rules.step(at, out)
        if any(rules.weights[at]):
            best = tuple(map(max, best, rules.weights[at]))
    factor = through.factor(state)
    return tuple(x * factor for x in best)
