"""Literals without which patterns can't match, derived from the patterns, and one pass that looks for all of them."""

from __future__ import annotations

import re
from re import _parser as sre

try:
    import ahocorasick
except ModuleNotFoundError:
    ahocorasick = None


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between bars outside groups and classes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i += 1 + (pattern[i + 1] == "^")
            while pattern[i + 1] != "]" or pattern[i] == "[":
                i += 2 if pattern[i + 1] == "\\" else 1
            i += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def needed(parsed) -> set[str] | None:  # noqa: ANN001
    """Literals one of which every match holds, the longest that can be told; None if there is none."""
    best: set[str] | None = None
    run = ""

    def consider(found: set[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if run:
            consider({run})
        run = ""
        if name == "BRANCH":
            parts = [needed(p) for p in value[1]]
            consider(set().union(*parts) if all(parts) else None)
        elif name == "SUBPATTERN":
            consider(needed(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
            consider(needed(value[2]))
    if run:
        consider({run})
    return best


class Detector:
    """A pattern in two parts: what stands at the start of a text, and what needs one of the literals."""

    def __init__(self, pattern: str):
        parts = alternatives(pattern)
        covers = [needed(sre.parse(p)) for p in parts]
        starts = [p for p in parts if p.startswith("^")]
        always = [p for p, c in zip(parts, covers) if not p.startswith("^") and c is None]
        rest = [(p, c) for p, c in zip(parts, covers) if not p.startswith("^") and c is not None]
        self.at_start = re.compile("|".join(starts)).match if starts else None
        self.always = re.compile("|".join(always)).search if always else None
        self.inside = re.compile("|".join(p for p, _ in rest)).search if rest else None
        self.literals = set().union(*(c for _, c in rest)) if rest else set()

    def __call__(self, text: str, may: bool) -> bool:
        """Whether the pattern matches; `may` says that the text has one of the literals."""
        if self.at_start and self.at_start(text) or self.always and self.always(text):
            return True
        return bool(may and self.inside and self.inside(text))


class Screen:
    """One automaton over the literals of several lists; each list has a bit. Without the automaton's package
    literals are looked for one by one."""

    def __init__(self, lists: list[set[str]]):
        self.literals: dict[str, int] = {}
        for k, literals in enumerate(lists):
            for x in literals:
                self.literals[x] = self.literals.get(x, 0) | 1 << k
        self.automaton = None
        if ahocorasick is not None:
            self.automaton = ahocorasick.Automaton()
            for x, b in self.literals.items():
                self.automaton.add_word(x, b)
            self.automaton.make_automaton()

    def bits(self, text: str) -> int:
        """The bits of the lists of which a text has a literal."""
        out = 0
        if self.automaton is None:
            for x, b in self.literals.items():
                if x in text:
                    out |= b
        else:
            for _, b in self.automaton.iter(text):
                out |= b
        return out
