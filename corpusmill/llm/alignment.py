"""Ordered alignment of two texts' words from collinear chains of shared seeds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from difflib import SequenceMatcher

from corpusmill.llm.p1_pairs import near


def slip(x: str, y: str) -> bool:
    """One slip apart, or two in a long word; either way the first or the last letter is the same."""
    if x[0] != y[0] and x[-1] != y[-1]:
        return False
    if near(x, y):
        return True
    if len(x) < 8 or len(y) < 8 or abs(len(x) - len(y)) > 2:
        return False
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    return max(len(x), len(y)) - head - tail <= 3 and head + tail >= 0.6 * max(len(x), len(y))


def slip_keys(word: str) -> list[str]:
    """Keys of which two words one slip apart share at least one; long words that may be two slips apart
    share one of those that start with < or >."""
    keys = [word] + [word[:i] + word[i + 1 :] for i in range(len(word))]
    return keys + ["<" + word[:3], ">" + word[-3:]] if len(word) >= 8 else keys


class Slips:
    """Finds words that are slips of given ones, without comparing each with each."""

    def __init__(self, ws: list[str]):
        self.words = ws
        self.places: dict[str, list[int]] = {}
        for j, w in enumerate(ws):
            if not w[0].isdigit():
                for k in set(slip_keys(w)):
                    self.places.setdefault(k, []).append(j)

    def of(self, word: str) -> list[int]:
        """Places of slips of a word, in order; numbers have none."""
        if word[0].isdigit():
            return []
        near_by = {j for k in slip_keys(word) for j in self.places.get(k, ())}
        return sorted(j for j in near_by if slip(word, self.words[j]))


#: Comparisons of words beyond which an index of slips is made first (only speed depends on it).
MANY = 4096


def longest_chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of seeds that rises on both sides, in n log n steps."""
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    ends: list[int] = []  # least end on the right side of a chain of each length
    at: list[int] = []
    before = [-1] * len(seeds)
    for k, (_, j) in enumerate(seeds):
        place = bisect_left(ends, j)
        before[k] = at[place - 1] if place else -1
        if place == len(ends):
            ends.append(j)
            at.append(k)
        else:
            ends[place], at[place] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(seeds[k])
        k = before[k]
    return out[::-1]


def shared_seeds(a: list, b: list, free_a: list[bool] | None = None, free_b: list[bool] | None = None) -> list[tuple[int, int]]:
    """(place in a, place in b) of equal entries; of several places in b the one that goes on straightest."""
    places: dict = {}
    for j, x in enumerate(b):
        if free_b is None or free_b[j]:
            places.setdefault(x, []).append(j)
    out, shift = [], 0
    for i, x in enumerate(a):
        if (free_a is None or free_a[i]) and (js := places.get(x)):
            k = bisect_left(js, i + shift)
            j = min(js[max(0, k - 1) : k + 1], key=lambda j: abs(j - i - shift))
            out.append((i, j))
            shift = j - i
    return out


def fill_gap(a: list[str], b: list[str], i0: int, i1: int, j0: int, j1: int, at: list[int], may_slip: Callable[[str], bool] | None = None) -> None:
    """Match the words of a[i0:i1] and b[j0:j1] in order, equal ones first, then slips between them. Words for which
    may_slip gives False are known to have no slip in b (only speed depends on it)."""
    if i0 >= i1 or j0 >= j1:
        return
    blocks = [(0, 0, 0)]
    if set(a[i0:i1]).isdisjoint(b[j0:j1]):
        if may_slip is not None and not any(map(may_slip, a[i0:i1])):
            return
        blocks = [(i1 - i0, j1 - j0, 0)]
    elif i1 - i0 > 1 or j1 - j0 > 1:
        blocks = SequenceMatcher(None, a[i0:i1], b[j0:j1], autojunk=False).get_matching_blocks()
    else:
        at[i0] = j0
        return
    di = dj = 0
    index: Slips | None = None
    for i, j, n in blocks:
        y = dj
        if (i - di) * (j - dj) > MANY and index is None:
            index = Slips(b[j0:j1])
        for x in range(di, i):
            if a[i0 + x][0].isdigit() or (may_slip is not None and not may_slip(a[i0 + x])):
                continue
            if index is not None:
                hit = next((k for k in index.of(a[i0 + x]) if y <= k < j), None)
            else:
                hit = next((k for k in range(y, j) if not b[j0 + k][0].isdigit() and slip(a[i0 + x], b[j0 + k])), None)
            if hit is not None:
                at[i0 + x] = j0 + hit
                y = hit + 1
        for k in range(n):
            at[i0 + i + k] = j0 + j + k
        di, dj = i + n, j + n


def align_words(
    a: list[str], b: list[str], gram: int = 3, moves: bool = True, reach: int = 8,
    seeds: list[tuple[int, int]] | None = None, may_slip: Callable[[str], bool] | None = None,
) -> list[int]:
    """The place in b of each word of a, or -1.

    Seeds are grams that both texts have; the longest collinear chain is extended word by word between
    its seeds and by the gap's length and `reach` words at its ends. With `moves` what is left is chained
    again, so that a stretch of more than `gram` words may stand elsewhere; order counts within stretches.
    Seeds that are known already, of `gram` words as shared_seeds() gives them, and may_slip of fill_gap() save time.
    """
    at = [-1] * len(a)
    if not a or not b:
        return at
    k = min(gram, len(a), len(b))
    taken = [False] * len(b)
    first = True
    while True:
        if seeds and first and k == gram:
            chain = longest_chain(seeds)
        else:
            ga = [tuple(a[i : i + k]) for i in range(len(a) - k + 1)]
            gb = [tuple(b[j : j + k]) for j in range(len(b) - k + 1)]
            free_a = [all(x < 0 for x in at[i : i + k]) for i in range(len(ga))] if not first else None
            free_b = [not any(taken[j : j + k]) for j in range(len(gb))] if not first else None
            chain = longest_chain(shared_seeds(ga, gb, free_a, free_b))
        if not chain and first and k > 1:
            k -= 1  # few words are shared in a row
            continue
        if not chain and first:
            fill_gap(a, b, 0, len(a), 0, len(b), at, may_slip)
        if not chain or (not first and len(chain) < 2):
            return at
        done_i, done_j = max(0, chain[0][0] - reach), max(0, chain[0][1] - reach)
        if first:
            done_i = 0
            done_j = max(0, chain[0][1] - chain[0][0] - reach)
        for i, j in chain:
            if first or not (any(x >= 0 for x in at[done_i:i]) or any(taken[done_j:j])):
                fill_gap(a, b, done_i, i, done_j, j, at, may_slip)
            for x in range(k):
                if at[i + x] < 0:
                    at[i + x] = j + x
            done_i, done_j = max(done_i, i + k), max(done_j, j + k)
        if first:
            fill_gap(a, b, done_i, len(a), done_j, min(len(b), done_j + len(a) - done_i + reach), at, may_slip)
        for j in at:
            if j >= 0:
                taken[j] = True
        if not moves or sum(x < 0 for x in at) <= k:
            return at
        first = False
