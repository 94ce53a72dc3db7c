"""A bidirectional FM-index over words with a delimiter between them, and search schemes for one error.

The text is each word and a delimiter after it, read in a circle. An interval of ranks among its sorted rotations stands for a pattern; an index of the text extends patterns to the left, one of the
reversed text to the right, and extending on one side keeps the interval of the other in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DELIMITER = "\n"
#: Words that are searched for side by side.
SIDE = 8192
#: Ranks of an interval whose symbols are looked at one by one; in larger ones every symbol of the alphabet is tried.
FEW = 64


class Ranks:
    """A wavelet matrix over small numbers."""

    def __init__(self, x: np.ndarray, symbols: int) -> None:
        self.levels = []
        for bit in reversed(range(max(1, (symbols - 1).bit_length()))):
            one = (x >> bit) & 1 == 1
            zeros = np.zeros(len(x) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            x = np.concatenate([x[~one], x[one]])
        self.start = np.searchsorted(_reversed_bits(x, len(self.levels)), _reversed_bits(np.arange(symbols), len(self.levels)))

    def within(self, c: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many c come before lo, how many are in the `size` places from lo, and how many smaller symbols are there."""
        hi = lo + size
        smaller = np.zeros(len(lo), np.int64)
        for bit, zeros, z in self.levels:
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = (c >> bit) & 1 == 1
            smaller += np.where(one, b - a, 0)
            lo, hi = np.where(one, z + lo - a, a), np.where(one, z + hi - b, b)
        return lo - self.start[c], hi - lo, smaller


def _reversed_bits(x: np.ndarray, bits: int) -> np.ndarray:
    """The order in which the last level of a wavelet matrix holds its symbols."""
    out = np.zeros(len(x), np.int64)
    for i in range(bits):
        out |= ((x >> i) & 1).astype(np.int64) << (bits - 1 - i)
    return out


def rotations(text: np.ndarray) -> np.ndarray:
    """Where each rotation of the text begins, in sorted order, by doubling; no two rotations are equal."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    while True:
        key = rank.astype(np.int64) * n + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        rank = new
        if step >= n or rank[order[-1]] == n - 1:
            return order
        step *= 2


class OneWay:
    """Extends patterns to the left."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        self.places = rotations(text).astype(np.int32)
        self.before = text[self.places - 1]  # the symbol before each rotation
        self.ranks = Ranks(self.before, symbols)
        self.first = np.searchsorted(np.sort(text), np.arange(symbols))

    def extend(self, c: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, size) of the pattern with c before it, and how far the other side's interval moves."""
        rank, size, smaller = self.ranks.within(c, lo, size)
        return self.first[c] + rank, size, smaller


class WordIndex:
    """Different words, searched with one error."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        points = np.frombuffer("".join(w + DELIMITER for w in words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.append(ord(DELIMITER), np.setdiff1d(points, [ord(DELIMITER)]))  # the delimiter is the least
        order = np.argsort(self.alphabet)
        text = order[np.searchsorted(self.alphabet, points, sorter=order)].astype(np.uint8 if len(self.alphabet) < 256 else np.int64)
        self.ends = np.flatnonzero(text == 0)
        self.left, self.right = OneWay(text, len(self.alphabet)), OneWay(text[::-1].copy(), len(self.alphabet))

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of words in a row (-1: not in the index), where each word's begin, and lengths."""
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        order = np.argsort(self.alphabet)
        at = order[np.minimum(np.searchsorted(self.alphabet, points, sorter=order), len(order) - 1)]
        return np.where(self.alphabet[at] == points, at, -1), np.cumsum(size) - size, size

    def near(self, words: list[str], first_exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number in words, number of an index word one edit away) of all pairs that agree on the first half (len // 2 symbols) or else on the last one."""
        for lo in range(0, len(words), SIDE):
            some = words[lo : lo + SIDE]
            if first_exact:
                query, place = self._search(some, self.left, self.right, np.array([len(w) // 2 for w in some]))
                found = np.searchsorted(self.ends, len(self.right.places) - 1 - place)
            else:  # all reversed
                query, place = self._search([w[::-1] for w in some], self.right, self.left, np.array([len(w) - len(w) // 2 for w in some]))
                found = (np.searchsorted(self.ends, place) + 1) % len(self.words)
            pair = np.unique(query * len(self.words) + found)
            yield lo + pair // len(self.words), pair % len(self.words)

    def _search(self, words: list[str], left: OneWay, right: OneWay, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scheme: the first `half` symbols exactly, right to left, and the delimiter before them; then on to the right with exactly one error, and the delimiter. (query, place in right's text)."""
        codes, start, length = self._codes(words)
        codes = np.append(codes, -1)
        n = len(left.places)
        q = np.arange(len(words))
        lo, other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), n)
        for s in range(int(half.max(initial=0)) + 1):
            c = np.where(s < half[q], codes[start[q] + np.maximum(half[q] - 1 - s, 0)], 0)
            due = (s <= half[q]) & (c >= 0)
            size[(s <= half[q]) & (c < 0)] = 0
            lo[due], size[due], moved = left.extend(c[due], lo[due], size[due])
            other[due] += moved
            alive = size > 0
            q, lo, other, size = q[alive], lo[alive], other[alive], size[alive]
        exact = (q, other, size)
        none = np.zeros(0, np.int64)
        wrong = (none, none, none)
        hits: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
        t = 0
        while len(exact[0]) or len(wrong[0]):
            q, lo, size = exact
            ahead = codes[np.minimum(start[q] + half[q] + t, len(codes) - 1)]
            at_end = half[q] + t == length[q]
            k, c = self._followers(right, lo, size)
            child_lo, child_size, _ = right.extend(c, lo[k], size[k])
            there = child_size > 0
            k, c, child_lo, child_size = k[there], c[there], child_lo[there], child_size[there]
            same = (c == ahead[k]) & ~at_end[k]
            odd = ~same
            sub = odd & ~at_end[k]
            now = [np.concatenate(x) for x in zip(wrong, (q[k[odd]], child_lo[odd], child_size[odd]), strict=True)]  # with another symbol put in
            later = [(q[k[sub]], child_lo[sub], child_size[sub]), (q[~at_end], lo[~at_end], size[~at_end])]  # replaced, or left out
            exact = (q[k[same]], child_lo[same], child_size[same])
            q, lo, size = now
            at_end = half[q] + t == length[q]
            c = np.where(at_end, 0, codes[np.minimum(start[q] + half[q] + t, len(codes) - 1)])
            q, lo, size, at_end, c = (x[c >= 0] for x in (q, lo, size, at_end, c))
            lo, size, _ = right.extend(c, lo, size)
            hits.append((q[at_end & (size > 0)], right.places[lo[at_end & (size > 0)]]))
            on = ~at_end & (size > 0)
            wrong = tuple(np.concatenate(x) for x in zip((q[on], lo[on], size[on]), *later, strict=True))
            t += 1
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))

    def _followers(self, right: OneWay, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) of the symbols but the delimiter that may follow: those there are in small intervals, all in large ones."""
        symbols = len(self.alphabet)
        few = np.flatnonzero(size <= FEW)
        n = size[few]
        place = np.repeat(lo[few] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen = np.unique(np.repeat(few, n) * symbols + right.before[place])
        many = np.flatnonzero(size > FEW)
        k = np.concatenate([seen // symbols, np.repeat(many, symbols)])
        c = np.concatenate([seen % symbols, np.tile(np.arange(symbols), len(many))])
        return k[c > 0], c[c > 0]
