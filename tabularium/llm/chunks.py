"""Texts cut at single spaces into chunks that tokenizers treat alone, with a bounded cache of what each chunk gives.

A tokenizer that never merges over a space before a visible (printable) character gives the tokens of a text as those of its chunks in a row. A cut is made only where
visible characters stand on both sides of one space; what lies between two cuts is one chunk, however much white space it holds.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a cache holds, and characters of them, before it starts anew.
CHUNKS, CHARS = 1_500_000, 30_000_000
#: How byte-level vocabularies write a space.
SPACE = "Ġ"
#: Bytes of text that a task cuts together.
SLICE = 1 << 22


@functools.cache
def byte_level() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it is visible, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def decoded(token: str) -> bytes:
    """The bytes of a byte-level entry; a special token's are those of its string."""
    to_byte = byte_level()
    return bytes(to_byte[x] for x in token) if all(x in to_byte for x in token) else token.encode()


def cuts(tokens: Iterable[bytes | str]) -> bool:
    """Whether no token of a vocabulary holds a space after a visible character, so that texts can be cut there."""
    for t in tokens:
        text = t.decode("utf-8", "replace") if isinstance(t, bytes) else t
        if any(b == " " and a != " " and a.isprintable() for a, b in zip(text, text[1:], strict=False)):
            return False
    return True


class _Shown(dict):
    """Whether a character is visible; none, and a space, are not."""

    def __missing__(self, x: str) -> bool:
        seen = self[x] = x not in ("", " ") and x.isprintable()
        return seen


SHOWN = _Shown()


class Grown:
    """An array that rows are added to."""

    def __init__(self, dtype) -> None:
        self.data, self.n = np.zeros(1024, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(x), self.n // 2 + 1024), self.data.dtype)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class Chunks:
    """Numbers of the chunks of texts. learn(new chunks, which of them have visible ends) is called once for each chunk, in order of numbers; forget() where the cache starts anew.
    With `whole`, texts aren't cut: for tokenizers with tokens that hold a space after other characters.
    """

    def __init__(self, learn: Callable[[list[str], np.ndarray], None], forget: Callable[[], None], chunks: int = CHUNKS, whole: bool = False) -> None:
        self.learn, self.forget, self.limit, self.whole = learn, forget, chunks, whole
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.begins, self.ends = Grown(bool), Grown(bool)
        self.chars = 0
        self.forget()

    def _number(self, chunks: list[str]) -> np.ndarray:
        """The numbers of different chunks; those not known are learned."""
        known = self.known
        new = list(dict.fromkeys(c for c in chunks if c not in known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.names += new
            self.chars += sum(map(len, new))
            begins = np.fromiter(map(SHOWN.__getitem__, [c[:1] for c in new]), bool, len(new))
            ends = np.fromiter(map(SHOWN.__getitem__, [c[-1:] for c in new]), bool, len(new))
            self.begins.add(begins)
            self.ends.add(ends)
            self.learn(new, begins & ends)
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' chunks in a row, and where each text's begin (one more entry than texts); null and empty texts have one empty chunk."""
        if len(self.known) > self.limit or self.chars > CHARS:
            self._clear()
        texts = pc.fill_null(texts, "")
        if self.whole:
            return self._number(texts.to_pylist()), np.arange(len(texts) + 1)
        parts = pc.split_pattern(texts, " ")
        cut = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), out=cut[1:])
        coded = parts.flatten().dictionary_encode()
        at = self._number(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        joined = ~(self.ends.data[at[:-1]] & self.begins.data[at[1:]])  # no cut between a part and its next
        joined[cut[1:-1] - 1] = False
        if not joined.any():
            return at, cut
        starts = np.flatnonzero(np.append(True, ~joined))
        sizes = np.diff(np.append(starts, len(at)))
        out = at[starts]
        many = np.flatnonzero(sizes > 1)
        whole = [" ".join([self.names[k] for k in at[lo : lo + n].tolist()]) for lo, n in zip(starts[many].tolist(), sizes[many].tolist(), strict=True)]
        different = list(dict.fromkeys(whole))
        number = dict(zip(different, self._number(different).tolist(), strict=True))
        out[many] = [number[w] for w in whole]
        return out, np.searchsorted(starts, cut)


def gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat's runs with the numbers `at` in a row, where run i ends at ends[i + 1]; and where each of them ends (with a 0 before)."""
    start, n = ends[at], ends[at + 1] - ends[at]
    cum = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(start - cum[:-1], n) + np.arange(cum[-1])], cum


def runs(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows of about `limit` bytes, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, limit + (size[lo - 1] if lo else 0), side="right")))
        yield lo, hi - lo
        lo = hi
