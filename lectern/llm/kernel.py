"""Vectorised work on the UTF-8 bytes of a batch of texts (numpy inside tasks).

Texts of an Arrow batch lie in one byte buffer. Words, lines and shingles are
ranges of it; a range's hash comes from a running polynomial sum over random
values of the bytes, so that no Python object per word is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; longer single texts are handled alone.
CHUNK = 2_000_000
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_COEF = _rng.integers(0, 2**63, 64, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters.
NO_LETTER = np.arange(256) < 128
NO_LETTER[[*range(65, 91), *range(97, 123)]] = False
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(n - 1, b, U)])) for b in (_BASE, _INVERSE)]
    return _powers


class Texts:
    """A run of texts: ``data`` their bytes, ``at`` the n + 1 offsets."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data, self.at, self.n = (LOWER[data] if lower else data), at, len(at) - 1
        self._sums = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they stand."""
        if not len(start):
            return np.zeros(0, U)
        up, down = _powers_to(max(len(self.data) + 1, CHUNK))
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, U)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix64((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U) * _COEF[63])

    def words(self, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the n + 1 offsets of the texts' words. between: bytes that part words."""
        inside = ~between[self.data]
        if not inside.any():
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        a, b = self.at[:-1][self.at[:-1] < self.at[1:]], self.at[1:][self.at[:-1] < self.at[1:]] - 1
        first[a], last[b] = inside[a], inside[b]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, np.searchsorted(start, self.at)

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return np.diff(sums[self.at])


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, pa.scalar("", column.type))
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def owners(at: np.ndarray) -> np.ndarray:
    """For offsets of groups, the group of each member."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def windows(word: np.ndarray, at: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place of the first word) of all n-word windows. short: a text with fewer words is one window."""
    text = owners(at)
    m = max(0, len(word) - n + 1)
    h = np.zeros(m, U)
    for k in range(n):
        h += word[k : m + k] * _COEF[k]
    same = text[:m] == text[n - 1 : n - 1 + m]
    place = np.flatnonzero(same)
    h, owner = mix64(h[same]), text[:m][same]
    if short:
        parts = [(h, owner, place)]
        for k in range(1, n):
            few = np.flatnonzero(np.diff(at) == k)
            s = np.full(len(few), U(k)) * _COEF[62]
            for j in range(k):
                s = s + word[at[few] + j] * _COEF[j]
            parts.append((mix64(s), few, at[few]))
        h, owner, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, owner, place


def distinct(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each owner in order, and the n + 1 offsets."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(n + 1))


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


#: (name, slot) sums that a task holds before it sends them on; each is some 16 bytes.
HELD = 1_000_000


class Sums:
    """Sums by name and slot, sparse however many names occur; ``full`` says when to send them on."""

    def __init__(self, width: int, columns: tuple[str, str, str]):
        self.width, self.columns = width, columns
        self._empty()

    def _empty(self) -> None:
        self.names: dict[str | None, int] = {}
        self.code, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, names: list[str | None], member: np.ndarray, slot: np.ndarray, n: np.ndarray | None = None) -> None:
        """Adds n (1 each if not given) to the slots of the names of the members."""
        number = np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int64)
        self.waiting.append((number[member] * self.width + slot, np.ones(len(slot), np.int64) if n is None else n))

    @property
    def full(self) -> bool:
        if sum(len(c) for c, _ in self.waiting) > HELD:
            self._settle()
        return len(self.code) > HELD

    def _settle(self) -> None:
        self.code, at = np.unique(np.concatenate([self.code, *[c for c, _ in self.waiting]]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, *[n for _, n in self.waiting]]), len(self.code)).astype(np.int64)
        self.waiting = []

    def told(self) -> pa.RecordBatch:
        """(name, slot, sum) of what was added since the last time."""
        self._settle()
        names = pa.array(list(self.names), pa.string()).take(pa.array(self.code // self.width))
        out = pa.RecordBatch.from_arrays([names, pa.array((self.code % self.width).astype(np.int32)), pa.array(self.n)], list(self.columns))
        self._empty()
        return out
