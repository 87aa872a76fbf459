"""Words, word windows and lines of many texts at once, as arrays of hashes.

Texts are handled as UTF-8 bytes, joined by line feeds into buffers of about a megabyte,
so that a few array operations serve hundreds of documents. White space is space and
the five control characters from tab to carriage return; a word is a run of anything
else. A hash is a polynomial over the bytes, modulo the prime 2**61 - 1, then mixed: a
word's hash comes from prefix sums, whatever its length. Equal words always have equal
hashes; two unequal ones of n bytes collide for at most n of the 2**61 bases, and the base
is a fixed one that no text knows of. (A modulus of 2**64 would not do: there some pairs
of words collide whatever the base.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np

BUFFER_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """The first n of a seeded stream of 64-bit numbers."""
    return mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


PRIME = (1 << 61) - 1
BASE = 0x0D1342543DE82EF9
INVERSE = pow(BASE, -1, PRIME)
#: Odd, for windows: polynomials of a few mixed hashes, modulo 2**64.
WINDOW_BASE = 0xD1342543DE82EF95 | 3
BYTE_CODES = np.arange(1, 257, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_CODES = BYTE_CODES[_LOWER]
#: Longer spans are hashed by blake2b: a sum of 8-bit codes times 31-bit halves stays below 2**64.
LONGEST_SUM = 1 << 23
_LOW31 = np.uint64((1 << 31) - 1)
_LOW30 = np.uint64((1 << 30) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, for any 64-bit numbers."""
    prime = np.uint64(PRIME)
    x = (x & prime) + (x >> np.uint64(61))
    return np.where(x >= prime, x - prime, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of numbers below it."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a_high * b_low + a_low * b_high
    # 2**62 is 2, and 2**31 times the middle is its high part times 2**61 plus its low part times 2**31.
    whole = a_high * b_high * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31))
    return reduced(reduced(whole) + reduced(a_low * b_low))


def _doubled(base: int, n: int) -> np.ndarray:
    """Powers of a base modulo the prime, 0 to n - 1 at least, by doubling."""
    table = np.ones(1, np.uint64)
    while len(table) < n:
        table = np.concatenate([table, product(table, np.uint64(pow(base, len(table), PRIME)))])
    return table


_powers = [np.ones(1, np.uint64)] * 3


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base, high and low halves, and of its inverse, from 0 to n; kept
    between calls."""
    if len(_powers[0]) <= n:
        own, inverse = (_doubled(base, n + 1) for base in (BASE, INVERSE))
        _powers[:] = [own >> np.uint64(31), own & _LOW31, inverse]
    return [table[: n + 1] for table in _powers]


@dataclass
class Words:
    """The words of some texts. ``doc`` gives each word's text, in order."""

    buffer: np.ndarray
    starts: np.ndarray
    n_docs: int
    lower: bool = False

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(self.buffer) + 2, np.int8)
        inside[1:-1] = ~SPACES[self.buffer]
        edge = np.diff(inside)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    @property
    def start(self) -> np.ndarray:
        return self._edges[0]

    @property
    def end(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def doc(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.start, "right") - 1

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of codes times the high and low halves of powers, modulo 2**64: a
        difference is exact as long as its span is at most ``LONGEST_SUM`` long."""
        codes = (LOWER_CODES if self.lower else BYTE_CODES)[self.buffer]
        out = []
        for half in powers(len(codes))[:2]:
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * half[:-1], out=sums[1:])
            out.append(sums)
        return out[0], out[1]

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self._sums
        inverse = powers(len(self.buffer))[2]
        upper, lower = reduced(high[end] - high[start]), reduced(low[end] - low[start])
        raw = product(reduced(product(upper, np.uint64(1 << 31)) + lower), inverse[start])
        out = mix(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(end - start > LONGEST_SUM):
            span = self.buffer[start[i] : end[i]].tobytes()
            digest = blake2b(span.lower() if self.lower else span, digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.start, self.end)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Each run of ``size`` words inside one text: its hash and its first word."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = self.hashes[:n].copy()
        for step in range(1, size):
            whole *= np.uint64(WINDOW_BASE)
            whole += self.hashes[step : n + step]
        first = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return mix(whole[first] + np.uint64(size)), first

    def per_doc(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(at, weights, self.n_docs).astype(np.int64)


def buffers(texts: list[bytes], lower: bool = False, most: int = BUFFER_BYTES) -> Iterator[tuple[slice, Words]]:
    """The texts in order, a buffer at a time: which of them, and their words."""
    at = 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and (until == at or size + len(texts[until]) < most):
            size += len(texts[until]) + 1
            until += 1
        part = texts[at:until]
        starts = np.zeros(len(part), np.int64)
        np.cumsum([len(x) + 1 for x in part[:-1]], out=starts[1:])
        yield slice(at, until), Words(np.frombuffer(b"\n".join(part), np.uint8), starts, len(part), lower)
        at = until


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
