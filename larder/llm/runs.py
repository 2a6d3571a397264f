"""Words of many texts at once: places, 64-bit hashes and table look-ups as array operations.

Texts are joined to one array of code points.  A run's hash is a polynomial in its code points modulo 2^64, taken from
prefix sums, so hashing all runs of a text costs a few passes over its characters.  Different runs of at most ``LONGEST``
code points share a hash with a probability of about 2^-64 a pair; such polynomials can be attacked by far longer runs
only, which callers treat as strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

LONGEST = 64
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_PLANES = (0x250, 0x3000, 0x10000, 0x110000)  # of most texts the first or second holds all
_WORD_END = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 2^bits of each."""
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        found = np.ones(1, np.uint64)
        for k in range(bits):
            found = np.concatenate([found, found * np.uint64(pow(base, 1 << k, 1 << 64))])
        out.append(found)
    return out[0], out[1]


def pieces(text: str, size: int) -> Iterator[str]:
    """The text cut at ends of words into pieces of about ``size`` characters, so that arrays over a piece stay small."""
    at = 0
    while len(text) - at > size and (end := _WORD_END.search(text, at + size)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def joined(texts: list[str], lower: bool = False) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts, a line feed after each, as one text and its code points, and where each starts; the last start is the length."""
    text = "\n".join([*texts, ""])
    if lower:  # A-Z only
        text = text.encode().lower().decode()
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return text, np.frombuffer(text.encode("utf-32-le"), "<u4"), starts


@cache
def _folds(size: int, letters: bool) -> np.ndarray:
    inside = str.isalpha if letters else (lambda c: c.isalnum() or c == "_")
    return np.array([ord(c.lower()[0]) if inside(c) else 0 for c in map(chr, range(size))], np.uint32)


def folded(codes: np.ndarray, letters: bool = False) -> np.ndarray:
    """Lower case (its first character) of letters, digits and underscores, or of letters only; 0 for all else."""
    most = int(codes.max(initial=0))
    return _folds(next(size for size in _PLANES if most < size), letters)[codes]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the stretches where ``inside`` is true."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.append(0, edges)
    if len(inside) and inside[-1]:
        edges = np.append(edges, len(inside))
    return edges[::2], edges[1::2]


def hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash, never 0, of each run of code points."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(max(1, int(len(codes)).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    found = (sums[end] - sums[begin]) * inverse[begin]
    found = (found ^ (found >> _SHIFT)) * _MIX
    return np.maximum(found ^ (found >> _SHIFT), np.uint64(1))


def hash_of(words: list[str]) -> np.ndarray:
    """Hashes of words that are given as strings, as ``hashes`` finds them in a text."""
    _, codes, starts = joined(words)
    return hashes(codes, starts[:-1], starts[1:] - 1)


class Table:
    """From 64-bit keys to numbers: open addressing in two arrays, many keys at a time."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there, wanted = self.keys[slot], keys[left]
            hit = there == wanted
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (there != 0)
            left, slot = left[more], slot[more]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and new."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = self.keys != 0
            old = self.keys[held], self.values[held]
            while 2 * (self.size + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.size = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0
            self.add(*old)
        self.size += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            own = free & (self.keys[slot] == keys)  # of keys that meet in a free slot the last one has it
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & (len(self.keys) - 1)
