"""Vectorised text primitives shared by the corpus operators.

A *word* is a maximal run of characters other than U+0020 and U+0009..U+000D, which is what the pattern
``[^\\x20\\x09-\\x0D]+`` matches. Texts are handled as arrays of code points, several short texts at a time, so
that the cost per text is a fraction of a Python loop over its words and memory stays near ``CHUNK_CHARS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are concatenated until they reach this many code points; one longer text is a chunk of its own.
CHUNK_CHARS = 1 << 18

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_R33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _R33)
    x = x * _M1
    x = x ^ (x >> _R33)
    x = x * _M2
    return x ^ (x >> _R33)


_powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(255, _BASE, np.uint64)]))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE, np.uint64)]))
    return _powers


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunked(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Texts in order (null as empty), grouped so that a group has about ``limit`` characters."""
    group: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield group


class Words:
    """Words of a group of texts: 64-bit hashes, code-point bounds, and the slice that each text owns."""

    __slots__ = ("codes", "starts", "ends", "hashes", "first", "texts")

    def __init__(self, group: list[str], lower_ascii: bool = False):
        codes = code_points("\n".join(group))
        if lower_ascii:
            codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
        inside = np.empty(len(codes) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
        edge = np.diff(inside)
        self.codes, self.texts = codes, len(group)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = self.ends - self.starts
        if len(lengths):
            # every code point weighs a power of the base by its place in the word; a word's sum is its polynomial hash
            offset = np.cumsum(np.concatenate([[0], lengths]))[:-1]
            at = np.arange(int(lengths.sum())) - np.repeat(offset, lengths)
            chars = codes[inside[1:-1].astype(bool)].astype(np.uint64) + np.uint64(1)
            self.hashes = mix64(np.add.reduceat(chars * _power_table(int(lengths.max()) + 1)[at], offset) + lengths.astype(np.uint64))
        else:
            self.hashes = np.empty(0, np.uint64)
        bounds = np.cumsum([0] + [len(t) + 1 for t in group])
        self.first = np.searchsorted(self.starts, bounds)

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            yield self.hashes[a:b]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; of the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    out = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        out = mix64(out * _BASE + hashes[k : len(hashes) - width + 1 + k])
    return out
