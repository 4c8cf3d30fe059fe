"""Deep-shallow sorting of suffixes that are read to a fixed depth.

Multikey quicksort orders suffixes by their first ``shallow`` words of eight bytes, one word as one character: every round splits
all open segments at once into smaller, equal and larger, and only the equal part moves on to the next word. What is still together
then shares a long prefix, where comparing from the front would read the same bytes over and over: those groups go into
blind tries, which store branching positions alone, look at one suffix in full per insertion, and give the order by a walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORD = 8
SHALLOW = 3


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes, a multiple of eight wide, as big-endian words, so that words compare as bytes do."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def _quicksort(words: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, ends): rows in order of their first words; the bounds of groups that agree in all of them."""
    order = np.arange(len(words))
    start, end, depth = (np.array([x], np.int64) for x in (0, len(words), 0))
    groups: list[tuple[np.ndarray, np.ndarray]] = []
    while len(start):
        keep = end - start > 1
        start, end, depth = start[keep], end[keep], depth[keep]
        deep = depth == shallow
        groups.append((start[deep], end[deep]))
        start, end, depth = start[~deep], end[~deep], depth[~deep]
        if not len(start):
            break
        size = end - start
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(start)), size)
        place = np.arange(int(size.sum())) - first[segment] + start[segment]
        row = order[place]
        key = words[row, depth[segment]]
        three = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)
        pivot = three[1][segment]
        lower, same = key < pivot, key == pivot
        n_lower, n_same = np.add.reduceat(lower, first, dtype=np.int64), np.add.reduceat(same, first, dtype=np.int64)

        def nth(mask: np.ndarray, first: np.ndarray = first, segment: np.ndarray = segment) -> np.ndarray:
            """How many before a row, within its segment, are in the mask."""
            before = np.cumsum(mask) - mask
            return before - before[first][segment]

        at = np.where(lower, nth(lower), np.where(same, n_lower[segment] + nth(same), (n_lower + n_same)[segment] + nth(~lower & ~same)))
        order[start[segment] + at] = row
        start, end, depth = (
            np.concatenate([start, start + n_lower, start + n_lower + n_same]), np.concatenate([start + n_lower, start + n_lower + n_same, end]),
            np.concatenate([depth, depth + 1, depth]),
        )
    return order, np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    return len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class BlindTrie:
    """Strings of one width in a trie of branching positions: a node is [position, children by byte], a leaf the numbers of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [0]
        for k in range(1, len(strings)):
            self.insert(k)

    def insert(self, k: int) -> None:
        s, node = self.strings[k], self.root
        while isinstance(node[-1], dict):  # blindly: bytes between branching positions are not looked at
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = self.strings[node[0]]
        if s == t:
            node.append(k)
            return
        at = _common(s, t)
        node, parent = self.root, None
        while isinstance(node[-1], dict) and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node[-1], dict) and node[0] == at:
            node[1][s[at]] = [k]
            return
        fresh = [at, {t[at]: node, s[at]: [k]}]
        if parent is None:
            self.root = fresh
        else:
            parent[1][s[parent[0]]] = fresh

    def ordered(self) -> Iterator[int]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[-1], dict):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield from node


def sort(rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the rows (bytes, a multiple of eight wide), equal rows in any order."""
    words = as_words(rows)
    shallow = min(shallow, words.shape[1])
    order, starts, ends = _quicksort(words, shallow)
    if shallow < words.shape[1]:
        rest, width = np.ascontiguousarray(rows[:, shallow * WORD :]), rows.shape[1] - shallow * WORD
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            group = order[a:b]
            flat = rest[group].tobytes()
            trie = BlindTrie([flat[k : k + width] for k in range(0, len(flat), width)])
            order[a:b] = group[np.fromiter(trie.ordered(), np.int64, b - a)]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order; 0 for the first."""
    found = np.zeros(len(order), np.int64)
    step = 1 << 16
    for k in range(1, len(order), step):
        a, b = rows[order[k - 1 : k - 1 + step][: len(order) - k]], rows[order[k : k + step]]
        differ = a != b
        found[k : k + step] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return found
