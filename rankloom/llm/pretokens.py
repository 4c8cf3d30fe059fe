"""Byte-level BPE over a cache of pre-tokens.

Byte-level BPE merges inside each match of the split pattern only, so a text's ids are the ids of its pre-tokens
in order. Each distinct pre-token is encoded once by the library and kept as packed little-endian 32-bit ids, in a cache of
bounded size that a Python worker keeps between its tasks.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Pre-tokens of one generation; a worker keeps the current and the last one, about 200 bytes each.
CACHE = 600_000

# For texts of white space, printable ASCII and Latin letters alone, the classes of the public pattern can be spelled out, and
# matching takes a third of the time.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile("[^\t\n\x0b\x0c\r -~À-ɏ]").search
_SPELLED_OUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall
_ASSIGNABLE = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
#: The classes of the public pattern.
_CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def tiktoken_members(pattern: str) -> str:
    """The characters that the tiktoken library's matcher finds by a pattern: what does not match gives no ids."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(_ASSIGNABLE)).decode()


def tokenizers_members(pattern: str) -> str:
    """The characters that the tokenizers library's matcher finds by a pattern."""
    from tokenizers import Regex, pre_tokenizers

    left = pre_tokenizers.Split(Regex(pattern + "+"), "removed").pre_tokenize_str(_ASSIGNABLE)
    out, at = [], 0
    for _, (start, end) in left:
        out.append(_ASSIGNABLE[at:start])
        at = end
    return "".join([*out, _ASSIGNABLE[at:]])


def class_of(members: str) -> str:
    """The inside of a bracket expression with these characters, which come in order."""
    codes, out = [*map(ord, members)], []
    starts = [k for k in range(len(codes)) if not k or codes[k] != codes[k - 1] + 1]
    for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
        out.append(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}")
    return "".join(out)


@lru_cache(maxsize=2)
def public_split(members: Callable[[str], str]) -> Callable[[str], list[str]]:
    """Matches of the public split pattern, whose letters, numbers and white space are those of the library that ``members`` asks.

    The libraries follow different versions of Unicode, and ids depend on them.
    """
    letters, numbers, space = (class_of(members(c)) for c in _CLASSES)
    whole = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    return lambda text: whole(text) if _OTHER(text) else _SPELLED_OUT(text)


class Pieces(dict):
    """Pre-token to packed ids. A new one comes from the last generation or is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.last = encode, {}

    def __missing__(self, part: str) -> bytes:
        packed = self.last.get(part)
        if packed is None:
            packed = array("I", self.encode(part)).tobytes()
        self[part] = packed
        return packed

    def renew(self) -> None:
        self.last = dict(self)
        self.clear()


class PackedEncoder:
    """Texts to packed ids, by an ``encode`` that maps a pre-token to its ids.

    ``special`` maps strings to ids of their own: a text is cut at them first, the longest of those that start at a place.
    """

    def __init__(self, encode: Callable[[str], list[int]], members: Callable[[str], str], cache: int = CACHE, special: dict[str, int] | None = None):
        self.split, self.known, self.cache = public_split(members), Pieces(encode), cache
        self.special = {s: k.to_bytes(4, "little") for s, k in (special or {}).items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if special else None

    def __call__(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.known) > self.cache:
            self.known.renew()
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.known.__getitem__, self.split(text)))
        parts = self.cut.split(text)  # every second one is special
        return b"".join(self.special[p] if k % 2 else b"".join(map(self.known.__getitem__, self.split(p))) for k, p in enumerate(parts) if p)


@lru_cache(maxsize=4)
def tokenizers_encoder(path: str, ordinary: bool = False) -> PackedEncoder:
    """For a byte-level tokenizer file of the tokenizers library, as it encodes without adding special tokens.

    Strings of special tokens in a text get their ids, as the library gives them; with ``ordinary`` they are text like any other.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {} if ordinary else tokenizer.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        raise ValueError("special tokens that take characters around them are not supported")
    tokenizer.encode_special_tokens = True  # within the parts
    return PackedEncoder(lambda part: tokenizer.encode(part, add_special_tokens=False).ids, tokenizers_members, special={t.content: k for k, t in added.items()})
