"""Splitting text into pre-tokens exactly as a tokenizer library does.

The libraries carry Unicode tables of different ages. The character classes are
therefore read from the library itself, once on the driver, and compiled into a
pattern of explicit ranges, so that the split on the executors cannot drift.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Texts longer than this are split lazily, so that a huge text never becomes one list.
LAZY_CHARS = 1 << 20
LAZY_PIECES = 1 << 16

_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_PLANES = [(0, 0xD800), *((a, min(a + 0x8000, 0x110000)) for a in range(0xE000, 0x110000, 0x8000))]


def _all_chars() -> Iterator[str]:
    for start, end in _PLANES:
        yield "".join(map(chr, range(start, end)))


@lru_cache(maxsize=None)
def classes(library: str) -> tuple[frozenset, frozenset, frozenset]:
    """Code points that ``library`` takes for letters, numbers and white space."""
    return tuple(frozenset(_members(library, c)) for c in (r"\p{L}", r"\p{N}", r"\s"))


def _members(library: str, cls: str) -> set[int]:
    out: set[int] = set()
    if library == "tiktoken":
        # with byte ranks only, encoding returns the bytes of what the pattern matches
        probe = tiktoken.Encoding("probe", pat_str=f"{cls}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        for chars in _all_chars():
            out.update(map(ord, bytes(probe.encode_ordinary(chars)).decode()))
        return out
    split = pre_tokenizers.Split(Regex(f"{cls}+"), "removed", invert=True)
    for chars in _all_chars():
        for piece, _ in split.pre_tokenize_str(chars):
            out.update(map(ord, piece))
    return out


def _ranges(members: frozenset, top: int) -> str:
    out, start, last = [], None, None
    for code in sorted(c for c in members if c <= top):
        if last is None or code != last + 1:
            if start is not None:
                out.append((start, last))
            start = code
        last = code
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def pattern_sources(library: str) -> tuple[str, str]:
    """The split pattern with explicit ranges: for texts within the basic plane, and for all texts."""
    out = []
    for top in (0xFFFF, 0x10FFFF):
        letter, number, space = (_ranges(members, top) for members in classes(library))
        out.append(
            rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            rf"|[{space}]+(?![^{space}])|[{space}]+"
        )
    return out[0], out[1]


class Splitter:
    """Lists the pre-tokens of a text; built from :func:`pattern_sources`, which are small enough to broadcast."""

    def __init__(self, sources: tuple[str, str]) -> None:
        self.basic, self.full = map(re.compile, sources)

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens in order, in lists of bounded length."""
        pattern = self.full if _ASTRAL.search(text) else self.basic
        if len(text) <= LAZY_CHARS:
            yield pattern.findall(text)
            return
        block: list[str] = []
        for match in pattern.finditer(text):
            block.append(match.group())
            if len(block) == LAZY_PIECES:
                yield block
                block = []
        yield block


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 upwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class PieceEncoder:
    """Encodes many pre-tokens with one call of the library.

    Pre-tokens are joined by the character of byte 0xFF, which no UTF-8 text holds, and
    the library splits them there again; the word number of each token tells its pre-token.
    """

    MARK = byte_alphabet()[0xFF]
    #: Pre-tokens joined for one call.
    STEP = 4_000

    def __init__(self, definition: str) -> None:
        self.library = Tokenizer.from_str(definition)
        self.library.pre_tokenizer = pre_tokenizers.Split(self.MARK, "removed")
        self.library.no_truncation()
        self.library.no_padding()
        self.table = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})

    def shown(self, pieces: list[str]) -> str:
        """Pre-tokens in the library's alphabet, joined by the mark."""
        return b"\xff".join([p.encode() for p in pieces]).decode("latin-1").translate(self.table)

    def ids(self, pieces: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """``(pieces, ids, stops)`` for stretches of the pre-tokens: their ids in a row, and where each one's end."""
        for s in range(0, len(pieces), self.STEP):
            part = pieces[s : s + self.STEP]
            coded = self.library.encode(self.shown(part), add_special_tokens=False)
            ids, word = coded.ids, coded.word_ids
            yield part, np.array(ids, np.uint32), np.searchsorted(np.array(word, np.int64), np.arange(len(part)), "right")


class Memory:
    """What a worker has learned of pre-tokens, in two generations of ``size`` each.

    When the young generation is full it becomes the old one; what is met again is
    carried over, so frequent pre-tokens are learned once.
    """

    def __init__(self, learn: Callable[[list[str]], Iterator[tuple[str, object]]], size: int) -> None:
        self.learn, self.size = learn, size
        self.young: dict = {}
        self.old: dict = {}

    def of(self, pieces: list[str]) -> Iterator:
        """What is known of each pre-token, in order."""
        unknown = set(pieces).difference(self.young)
        if unknown:
            if len(self.young) + len(unknown) > self.size:
                self.old, self.young = self.young, {}
                unknown = set(pieces)
            again = self.old.keys() & unknown
            self.young.update((p, self.old[p]) for p in again)
            self.young.update(self.learn(list(unknown - again)))
        return map(self.young.__getitem__, pieces)


_kept: dict = {}


def kept(key: object, build):
    """An object that a Python worker keeps from task to task; one for each kind, so that memory stays bounded."""
    name = build.__qualname__
    if _kept.get(name, (None,))[0] != key:
        _kept.pop(name, None)
        _kept[name] = (key, build())
    return _kept[name][1]
