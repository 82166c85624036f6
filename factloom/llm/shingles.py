"""Word and shingle hashes of whole Arrow batches, computed without a Python loop over words.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased. Its hash
is a polynomial of its bytes modulo 2^64, taken from running sums over the batch and
then mixed; a shingle's hash combines those of its words. Two different shingles share
a 64-bit hash with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed at once. A longer text is cut at white space.
STEP = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_FACTORS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[0x41:0x5B] += np.uint64(0x20)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, STEP + 1), base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in ``raw``; a word never crosses one of ``breaks``."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _tables(n + 1)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[breaks] = True
    edge[[0, n]] = True
    edge[1:] |= space
    edge[:-1] |= space
    starts = np.flatnonzero(~space & edge[:-1])
    ends = np.flatnonzero(~space & edge[1:]) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text in order; nulls are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    nulls = np.asarray(texts.is_null())
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1)
        begin, end = offsets[row], offsets[last]
        if end - begin > STEP:  # one long text
            yield np.concatenate(list(_long(raw[begin:end]))) if not nulls[row] else np.zeros(0, np.uint64)
        else:
            bounds = offsets[row : last + 1] - begin
            hashes, starts = _hash_words(raw[begin:end], bounds)
            cuts = np.searchsorted(starts, bounds)
            for k in range(last - row):
                yield hashes[cuts[k] : cuts[k + 1]] if not nulls[row + k] else hashes[:0]
        row = last


def cut_at_space(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of a text of about ``STEP`` bytes; a word is never cut, however long it is."""
    while len(raw) > STEP:
        gaps = np.flatnonzero(_SPACE[raw[:STEP]])
        cut = int(gaps[-1]) + 1 if len(gaps) else STEP + int((np.flatnonzero(_SPACE[raw[STEP:]])[:1] + 1).sum() or len(raw) - STEP)
        yield raw[:cut]
        raw = raw[cut:]
    yield raw


def _long(raw: np.ndarray) -> Iterator[np.ndarray]:
    none = np.zeros(0, np.int64)
    for piece in cut_at_space(raw):
        yield _hash_words(piece, none)[0]


def shingle_sequence(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the runs of ``width`` words; fewer words, but not none, are one shingle."""
    if len(words) == 0:
        return words
    if len(words) < width:
        out = np.array([len(words)], np.uint64)
        for word in words:
            out = mix(out * _FACTORS[0] + word)
        return out
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out) if k >= len(_FACTORS) else out
        out = out + words[k : k + n] * _FACTORS[k % len(_FACTORS)]
    return mix(out)


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_sequence(words, width))
