"""Word and shingle hashes of whole texts, worked out over the bytes of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts hashed together, by bytes; a longer text is a part of its own.
PART_BYTES = 4_000_000
#: The same where shingles are made: hashing takes some 40 bytes per byte of text at once.
SHINGLE_BYTES = 500_000

_random = np.random.default_rng(20240611)
_LETTER = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(texts: pa.StringArray, most: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of the batch: first row, bytes, and where each row's bytes end."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, len(texts))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_starts(blank: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks the first byte of each word; ``blank`` tells the bytes that are between words, rows part words too."""
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = bounds[:-1][(bounds[:-1] < len(blank)) & (bounds[:-1] < bounds[1:])]
    begins[inner] |= ~blank[inner]
    return begins


def word_hashes(data: np.ndarray, bounds: np.ndarray, blanks: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per row the number of the first word (one more at the end)."""
    blank = blanks[data]
    begins = word_starts(blank, bounds)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    held = np.flatnonzero(~blank)
    # Which word each held byte is of, and its place in it.
    word = np.cumsum(begins)[held] - 1
    place = held - starts[word]
    powers = np.ones(int(place.max()) + 1, dtype=np.uint64)
    powers[1:] = _STEP
    terms = _LETTER[data[held]] * np.cumprod(powers)[place]
    first = np.searchsorted(held, starts)
    sums = np.add.reduceat(terms, first)
    sizes = np.diff(np.append(first, len(held))).astype(np.uint64)
    return mix(sums + sizes * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, bounds)


def shingles(texts: pa.StringArray, size: int) -> Iterator[np.ndarray]:
    """Per row the hashes of its runs of ``size`` words, repeats included; a shorter text is one run, a blank one none."""
    for _, data, bounds in parts(texts, SHINGLE_BYTES):
        words, firsts = word_hashes(data, bounds)
        full = len(words) - size + 1
        total = np.zeros(max(full, 0), dtype=np.uint64)
        for k in range(size if full > 0 else 0):
            total += words[k : k + full] * _PLACE[k]
        total = mix(total)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= size:
                yield total[a : b - size + 1]
            elif b > a:
                short = (words[a:b] * _PLACE[16 : 16 + b - a]).sum(keepdims=True, dtype=np.uint64)
                yield mix(short + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
