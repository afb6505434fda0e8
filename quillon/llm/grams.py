"""Word n-grams of whole Arrow columns as 64-bit hashes, without a Python step for each word.

A word is a run of ASCII letters and digits and of any characters beyond ASCII, in lower case; all else separates words.
The hash of a word is a polynomial of its bytes, that of an n-gram one of the mixed hashes of its words. A text with
fewer than n words, but at least one, has one n-gram: all of it. A text without words, or null, has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer text counts as a whole).
SLICE_BYTES = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C55)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that makes all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with at most so many bytes in sum, or one row: where each begins, and the rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    a, before = 0, 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, texts.slice(a, b - a)
        a, before = b, int(ends[b - 1])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after the other, and where each row begins and the last one ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all rows, and the row of each."""
    data, offsets = buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1]
    rows = rows[rows < len(data)]
    first[rows] |= inside[rows]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    kept = data[inside].astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(first[inside])
    lengths = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, lengths)
    hashes = mix(np.add.reduceat(kept * _powers(int(lengths.max()))[place], at))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each row the sorted, different hashes of its n-grams."""
    out: list[np.ndarray] = []
    for _, part in slices(texts):
        words, rows = word_hashes(part)
        bounds = np.searchsorted(rows, np.arange(len(part) + 1))
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for k in range(n):
            grams = grams * _STEP + words[k : len(words) - n + 1 + k]
        grams = mix(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                one = np.sort(grams[a : b - n + 1])
                out.append(one[np.append(True, one[1:] != one[:-1])])
            elif b > a:
                one = np.zeros(1, dtype=np.uint64)
                for w in words[a:b]:
                    one = one * _STEP + w
                out.append(mix(one))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
