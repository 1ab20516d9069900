"""Word shingles of whole columns as 64-bit codes, computed over a batch's bytes at once.

A word's code is a polynomial over its bytes, taken as a difference of running sums; shingles mix the codes of
consecutive words.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slab of its own.
SLAB = 2 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijective mixing of 64-bit integers (murmur3's finalizer)."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: A value for each byte, as it is and with A-Z lowered.
EXACT = mix(np.arange(256, dtype=np.uint64) * STEP, 0x77)
VALUE = EXACT.copy()
VALUE[0x41:0x5B] = EXACT[0x61:0x7B]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, _INVERSE):
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def slabs(column: pa.Array, size: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row offsets) of runs of a string column's rows; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words between ASCII white space begin and end; a row's end ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = _SOLID[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    begins[heads], ends[tails] = solid[heads], solid[tails]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_sums(data: np.ndarray, s: np.ndarray, e: np.ndarray, values: np.ndarray = VALUE) -> np.ndarray:
    """The polynomial of each word: the sum of values[byte] * BASE ** (place in the word).  Running sums cover SLAB bytes
    at most; a longer word is digested."""
    out, at = np.zeros(len(s), np.uint64), 0
    while at < len(s):
        end = max(at + 1, int(np.searchsorted(e, s[at] + SLAB, side="right")))
        begin, part = s[at], data[s[at] : e[end - 1]]
        if len(part) > SLAB:
            digest = hashlib.blake2b(values[part].tobytes(), digest_size=8).digest()
            out[at] = np.frombuffer(digest, np.uint64)[0]
        else:
            power, inverse = powers(max(16, int(len(part)).bit_length()))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * power[: len(part)], out=sums[1:])
            out[at:end] = (sums[e[at:end] - begin] - sums[s[at:end] - begin]) * inverse[s[at:end] - begin]
        at = end
    return out


def codes_of(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(sums + length.astype(np.uint64) * STEP, 0)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words between ASCII white space, A-Z lowered, and where each row's words begin."""
    s, e = word_spans(data, offsets)
    return codes_of(span_sums(data, s, e), e - s), np.searchsorted(s, offsets)


def shingle_codes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row's runs of ``n`` words and where they begin; a row of fewer words is one run."""

    def chain(run: list[np.ndarray]) -> np.ndarray:
        code = mix(run[0], len(run))
        for j, w in enumerate(run[1:], 1):
            code = mix(code * STEP + w, j)
        return code

    lengths = np.diff(starts)
    count = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    whole = chain([words[j : len(words) - n + 1 + j] for j in range(n)]) if len(words) >= n else np.zeros(1, np.uint64)
    at = np.repeat(starts[:-1] - out[:-1], count) + np.arange(out[-1])
    codes = whole[np.minimum(at, len(whole) - 1)]
    for k in np.flatnonzero((lengths > 0) & (lengths < n)):
        codes[out[k]] = chain([words[i : i + 1] for i in range(starts[k], starts[k + 1])])[0]
    return codes, out


def distinct(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's codes sorted, without repeats, and where they begin.  ``codes`` is sorted in place."""
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        codes[a:b].sort()
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    first[starts[:-1][starts[:-1] < len(codes)]] = True
    return codes[first], np.concatenate([np.zeros(1, np.int64), np.cumsum(first)])[starts]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted codes of the distinct ``n``-word shingles of each text."""
    out = []
    for data, offsets in slabs(texts):
        codes, starts = distinct(*shingle_codes(*word_codes(data, offsets), n))
        out += np.split(codes, starts[1:-1]) if len(starts) > 1 else []
    return out
