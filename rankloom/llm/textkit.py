"""Vectorised text helpers shared by the operators: byte views, words and hashes of whole Arrow batches.

All of them work on the UTF-8 bytes of many texts at once, in pieces of a few MB, so that temporary arrays
stay small whatever the batch size. A single text is never cut; a piece holds one text at least.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 512 << 10

#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z are lower-cased).
ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes go through a cryptographic hash, one by one.
_LONG = 256
#: The low bytes of an eight-byte word, by their number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end and the n + 1 offsets; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_large_binary(texts.type) and not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES):
    """Ranges of texts of at most `most` bytes together, or one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def text_pieces(texts: pa.Array, most: int = PIECE_BYTES):
    """(first text, bytes, offsets from 0) of each piece."""
    data, offsets = view(texts)
    for lo, hi in pieces(offsets, most):
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the n + 1 offsets of each text's words."""
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if len(data):
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def _stir(x: np.ndarray) -> np.ndarray:
    """Another 64-bit finaliser, unrelated to mix()."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_pairs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unrelated 64-bit hashes of each word's bytes, eight bytes at a time, each step a bijection of the eight; no polynomial of the
    bytes, whose collisions could be written down."""
    size = stops - starts
    padded = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    wide = padded.view("<u8")
    one, two = mix(size.astype(np.uint64) * _K1 + _K2), _stir(size.astype(np.uint64) * _K3 + _K1)
    live, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        begin, left = starts[live] + at, size[live] - at
        shift, place = (begin & 7).astype(np.uint64) << np.uint64(3), begin >> 3
        part = wide[place] >> shift | (wide[place + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        part &= _LOW[np.minimum(left, 8)]
        one[live], two[live] = mix(one[live] ^ part * _K1), _stir((two[live] + part) * _K3)
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > _LONG).tolist():
        one[i], two[i] = np.frombuffer(hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=16).digest(), np.uint64)
    return one, two


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    one, two = word_pairs(data, starts, stops)
    return one ^ two * _K2


def window_hashes(words_: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, from both hashes of its words, of every run of k words within one text, and the n + 1 offsets of each text's windows."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=at[1:])
    n = max(len(words_[0]) - k + 1, 0)
    if not at[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at
    sums = []
    for hashes, by in zip(words_, (_K1, _K2)):
        total = hashes[:n].copy()
        for j in range(1, k):
            total *= by
            total += hashes[j : n + j]
        sums.append(total)
    first = np.repeat(offsets[:-1] - at[:-1], counts) + np.arange(at[-1])
    a, b = sums[0][first], sums[1][first]
    return mix(a ^ (b << np.uint64(32) | b >> np.uint64(32))), _stir(b + a * _K3), at


def word_array(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: np.ndarray) -> pa.Array:
    """All words of `kind`, as words() finds them, as an Arrow binary array."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind[data]])])


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start .. start + size - 1 of every span, end to end."""
    at = np.cumsum(sizes) - sizes
    return np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))
