"""Vectorised words of Arrow text batches, for use inside Spark tasks.

``slices`` cuts a batch into runs of documents of bounded bytes; ``words`` gives the words of such
a run as numpy arrays. A word's hash is a polynomial of its bytes modulo 2^64, taken from prefix
sums, and mixed; equal words have equal hashes in every task. Over long stretches such polynomials can be
made to collide whatever their base (by swaps in the order of the Thue-Morse sequence), so words of more than
``LONG`` bytes and whole texts are hashed by BLAKE2b, and polynomials only span few symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

#: Bytes of a word that is hashed by a digest.
LONG = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 16 * SLICE_BYTES:  # powers for a huge document are not kept
            _POWERS[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(members: bytes | range | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, letters and all
#: that is not ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Text(NamedTuple):
    """A run of documents: their UTF-8 bytes one after another, and where each begins."""
    data: np.ndarray
    offsets: np.ndarray

    def doc(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    """starts and ends in the data; hashes; first[i]:first[i + 1] are the words of document i."""
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """(low, high, Text) of rows low:high; null is empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high, Text(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high


def words(text: Text, of: np.ndarray = NOT_SPACE, mapped: np.ndarray | None = None) -> Words:
    """Words are maximal runs of bytes in ``of``; ``mapped`` is applied to bytes before hashing."""
    data, offsets = text
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = of[data]
    # a word starts where its byte is inside and the byte before it is not, or a document begins
    is_start = inside[1:-1] & ~inside[:-2]
    is_end = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    is_start[edges] = inside[1:-1][edges]
    is_end[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(is_start), np.flatnonzero(is_end) + 1
    values = (data if mapped is None else mapped[data]).astype(np.uint64) + np.uint64(1)
    hashes = spans(values, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    hashes = mixed(hashes)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        word = data[starts[i]:ends[i]]
        hashes[i] = np.frombuffer(hashlib.blake2b((word if mapped is None else mapped[word]).tobytes(), digest_size=8).digest(), np.uint64)[0]
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, not yet mixed. For short spans only."""
    return between(prefix_sums(values, base), starts, ends, base)


def prefix_sums(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """The sums that :func:`between` takes the hashes of spans from."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n + 1)[:n], out=sums[1:])
    return sums


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    back = _powers(pow(base, -1, 1 << 64), len(sums))
    return (sums[ends] - sums[starts]) * back[starts]


def grams(hashes: np.ndarray, first: np.ndarray, k: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run of k words within a document."""
    n = np.diff(first)
    at = np.arange(len(hashes))
    starts = at[at + k <= np.repeat(first[1:], n)] if len(hashes) else at
    return starts, mixed(spans(hashes, starts, starts + k, base) + np.uint64(k))
