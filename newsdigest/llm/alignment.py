"""Longest common subsequence of two integer sequences in a band, bit-parallel."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence


def banded_common(a: Sequence[int], b: Sequence[int], band: int) -> int:
    """Length of the longest common subsequence of a and b whose matches (i, j) keep to
    ``-band <= j - i - shift <= band``, shift taking up the difference in length (the band holds
    both corners). A bit of ``row`` is 0 where the length grows at that word of b; one row of the
    alignment is a few operations on one integer as wide as the band. Equal ends are cut off first."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head:n - tail], b[head:m - tail]
    if not a or not b:
        return head + tail
    low, high = min(0, len(b) - len(a)) - band, max(0, len(b) - len(a)) + band
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    # only the places of b in the band of the current word are held: bit k is place at + k
    width = high - low + 1
    full = row = (1 << width) - 1
    at, length = low, 0
    for i, x in enumerate(a):
        found = places.get(x)
        if found is None:
            continue
        begin = i + low
        first = bisect_left(found, begin)
        match = 0
        for j in found[first:bisect_left(found, begin + width, first)]:
            match |= 1 << (j - begin)
        if not match:
            continue
        if begin > at:  # places that the band has left keep what they are
            gone = min(begin - at, width)
            length += gone - (row & ((1 << gone) - 1)).bit_count()
            row = (row >> gone | full << (width - gone)) & full
            at = begin
        hit = row & match
        row = ((row + hit) | (row - hit)) & full
    return head + tail + length + width - row.bit_count()
