"""Suffix order and threshold-bounded interval expansion on a Burrows-Wheeler transform, in numpy.

``repeated_starts`` tells for each position of a byte string whether the next
``least`` bytes also start elsewhere in it.  The common prefixes of neighbouring
suffixes come in increasing value from a breadth-first backward extension on the
transform: the intervals of all strings of length l are extended to the left by
each character found in them; the right border of an extended interval that no
shorter string has set gets the value l, and only such intervals are extended
further.  At l = least the expansion stops: the borders still unset have at
least that long a common prefix.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` symbols at least, by prefix doubling; symbols are below 512."""
    n = len(s)
    known = 7  # symbols of 9 bits in a first key
    padded = np.concatenate([s, np.zeros(known, s.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(known):
        key = key << np.uint64(9) | padded[k : n + k]
    order = np.argsort(key)
    starts = np.ones(n, bool)  # whether a row differs from the row before
    starts[1:] = key[order[1:]] != key[order[:-1]]
    while True:
        # rows that share their symbols with a neighbour; all others have their place
        open_rows = np.flatnonzero(~(starts & np.append(starts[1:], True)))
        if known >= depth or not len(open_rows):
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(starts)
        at = order[open_rows]
        after = at + known
        key = rank[at] << 32
        inside = after < n
        key[inside] |= rank[after[inside]]
        within = np.argsort(key)
        order[open_rows] = at[within]
        key = key[within]
        starts[open_rows[1:]] |= key[1:] != key[:-1]
        known *= 2


def borders(s: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For rows 0..n of the suffix order, whether a row's common prefix with the row before is below ``least``."""
    n = len(s)
    last = s[order - 1]
    by_char = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)  # the row of a row's suffix with one more byte to the left
    step[by_char] = np.arange(n)
    same = last[by_char][1:] == last[by_char][:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)  # nearest rows with the same byte to the left
    before[by_char[1:][same]] = by_char[:-1][same]
    after[by_char[:-1][same]] = by_char[1:][same]
    is_set = np.zeros(n + 1, bool)
    is_set[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(least):
        if not len(low):
            break
        single = low == high
        alone = step[low[single]]
        low, high = low[~single], high[~single]
        if len(low):
            sizes = high - low + 1
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(low)), sizes)
            row = np.arange(ends[-1]) + np.repeat(low - ends + sizes, sizes)
            first, final = before[row] < low[owner], after[row] > high[owner]
            # within an interval, rows of `step` are in the order of the byte, so both sorts list the same bytes
            new_low = np.sort(owner[first] << 32 | step[row[first]]) & 0xFFFFFFFF
            new_high = np.sort(owner[final] << 32 | step[row[final]]) & 0xFFFFFFFF
            low, high = np.concatenate([alone, new_low]), np.concatenate([alone, new_high])
        else:
            low = high = alone
        fresh = ~is_set[high + 1]
        low, high = low[fresh], high[fresh]
        is_set[high + 1] = True
    return is_set


def repeated_starts(s: np.ndarray, least: int) -> np.ndarray:
    """Whether the ``least`` bytes from each position on occur from another position on too."""
    n = len(s)
    out = np.zeros(n + 1, bool)
    if n > least:
        ended = np.concatenate([s.astype(np.uint16) + np.uint16(1), np.zeros(1, np.uint16)])  # one end mark, below all bytes
        order = suffix_order(ended, least + 2)
        is_set = borders(ended, order, least)
        out[order] = ~(is_set[:-1] & is_set[1:])
    out[max(0, n - least + 1) :] = False
    return out[:n]
