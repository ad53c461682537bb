"""Word shingles as 64-bit hashes, in arrays over whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_BYTE[0]) | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 21), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def by_bytes(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, for bounded working arrays."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words cut at ASCII white space.

    A text of fewer words than ``width`` has its whole sequence as one shingle; one without words none.
    """
    out: list[np.ndarray] = []
    for a, b in by_bytes(texts):
        part = [t.lower() for t in texts[a:b]]
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        up, down = _powers(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])])
        words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULTIPLIER)
        at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        if len(words) >= width:
            n = len(words) - width + 1
            whole = words[:n] * _PLACE[0]
            for k in range(1, width):
                whole = whole + words[k : n + k] * _PLACE[k]
            whole = mix(whole)
        for i, j in zip(at, at[1:], strict=False):
            if j - i >= width:
                out.append(np.unique(whole[i : j - width + 1]))
            elif j > i:
                out.append(mix((words[i:j] * _PLACE[8 : 8 + j - i]).sum(keepdims=True) + np.uint64(j - i)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fast_similarity_sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of ``t`` coordinates per set; the probability that a coordinate of two sets agrees is their similarity.

    In round i < t every element falls into a hashed bin; in round t + b all
    elements fall into bin b, so no bin stays empty.  A bin keeps the least value
    of the first round that reaches it.  An empty set keeps the largest value.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), none, np.uint64)
    flat = out.reshape(-1)
    sizes = [len(s) for s in sets]
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items ^ mix(np.array([i + 1], np.uint64) * _MULTIPLIER))
        h[h == none] -= np.uint64(1)
        at = owner * t + ((h % np.uint64(t)).astype(np.int64) if i < t else i - t)
        free = flat[at] == none
        np.minimum.at(flat, at[free], h[free])
        waiting = (out == none).any(1)[owner]
        items, owner = items[waiting], owner[waiting]
    return out


def band_hashes(sketches: np.ndarray, bands: int) -> np.ndarray:
    """Signed 64-bit hash of each of ``bands`` equal parts of each sketch; the number of the band is part of it."""
    n, t = sketches.shape
    parts = sketches.reshape(n, bands, t // bands)
    h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _MULTIPLIER
    for k in range(t // bands):
        h = mix(h + parts[:, :, k] * _PLACE[16 + k])
    return h.view(np.int64)
