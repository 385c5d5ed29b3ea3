"""Order MinHash sketches, shared by the fingerprint and near-duplicate operators.

Items (k-mers of characters or words, as 64-bit hashes in text order) get an
occurrence number, so that a repeated k-mer counts as often as it occurs.  A
sketch keeps, per bin or hash function, the few labelled items with the
smallest hash, puts them back in text order, and hashes that tuple: two texts
agree on an entry when they share the items *and* their order, which follows
edit distance rather than set overlap.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)  # splitmix64's fixed multipliers
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that scatters 64-bit values."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def kmers(items: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` items; shorter inputs are one window."""
    items = items.astype(np.uint64)
    n = len(items)
    if n == 0:
        return items
    k = min(k, n)
    h = items[:n - k + 1] + _U(1)
    for i in range(1, k):
        h = h * _GOLD + (items[i:n - k + 1 + i] + _U(1))
    return mix(h + _U(k))


def label(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number), numbered in text order."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(n, dtype=bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return mix(h)
    at = np.arange(n)
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty(n, dtype=np.uint64)
    out[order] = mix(s + occurrence.astype(np.uint64) * _GOLD)
    return out


def binned_sketch(h: np.ndarray, bins_log2: int, picks: int) -> np.ndarray:
    """One 32-bit entry per bin: labelled items fall into bins by their hash,
    the ``picks`` smallest of a bin form its tuple.  0 marks an empty bin."""
    bins = 1 << bins_log2
    out = np.zeros(bins, dtype=np.uint32)
    if len(h) == 0:
        return out
    g = label(h)
    # Only small hashes can be picked: look at about 12 a bin first.
    per_bin = len(h) / bins
    if per_bin > 24:
        low = (g << _U(bins_log2)) < _U(int(12 / per_bin * 2.0 ** 64))
        some = np.flatnonzero(low)
        if (np.bincount((g[some] >> _U(64 - bins_log2)).astype(np.int64), minlength=bins) < picks).any():
            some = np.arange(len(g))
    else:
        some = np.arange(len(g))
    some = some[np.argsort(g[some], kind="stable")]
    of = (g[some] >> _U(64 - bins_log2)).astype(np.int64)
    start = np.searchsorted(of, np.arange(bins))
    end = np.searchsorted(of, np.arange(bins), side="right")
    rows = start[:, None] + np.arange(picks)[None]
    real = rows < end[:, None]
    position = np.where(real, some[np.minimum(rows, len(some) - 1)], len(h))
    position.sort(axis=1)
    item = np.where(position < len(h), h[np.minimum(position, len(h) - 1)], _U(0))
    entry = np.zeros(bins, dtype=np.uint64)
    for i in range(picks):
        entry = mix(entry * _GOLD + item[:, i])
    entry = (entry >> _U(32)).astype(np.uint32)
    return np.where(end > start, np.maximum(entry, 1), 0).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, over bins that are not empty in both; 1 if all are."""
    used = (a != 0) | (b != 0)
    return float((a == b)[used].mean()) if used.any() else 1.0
