"""SuperMinHash signatures of element sets, and their bands.

Each element has a pseudo-random permutation of the m slots (a Fisher-Yates shuffle driven
by a counter-based hash) and offers slot ``p[j]`` the value ``j + r`` with r uniform in
[0, 1). A slot keeps the least offer of all elements. Ranks of one element are correlated
(it offers each slot a different j), which lowers the variance of the share of equal slots
against independent minima. Offers of rank j are at least j, so the work ends at the first
rank at which no slot is open: about m ln(m) / n ranks for n elements.

All elements of many sets advance together, one rank at a time, in numpy. A set of more than
``CHUNK`` elements goes through in slices against its running minima (a least offer is the
least of the slices' least offers), so memory does not grow with a set; later slices end at
the first ranks, as no slot is open there.
"""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)
CHUNK = 8192


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _lower(h: np.ndarray, elements: np.ndarray, owner: np.ndarray, m: int) -> None:
    """The minima h (sets, m), lowered in place by the offers of the elements of their sets."""
    distinct, of = np.unique(elements, return_inverse=True)
    flat = h.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.int32), (len(distinct), 1))
    lane = np.arange(len(distinct))
    base = owner * m
    with np.errstate(over="ignore"):
        for j in range(m):
            if j % 8 == 0:
                unfinished = (h >= j).any(axis=1)
                if not unfinished.any():
                    break
                keep = unfinished[owner]
                if keep.mean() < 0.7:
                    owner, of = owner[keep], of[keep]
                    used, of = np.unique(of, return_inverse=True)
                    distinct, perm, base = distinct[used], perm[used], owner * m
                    lane = np.arange(len(distinct))
            z = mix64(distinct + np.uint64(j + 1) * _STEP)
            k = j + (((z & _LOW) * np.uint64(m - j)) >> _SHIFT).astype(np.int64)
            slot = perm[lane, k]
            perm[lane, k] = perm[:, j]
            at = base + slot[of]
            open_ = np.flatnonzero(flat[at] >= j)
            if len(open_):
                offer = (z >> _SHIFT).astype(np.float64) * 2.0**-32 + j
                np.minimum.at(flat, at[open_], offer[of[open_]])


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The m-slot signature of each (non-empty) set of 64-bit hashes."""
    out = np.full((len(sets), m), np.inf)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    i = 0
    while i < len(order):
        total, j = 0, i
        while j < len(order) and (j == i or total + sizes[order[j]] <= CHUNK):
            total += sizes[order[j]]
            j += 1
        part = order[i:j]
        h = np.full((len(part), m), np.inf)
        if len(part) > 1 or total <= CHUNK:
            _lower(h, np.concatenate([sets[x] for x in part]).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(part)), sizes[part]), m)
        else:
            whole = np.asarray(sets[part[0]], np.int64).view(np.uint64)
            for first in range(0, total, CHUNK):
                some = whole[first : first + CHUNK]
                _lower(h, some, np.zeros(len(some), np.int64), m)
        out[part] = h
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int, seed: int = 0) -> np.ndarray:
    """A 64-bit key for each band of each signature: (sets, bands), as int64."""
    bits = np.ascontiguousarray(signature[:, : bands * rows]).view(np.uint64).reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64((np.arange(bands, dtype=np.uint64) + np.uint64(1 + 4096 * seed)) * _STEP), bits.shape[:2])
        for i in range(rows):
            key = mix64(key ^ bits[:, :, i])
    return key.view(np.int64)
