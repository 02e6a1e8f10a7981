"""SuperMinHash signatures (O. Ertl, 2017), vectorised over the elements of many sets.

Every element of a set draws a pseudo-random permutation of the signature's positions, one Fisher-Yates step at a
time.  At step ``k`` it offers ``k + r`` (r uniform in [0, 1)) to the position drawn; a position keeps its least offer.
The offers of one element are correlated ranks, which lowers the variance of the estimate against independent
minima.  A set stops as soon as its greatest kept value is below ``k``: later steps cannot change it.
"""

from __future__ import annotations

import numpy as np

from .wordhash import mix

_GOLDEN = 0x9E3779B97F4A7C15
_FRACTION = 24


def signatures(elements: np.ndarray, ptr: np.ndarray, m: int) -> np.ndarray:
    """uint32 array (sets, m): step in the upper 8 bits, fraction in the lower 24.  An empty set keeps 0xFFFFFFFF."""
    n = len(ptr) - 1
    sig = np.full(n * m, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(ptr))
    state, perm = elements, None
    live = np.arange(len(elements))
    for k in range(m):
        if not len(live):
            break
        bits = mix(state[live] + np.uint64((_GOLDEN * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
        rank = (np.uint32(k) << np.uint32(_FRACTION)) | (bits & np.uint64(0xFFFFFF)).astype(np.uint32)
        draw = k + ((bits >> np.uint64(32)) * np.uint64(m - k) >> np.uint64(32)).astype(np.int64)
        if k == 0:
            position, first = draw, draw
        else:
            row = np.arange(len(live))
            position = perm[row, draw].astype(np.int64)
            perm[row, draw] = perm[row, k]
        np.minimum.at(sig, owner[live] * m + position, rank)
        if k + 1 == m:
            break
        open_sets = sig.reshape(n, m).max(axis=1) >= np.uint32(k + 1) << np.uint32(_FRACTION)
        keep = open_sets[owner[live]]
        live = live[keep]
        if k == 0:
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(live), 1))
            at = first[keep]
            row = np.arange(len(live))
            perm[row, at] = 0
        else:
            perm = perm[keep]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One uint64 key for each band of ``rows`` positions; the band number is part of the key."""
    n, m = sig.shape
    parts = sig[:, : m // rows * rows].reshape(n, m // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * np.uint64(0x1F3D5B79), (n, m // rows)).copy()
    for i in range(rows):
        key = mix(key * np.uint64(3) + parts[:, :, i])
    return key
