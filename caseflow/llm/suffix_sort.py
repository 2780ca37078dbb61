"""Suffix sorting with a difference cover, in numpy.

Positions whose index modulo ``V`` lies in ``COVER`` are the sample: for any two
positions i, j some k < V makes both i + k and j + k sample positions. The
sample is ranked first. A bucket of suffixes is then sorted by its first
``HEAD`` bytes, and ties are settled by the ranks at i + k and j + k, without
comparing texts again however long the ties are. Ranks and order look ``depth``
bytes far.
"""

from __future__ import annotations

import functools

import numpy as np

V = 13
COVER = (0, 1, 3, 9)    # all differences modulo 13
HEAD = 16               # bytes, at least V


def _shifts():
    s = np.zeros((V, V), "int64")
    for i in range(V):
        for j in range(V):
            s[i, j] = next(k for k in range(V) if (i + k) % V in COVER and (j + k) % V in COVER)
    return s


SHIFT = _shifts()
IN_COVER = np.isin(np.arange(V), COVER)


def words(data: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte word at every position and one past the end; ``data`` (uint8)
    is read as if followed by zeros."""
    padded = np.concatenate([data, np.zeros(8, "uint8")])
    return np.ndarray((len(data) + 1,), ">u8", padded.tobytes(), strides=(1,)).astype("u8")


def _at(w: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return w[np.minimum(pos, len(w) - 1)]


def sample_ranks(w: np.ndarray, where: np.ndarray, depth: int) -> np.ndarray:
    """int32 rank at each sample position among ``where`` (boolean mask), by the next
    ``depth`` bytes (rounded up to words); equal strings share a rank. -1 elsewhere."""
    pos = np.flatnonzero(where & IN_COVER[np.arange(len(where)) % V])
    rank = np.full(len(where), -1, "int32")
    if not len(pos):
        return rank
    group = np.zeros(len(pos), "int64")
    order = np.arange(len(pos))
    tied = order.copy()   # the places of ``order`` that still tie
    for d in range(0, depth, 8):
        p = order[tied]
        key, g = _at(w, pos[p] + d), group[tied]
        o = np.lexsort((key, g))
        p, key, g = p[o], key[o], g[o]
        order[tied] = p
        new = np.ones(len(p), bool)
        new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        # a group is named by its first place, so names only grow finer
        first = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
        group[tied] = tied[first]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if not len(tied):
            break
    rank[pos[order]] = group
    return rank


@functools.lru_cache(maxsize=64)
def _network(size: int) -> tuple:
    """Odd-even merge sort of ``size`` (a power of two) items: stages of disjoint pairs."""
    stages, p = [], 1
    while p < size:
        k = p
        while k:
            a = np.concatenate([np.arange(s, min(s + k, size - k)) for s in range(k % p, size - k, 2 * k)])
            a = a[a // (2 * p) == (a + k) // (2 * p)]
            if len(a):
                stages.append((a, a + k))
            k //= 2
        p *= 2
    return tuple(stages)


def _less(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    k = SHIFT[i % V, j % V]
    return rank[i + k] < rank[j + k]


def _settle(pos: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> None:
    """Sort, in place, the groups of ``pos`` that begin at ``starts``, by cover ranks."""
    for e in range(1, int(sizes.max()).bit_length() + 1):
        top = 1 << e
        own = np.flatnonzero((sizes > top // 2) & (sizes <= top))
        if not len(own):
            continue
        lanes = np.arange(top)
        there = lanes[None, :] < sizes[own][:, None]
        at = starts[own][:, None] + lanes[None, :]
        m = np.where(there, pos[np.where(there, at, 0)], -1)
        for a, b in _network(top):
            x, y = m[:, a], m[:, b]
            both = (x >= 0) & (y >= 0)
            swap = np.zeros(x.shape, bool)
            swap[both] = _less(rank, y[both], x[both])
            swap |= (x < 0) & (y >= 0)
            m[:, a], m[:, b] = np.where(swap, y, x), np.where(swap, x, y)
        pos[at[there]] = m[there]


def sort_suffixes(w: np.ndarray, pos: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """``pos`` ordered by the suffixes that start there."""
    a, b = _at(w, pos), _at(w, pos + 8)
    o = np.lexsort((b, a))
    pos, a, b = pos[o], a[o], b[o]
    new = np.ones(len(pos), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(pos)))
    tied = sizes > 1
    if tied.any():
        _settle(pos, starts[tied], sizes[tied], rank)
    return pos


def same_prefix(w: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in ``pos`` shares its first ``length`` bytes with the one before."""
    same = np.ones(len(pos), bool)
    if len(pos):
        same[0] = False
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 and length > 8 else [])
    if length < 8:
        x = _at(w, pos) >> np.uint64(8 * (8 - length))
        same[1:] &= x[1:] == x[:-1]
    for d in offsets:
        x = _at(w, pos + d)
        same[1:] &= x[1:] == x[:-1]
    return same


def classes(data: np.ndarray, pos: np.ndarray, length: int, bucket: int) -> np.ndarray:
    """A class number per position of ``pos``: equal iff the ``length`` bytes there are
    equal. Suffixes are sorted bucket by bucket: ``bucket`` of them at most share a
    pass, cut where their first bytes change."""
    w = words(data)
    where = np.zeros(len(data) + V, bool)
    for k in range(V):
        where[pos + k] = True
    rank = sample_ranks(w, where, length)
    head = _at(w, pos) >> np.uint64(64 - 8 * min(3, length))
    order = np.argsort(head, kind="stable")
    out = np.empty(len(pos), "int64")
    at = used = 0
    cuts = np.flatnonzero(np.diff(head[order])) + 1
    while at < len(order):
        end = len(order) if len(order) - at <= bucket else 0
        if not end:
            j = np.searchsorted(cuts, at + bucket, side="right") - 1
            end = int(cuts[j]) if j >= 0 and cuts[j] > at else int(cuts[j + 1]) if j + 1 < len(cuts) else len(order)
        own = order[at:end]
        p = sort_suffixes(w, pos[own].astype("int64"), rank)
        name = np.cumsum(~same_prefix(w, p, length)) + used
        # positions are distinct, so a sorted position finds its place again
        o = np.argsort(pos[own], kind="stable")
        out[own[o]] = name[np.argsort(p, kind="stable")]
        used = int(name[-1])
        at = end
    return out
