"""Suffix arrays by induced sorting, in numpy.

Suffixes are classed as smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes (LMS) are
sorted by their substrings, recursively on their names while names repeat; all others follow from them in
two linear scans. A scan takes as many entries of the array at once as do not feed on each other.
"""

from __future__ import annotations

import numpy as np


def _smaller(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; equal neighbours share the class of the run's end."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64)).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    out = np.ones(n, bool)  # the sentinel counts as S
    out[:-1] = np.append(step, np.int8(1))[nxt] > 0
    return out


def _scan_larger(s: np.ndarray, small: np.ndarray, sa: np.ndarray, head: np.ndarray) -> None:
    n, i, width = len(s), 0, 4096
    while i < n:
        hi = min(n, i + width)
        block = sa[i:hi]
        idx = np.flatnonzero(block > 0)
        j = block[idx] - 1
        keep = ~small[j]
        idx, j = idx[keep], j[keep]
        lim = hi
        if len(j):
            c = s[j]
            order = np.argsort(c, kind="stable")
            cs = c[order]
            k = np.arange(len(cs))
            fresh = np.append(True, cs[1:] != cs[:-1])
            pos = head[cs] + k - np.maximum.accumulate(np.where(fresh, k, 0))
            near = pos[pos < hi]
            if len(near):
                lim = int(near.min())
                ok = idx[order] + i < lim
                order, cs, pos = order[ok], cs[ok], pos[ok]
            sa[pos] = j[order]
            head[cs] = pos + 1
        width = min(width * 2, 1 << 16) if lim == hi else max(64, 2 * (lim - i))
        i = lim


def _scan_smaller(s: np.ndarray, small: np.ndarray, sa: np.ndarray, tail: np.ndarray) -> None:
    i, width = len(s), 4096
    while i > 0:
        lo = max(0, i - width)
        block = sa[lo:i][::-1]
        idx = np.flatnonzero(block > 0)
        j = block[idx] - 1
        keep = small[j]
        idx, j = idx[keep], j[keep]
        lim = lo
        if len(j):
            c = s[j]
            order = np.argsort(c, kind="stable")
            cs = c[order]
            k = np.arange(len(cs))
            fresh = np.append(True, cs[1:] != cs[:-1])
            pos = tail[cs] - 1 - (k - np.maximum.accumulate(np.where(fresh, k, 0)))
            near = pos[pos >= lo]
            if len(near):
                lim = int(near.max()) + 1
                ok = i - 1 - idx[order] >= lim
                order, cs, pos = order[ok], cs[ok], pos[ok]
            sa[pos] = j[order]
            tail[cs] = pos
        width = min(width * 2, 1 << 16) if lim == lo else max(64, 2 * (i - lim))
        i = lim


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that follows from ``lms``, whose order inside a bucket is kept."""
    n = len(s)
    sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    order = np.argsort(s[lms], kind="stable")
    placed, c = lms[order], s[lms][order]
    count = np.bincount(c, minlength=len(starts))
    sa[ends[c] - count[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]] = placed
    _scan_larger(s, small, sa, starts.copy())
    sa[sa >= 0] = np.where(small[sa[sa >= 0]], -1, sa[sa >= 0])
    sa[0] = n - 1
    tail = ends.copy()
    _scan_smaller(s, small, sa, tail)
    return sa


def _names(s: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in their sorted order ``in_order``; equal substrings share one."""
    nxt = np.zeros(len(s), np.int64)
    nxt[lms[:-1]] = lms[1:]
    nxt[lms[-1]] = lms[-1]
    a, b = in_order[:-1], in_order[1:]
    size = nxt[in_order] - in_order + 1
    same = size[:-1] == size[1:]
    live = np.flatnonzero(same)
    t = 0
    while len(live):
        live = live[size[live] > t]
        eq = s[a[live] + t] == s[b[live] + t]
        same[live[~eq]] = False
        live = live[eq]
        t += 1
    return np.append(0, np.cumsum(~same))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s``, non-negative integers whose last is a 0 that stands nowhere else."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = _smaller(s)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    count = np.bincount(s)
    ends = np.cumsum(count)
    starts = ends - count
    sa = _induce(s, small, lms, starts, ends)
    in_order = sa[is_lms[sa]]
    names = _names(s, lms, in_order)
    if names[-1] + 1 < len(lms):
        at = np.zeros(n, np.int64)
        at[in_order] = names
        in_order = lms[suffix_array(at[lms])]
    else:
        return sa if len(lms) < 2 else _induce(s, small, in_order, starts, ends)
    return _induce(s, small, in_order, starts, ends)


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Per text position: its common prefix with its predecessor in the array, at most ``cap`` (a permuted LCP).

    Only positions whose left characters differ are compared; from there the value falls by one a step.
    """
    n = len(s)
    phi = np.full(n, -1, sa.dtype)
    phi[sa[1:]] = sa[:-1]
    lead = np.ones(n, bool)
    i = np.flatnonzero(phi[1:] > 0) + 1
    lead[i] = s[i - 1] != s[phi[i] - 1]
    live = np.flatnonzero(lead & (phi >= 0)).astype(sa.dtype)
    other = phi[live]
    plcp, place = np.zeros(n, sa.dtype), np.arange(n, dtype=sa.dtype)
    t = 0
    limit = cap + 256  # values fall by one a step, so a capped run may reach further than the cap
    while len(live) and t < limit:
        same = s[live + t] == s[other + t]  # ends before either leaves s, whose last value stands nowhere else
        if not same.all():
            plcp[live[~same]] = t
            live, other = live[same], other[same]
        t += 1
    plcp[live] = t
    head = np.maximum.accumulate(np.where(lead, place, 0))
    out = np.maximum(plcp[head] - (place - head), 0)
    out[phi < 0] = 0
    return np.minimum(out, cap)
