"""Two-stage suffix sorting of a byte string in numpy, to a fixed depth.

A suffix is of type B if it is smaller than its successor, else of type A.
Only B suffixes are sorted directly.  A suffix of type A that starts with byte
c is followed by one of a smaller bucket, or of its own if that byte repeats,
so scanning the buckets upwards meets the followers of all A suffixes in order
and places each at the end of its bucket's A part, before the B part.

``wanted`` restricts the work: only the suffixes wanted, and the few after them
that their order hangs on, are sorted.
"""

from __future__ import annotations

import numpy as np


def packed(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one big-endian number; zeros beyond the end."""
    x = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    w = np.zeros(len(t), np.uint64)
    for j in range(8):
        w = w << np.uint64(8) | x[j : j + len(t)]
    return w


def b_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last run of bytes is not."""
    last = np.flatnonzero(np.append(t[1:] != t[:-1], True))  # ends of runs of equal bytes
    run_b = np.append(t[last[:-1]] < t[last[:-1] + 1], False)
    return np.repeat(run_b, np.diff(last, prepend=-1))


def _sorted_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` bytes, 8 bytes a round, only ties going on."""
    order, group = at, np.zeros(len(at), np.int64)
    tied = np.arange(len(at))
    for d in range(0, depth, 8):
        if not tied.size:
            break
        p = order[tied]
        key = np.where(p + d < len(w), w[np.minimum(p + d, len(w) - 1)], np.uint64(0))
        by = np.argsort(key, kind="stable") if d == 0 else np.lexsort((key, group[tied]))
        p, key, g = p[by], key[by], group[tied]
        order[tied] = p
        new = np.append(True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]))
        first = tied[np.flatnonzero(new)]
        group[tied] = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(tied))))
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    return order


def suffix_order(t: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places where ``wanted`` is set, ordered by the suffixes there to ``depth`` bytes at least."""
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    is_b = b_types(t)
    # an A suffix needs its followers up to the next B
    last = np.flatnonzero(is_b | np.append(np.zeros(n - 1, bool), True))
    stop = last[np.searchsorted(last, np.arange(n))]
    edge = np.zeros(n + 1, np.int64)
    want = np.flatnonzero(wanted)
    np.add.at(edge, want, 1)
    np.add.at(edge, stop[want] + 1, -1)
    needed = np.cumsum(edge[:-1]) > 0
    w = packed(t)
    direct = _sorted_directly(np.flatnonzero(needed & is_b), w, depth)
    first_byte = t[direct]
    cut = np.searchsorted(first_byte, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1] and not is_b[n - 1]:
        induced[t[n - 1]].append(np.array([n - 1]))  # smaller than all that start alike
    out = []
    for c in range(256):
        part = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        parts = [part]
        while part.size:  # runs of c, one byte longer each time
            part = part[part > 0] - 1
            part = part[needed[part] & (t[part] == c)]
            parts.append(part)
        bucket = np.concatenate([*parts, direct[cut[c] : cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & (t[before] > c)]
        if before.size:
            head = t[before]
            by = np.argsort(head, kind="stable")
            before, head = before[by], head[by]
            for piece in np.split(before, np.flatnonzero(np.diff(head)) + 1):
                induced[t[piece[0]]].append(piece)
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place of ``order`` shares with the one before, ``depth`` at most; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    a, b, open_ = order[:-1], order[1:], np.arange(len(order) - 1)
    w = packed(t)
    for d in range(0, depth, 8):
        p, q = a[open_] + d, b[open_] + d
        ok = np.maximum(p, q) < len(t)
        open_, p, q = open_[ok], p[ok], q[ok]
        diff = w[p] ^ w[q]
        zero = np.zeros(len(diff), np.int64)  # leading bytes alike
        for j in range(8):
            zero += (diff >> np.uint64(8 * (7 - j))) == 0
        zero = np.minimum(zero, len(t) - np.maximum(p, q))
        shared[open_ + 1] += zero
        open_ = open_[zero == 8]
    return np.minimum(shared, depth)
