"""Suffix arrays in numpy: Larsson-Sadakane refinement, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def suffix_array(first: np.ndarray, depth: int, enough: int | None = None) -> np.ndarray:
    """Suffixes in order, from sort keys ``first`` of their ``depth`` leading symbols.

    Rounds double the sorted depth: within a group of equal suffixes the next key is the
    group number ``depth`` symbols on. Groups of one are done and are not looked at again.
    ``enough``: stop once that many symbols are sorted (others stay in any order).
    """
    n = len(first)
    order = np.argsort(first)
    keys = first[order]
    head = np.ones(n, bool)
    head[1:] = keys[1:] != keys[:-1]
    slot = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)  # a group's number is its first slot
    rank[order] = slot
    open_ = ~head
    open_[:-1] |= ~head[1:]
    slots = np.flatnonzero(open_)
    while len(slots) and (enough is None or depth < enough):
        at = order[slots]
        after = at + depth
        inside = after < n
        second = np.zeros(len(at), np.int64)
        second[inside] = rank[after[inside]] + 1
        both = (rank[at] << 32) | second
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[slots] = at
        head = np.ones(len(at), bool)
        head[1:] = both[1:] != both[:-1]
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        open_ = ~head
        open_[:-1] |= ~head[1:]
        slots = slots[open_]
        depth *= 2
    return order


def packed_symbols(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Sort keys of the leading symbols of every suffix, and how many symbols they hold."""
    depth = 63 // bits
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(depth, np.int64)])
    keys = np.zeros(len(symbols), np.int64)
    for k in range(depth):
        keys = (keys << bits) | padded[k : k + len(symbols)]
    return keys, depth


def words8(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, as big-endian numbers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.zeros(len(data), np.uint64)
    for k in range(8):
        keys = (keys << np.uint64(8)) | padded[k : k + len(data)]
    return keys


def previous_common(data: np.ndarray, order: np.ndarray, eight: np.ndarray, enough: int) -> np.ndarray:
    """Length of the prefix that every suffix shares with its predecessor in ``order``, by position.

    Kasai's bound in vector form: where a suffix and its predecessor both follow, by one symbol,
    a suffix and its predecessor that begin alike, they share one symbol less. So along such a run
    only the last suffix is compared, eight bytes a step and up to ``enough``: lengths of at least
    that are only known to be so. -1 for the first in order.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    follows = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    follows &= data[:-1] == data[before[:-1]]
    tails = np.flatnonzero(np.append(~follows, True))
    shared = np.zeros(len(tails), np.int64)
    live = np.flatnonzero(before[tails] >= 0)
    while len(live):
        a = tails[live] + shared[live]
        b = before[tails[live]] + shared[live]
        room = n - np.maximum(a, b)
        inside = room > 0
        differ = np.ones(len(live), np.uint64)
        differ[inside] = eight[a[inside]] ^ eight[b[inside]]
        same = np.zeros(len(live), np.int64)  # bytes before the first that differs
        for k in range(8):
            same += (differ >> np.uint64(56 - 8 * k)) == 0
        same = np.where(inside, np.minimum(same, room), 0)
        shared[live] += same
        live = live[(same == 8) & (shared[live] < enough)]
    lengths = np.diff(tails, prepend=-1)
    out = np.repeat(shared + tails, lengths) - np.arange(n)
    return np.where(before < 0, -1, out)
