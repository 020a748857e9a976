"""Suffix arrays of byte blocks by induced sorting, in numpy.

Induced sorting runs bucket by bucket (one bucket per first byte).  Within a
bucket the suffixes induced so far are handled as one batch, and those they add
to the same bucket form the next batch, so the passes over the array are
vectorised and stay linear.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type).  The end of
    the text counts as smaller than any byte."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    rising = np.zeros(n, bool)
    if n > 1:
        # Equal neighbours take the type of the next place that differs.
        at = np.where(step != 0, np.arange(n - 1), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        rising[:-1] = np.append(step, -1)[at] > 0
    return rising


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from ``seeds``, the leftmost
    S-type suffixes in their order."""
    n = len(text)
    sizes = np.bincount(text, minlength=256)
    start = np.cumsum(sizes) - sizes
    out = np.full(n, -1, np.int32)

    head = start.copy()
    heads = text[seeds]
    seed_at = np.concatenate(([0], np.cumsum(np.bincount(heads, minlength=256))))

    def put_front(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        first = text[before]
        order = np.argsort(first, kind="stable")
        first = first[order]
        many = np.bincount(first, minlength=256)
        rank = np.arange(len(first)) - (np.cumsum(many) - many)[first]
        out[head[first] + rank] = before[order]
        np.add(head, many, out=head)

    # The suffix before the end of the text is L-type and comes first of all.
    put_front(np.array([n]))
    for c in np.flatnonzero(sizes):
        done = start[c]
        while done < head[c]:
            upto = head[c]
            put_front(out[done:upto])
            done = upto
        put_front(seeds[seed_at[c]:seed_at[c + 1]])

    tail = start + sizes
    large_end = head

    def put_back(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if not len(before):
            return
        first = text[before]
        order = np.argsort(first, kind="stable")
        first = first[order]
        many = np.bincount(first, minlength=256)
        rank = np.arange(len(first)) - (np.cumsum(many) - many)[first]
        out[tail[first] - 1 - rank] = before[order]
        np.subtract(tail, many, out=tail)

    for c in np.flatnonzero(sizes)[::-1]:
        done = start[c] + sizes[c]
        while done > tail[c]:
            upto = tail[c]
            put_back(out[upto:done][::-1])
            done = upto
        put_back(out[start[c]:large_end[c]][::-1])
    return out


def _names(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For leftmost-smaller substrings in sorted ``order`` (``ends``: the last
    place of each, itself included): the running number of distinct ones."""
    a, b = order[:-1], order[1:]
    length = ends[b] - b + 1
    alive = np.flatnonzero(ends[a] - a + 1 == length)
    same = np.zeros(len(order) - 1, bool)
    at = 0
    while len(alive):
        over = length[alive] <= at
        same[alive[over]] = True
        alive = alive[~over]
        alive = alive[text[a[alive] + at] == text[b[alive] + at]]
        at += 1
    return np.concatenate(([0], np.cumsum(~same)))


def _sort_reduced(names: np.ndarray) -> np.ndarray:
    """The suffix order of the reduced string.  The recursion doubles: ranks of
    neighbouring stretches become ranks of stretches twice as long, for the
    suffixes that are still tied."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    many = np.bincount(names)
    rank = (np.cumsum(many) - many)[names]  # of the first one with that name
    tied = order[(many > 1)[names[order]]]
    width = 1
    while len(tied):
        after = tied + width
        key = np.zeros(len(tied), np.int64)
        inside = after < n
        key[inside] = rank[after[inside]] + 1
        by = np.argsort(rank[tied] * (n + 1) + key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        at = np.arange(len(tied))
        group = np.concatenate(([True], old[1:] != old[:-1]))
        part = group | np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(part, at, 0))
        rank[tied] = old + first - np.maximum.accumulate(np.where(group, at, 0))
        alone = part & np.append(part[1:], True)
        tied = tied[~alone]
        width *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (uint8) in byte order; a suffix that is
    another's prefix comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = classify(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(leftmost):
        return _induce(text, small, leftmost)
    # Sort the substrings between leftmost-smaller places: any order within a
    # first byte will do as seed, the induction orders the rest.
    seeds = leftmost[np.argsort(text[leftmost], kind="stable")].astype(np.int32)
    order = _induce(text, small, seeds)
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    order = order[is_left[order]]
    ends = np.zeros(n, np.int64)
    ends[leftmost] = np.append(leftmost[1:], n - 1)
    names = np.zeros(n, np.int64)
    names[order] = _names(text, order, ends)
    reduced = names[leftmost]
    if reduced.max() + 1 < len(reduced):
        order = leftmost[_sort_reduced(reduced)]
    return _induce(text, small, order)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text (not of the array): how many bytes its suffix
    shares with the one before it in ``order``, at most ``most``."""
    n = len(text)
    common = np.zeros(n, np.int64)
    if n < 2:
        return common
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    alive = np.ones(n, bool)
    alive[order[0]] = False
    at = np.flatnonzero(alive)
    # Eight bytes a step through an unaligned view; the end is filled up with
    # bytes that differ from one place to another by the length check below.
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(padded) - 7,), strides=(1,))
    room = np.minimum(n - at, n - before[at])
    upto = np.minimum(room, most)
    done = 0
    while len(at):
        differ = words[at + done] ^ words[before[at] + done]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        total = np.minimum(done + same, upto)
        over = (differ != 0) | (total >= upto)
        common[at[over]] = total[over]
        at, upto = at[~over], upto[~over]
        done += 8
    return common
