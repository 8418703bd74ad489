"""Suffixes of byte strings by bucket-pointer refinement.

Every position points to its bucket.  The first buckets hold equal q-grams.
A bucket is refined by sorting its members on the bucket identifiers (the
pointers) of the positions behind what they are known to share, and the new
pointers are written at once: buckets that are refined afterwards read them,
so a pointer into a bucket that has already been refined to depth d takes a
member d bytes further in one step, not q.
"""

from __future__ import annotations

import numpy as np

from marquee.llm.pieces import packed

Q = 8                            # bytes of the first buckets
BATCHES = 4                      # parts of a round; each reads the pointers that the parts before it have written


def refined(data: bytes, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the strings laid end to end in ``data``, in an order in
    which those that share ``depth`` bytes stand together.  Strings end in
    marks of their own: no two suffixes that reach an end are equal."""
    n = len(data)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)      # bytes up to the end of the string
    short = left < Q
    # first byte highest, zeros behind an end: in the order of the bytes, any
    # number of shared bytes keeps suffixes together
    gram = packed(data).byteswap()
    gram[short] &= ~(np.uint64((1 << 64) - 1) >> (left[short].astype(np.uint64) * np.uint64(8)))
    own = np.where(short, np.arange(1, n + 1), 0)                 # too close to an end for a q-gram: a bucket alone
    order = np.lexsort((own, gram))
    new = np.ones(n, bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (own[order][1:] != own[order][:-1])
    pointer = np.empty(n, np.int64)                               # the place of the bucket's first member
    known = np.full(n, Q, np.int64)                               # by place: bytes that the members of a bucket share
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        # buckets of two or more that are not yet deep enough
        size = np.bincount(pointer, minlength=n)
        todo = np.flatnonzero((size > 1) & (known < depth))
        if not len(todo):
            return order
        for part in np.array_split(todo, min(BATCHES, len(todo))):
            count = size[part]
            ends = np.cumsum(count)
            place = np.arange(ends[-1]) + np.repeat(part - (ends - count), count)
            member = order[place]
            bucket = np.repeat(part, count)
            behind = member + known[bucket]
            inside = known[bucket] < left[member]
            key = np.where(inside, pointer[np.minimum(behind, n - 1)], -1 - member)
            by = np.lexsort((key, bucket))
            member, key = member[by], key[by]                     # buckets are sorted already
            change = np.ones(len(by), bool)
            change[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
            first = place[np.maximum.accumulate(np.where(change, np.arange(len(by)), 0))]
            deeper = known[bucket[change]] + np.where(key[change] >= 0, known[np.maximum(key[change], 0)], depth)
            order[place] = member
            pointer[member] = first
            known[place[change]] = deeper


def same_as_before(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether a position's ``depth`` bytes are those of the one before it in
    the order, byte for byte."""
    words = packed(data)
    out = np.ones(len(order), bool)
    out[:1] = False
    for k in [*range(0, depth - 7, 8), depth - 8]:
        w = words[order + k]
        out[1:] &= w[1:] == w[:-1]
    return out
