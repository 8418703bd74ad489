"""Anchored segments of byte strings, vectorised over a slice of texts.

Content identifiers of all positions are hashes: that at depth 2d is made of
those at depth d of the position and of the one d bytes later, so depth 25
gives 50 and 50 gives 100.  Each 100-byte window goes to the bucket of the
smallest depth-50 identifier inside it; windows in a row with the same one
form a segment.  Equal windows therefore meet in equal buckets wherever they
stand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from marquee.llm.pieces import LOW_BYTES, packed
from marquee.llm.shingles import ODD, mix

GRAM, ANCHOR, LENGTH = 25, 50, 100   # depth of the first buckets, of the anchors, length of the matches
REACH = LENGTH - ANCHOR + 1          # anchor positions within a window
MAX_RUN = 64                         # windows of a segment; longer runs are cut


def deepen(ids: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers at twice the depth."""
    return mix(ids[:-depth] * np.uint64(ODD) + mix(ids[depth:] + np.uint64(depth)))


def _strings(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from each position, eight at a time
    mixed into the hash so far."""
    blocks = packed(data.tobytes())
    out = np.full(len(at), seed, np.uint64)
    for k in range(0, length, 8):
        out = mix(out * np.uint64(ODD) + (blocks[at + k] & LOW_BYTES[min(8, length - k)]))
    return out


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of every position at depth ANCHOR and at depth LENGTH."""
    at = np.arange(max(0, len(data) - GRAM + 1))
    anchor = deepen(_strings(data, at, GRAM, 1), GRAM)
    return anchor, deepen(anchor, ANCHOR)


def second_identifiers(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Independent identifiers of the windows that begin at ``at``."""
    return _strings(data, at, LENGTH, 2)


def smallest_within(ids: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Minimum of ids[s:s + reach] for every s."""
    out, span = ids, 1
    while span * 2 <= reach:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = reach - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def segments(data: np.ndarray, doc_at: np.ndarray):
    """(document index, first window, last window, bucket, segment identifier,
    repeats) for texts laid end to end; windows are offsets in ``data``.
    ``repeats``: the segment holds a window twice."""
    if len(data) < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    anchor, whole = identifiers(data)
    least = smallest_within(anchor)              # one per window start
    n_windows = np.maximum(np.diff(doc_at) - LENGTH + 1, 0)
    stop = doc_at[:-1] + n_windows               # starts from here to the end of the text are no windows
    begin = np.zeros(len(least) + 1, dtype=bool)
    begin[1:-1] = least[1:] != least[:-1]
    begin[doc_at[:-1][n_windows > 0]] = True
    begin[stop[n_windows > 0]] = True
    edges = np.append(np.flatnonzero(begin[:-1]), len(least))
    low, ends = edges[:-1], edges[1:]
    doc = np.searchsorted(doc_at, low, side="right") - 1
    inside = low < stop[doc]
    low, ends, doc = low[inside], ends[inside], doc[inside]
    parts = -(-(ends - low) // MAX_RUN)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        low, ends, doc = np.repeat(low, parts) + nth * MAX_RUN, np.repeat(ends, parts), np.repeat(doc, parts)
        ends = np.minimum(ends, low + MAX_RUN)
    high = ends - 1
    own = mix(mix(whole[low] + np.uint64(1)) + whole[high] * np.uint64(ODD) + (high - low).astype(np.uint64))
    own ^= second_identifiers(data, low) + np.uint64(3) * second_identifiers(data, high)
    # repeats: only segments with a window that the slice has seen before can have one
    again = np.flatnonzero(pd.Series(whole).duplicated().to_numpy())
    repeats = np.zeros(len(low), dtype=bool)
    suspects = np.unique(np.searchsorted(low, again, side="right") - 1)
    suspects = suspects[(suspects >= 0) & (high[suspects] > low[suspects])] if len(low) else suspects
    if len(suspects):
        size = (high - low + 1)[suspects]
        of = np.repeat(suspects, size)
        window = np.repeat(low[suspects], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        order = np.lexsort((whole[window], of))
        same = (of[order][1:] == of[order][:-1]) & (whole[window][order][1:] == whole[window][order][:-1])
        repeats[of[order][1:][same]] = True
    return doc, low, high, least[low], own, repeats
