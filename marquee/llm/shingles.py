"""Word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from marquee.llm.pieces import LOW_BYTES, byte_offsets, packed, slices

WORDS = 5
ODD = 0xC2B2AE3D27D4EB4F
LONG_WORD = 256                  # bytes; longer words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte strings: eight bytes at a time are mixed into the hash
    so far, so equal hashes of different words are left to chance."""
    length = end - begin
    blocks = packed(data)
    out = mix(length.astype(np.uint64) * np.uint64(ODD) + np.uint64(1))
    left = np.flatnonzero(length <= LONG_WORD)
    done = 0
    while len(left := left[length[left] > done]):
        block = blocks[begin[left] + done] & LOW_BYTES[np.minimum(length[left] - done, 8)]
        out[left] = mix(mix(out[left] + block) * np.uint64(ODD) + np.uint64(done + 1))
        done += 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i]:end[i]], digest_size=8).digest(), "little")
    return out


def canonical(text: str | None) -> str:
    """Lower-case words, one blank between them."""
    return " ".join((text or "").lower().split())


def multisets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle multisets of canonical texts: (hash, count, text index) of the
    distinct shingles, sorted by text and hash, and where each text's begin.
    A text of fewer words has one shingle of all of them, an empty one none."""
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    doc_at = np.concatenate([[0], np.cumsum(sizes)])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(chars):
        none = np.zeros(0, dtype=np.uint64)
        return none, none.astype(np.int64), none.astype(np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    blank = chars == 32
    is_start = np.zeros(len(chars) + 1, dtype=bool)
    is_start[doc_at] = True
    is_start[1:][blank] = True                   # canonical texts end in no blank
    begin = np.flatnonzero(is_start[:-1])
    end = np.append(begin[1:], len(chars))
    end -= blank[end - 1]
    data = joined.encode("utf-8", "surrogatepass")
    word = word_hashes(data, byte_offsets(chars, len(data), begin), byte_offsets(chars, len(data), end))
    word_doc = np.searchsorted(doc_at, begin, side="right") - 1
    n_words = np.bincount(word_doc, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    # a shingle begins at every word with enough words behind it, or at the first
    n_shingles = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(texts)), n_shingles)
    at = first_word[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    last = (first_word + n_words)[doc]
    shingle = np.zeros(len(doc), dtype=np.uint64)
    for k in range(words):
        there = at + k < last
        nth = np.where(there, word[np.minimum(at + k, len(word) - 1)], np.uint64(0))
        shingle = mix(shingle * np.uint64(ODD) + nth + np.uint64(k + 1))
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc)))
    doc = doc[at]
    return shingle[at], count, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, float]:
    """Weight of the common part and weighted Jaccard similarity of two
    multisets (sorted hashes, counts); two empty ones are equal."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0, 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, both / (total - both)


def by_slice(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    for i, j in slices(texts):
        yield i, texts[i:j]
