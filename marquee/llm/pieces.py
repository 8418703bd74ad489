"""Splitting texts into the pieces that byte-level BPE encodes one by one,
vectorised over a slice of many texts.

The split is the one of ``public_tokenizers.PATTERN``: contractions, runs of
letters, of numbers, of other signs (each with one leading space), and white
space.  Instead of a regex engine per text, every code point is classed by a
table and piece starts follow from class changes; ``tests/llm`` holds the
result against the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SLICE_CHARS = 500_000            # code points handled at once; a longer text is cut where a piece begins
CACHED_SHORT = 300_000           # encoded pieces of up to seven bytes kept per worker
CACHED_LONG = 80_000             # and of longer ones
LONGEST_KEPT = 64                # bytes of a piece that is kept

_state: dict = {}


def char_classes() -> np.ndarray:
    """Class of every code point, from the regex library's properties."""
    if "classes" not in _state:
        import regex

        at = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
        every = at.tobytes().decode("utf-32-le")
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for cls, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(prop, every):
                table[at[m.start():m.end()]] = cls
        _state["classes"] = table
    return _state["classes"]


def starts_of(chars: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Start offsets of the pieces in ``chars`` (code points of texts laid
    end to end; text i begins at ``doc_at[i]``)."""
    n = len(chars)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    cls = char_classes()[chars]
    first = np.zeros(n + 1, dtype=bool)
    first[doc_at[doc_at < n]] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    # a white-space run before something else gives up its last character:
    # a blank goes to what follows, anything else is a piece of its own
    space = cls == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    start[last] = True
    start[last[chars[last] == 32] + 1] = False
    # contractions: an apostrophe that starts a piece, then s t m d re ve ll
    ap = np.flatnonzero((chars == 39) & start[:n])
    ap = ap[ap + 1 < n]
    ap = ap[~first[ap + 1]]
    if len(ap):
        c1 = chars[ap + 1]
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two_ok = ap + 2 < n
        two_ok[two_ok] &= ~first[ap[two_ok] + 2]
        c2 = np.where(two_ok, chars[np.minimum(ap + 2, n - 1)], 0)
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        hit = ap[one | two]
        start[hit + 1] = False
        start[ap[one] + 2] = True
        start[ap[two] + 2] = False
        start[ap[two] + 3] = True
        start |= first
    return np.flatnonzero(start[:n])


def packed(data: bytes) -> np.ndarray:
    """The eight bytes from every position of ``data``, as little-endian
    64-bit integers; zeros follow the end."""
    return np.ndarray((len(data),), dtype="<u8", buffer=data + bytes(8), strides=(1,))


LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def byte_offsets(chars: np.ndarray, n_bytes: int, at: np.ndarray) -> np.ndarray:
    """UTF-8 offsets of the code points ``at`` (the end included)."""
    if n_bytes == len(chars):
        return at
    size = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    return np.concatenate([[0], np.cumsum(size)])[at]


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` code points."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


class ShortPieces:
    """Ids of pieces of up to seven bytes, in arrays sorted by the piece: its
    bytes and its length in one 64-bit word, so no two pieces share a key."""

    def __init__(self, most: int):
        self.most = most
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, np.uint32)

    def ids_of(self, wanted: np.ndarray, encode: Callable[[list[bytes]], list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, offset, size) of distinct keys."""
        where = np.searchsorted(self.keys, wanted)
        there = np.zeros(len(wanted), bool)
        inside = where < len(self.keys)
        there[inside] = self.keys[where[inside]] == wanted[inside]
        new = np.sort(wanted[~there])
        if len(new):
            raw, length = new.tobytes(), (new >> np.uint64(56)).tolist()
            ids = encode([raw[8 * i:8 * i + n] for i, n in enumerate(length)])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
            place = np.searchsorted(self.keys, new)
            self.at = np.insert(self.at, place, len(self.pool) + np.cumsum(size) - size)
            self.size = np.insert(self.size, place, size)
            self.used = np.insert(self.used, place, True)
            self.keys = np.insert(self.keys, place, new)
            self.pool = np.concatenate([self.pool, flat])
            where = np.searchsorted(self.keys, wanted)
        self.used[where] = True
        out = self.pool, self.at[where], self.size[where]
        if len(self.keys) > self.most:
            self._trim()
        return out

    def _trim(self) -> None:
        """Only what was used since the last time stays, or nothing if that
        is still too much."""
        keep = self.used if self.used.sum() <= self.most // 2 else np.zeros(len(self.keys), bool)
        self.keys, at, self.size = self.keys[keep], self.at[keep], self.size[keep]
        ends = np.cumsum(self.size)
        self.pool = self.pool[np.repeat(at - (ends - self.size), self.size) + np.arange(ends[-1] if len(ends) else 0)]
        self.at, self.used = ends - self.size, np.zeros(len(self.keys), bool)


class LongPieces:
    """Ids of longer pieces, by their bytes."""

    def __init__(self, most: int):
        self.most = most
        self.at, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, np.uint32)
        self.new: list[bytes] = []
        self.numbers = self._table({})

    def _table(self, known: dict[bytes, int]) -> dict[bytes, int]:
        new = self.new

        class Numbers(dict):
            def __missing__(self, piece: bytes) -> int:
                self[piece] = n = len(self)
                new.append(piece)
                return n
        return Numbers(known)

    def ids_of(self, pieces: Iterator[bytes], count: int, encode: Callable[[list[bytes]], list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, offset, size) of every piece."""
        which = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, count)
        if self.new:
            ids = encode(self.new)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.ones(len(ids), bool)])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        self.used[which] = True
        out = self.pool, self.at[which], self.size[which]
        if len(self.numbers) > self.most or max(map(len, self.new), default=0) > LONGEST_KEPT:
            self._trim()
        self.new.clear()
        return out

    def _trim(self) -> None:
        """As of ShortPieces; very long pieces never stay."""
        if self.used.sum() > self.most // 2:
            self.used[:] = False
        full = len(self.numbers) > self.most
        kept = [(p, n) for p, n in self.numbers.items() if len(p) <= LONGEST_KEPT and (not full or self.used[n])]
        old = np.array([n for _, n in kept], np.int64)
        self.numbers = self._table({p: i for i, (p, _) in enumerate(kept)})
        at, self.size = self.at[old], self.size[old]
        self.used = np.zeros(len(old), bool) if full else self.used[old]
        ends = np.cumsum(self.size)
        self.pool = self.pool[np.repeat(at - (ends - self.size), self.size) + np.arange(ends[-1] if len(ends) else 0)]
        self.at = ends - self.size


class PieceEncoder:
    """Ids of many texts at once: each distinct piece is encoded once and
    kept, and the ids of all texts are gathered by index.  Pieces are told
    apart exactly: up to seven bytes as 64-bit words, longer ones as bytes.

    ``encode_new`` maps a list of distinct pieces, as UTF-8, to a list of id
    lists.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], list]):
        self.encode_new = encode_new
        self.short, self.long = ShortPieces(CACHED_SHORT), LongPieces(CACHED_LONG)

    def encode_slice(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32 arrays."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        doc_at = np.concatenate([[0], np.cumsum(sizes)])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begin = starts_of(chars, doc_at[:-1])
        if not len(begin):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        data = joined.encode("utf-8", "surrogatepass")
        edges = byte_offsets(chars, len(data), np.append(begin, len(chars)))
        start, length = edges[:-1], np.diff(edges)
        is_short = length < 8
        at, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        keys = packed(data)[start[is_short]] & LOW_BYTES[length[is_short]] | length[is_short].astype(np.uint64) << np.uint64(56)
        import pandas as pd              # not at the top: other users of this module do without it

        codes, distinct = pd.factorize(keys)
        flat, kind_at, kind_size = self.short.ids_of(distinct, self.encode_new)
        at[is_short], size[is_short] = kind_at[codes], kind_size[codes]
        rest = np.flatnonzero(~is_short)
        if len(rest):
            pieces = (data[a:b] for a, b in zip(start[rest].tolist(), edges[rest + 1].tolist()))
            more, kind_at, size[rest] = self.long.ids_of(pieces, len(rest), self.encode_new)
            at[rest] = len(flat) + kind_at
            flat = np.concatenate([flat, more])
        ends = np.cumsum(size)
        ids = flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        # cut the ids where the texts begin
        piece_at = np.searchsorted(begin, doc_at)
        id_at = np.concatenate([[0], ends])[piece_at]
        return [ids[a:b] for a, b in zip(id_at[:-1], id_at[1:])]

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of one text, taken in chunks that end where a piece does.  The
        scan for pieces looks ahead only behind white space, so a piece that
        follows something else begins a text of its own with equal pieces."""
        parts, done = [], 0
        while done < len(text):
            size = SLICE_CHARS
            while True:
                end = min(len(text), done + size)
                if end == len(text):
                    break
                chars = np.frombuffer(text[done:end].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                begin = starts_of(chars, np.zeros(1, np.int64))
                begin = begin[1:-1]              # the last piece may go on
                begin = begin[char_classes()[chars[begin - 1]] != SPACE]
                if len(begin):
                    end = done + int(begin[-1])
                    break
                size *= 2
            parts += self.encode_slice([text[done:end]])
            done = end
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Slices of the texts with their ids: (index of the first, ids)."""
        for i, j in slices(texts):
            yield i, [self.encode_long(texts[i])] if j == i + 1 and len(texts[i]) > SLICE_CHARS else self.encode_slice(texts[i:j])
