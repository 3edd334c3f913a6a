"""Words, shingles and hashes of whole Arrow batches with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D. A hash of 64 bits only
proposes; each operator says where it compares the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that numpy works on at once; longer documents are cut into overlapping pieces.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column (null: empty) and where each begins; one offset more at the end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of the pieces of a block. own: False for words that only complete windows of the piece before them."""

    data: np.ndarray  # bytes of the block
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after it
    piece: np.ndarray  # piece of each word
    row: np.ndarray  # for each piece, its row in the batch
    base: np.ndarray  # for each piece, words of its document before it
    own: np.ndarray  # for each word

    def first(self) -> np.ndarray:
        """Index of the first word of each piece, and the number of words at the end."""
        return np.searchsorted(self.piece, np.arange(len(self.row) + 1))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1, joined by one space."""
        d = self.data
        return b" ".join(d[a:b].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True))


def bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it; words end where strings end."""
    white = WHITE[data]
    solid = ~white
    first, last = solid.copy(), solid.copy()
    first[1:] &= white[:-1]
    last[:-1] &= white[1:]
    full = off[:-1][off[:-1] < off[1:]]
    first[full] = solid[full]
    ends = off[1:][off[:-1] < off[1:]] - 1
    last[ends] = solid[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def blocks(column: pa.Array, overlap: int, lower: bool = False) -> Iterator[Words]:
    """Blocks of words of a column of texts; a long text comes in pieces that share ``overlap`` words."""
    data, off = utf8(column)
    if lower:
        data = LOWER[data]
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + BLOCK_BYTES, side="right")) - 1
        if j > i:
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            s, e = bounds(part, at)
            yield Words(part, s, e, np.searchsorted(at, s, side="right") - 1, np.arange(i, j), np.zeros(j - i, np.int64), np.ones(len(s), bool))
            i = j
        else:
            yield from _pieces(data[off[i] : off[i + 1]], i, overlap)
            i += 1


def _word_end(text: np.ndarray, at: int) -> int:
    """The first white byte at or after ``at``, or the end."""
    while at < len(text):
        if (hit := np.flatnonzero(WHITE[text[at : at + 65536]])).size:
            return at + int(hit[0])
        at += 65536
    return len(text)


def _pieces(text: np.ndarray, row: int, overlap: int) -> Iterator[Words]:
    at, base = 0, 0
    while at < len(text):
        mine = _word_end(text, min(at + BLOCK_BYTES, len(text)))
        more = mine
        while more < len(text):  # until enough words follow
            more = _word_end(text, min(more + 64 * overlap + 64, len(text)))
            if len(bounds(text[mine:more], np.array([0, more - mine]))[0]) >= overlap:
                break
        part = text[at:more]
        s, e = bounds(part, np.array([0, len(part)]))
        own = s < mine - at
        yield Words(part, s, e, np.zeros(len(s), np.int64), np.array([row]), np.array([base]), own)
        base += int(own.sum())
        at = mine


def word_hashes(w: Words, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of each word."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    byte = w.data[place + np.repeat(w.start, size)].astype(np.uint64) + np.uint64(1)
    byte *= powers(base, int(size.max()))[place]
    return mix(np.add.reduceat(byte, at[:-1]) + size.astype(np.uint64))


def window_hashes(h: np.ndarray, n: int, base: np.uint64 = np.uint64(0xD6E8FEB86659FD93)) -> np.ndarray:
    """A hash of each n values in a row; the windows of pieces must be told apart by the caller."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * base + h[k : k + len(out)]
    return mix(out)


def whole(w: Words, n: int) -> np.ndarray:
    """For each window of n words by its first word: whether it lies in one piece and is the piece's own."""
    last = len(w.start) - n + 1
    if last <= 0:
        return np.zeros(0, bool)
    return (w.piece[:last] == w.piece[n - 1 :]) & w.own[:last]


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle of n words; a text with fewer words has one, all its words."""
    h = word_hashes(w)
    ok = whole(w, n)
    value, row = window_hashes(h, n)[ok], w.row[w.piece[: len(ok)][ok]]
    first = w.first()
    count = first[1:] - first[:-1]
    short = np.flatnonzero((count > 0) & (count < n) & (w.base == 0))
    if short.size:
        some = [mix(window_hashes(h[first[p] : first[p + 1]], int(count[p])) + count[p].astype(np.uint64)) for p in short]
        value, row = np.concatenate([value, *some]), np.concatenate([row, w.row[short]])
    return value, row


def shingle_set(text: bytes, n: int) -> set[bytes]:
    """The shingles of one lower-cased text themselves."""
    words = text.split()
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def rows(batches: Iterable[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, in slices of about ``most`` bytes of the column text at most."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(size)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
