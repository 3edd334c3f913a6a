"""Suffix-array deduplication of exact byte strings, by column-wise construction over many strings.

Strings of 100 bytes meet in buckets by the content around a minimiser (``superkmers``). In a bucket the strings are lined up at that
anchor, and the order of their suffixes is built from the last column to the first: each round puts one more
symbol before every string's suffix, and the order, the symbols before it (the transform) and the common prefixes of neighbours
follow from those of the round before, read once from first to last. Equal strings of a bucket start in the same column, so
the columns' orders need not be merged into one. What shares at least 100 bytes with a neighbour is repeated; the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegraph.llm import superkmers as S
from tidegraph.llm.textblocks import mix, powers, utf8

LENGTH, MINIMISER = 100, 12
#: Bytes that numpy works on at once.
BLOCK = 1 << 20
_B = 0x9E3779B97F4A7C15


def _blocks(column: pa.Array, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets of pieces, and each piece's row and place in its document; a long text comes in overlapping pieces."""
    data, off = utf8(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1
        if j > i:
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j), np.zeros(j - i, np.int64)
            i = j
        else:
            for a in range(int(off[i]), int(off[i + 1]), BLOCK):
                z = min(a + BLOCK + overlap, int(off[i + 1]))
                yield data[a:z], np.array([0, z - a]), np.array([i]), np.array([a - off[i]])
            i += 1


def runs_of(data: np.ndarray, off: np.ndarray, row: np.ndarray, base: np.ndarray, n: int, k: int) -> S.Runs | None:
    if len(data) < n:
        return None
    value = data.astype(np.uint64) + np.uint64(1)
    p = powers(np.uint64(_B), len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * p[:-1])))
    back = powers(np.uint64(pow(_B, -1, 1 << 64)), len(data) + 1)
    gram = mix((total[k:] - total[:-k]) * back[: len(total) - k])
    del total, back, p
    low = np.uint64((1 << 24) - 1)
    least = S.sliding_min((gram & ~low) | np.arange(len(gram), dtype=np.uint64), n - k + 1)
    anchor = (least & low).astype(np.int64)
    ok = np.zeros(len(anchor), bool)
    edge = np.zeros(len(data) + 1, np.int32)
    size = np.diff(off)
    full = size >= n
    np.add.at(edge, off[:-1][full], 1)
    np.add.at(edge, off[:-1][full] + size[full] - n + 1, -1)
    ok = np.cumsum(edge)[: len(anchor)] > 0
    if not ok.any():
        return None
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    starts = off[:-1][full]
    first[starts] = True
    head = np.flatnonzero(first)
    at = np.flatnonzero(ok)
    count = np.diff(np.append(np.searchsorted(at, head), len(at)))
    last = head + count + n - 1
    h1, h2 = S.span_hashes(value, head, last)
    mark = anchor[head] - head
    piece = np.searchsorted(off, head, "right") - 1
    length = last - head

    def pack(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data[S.ranges(head[chosen], length[chosen])], length[chosen]

    return S.Runs(mix(gram[anchor[head]]), h1, h2, row[piece], base[piece] + head - off[piece], count, mark, pack)


def _may_repeat(b: S.Bucket, n: int, k: int) -> np.ndarray:
    """Strings that may have a window in common with another one.

    A window holds the anchor and, on one side of it at least, half of its other bytes: strings that share a window share the anchor with these.
    """
    half = (n - k + 1) // 2
    raw, begin = b.text.tobytes(), b.at + b.mark
    out = np.zeros(len(b.at), bool)
    for first, last in ((-half, k), (0, k + half)):
        at = np.flatnonzero((b.mark + first >= 0) & (b.mark + last <= b.length))
        seen: dict[bytes, int] = {}
        for i, a in zip(at.tolist(), begin[at].tolist(), strict=True):
            j = seen.setdefault(raw[a + first : a + last], i)
            if j != i:
                out[i] = out[j] = True
    return out


def _columns(text: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column from the last to the first in which a whole string can start: the column, the strings in the order of their suffixes there, and
    the common prefix of each with the one before.

    String i has the columns -left[i] to right[i] - 1, and its symbol of column c is text[anchor[i] + c].
    """
    enter = {c: np.flatnonzero(right == c + 1) for c in np.unique(right - 1).tolist()}
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int16)
    for c in range(int(right.max()) - 1, -int(left.max()) - 1, -1):
        here = left[order] >= -c
        if not here.all():
            # a string that ends here to the left leaves; what stood before and after it shares the least of what it shared
            keep = np.flatnonzero(here)
            if keep.size:
                common = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
                common[0] = 0
            else:
                common = common[:0]
            order = order[keep]
        new = enter.get(c)
        if new is not None:
            new = new[left[new] >= -c]
            order = np.concatenate((new, order))
            common = np.concatenate((np.zeros(len(new) + min(1, len(common)), np.int16), common[1:]))
        if not order.size:
            continue
        symbol = text[anchor[order] + c]
        turn = np.argsort(symbol, kind="stable")
        symbol = symbol[turn]
        least = np.minimum.reduceat(np.append(common, np.int16(0)), turn + 1)
        order = order[turn]
        common = np.zeros(len(order), np.int16)
        same = symbol[1:] == symbol[:-1]
        common[1:][same] = least[:-1][same] + 1
        if c <= 0:
            yield c, order, common


def settled(b: S.Bucket, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Spans of all windows of a bucket that start earlier too."""
    # the earliest occurrence of each string; all later ones go as a whole
    order = np.lexsort((b.start, b.doc_id, b.string))
    head = order[np.searchsorted(b.string[order], np.arange(len(b.at)))]
    later = (b.doc_id != b.doc_id[head][b.string]) | (b.start != b.start[head][b.string])
    gone = np.flatnonzero(later)
    left = b.mark
    some = np.flatnonzero(_may_repeat(b, n, k))
    flags = np.zeros(int(b.windows.sum()), bool)
    first = np.concatenate(([0], np.cumsum(b.windows)[:-1]))
    if some.size:
        _, rank = np.unique(b.doc_id[head], return_inverse=True)
        place = (rank.astype(np.int64) << np.int64(40)) + b.start[head]
        mine = left[some]
        for c, row, common in _columns(b.text, b.at[some] + mine, mine, b.length[some] - mine, n):
            near = common >= n
            if not near.any():
                continue
            begin = np.flatnonzero(~near)
            at = some[row]
            t = c + mine[row]
            earliest = np.minimum.reduceat(place[at] + t, begin)[np.cumsum(~near) - 1]
            back = place[at] + t > earliest
            flags[first[at[back]] + t[back]] = True
    now = np.flatnonzero(~later)
    which, start, stop = S.flagged_spans(flags, first[b.string[now]], b.windows[b.string[now]], n)
    at = now[which]
    return tuple(np.concatenate(x) for x in ((b.doc_id[gone], b.doc_id[at]), (b.th[gone], b.th[at]), (b.start[gone], b.start[at] + start), (b.start[gone] + b.windows_of[gone] + n - 1, b.start[at] + stop)))


def _apply(text: pa.Array, spans: pa.Array) -> pa.Array:
    size, removed, runs, kept = [], [], [], []
    for raw, s in zip(S.unzipped(text), spans.to_pylist(), strict=True):
        size.append(len(raw))
        if s:
            gone = S.covered(s, len(raw))
            removed.append(int(gone.sum()))
            runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        else:
            removed.append(0)
            runs.append(0)
            kept.append(raw)
    return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])


def remove_later(docs: DataFrame, length: int = LENGTH, into: str = "__later") -> DataFrame:
    """docs with one more column ``into`` (and underscores, where docs has one of that name) at the end: struct of n_bytes, n_removed, n_spans and kept, the bytes that stay (they may end within a character).

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller doc_id, or further left in the same one. A null text is empty; a null doc_id
    comes before all others; rows with the same id and text start at the same places, so neither is earlier. Matches never cross documents. All columns of docs stay.
    """
    if not MINIMISER < length <= 255:
        raise ValueError("strings have 13 to 255 bytes")

    def cut(column: pa.Array) -> Iterator[S.Runs]:
        for data, off, row, base in _blocks(column, length - 1):
            if (runs := runs_of(data, off, row, base, length, MINIMISER)) is not None:
                yield runs

    kind = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary>"
    return S.with_repeats(docs, into, kind, cut, lambda b: settled(b, length, MINIMISER), _apply, length, True, 3.5)
