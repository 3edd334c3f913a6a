"""Substring removal over windows of words, by super-k-mer partitioning.

A window is 35 words in a row. Each word that a window covers which occurs twice or more, anywhere, is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegraph.llm import superkmers as S
from tidegraph.llm.textblocks import Words, blocks, mix, whole, window_hashes, word_hashes

WINDOW, MINIMISER, LONGEST = 35, 5, 64


def runs_of(w: Words, n: int) -> S.Runs | None:
    h = word_hashes(w)
    ok = whole(w, n)
    if not ok.any():
        return None
    least = S.sliding_min(window_hashes(h, MINIMISER), n - MINIMISER + 1)
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    head = np.flatnonzero(first)
    at = np.flatnonzero(ok)
    place = at - head[np.searchsorted(head, at, "right") - 1]
    first[at[place % LONGEST == 0]] = True
    head = np.flatnonzero(first)
    size = np.diff(np.append(np.searchsorted(at, head), len(at)))
    last = head + size + n - 1
    h1, h2 = S.span_hashes(h, head, last)
    begin = w.first()
    start = w.base[w.piece[head]] + head - begin[w.piece[head]]

    def pack(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words joined by a space, strings ended by a line break."""
        a, words = head[chosen], (last - head)[chosen]
        index = S.ranges(a, words)
        size = w.end[index] - w.start[index] + 1
        stop = np.cumsum(size)
        data = np.full(stop[-1], 32, np.uint8)
        source = S.ranges(w.start[index], size)
        source[stop - 1] = 0
        np.take(w.data, source, out=data)
        data[stop - 1] = 32
        ends = np.cumsum(words) - 1
        data[stop[ends] - 1] = 10
        return data, np.diff(np.concatenate(([0], stop[ends])))

    return S.Runs(mix(least[head]), h1, h2, w.row[w.piece[head]], start, size, np.zeros(len(head), np.int64), pack)


def counted(b: S.Bucket, n: int) -> tuple[np.ndarray, ...]:
    """Counts the windows of a bucket by sorting them; gives the spans of all their occurrences that come twice or more."""
    # strings of the bucket, one after the other, with their line breaks
    take = S.ranges(b.at, b.length)
    data = b.text[take]
    del take
    solid = (data != 32) & (data != 10)
    off = np.concatenate(([0], np.cumsum(b.length)))
    start = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1])))
    end = np.flatnonzero(solid & np.concatenate((~solid[1:], [True]))) + 1
    piece = np.searchsorted(off, start, "right") - 1
    w = Words(data, start, end, piece, np.arange(len(b.at)), np.zeros(len(b.at), np.int64), np.ones(len(start), bool))
    ok = np.flatnonzero(whole(w, n))
    value = window_hashes(word_hashes(w), n)[ok]
    string = piece[ok]
    weight = b.weight[string]
    order = np.argsort(value, kind="stable")
    v = value[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    group = np.cumsum(new) - 1
    # equal hashes only propose: neighbours are compared
    raw, a, z = data.tobytes(), start[ok], end[ok + n - 1]
    wrong: set[int] = set()
    for k in np.flatnonzero(~new).tolist():
        i, j = order[k - 1], order[k]
        if raw[a[i] : z[i]] != raw[a[j] : z[j]]:
            wrong.add(int(group[k]))
    total = np.add.reduceat(weight[order], np.flatnonzero(new))
    flags = np.zeros(len(ok), bool)
    flags[order] = (total > 1)[group]
    for g in wrong:
        by: dict[bytes, list[int]] = {}
        for i in order[group == g].tolist():
            by.setdefault(raw[a[i] : z[i]], []).append(i)
        for same in by.values():
            flags[same] = weight[same].sum() > 1
    first = np.searchsorted(string, np.arange(len(b.at)))
    occurrence, head, stop = S.flagged_spans(flags, first[b.string], b.windows_of, n)
    return b.doc_id[occurrence], b.th[occurrence], b.start[occurrence] + head, b.start[occurrence] + stop


def _apply(text: pa.Array, spans: pa.Array) -> pa.Array:
    words, removed, kept = [], [], []
    for t, s in zip(S.unzipped(text), spans.to_pylist(), strict=True):
        w = t.split()
        words.append(len(w))
        if s:
            gone = S.covered(s, len(w))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g]).decode())
        else:
            removed.append(0)
            kept.append(b" ".join(w).decode())
    return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, into: str = "__repeats") -> DataFrame:
    """docs with one more column ``into`` (and underscores, where docs has one of that name) at the end: struct of n_words, n_removed and kept, the words left, joined by one space.

    A window counts wherever it starts again, in its own document too; windows are judged on the input. A null or empty text has no words; repeated
    rows are copies of each other; a null doc_id is an id like others. All columns of docs stay.
    """
    if window < MINIMISER:
        raise ValueError(f"windows have {MINIMISER} words at least")

    def cut(column: pa.Array) -> Iterator[S.Runs]:
        for w in blocks(column, window - 1):
            if (runs := runs_of(w, window)) is not None:
                yield runs

    kind = "struct<n_words: bigint, n_removed: bigint, kept: string>"
    return S.with_repeats(docs, into, kind, cut, lambda b: counted(b, window), _apply, window, False, 3.1)
