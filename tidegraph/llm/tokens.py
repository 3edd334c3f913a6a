"""Token counts, and token ids of whole texts, in Arrow functions.

A text is split where the tokenizer always splits: at white between two characters that are not
white, and between a letter and a sign. Each part is encoded by itself. Plain texts of a byte-level vocabulary are cut by their bytes, all
texts of a slice at once; a slice has about equal bytes, each of its different parts is encoded once, and texts longer than a slice
are cut at safe spaces, so they need no more memory than others. Other texts are cut one by one, and parts that come again are looked up.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidegraph.llm.common import bounded_batches
from tidegraph.llm.textblocks import rows, utf8

#: Python's white characters include all that byte-level pre-tokenizers take as white.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White characters other than the two common ones.
RARE = re.compile(r"[^\S \n]")
#: Inside a part: before a line break between characters that are not white, and between a letter and a sign that begins no contraction.
WITHIN = re.compile(r"(?<=\S)(?=\n\S)|(?<=[^\W\d_])(?=[.,;:!?#*%&$|()\"-])")
#: Parts that may stand side by side in one call: white, then letters and signs of the Latin blocks, nothing white within.
PLAIN = re.compile(r"[ \n][!-~\u00a1-\u024f]+")
#: A text that is not plain: characters outside of the Latin blocks, two white characters in a row, white at its end.
NOT_PLAIN = r"[^\n !-~\x{a1}-\x{24f}]|[ \n][ \n]|[ \n]$"
#: Bytes before which a part ends if a letter stands there.
SIGN, LETTER = np.zeros(256, bool), np.zeros(256, bool)
SIGN[list(b'.,;:!?#*%&$|()"-')] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of new parts that go to the tokenizer at once, parts that a worker remembers, and bytes of text that are cut at once.
BATCH_BYTES, REMEMBERED, SLICE_BYTES = 1 << 18, 500_000, 6 << 20


class Encoder:
    """Ids of parts of texts; one per Python worker and vocabulary.

    A byte-level .json vocabulary that has a .tiktoken twin uses it for plain parts: the ids are the same
    and the calls shorter. Everything else goes to the library of the file.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers

        path = name if os.path.sep in name else public_tokenizers.path(name)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.known: dict[str, bytes] = {}
        self.splits, self.twin, self.special = False, None, ()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.batch = lambda texts: model.encode(texts, num_threads=1)
        else:
            import json

            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                file = json.load(f)
            model = Tokenizer.from_file(path)
            self.batch = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.special = tuple(t["content"] for t in file.get("added_tokens", []))
            before = file.get("pre_tokenizer") or {}
            self.splits = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not file.get("normalizer") and not any(set(x) & {" ", "\n"} for x in self.special)
            if self.splits and os.path.exists(twin := path.removesuffix(".json") + ".tiktoken"):
                import tiktoken

                with open(twin, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                coding = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
                self.twin, self.twin_ids = coding.encode_ordinary, lambda text: coding.encode_to_numpy(text, disallowed_special=())
                self.newline = ranks.get(b"\n")
                self.width = np.zeros(max(ranks.values()) + 1, np.int64)
                for token, i in ranks.items():
                    self.width[i] = len(token)

    def parts(self, text: str) -> list[str]:
        """The text, in parts that can be encoded one by one; all but the first begin with their space."""
        if not self.splits:
            return [text]
        if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or RARE.search(text):
            head, *rest = SAFE.split(text)
        else:
            head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def learn(self, parts: set[str], special: bool = True) -> None:
        """Encodes the parts that are new. special: whether one of them may have a special string."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [p for p in parts if p not in known]
        if not self.twin:
            self._batches(new)
            return
        odd = [p for p in new if any(t in p for t in self.special)] if special else []
        self._batches(odd)
        split, match = WITHIN.split, PLAIN.fullmatch
        cut = {p: split(p) for p in new if p not in known} if odd else dict(zip(new, map(split, new), strict=True))
        small = set().union(*cut.values()).difference(known)
        plain = [x for x in small if match(x)]
        self._batches(list(small.difference(plain)))
        self._side_by_side(plain)
        for part, cuts in cut.items():
            if len(cuts) == 2:
                known[part] = known[cuts[0]] + known[cuts[1]]
            elif len(cuts) > 2:
                known[part] = b"".join([known[x] for x in cuts])

    def _batches(self, texts: list[str]) -> None:
        """In batches of about BATCH_BYTES, shortest texts first."""
        texts.sort(key=len)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= BATCH_BYTES):
                size += len(texts[end]) + 1
                end += 1
            for text, ids in zip(texts[at:end], self.batch(texts[at:end]), strict=True):
                self.known[text] = np.asarray(ids, dtype="<u4").tobytes()
            at = end

    def _side_by_side(self, texts: list[str]) -> None:
        """Many short parts as one text; their ids are told apart by the bytes that each id stands for."""
        size = np.cumsum([0] + [len(x.encode()) for x in texts])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, size[at] + BATCH_BYTES, "right")) - 1)
            ids = np.asarray(self.twin("".join(texts[at:end])), dtype="<u4")
            stop = np.searchsorted(np.cumsum(self.width[ids]), size[at + 1 : end + 1] - size[at]) + 1
            raw, last = ids.tobytes(), 0
            for text, n in zip(texts[at:end], (4 * stop).tolist(), strict=True):
                self.known[text] = raw[last:n]
                last = n
            at = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text, its ids as little-endian 32-bit numbers."""
        at = 0
        while at < len(texts):
            cut, size, end = [], 0, at
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= 16 * BATCH_BYTES):
                size += len(texts[end])
                cut.append(self.parts(texts[end]))
                end += 1
            self.learn(set().union(*cut), any(t in x for t in self.special for x in texts[at:end]))
            get = self.known.__getitem__
            for parts in cut:
                yield b"".join(map(get, parts))
            at = end

    def plain(self, text: pa.Array) -> np.ndarray:
        """Which texts can be cut by their bytes."""
        if not self.twin or self.newline is None:
            return np.zeros(len(text), bool)
        odd = pc.match_substring_regex(text, NOT_PLAIN)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(text, special))
        return ~odd.to_numpy(zero_copy_only=False)

    def distinct(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of plain texts: where the parts of each begin (one more at the end), the number of each part, and of each number its first id, how many, and all ids."""
        data, off = utf8(text)
        start = (data == 32) | (data == 10)
        start[1:] |= SIGN[data[1:]] & LETTER[data[:-1]]
        start[off[:-1][off[:-1] < off[1:]]] = True
        begin = np.flatnonzero(start)
        first = np.searchsorted(begin, off)
        stop = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, stop, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        raw, at = utf8_of(parts.dictionary)
        count = len(at) - 1
        if not count:
            return first, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        # side by side each part begins with white; those that have none get a line break, which is a token of its own
        bare = (raw[at[:-1]] != 32) & (raw[at[:-1]] != 10)
        size = np.diff(at) + bare
        put = np.concatenate(([0], np.cumsum(size)))
        joined = np.full(put[-1], 10, np.uint8)
        keep = np.ones(put[-1], bool)
        keep[put[:-1][bare]] = False
        joined[keep] = raw
        ids, a = [], 0
        while a < count:
            z = max(a + 1, int(np.searchsorted(put, put[a] + BATCH_BYTES, "right")) - 1)
            ids.append(self.twin_ids(joined[put[a] : put[z]].tobytes().decode()))
            a = z
        flat = np.concatenate(ids).astype("<u4")
        edge = np.searchsorted(np.cumsum(self.width[flat]), put[1:]) + 1
        begin_id = np.concatenate(([0], edge[:-1])) + bare
        return first, parts.indices.to_numpy(zero_copy_only=False), begin_id, edge - begin_id, flat

    def counts(self, text: pa.Array) -> np.ndarray:
        """Ids of each text of a slice without nulls."""
        out = np.zeros(len(text), np.int64)
        plain = self.plain(text)
        if plain.any():
            first, part, _, many, _ = self.distinct(text.filter(pa.array(plain)))
            total = np.concatenate(([0], np.cumsum(many[part])))
            out[plain] = total[first[1:]] - total[first[:-1]]
        if not plain.all():
            out[~plain] = [len(x) // 4 for x in self.encode(text.filter(pa.array(~plain)).to_pylist())]
        return out

    def ids(self, text: pa.Array) -> list[bytes]:
        """The ids of each text of a slice without nulls, as little-endian 32-bit numbers."""
        plain = self.plain(text)
        other = self.encode(text.filter(pa.array(~plain)).to_pylist()) if not plain.all() else iter(())
        if plain.any():
            first, part, begin, many, flat = self.distinct(text.filter(pa.array(plain)))
            size = many[part]
            at = np.concatenate(([0], np.cumsum(size)))
            raw = memoryview(flat[np.arange(at[-1]) + np.repeat(begin[part] - at[:-1], size)].tobytes())
            edge = (4 * at[first]).tolist()
            mine = iter(zip(edge, edge[1:], strict=False))
        return [bytes(raw[slice(*next(mine))]) if p else next(other) for p in plain]

    def slices(self, text: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """The texts (null: empty) in slices of about SLICE_BYTES, and the row of each; a longer text comes in pieces, which are encoded one by one."""
        text = pc.fill_null(text, "").cast(pa.large_string())
        off = np.concatenate(([0], np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))))
        a = 0
        while a < len(text):
            z = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1)
            if off[z] - off[a] > 2 * SLICE_BYTES and self.splits:
                for piece in safe_cuts(text[a].as_py().encode()):
                    yield pa.array([piece.decode()], pa.large_string()), np.array([a])
            else:
                yield text.slice(a, z - a), np.arange(a, z)
            a = z


def utf8_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of large binaries without nulls, and where each begins; one more at the end."""
    _, offsets, data = parts.buffers()
    off = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


def safe_cuts(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of about SLICE_BYTES that begin at a space between two characters of ASCII that are not white."""
    begin = 0
    while begin < len(raw):
        at = raw.find(b" ", begin + SLICE_BYTES)
        while at >= 0 and not (at + 1 < len(raw) and 32 < raw[at - 1] < 127 and 32 < raw[at + 1] < 127):
            at = raw.find(b" ", at + 1)
        end = at if at >= 0 else len(raw)
        yield raw[begin:end]
        begin = end


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    No special tokens are added; special strings in texts are read as the library does by default. A null text counts as empty: 0 and 0.
    Repeated rows and null ids stay as they are; other columns are not read.
    vocabulary: a file of public_tokenizers, or a path that all executors have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in rows(batches):
            text = pc.fill_null(batch.column("text"), "")
            n = np.zeros(len(text), np.int64)
            for part, row in coder.slices(text):
                n[row] += coder.counts(part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document's ids, its end id included.

    Documents of more than size ids are cut so that all pieces but the first are full. A null text is a document of the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = encoder(vocabulary), np.asarray([end_id], dtype="<u4").tobytes()

        def texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
            held: list[bytes] = []
            now = -1
            for part, row in coder.slices(column):
                for r, ids in zip(row.tolist(), coder.ids(part), strict=True):
                    if held and r != now:
                        yield now, b"".join(held)
                        held = []
                    now = r
                    held.append(ids)
            if held:
                yield now, b"".join(held)

        for batch in rows(batches):
            out: list[tuple] = []
            names = batch.column("doc_id").to_pylist()
            for row, ids in texts(batch.column("text")):
                doc_id = names[row]
                ids += last
                n = len(ids) // 4
                first = n % size or size
                for k, start in enumerate([0, *range(first, n, size)]):
                    stop = first if k == 0 else start + size
                    out.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
