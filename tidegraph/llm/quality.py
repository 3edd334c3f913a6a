"""Line-first cleaning: rules for each line first, then for what is left of the document.

A line fails if it is navigation (items between bars, arrows or bullets), boilerplate (an eighth of its characters at least are phrases of licences, cookie
notices, menus and sign-up forms; a phrase in a long line of prose does no harm), noise (many symbols for its words), shouting (exclamation marks or capitals
throughout), or, from five words on, has no final punctuation. Failed lines go; a document that loses
more than ``most_lost`` of the characters of its lines is rejected, and so is one that fails the base rules.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidegraph.llm.common import bounded_batches, free_name, quoted
from tidegraph.llm.textblocks import WHITE, bounds, rows, utf8

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS.encode())] = True
TERMINAL = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "。", "！", "？")
BARS = re.compile(r"[|»›•·]|\s>\s")
#: Phrases of licences, cookie notices, menus and forms, by language.
PHRASES = {
    "en": r"all rights reserved|cookies? (?:policy|settings|notice)|(?:uses?|accept) cookies|privacy policy|terms of (?:use|service)|terms and conditions|"
    r"sign (?:up|in)|log ?in|subscribe|click here|read more|share (?:this|on)|enable javascript|lorem ipsum|licen[sc]ed under|copyright (?:\(c\)|\d{4})",
    "es": r"todos los derechos reservados|pol[ií]tica de (?:cookies|privacidad)|(?:usa(?:mos)?|utiliza(?:mos)?|acepta[r]?) (?:las )?cookies|aviso legal|t[eé]rminos (?:de uso|y condiciones)|"
    r"condiciones de uso|iniciar sesi[oó]n|reg[ií]strate|suscr[ií]bete|haz clic aqu[ií]|leer m[aá]s|comparti[r]? en|bajo (?:la )?licencia",
    "fr": r"tous droits réservés|politique de (?:cookies|confidentialité)|(?:utilise(?:ns|ons)?|accepter) (?:les |des )?cookies|mentions légales|conditions (?:générales|d['’]utilisation)|"
    r"se connecter|s['’]inscrire|abonnez-vous|cliquez ici|lire la suite|en savoir plus|partager sur|sous licence",
    "de": r"alle rechte vorbehalten|cookie-(?:richtlinie|einstellungen)|(?:verwende[tn]?|akzeptieren) (?:sie )?cookies|cookies (?:akzeptieren|zulassen)|datenschutz(?:erklärung|bestimmungen)?|impressum|nutzungsbedingungen|"
    r"allgemeine geschäftsbedingungen|anmelden|registrieren sie|abonnieren|klicken sie hier|mehr lesen|weiterlesen|teilen auf|unter der lizenz",
}
BOILERPLATE = re.compile(rf"\b(?:{'|'.join(PHRASES.values())})\b|©", re.IGNORECASE)


def repeated_words(ids: np.ndarray, n: int = 8) -> int:
    """Words that windows of n words cover which the text has twice or more; ids: a number for each different word."""
    count = len(ids) - n + 1
    if count < 2:
        return 0
    ids = ids.astype(np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + count]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    near = np.zeros(count, bool)  # equal hashes only propose
    near[order[1:][same]] = near[order[:-1][same]] = True
    at = np.flatnonzero(near)
    # exact: the windows themselves, by columns
    windows = ids[at[:, None] + np.arange(n)]
    _, inverse, found = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    at = at[found[inverse.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text; a slice's words are told apart once, by the words themselves."""
    data, off = utf8(column)
    many = len(off) - 1
    start, _ = bounds(data, off)
    first = np.searchsorted(start, off)
    stop = pa.py_buffer(np.append(start, len(data)).astype(np.int64))
    words = pa.LargeStringArray.from_buffers(len(start), stop, pa.py_buffer(np.ascontiguousarray(data)))  # with the white after them
    ids = pc.ascii_rtrim_whitespace(words).dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def total(marked: np.ndarray) -> np.ndarray:
        out = np.zeros(many, np.int64)
        full = np.flatnonzero(off[:-1] < off[1:])
        if full.size:
            out[full] = np.add.reduceat(marked, off[:-1][full], dtype=np.int64)
        return out

    chars = total(~WHITE[data] & ((data & 0xC0) != 0x80))
    return np.diff(first), chars, total(SYMBOL[data]), [repeated_words(ids[a:z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def bad_line(line: str) -> bool:
    """Whether a line with a word fails a rule."""
    words = line.split()
    n = len(words)
    bars = len(BARS.findall(line))
    if bars >= 3 and 4 * bars >= n:
        return True
    if 10 * sum(line.count(c) for c in SYMBOLS) > 3 * n and n > 2 or 3 * line.count("!") > n + 2:
        return True
    if n >= 5 and line.isupper():
        return True
    if n >= 5 and not line.rstrip().endswith(TERMINAL):
        return True
    return 8 * sum(len(m[0]) for m in BOILERPLATE.finditer(line)) >= len(line.strip())


FIELDS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
    "n_lines_failed": pa.int64(),
    "n_chars_lost": pa.int64(),
    "cleaned": pa.string(),
}
STRUCT = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, kept: boolean, n_lines_failed: bigint, n_chars_lost: bigint, cleaned: string>"


def judged_lines(text: str) -> tuple[int, int, int, int, list[str]]:
    """Lines with a word that equal an earlier one, that fail, characters of these, characters of all lines with a word, and the lines that passed."""
    seen: set[str] = set()
    good: list[str] = []
    dup = failed = lost = total = 0
    for line in text.split("\n"):
        if not line.strip(BLANKS):
            continue
        dup += line in seen
        seen.add(line)
        total += len(line)
        if bad_line(line):
            failed += 1
            lost += len(line)
        else:
            good.append(line)
    return dup, failed, lost, total, good


def judge(column: pa.Array, most_lost: float) -> pa.StructArray:
    """The values of FIELDS for each text of a slice."""
    n, chars, symbols, repeats = word_counts(column)
    base = (n < 20) | (100 * np.array(repeats, np.int64) > 30 * n)
    lines = []
    for text in column:
        dup, failed, lost, total, good = judged_lines(text.as_py() or "")
        lines.append((dup, lost <= most_lost * total, failed, lost, "\n".join(good) if failed else None))
    dup, fine, failed, lost, cleaned = zip(*lines, strict=True) if lines else ((),) * 5
    kept = pa.array(~base & np.array(fine, bool))
    failed = pa.array(failed, pa.int64())
    columns = [n, chars, symbols, dup, repeats, base, kept, failed, lost, pc.if_else(pc.greater(failed, 0), pa.array(cleaned, pa.string()), pc.fill_null(column, "").cast(pa.string()))]
    return pa.StructArray.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, k) for c, k in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))


def clean_lines(docs: DataFrame, most_lost: float = 0.5, into: str = "__quality") -> DataFrame:
    """docs with one more column at the end: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines_failed, n_chars_lost and cleaned, the lines that passed (the text itself where none failed).

    The column is called ``into``, with underscores after it where docs has one of that name. A null or empty text has no words: it fails the base rules
    and cleaned is empty. Repeated rows and null ids stay as they are, and so do all columns of docs. Every line of a text counts, however long it is.
    """
    bounded_batches(docs.sparkSession)
    rest = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("rest"), "text")
    schema = StructType([*rest.schema.fields, StructField("found", _parse_datatype_string(STRUCT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, judge(batch.column(1), most_lost)], ["rest", "text", "found"])

    out = rest.mapInArrow(run, schema)
    columns = [F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, F.col("found").alias(free_name(docs.columns, into)))
