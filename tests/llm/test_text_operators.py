import hashlib
import os
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from tests.llm import brute
from tidegraph.llm import decontaminate, jaccard, language, packing, quality, sharding, substrings, suffixes, textblocks, tokens
from tidegraph.llm.common import scratch_dir


def order(row):
    return tuple((x is None, "" if x is None else x) for x in row)


def test_words_of_windows_that_repeat_go(docs, documents):
    got = [(r["doc_id"], r["__r"]["n_words"], r["__r"]["n_removed"], r["__r"]["kept"], r["text"]) for r in substrings.remove_repeats(docs, into="__r").collect()]
    want = [(d, len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode(), t) for (d, t, *_), (w, g) in zip(documents, brute.windows(documents))]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(r[2] for r in want)


def test_windows_of_other_lengths_and_in_small_blocks(docs, documents, monkeypatch):
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 700)  # the long text comes in pieces
    pieces = [(w.base[0], w.text(0, len(w.start))) for w in textblocks.blocks(pa.array([documents[-4][1]]), 34)]
    assert len(pieces) > 10
    column = pa.array([t for _, t, *_ in documents])
    runs = [r for w in textblocks.blocks(column, 34) if (r := substrings.runs_of(w, 35)) is not None]
    want = Counter()
    for i, (_, t, *_) in enumerate(documents):
        n = len((t or "").encode().split()) - 34
        for k in range(max(n, 0)):
            want[i, k] += 1
    assert Counter((int(i), int(s) + k) for r in runs for i, s, n in zip(r.row, r.start, r.windows) for k in range(n)) == want


def test_bytes_that_start_earlier_go(docs, documents):
    got = [(r["doc_id"], r["__l"]["n_bytes"], r["__l"]["n_removed"], r["__l"]["n_spans"], hashlib.sha256(r["__l"]["kept"]).hexdigest()) for r in suffixes.remove_later(docs, into="__l").collect()]
    want = []
    for (d, *_), (b, g) in zip(documents, brute.later(documents)):
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        want.append((d, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(r[2] for r in want)


def test_columns_give_the_order_of_suffixes():
    rng = random.Random(3)
    strings = ["".join(rng.choices("ab", k=rng.randint(8, 20))).encode() for _ in range(40)]
    left = np.array([rng.randint(0, 6) for _ in strings])
    at = np.cumsum([0, *[len(s) for s in strings]])[:-1]
    length = np.array([len(s) for s in strings])
    text = np.frombuffer(b"".join(strings), np.uint8)
    seen = 0
    for c, row, common in suffixes._columns(text, at + left, left, length - left, 4):
        rest = [strings[i][c + left[i] :] for i in row]
        assert rest == sorted(rest)
        for a, b, n in zip(rest, rest[1:], common[1:]):
            assert os.path.commonprefix([a, b]) == a[:n] and len(os.path.commonprefix([a, b])) == n
        seen += 1
    assert seen == left.max() + 1


def test_components_of_similar_sets(docs, documents):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()]
    want = [(d, n, c) for (d, *_), (n, c) in zip(documents, brute.components(documents))]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_chains_and_groups_of_near_copies(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    rows, base = [], rng.choices(words, k=120)
    for i in range(60):  # each differs from the last: the ends are not similar
        rows.append((i, " ".join(base)))
        base = list(base)
        base[rng.randrange(120)] = rng.choice(words)
    for size in (1, 2, 4, 5, 6, 9, 14, 25):  # sets at the edge of similarity
        s = rng.choices(words, k=size + 4)
        rows += [(100 * size + k, " ".join(s[: len(s) - k])) for k in range(4)]
    rows = [(d, t) for d, t in rows]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: x for (d, *_), x in zip(rows, brute.components(rows))}


def test_large_stars_are_split(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(jaccard, "STAR", 20)
    rows = []
    for i in range(300):  # one large component, some small ones and strays, of sizes that differ
        component = 0 if i < 200 else 1000 + i // 3 if i < 260 else i
        n = int(rng.integers(60, 120))
        sketch = np.zeros(4, np.uint64)
        sketch[0] = rng.integers(0, 1 << int(rng.integers(1, 40)))
        rows.append((5, i, component, n, bytearray(sketch.tobytes())))
    tasks = jaccard._blocks(spark.createDataFrame(rows, "center long, id long, component long, n long, sketch binary"), 80)
    assert tasks.groupBy("task").count().agg({"count": "max"}).first()[0] < 4 * 20
    assert tasks.groupBy("task").agg({"component": "min"}).count() > 10
    got = [tuple(sorted(r)) for r in tasks.groupBy("task").applyInArrow(jaccard._pairs_between(80), "a long, b long").collect()]
    word = [int.from_bytes(r[4], "little") for r in rows]
    want = {(a[1], b[1]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[2] != b[2] and 100 * min(a[3], b[3]) >= 80 * max(a[3], b[3]) and 180 * (word[a[1]] ^ word[b[1]]).bit_count() <= 20 * (a[3] + b[3])}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_components_with_split_stars(docs, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "STAR", 2)
    test_components_of_similar_sets(docs, documents)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    bands = jaccard.Bands(80, 3000)
    for _ in range(300):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 45, 130, 900]))
        a = rng.integers(1 << 62, size=n, dtype=np.uint64)
        drop = rng.permutation(n)
        b = a.copy()
        for i in drop:  # as many changes as similarity allows
            c = b.copy()
            c[i] = rng.integers(1 << 62, dtype=np.uint64)
            both = len(set(a.tolist()) & set(c.tolist()))
            if 100 * both < 80 * (2 * n - both):
                break
            b = c
        m = n * 8 // 10 if rng.random() < 0.3 and n >= 5 else n
        b = b if m == n else a[: -(-n * 8 // 10)]
        a, b = np.unique(a), np.unique(b)
        sig, which = bands.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]))
        assert set(sig[which == 0].tolist()) & set(sig[which == 1].tolist())


def plain(text):
    """In lower case, words apart by anything but letters, marks and digits."""
    return None if text is None else " ".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", unicodedata.normalize("NFC", text).lower()))


def test_contained_items(spark, docs, documents):
    inside = " ".join((documents[3][1] + " " + documents[2][1]).split()[:30])
    quoted = "“" + " - ".join(documents[4][1].upper().replace("SS", "ß").split()[:40]) + "”!"
    items = [(1, documents[41][1]), (2, inside), (3, "two words"), (4, None), (5, ""), (6, "not to be found at all in here"), (7, quoted)]
    got = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in decontaminate.contained(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t, *_ in documents:
        own = brute.shingles(plain(t))
        for i, s in items:
            q = brute.shingles(plain(s))
            if q and 10 * len(q & own) >= 8 * len(q):
                want.add((d, i, len(q & own)))
    assert got == want and len(want) >= 5 and any(i == 7 for _, i, _ in want)


def test_altered_items_are_found_and_clean_texts_left_alone(spark):
    """Case, punctuation, markup, line breaks and composed letters do not count; one word in twenty-five may differ, a fifth may be cut off."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñ", k=rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, prose(rng.randint(30, 60))) for i in range(12)]
    alter = [
        str.upper, str.title, lambda t: t.replace(" ", ", "), lambda t: t.replace(" ", "\n"), lambda t: f"<b>{t}</b>", lambda t: "“" + t.replace(" ", " — ") + ".”",
        lambda t: unicodedata.normalize("NFD", t), lambda t: " ".join(t.split()[: -(len(t.split()) // 6)]), lambda t: t.replace(t.split()[9], "other", 1), lambda t: "| " + t.replace(" ", " | ") + " |",
    ]
    rows = [(100 * k + i, prose(200) + " " + f(t) + " " + prose(200)) for k, f in enumerate(alter) for i, t in items]
    clean = [(10_000 + i, prose(3000)) for i in range(20)]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(spark.createDataFrame(rows + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(100 * k + i, i) for k in range(len(alter)) for i, _ in items}


def test_items_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, f"item {i} with its own six words") for i in range(9)] + [(99, "two words")], "item_id long, text string")
    want = sorted(map(str, decontaminate.contained(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 60)
    assert sorted(map(str, decontaminate.contained(docs, items).collect())) == want and want


def test_counts_are_the_librarys(docs, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs).collect()), key=order)
    want = []
    for d, t, *_ in documents:
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=order)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_with_other_vocabularies(docs, documents, name):
    coder = tokens.Encoder(name)
    texts = [t or "" for _, t, *_ in documents]
    want = Counter(zip([d for d, *_ in documents], [len(x) for x in coder.batch(texts)]))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(docs, name).collect()) == want


def test_ids_of_odd_texts_are_the_librarys():
    rng = random.Random(5)
    alphabet = list(" \n\t.,;:!?'abcstre") + ["'s", "'ll", "é", "ß", "İ", "中", "０", "½", "<|endoftext|>", "\x1c", "\xa0", "x̀", "\x85", " ", "  ", " \n", "_", "|"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(8000)]
    coder = tokens.Encoder("byte_bpe_50k.json")
    for text, got, want in zip(texts, coder.encode(texts), coder.batch(list(texts))):
        assert np.frombuffer(got, "<u4").tolist() == list(want), text


def test_pieces_and_sequences(docs, documents):
    coder = tokens.Encoder("byte_bpe_50k.json")
    rows = packing.pack(docs, size=256, partition=20).collect()
    want = Counter()
    for d, t, *_ in documents:
        ids = np.array([*coder.batch([t or ""])[0], 0], dtype="<u4")
        first = len(ids) % 256 or 256
        for k, a in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[a : first if k == 0 else a + 256]
            want[d, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    lengths = [r["length"] for r in rows]
    assert len(bins) >= packing.lower_bound(lengths, 256)
    assert len(bins) <= packing.lower_bound(lengths, 256) * 1.1 + 4
    made, bound = packing.certificate(packing.pack(docs, size=256, partition=20), 256)
    assert bound == packing.lower_bound(lengths, 256) <= made <= len(bins) + 1


def test_lower_bounds_hold_and_packing_fits():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([10, 64, 2048])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 60))]
        bins = packing.best_fit_decreasing(lengths, size)
        fill = Counter()
        for b, n in zip(bins, lengths):
            fill[b] += n
        assert max(fill.values()) <= size and len(fill) == max(bins) + 1
        assert packing.lower_bound(lengths, size) <= len(fill)
    assert packing.lower_bound([6] * 7, 10) == 7 and packing.lower_bound([4] * 7, 10) == 4


def test_shards(docs, documents):
    rows = sharding.shard(docs, 8).collect()
    assert len(rows) == len(documents)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in documents)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    again = {(r["doc_id"], r["text_crc32"], r["row"]): r["place"] for r in sharding.shard(docs.repartition(7), 8).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["row"]): r["place"] for r in rows}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 101, 1000])
def test_permutation_is_one_and_computable(spark, n):
    from pyspark.sql import functions as F

    def place(x):
        a, first = sharding.side(n), True
        while first or x >= n:
            first, (hi, lo) = False, divmod(x, a)
            for k in sharding.round_keys(9):
                t = (lo + k) % sharding.PRIME
                t = (t * t % sharding.PRIME * 48271 + k) % sharding.PRIME
                hi, lo = lo, (hi + t) % a
            x = hi * a + lo
        return x

    got = {r["id"]: r["p"] for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n, 9).alias("p")).collect()}
    assert got == {i: place(i) for i in range(n)} and sorted(got.values()) == list(range(n))


def test_base_counts(docs, documents):
    got = sorted(((r["doc_id"], *[r["__q"][f] for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in quality.clean_lines(docs, into="__q").collect()), key=order)
    want = []
    for d, t, *_ in documents:
        t = t or ""
        words = t.encode().split()
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = set()
        for i in range(len(words) - 7):
            if c[tuple(words[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        n = len(words)
        want.append((d, n, sum(len(w.decode()) for w in words), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n))
    assert got == sorted(want, key=order)


def test_lines_that_fail():
    for line in ("Home | News | Sport | Weather | Contact", "All rights reserved.", "We use cookies: see our cookie policy.", "BUY NOW!! AND!! SAVE!! MORE!!", "this long line has no end at all", "the&&& of*** and### so$$$ on%%%."):
        assert quality.bad_line(line), line
    for line in ("A clean line of prose, with commas, ends here.", "Short title", "It costs 5% more than in 1999!", "«Déjà vu», he said."):
        assert not quality.bad_line(line), line


def test_languages(spark, none):
    rng = random.Random(4)
    words = {x: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(80)] for x, letters in (("aa", "abcdefgh"), ("bb", "hijklmno"), ("cc", "opqrstuéü"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 80))), lang) for i, lang in enumerate(rng.choices(list(words), k=300))]
    train = spark.createDataFrame([*rows[:200], (900, None, "aa"), (901, "abc", None)], "doc_id long, text string, lang string")
    test = [*[(i, t) for i, t, _ in rows[200:]], (500, None), (501, "123 456 !"), (502, ""), (None, rows[0][1])]
    out = language.identify(spark.createDataFrame(test, "doc_id long, text string"), train).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert sum(got[i] == lang for i, _, lang in rows[200:]) >= 97
    assert got[500] == got[501] == got[502] == "und" and got[None] == rows[0][2]
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(test)
    empty = language.identify(spark.createDataFrame(test, "doc_id long, text string"), train.limit(0)).collect()
    assert {r["lang_pred"] for r in empty} == {"und"}


def test_columns_of_any_name_stay(spark, documents):
    """Columns named as the operators' own, and with odd signs, come back as they were."""
    odd = ["a.b", "__d", "__t", "__z", "rest", "spans", "packed", "th", "__quality", "__repeats", "__later", "island", "co`l"]
    rows = [(d, t, *[f"{c}{k}" for c in odd]) for k, (d, t, *_) in enumerate(documents[30:60])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *odd])
    for f in (substrings.remove_repeats, suffixes.remove_later, quality.clean_lines):
        out = f(docs)
        assert out.columns[:-1] == docs.columns and out.columns[-1] not in docs.columns
        assert sorted((tuple(r)[:-1] for r in out.collect()), key=order) == sorted(rows, key=order)


def test_texts_longer_than_a_slice(spark, documents, monkeypatch):
    """One long text gives what it gives in one piece."""
    text = " ".join(t for _, t, *_ in documents[:40]) + "\n" + " ".join(documents[3][1].split()[:30] * 2)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    whole = [f(docs).orderBy("doc_id").collect() for f in (tokens.count_tokens, tokens.pieces)]
    coder = tokens.Encoder("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "SLICE_BYTES", 500)
    column = pa.array([text, None, "a b", ""])
    cut = [(row.tolist(), coder.counts(part)) for part, row in coder.slices(column)]
    assert len(cut) > 5 and sum(int(n.sum()) for _, n in cut) == whole[0][0]["n_tokens"] + coder.counts(pa.array(["a b"]))[0]
    assert b"".join(x for part, row in coder.slices(column) for x in coder.ids(part) if 0 in row) == next(coder.encode([text]))
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", 400)
    item = spark.createDataFrame([(1, text[2000:2300])], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contained(docs, item).collect()] == [1]


def test_empty_tables(none):
    assert substrings.remove_repeats(none).count() == 0
    assert suffixes.remove_later(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert packing.pack(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert tokens.count_tokens(none).count() == 0
    assert quality.clean_lines(none).count() == 0
    assert decontaminate.contained(none, none.selectExpr("doc_id item_id", "text")).count() == 0


def test_scratch_folder_is_the_sessions(spark):
    assert scratch_dir(spark)
