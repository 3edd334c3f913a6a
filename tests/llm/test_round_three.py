"""Site templates, centroid clustering and the source audit, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegraph.llm import centroids, divergence, site_templates

# pages


def page(body, n=0):
    return f'<!DOCTYPE html><html><head><title>T{n}</title><style>p{{x:y}}</style><script>var t="</p><article>";</script></head><body>{body}</body></html>'


PAGES = {
    "plain article": (
        '<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy!</div><article><h1>Big &amp; small</h1><p>One  two\n three.<br>Four<p><b>Five</b> s<i>i</i>x &lt;7&gt; &eacute;&#x4e2d;&nbsp;end</p></article><footer>&copy; x</footer>',
        "Big & small\nOne two three. Four\nFive six <7> é中 end",
    ),
    "parts inside the article": (
        '<header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>Text.</p><div class="share-buttons">Share this</div><aside>See also</aside><form><input><label>Mail</label></form><div id="cookieNotice">We use cookies</div>'
        '<p>More.</p><footer>By me</footer><section class="comments"><p>First!</p></section></article></main><div class="sidebar"><p>Side</p></div>',
        "Title\nText.\nMore.",
    ),
    "comments are articles": ('<article><p>Own.</p></article><div id="comments"><article class="comment"><p>Me too</p></article></div>', "Own."),
    "main only": ('<div id="topbar">Log in</div><div role="main"><h2>Head</h2>loose <em>text</em><p>Par</p>tail</div><div>Other</div>', "Head\nloose text\nPar\ntail"),
    "neither": ('<header>Logo</header><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><div><p>Body text.</p><ul><li>item a</li><li>item b</ul></div><div hidden>no</div><div style="display: none">no</div>', "Body text.\nitem a\nitem b"),
    "table and list": ("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>k<dd>v</dl><pre>x\n  y</pre></article>", "a\nb\nc\nk\nv\nx y"),
    "unclosed": ("<article><div><p>One<p>Two <a href='>'>link</a><h2>Head<h3>Sub</h3><script>if (a < b) {}", "One\nTwo link\nHead\nSub"),
    "comments of markup": ("<article><!-- <p>no</p> --><p>yes<!---->!</p><?php echo 1 ?><p>a < b and c > d</p></p></article>", "yes!\na < b and c > d"),
    "words that only look like names": ('<article class="post header"><p class="additional">kept</p><div class="adapter shadow"><p>kept too</p></div></article>', "kept\nkept too"),
    "void": ("<article>a<wbr>b<img src=x>c<hr>d</article>", "ab c\nd"),
}


@pytest.mark.parametrize("name", PAGES)
def test_markup(name):
    body, want = PAGES[name]
    assert site_templates.extracted(page(body), set())[0] == want


def test_odd_pages():
    for html in ("", "<", "<<<>>>", "</p></div>", "text", "&", "<article", "<!--", "<script>", "<p " + "x" * 10_000, "\x00퟿"):
        site_templates.extracted(html, set())
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert site_templates.extracted(deep, set())[0] == "deep"
    assert site_templates.page_hashes(deep)[1]
    long = "<article>" + "<p>word &amp; word</p>" * 200_000 + "</article>"
    assert site_templates.extracted(long, set())[0].count("\n") == 199_999


def test_hashes_see_text_and_tags_only():
    one, two, other = ([n.mark for n in t.elements() if n.tag == "div"] for t in map(site_templates.tree, ("<div class=a> x <b>y</b></div>", "<div id=q>x\n<b>y</b> </div>", "<div>x z</div>")) if site_templates.hashed(t))
    assert one == two != other


def made_pages():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows, want = [], []
    for i in range(40):
        par = [prose(9) for _ in range(3)]
        own = "A sentence that the author repeats." if i % 2 and i < 30 else par[0]
        box = "<div><div>Subscribe to our daily letter</div><p>It is free</p></div>"
        body = f'<div class="q1"><div>Home of the brave</div></div><div><h1>{par[1]}</h1>{f"<article><h1>{par[1]}</h1><p>{own}</p>{box}<p>{par[2]}</p></article>" if i < 30 else f"<p>{own}</p>{box}"}</div><div>Hosted by us</div>'
        rows.append((i, f"https://User@Site.example.org:80/{i}", page(body, i)))
        want.append("\n".join([par[1], own, par[2]] if i < 30 else [par[1], own]))
    # copies of one page are one page of its host
    for i in range(40, 60):
        rows.append((i, f"http://copies.example.org/{i}", page(f"<div><p>Always this</p></div><div>{'and that'}</div>")))
        want.append("Always this\nand that")
    return rows, want


def test_what_a_host_repeats_goes(spark):
    rows, want = made_pages()
    rows[30:40] = [(i, u.replace("Site", "other"), h) for i, u, h in rows[30:40]]
    odd = [(60, None, rows[0][2]), (61, "no url", rows[0][2]), (None, "http://a/", None), (0, rows[0][1], rows[0][2]), (62, "http://a/", "")]
    plain = want[0].split("\n")
    whole = "\n".join([*plain[:2], "Subscribe to our daily letter", "It is free", plain[2]])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "page_id long, url string, html string, text string, __main int").repartition(4)
    out = site_templates.main_text(df)
    assert out.columns == ["page_id", "url", "html", "text", "__main", "__main_"]
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["__main_"]["text"], r["__main_"]["n_chars"]) for r in out.collect()))
    expect = [(r[0], w) for r, w in zip(rows, want)] + [(60, whole), (61, whole), (-1, ""), (0, want[0]), (62, "")]
    assert got == sorted((i, t, len(t)) for i, t in expect)


def test_no_pages(spark):
    assert site_templates.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# vectors


def plain_clusters(rows, k=16, rounds=3, size=64, scale=64, seed="1"):
    kept = [(v, [math.floor(scale * x) for x in e]) for v, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda v: (v is None, hashlib.sha256(f"{seed}:{v}".encode()).hexdigest())
    cents = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(cents)), key=lambda c: (dist(q, cents[c]), c))
    for _ in range(rounds):
        of = [near(q) for _, q in kept]
        for c in range(len(cents)):
            own = [q for (_, q), a in zip(kept, of) if a == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    of = [near(q) for _, q in kept]
    d = [dist(q, cents[c]) for (_, q), c in zip(kept, of)]
    inertia = Counter()
    for c, x in zip(of, d):
        inertia[c] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(v, c, x, inertia[c], sum(d), sha[c]) for (v, _), c, x in zip(kept, of, d)]


def made_vectors(size=64, wide=1.0):
    rng = random.Random(11)
    middle = [[rng.uniform(-wide, wide) for _ in range(size)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, wide / 8))) for x in middle[i % 5]]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(150)]  # a vector that most rows have
    rows += [rows[7], (7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]
    return rows + [(300, None), (301, []), (302, [0.5] * (size - 1)), (303, [0.5] * (size + 1)), (304, [None] + [0.5] * (size - 1)), (305, [float("nan")] * size), (306, [0.1] * (size - 1) + [float("inf")])]


def row_order(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("wide", [1.0, 60_000.0])
def test_clusters(spark, wide):
    rows = made_vectors(wide=wide)
    df = spark.createDataFrame([(v, e, "x", 5) for v, e in rows], "vec_id long, embedding array<float>, cluster string, q int").repartition(5)
    out = centroids.cluster(df)
    assert out.columns == ["vec_id", "embedding", "cluster", "q", "__cluster"]
    got = [(r["vec_id"], *r["__cluster"]) for r in out.collect()]
    assert sorted(got, key=row_order) == sorted(plain_clusters(rows), key=row_order)


def test_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-1.0] * 64)]
    got = [(r["vec_id"], *r["__cluster"]) for r in centroids.cluster(spark.createDataFrame(rows, kind)).collect()]
    assert sorted(got) == sorted(plain_clusters(rows))
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], kind)).collect() == []
    assert centroids.cluster(spark.createDataFrame([], kind)).collect() == []
    with pytest.raises(Exception, match="leaves the range"):
        centroids.cluster(spark.createDataFrame([(1, [1e300] * 64)], kind)).collect()


def test_sums_of_any_size():
    q = np.array([[centroids.LARGEST, -centroids.LARGEST], [1, 2]])
    n = np.array([1 << 40, 3])
    assert centroids.weighted_sums(q, n, np.array([0, 0]), 2) == [[(1 << 40) + 3, centroids.LARGEST * (1 << 40) + 3, -centroids.LARGEST * (1 << 40) + 6], [0, 0, 0]]


# sources


def plain_audit(rows, least=3, most=200):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs, count = set(), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = pattern.findall((text or "").translate(lower))
        docs.update((lang, w) for w in set(words))
        count[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((w for (x, w), n in docs.items() if x == lang and n >= least), key=lambda w: w.encode())
        mine = sorted((s for x, s in groups if x == lang), key=lambda s: s.encode())

        def p(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (n + len(kept)) for w in kept}

        every = Counter()
        for s in mine:
            every.update(count[lang, s])
        q, ps = p(every), {s: p(count[lang, s]) for s in mine}
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = sorted(((-sum(f(ps[s][w], ps[t][w]) for w in kept), t.encode(), t) for t in mine if t != s))
            out += [(lang, s, "pair", t, -v, i + 1) for i, (v, _, t) in enumerate(pairs)]
            terms = sorted((-f(ps[s][w], q[w]), w.encode(), w) for w in kept if count[lang, s][w] and ps[s][w] > q[w])
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(terms[:most])]
    return sorted(out)


def made_texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgéßλ", k=rng.randint(1, 4))) for _ in range(500)] + ["Big", "BIG", "x1y", "中文"]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(150):
        text = "".join(w + rng.choice([" ", "-", "1", ". "]) for w in rng.choices(words, weight, k=rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c", "Z", "é"])))
    rows += [rows[0], rows[0], (None, "en", "empty"), ("", "en", "empty"), ("solo word", None, None), ("solo word", None, "z"), ("solo", "fr", None), (None, "xx", "a"), (None, "xx", "b"), ("12 34 !", "en", "d")]
    return rows


def test_audit(spark, monkeypatch):
    rows = made_texts()
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == plain_audit(rows)
    # several blocks of vectors and of sources, fewer terms
    monkeypatch.setattr(divergence, "VECTORS", 40)
    assert sorted(tuple(r) for r in divergence.audit(df, most=3).collect()) == plain_audit(rows, most=3)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_blocks_of_sources():
    import pandas as pd

    vectors = pd.DataFrame({"at": [np.array([0, 2]), np.array([1])], "count": [np.array([3, 1]), np.array([2])], "terms": [2, 5]})
    groups = pd.DataFrame({"at": [2, 0, 1], "total": [2, 6, 10], "v": [7, 7, 7]})
    whole = divergence._compared(("en", 0, 0), vectors, groups)
    divergence.SOURCES, kept = 2, divergence.SOURCES
    try:
        parts = pd.concat([divergence._compared(("en", 0, i), vectors, groups) for i in (0, 1)])
    finally:
        divergence.SOURCES = kept
    assert whole.values.tolist() == parts.values.tolist() and len(whole) == 6


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    text = " ".join(random.Random(1).choices(["alpha", "Beta", "gämma", "中文字"], k=3000))
    batch = pa.record_batch({"lang": ["en", "en"], "source": ["a", "a"], "text": [text, "Alpha beta"]})
    want = sorted(map(str, divergence._slice(batch, 0, 1).to_pylist()))
    monkeypatch.setattr(divergence, "PIECE", 500)
    assert sorted(map(str, _merged(divergence._slice(batch, 0, 1).to_pylist()))) == sorted(map(str, _merged([eval(x) for x in want])))


def _merged(rows):
    out = {}
    for r in rows:
        key = (r["lang"], r["source"], r["term"])
        n, d = out.get(key, (0, 0))
        out[key] = (n + r["n"], d + r["docs"])
    return sorted(out.items())


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    counts = [0, 5, 8_999_999_999, 9_000_000_000, 10**14]
    got = [r["p"] for r in spark.createDataFrame([(c,) for c in counts], "c long").select(divergence.share(F.col("c"), F.lit(10**15), F.lit(7)).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (10**15 + 7) for c in counts] == divergence.shares(np.array(counts), np.array([10**15] * 5), np.array([7] * 5)).tolist()


# memory of long texts, the verdict of op9, packing in partitions


def test_language_of_a_long_text_in_bounded_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from tidegraph.llm import language

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=4)) for _ in range(200)]
    short = " ".join(rng.choices(words, k=400))
    code = np.concatenate([c for c, _, _ in language.blocks(*language.folded(pa.array([short])))])
    g, n = np.unique(code, return_counts=True)
    f = language.Filter(["xx"], {0: (g, n / n.sum())}, "xx")
    texts = pa.array([short, "other zzzz", None, "", short * 3, "é"])
    want = f.scores(*language.folded(texts))
    monkeypatch.setattr(language, "BLOCK", 37)
    assert np.array_equal(f.scores(*language.folded(texts)), want)
    monkeypatch.undo()
    column = pa.array([" ".join(rng.choices(words, k=6_000_000))])  # 30 MB
    tracemalloc.start()
    f.scores(*language.folded(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * column.nbytes  # what numpy holds


def plain_verdict(text):
    """base_failed and kept of a text, rule by rule."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    lost = total = 0
    for line in (text or "").split("\n"):
        tokens = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", line) if w]
        if not tokens:
            continue
        n = len(line.split())
        total += len(line)
        separators = sum(line.count(c) for c in "|»›•·") + len(re.findall(r"(?<=\s)>(?=\s)", line))
        menu = separators >= 3 and 4 * separators >= n
        noise = n > 2 and 10 * sum(c in "#*$%&|<>" for c in line) > 3 * n
        loud = 3 * line.count("!") > n + 2 or n >= 5 and line.upper() == line and line.lower() != line
        ending = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "。", "！", "？")
        unfinished = n >= 5 and line.rstrip()[-1:] not in ending
        phrases = ["all rights reserved", "privacy policy", "read more", "subscribe", "leer más", "lire la suite", "impressum"]
        told = sum(len(p) for p in phrases if re.search(rf"\b{p}\b", line, re.I))
        if menu or noise or loud or unfinished or 8 * told >= len(line.strip()) and told:
            lost += len(line)
    return base, not base and 2 * lost <= total


def test_verdict_of_quality_rules(spark):
    from tidegraph.llm import quality

    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) + "."
    bad = ["Home | News | Sport | More", "All rights reserved.", "Read more", "BUY THE BEST CARS HERE NOW", "### *** $$$ a b", "Wow!!! So great!!! Yes!!!", "a title without any end", "Subscribe for free.", "Leer más", "Impressum"]
    texts = [None, "", prose(19), prose(20), prose(40), prose(40) + " Read more in the privacy policy", "read more " + prose(60)]
    for _ in range(60):
        lines = [prose(rng.randint(4, 25)) for _ in range(rng.randint(1, 4))] + rng.choices(bad, k=rng.randint(0, 16))
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [f"{prose(12)}\n" * 5, (prose(9) + " ") * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["q"]["base_failed"], r["q"]["kept"]) for r in quality.clean_lines(df, into="q").collect()}
    assert got == {i: plain_verdict(t) for i, t in enumerate(texts)}
    assert {k for _, k in got.values()} == {True, False} and sum(not b and not k for b, k in got.values()) > 3


def test_packing_in_partitions_reaches_that_of_one(spark):
    from tidegraph.llm import packing

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, least = packing.certificate(packing.pack(docs, partition=100_000))
    packed = packing.pack(docs, partition=150).cache()
    many, same = packing.certificate(packed)
    assert least == same and least <= one <= many <= one + 1
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()
    assert packed.select("doc_id", "piece").distinct().count() == packed.count()
