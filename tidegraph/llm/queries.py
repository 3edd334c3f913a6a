"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import centroids, decontaminate, divergence, jaccard, language, packing, quality, sharding, site_templates, substrings, suffixes, tokens, warc
from tidegraph.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a benchmark item, in lower case and without punctuation."""
    return decontaminate.contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives, read back and merged into one index; span and place order it by URL key, time and page (one span holds 100,000 captures)."""
    return warc.archive_and_index(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "span", "place")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that a string of 100 bytes covers which starts earlier too."""
    out = suffixes.remove_later(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "__later.n_bytes", "__later.n_removed", "__later.n_spans", F.sha2("__later.kept", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language.identify(docs, docs.where(F.coalesce(~held_out, F.lit(False))))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document, linked at a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a window of 35 words covers which occurs again."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "__repeats.n_words", "__repeats.n_removed", F.sha2(F.col("__repeats.kept").cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, by a permutation of row numbers."""
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"), 8)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of each document and whether line-first cleaning keeps it."""
    out = quality.clean_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", *[f"__quality.{x}" for x in quality.FIELDS if x != "cleaned"])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page, without what its host repeats."""
    out = site_templates.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "__main.text", "__main.n_chars")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each vector after three rounds from 16 of them."""
    out = centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.select("vec_id", "__cluster.*")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source differ from those of its language and of the other sources."""
    return divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_warc, op3_suffix_array, op4_language_id, op5_jaccard_join, op6_packing, op7_substrings, op8_sharding, op9_quality, op10_token_counts,
        op11_html, op12_centroids, op13_divergence,
    )
}

#: Words of a lower-cased text, its five-word shingles, for DuckDB.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^ \t\n\x0b\x0c\r]+')"


#: A text in composed lower case without punctuation.
_PLAIN = r"regexp_replace(lower(nfc_normalize(text)), '[^\pL\pM\pN]+', ' ', 'g')"


def _shingles(source: str, key: str, name: str, text: str = _LOWER) -> str:
    words = _WORDS.format(text)
    return f"""{name}_w AS (SELECT {key}, {words} AS w FROM {source} WHERE text IS NOT NULL),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_w WHERE len(w) > 0))"""


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {15 - 5 * j}) & 31) + 1, 1)" for i in range(8) for j in range(4))

#: One round of Lloyd's over the kept vectors v (q, n) and centroids c{i}.
def _lloyd(i: int) -> str:
    near = f"a{i} AS (SELECT q, n, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT q, n, cluster, list_sum(list_transform(range(1, 65), lambda j: (q[j] - c[j]) * (q[j] - c[j])))::BIGINT AS d FROM v, c{i}) GROUP BY q, n)"
    if i == 3:
        return near
    cell = "list_transform(range(1, 65), lambda j: 0)"
    return f"""{near}, u{i} AS (SELECT cluster, j, sum(n)::BIGINT AS m, sum(n * q[j])::BIGINT AS s FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY 1, 2),
m{i} AS (SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY j) AS c FROM u{i} GROUP BY 1),
c{i + 1} AS (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""".replace(cell, "")


_F = "((p - q) * (p - q)) // q"
_P = "(1 + (1000000000 * ({} + 1)::HUGEINT) // ({} + v))"

ORACLE_SQL: dict[str, str] = {
    "op12_centroids": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT q, count(*) AS n FROM e GROUP BY 1),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, q) - 1 AS cluster, q AS c FROM (SELECT q, sha256('1:' || vec_id) AS h FROM e ORDER BY h NULLS LAST, q LIMIT 16)),
{", ".join(_lloyd(i) for i in range(4))},
t AS (SELECT cluster, sum(n * d)::BIGINT AS s FROM a3 GROUP BY 1)
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, s AS cluster_inertia, (SELECT sum(s) FROM t)::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM e JOIN a3 USING (q) JOIN t USING (cluster) JOIN c3 USING (cluster)""",
    "op13_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
o AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(n, 0)::BIGINT AS n, coalesce(v, 0)::BIGINT AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM o GROUP BY 1, 2) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY 1) USING (lang)),
l AS (SELECT lang, sum(n)::BIGINT AS n, any_value(v) AS v FROM g GROUP BY 1),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS c, {_P.format("coalesce(o.n, 0)", "g.n")} AS p FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum({_F.replace("p - q", "a.p - b.p").replace("// q", "// b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, term AS item, ({_F})::BIGINT AS value FROM (SELECT p.lang, source, p.term, p, {_P.format("total", "l.n")} AS q FROM p JOIN k USING (lang, term) JOIN l ON l.lang = p.lang WHERE c > 0) WHERE p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM y
UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM z QUALIFY rank <= 200""",
    "op2_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
u AS (SELECT page_id, regexp_extract(trim(url), '^(https?)://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['s', 'h', 'p', 'q']) AS u FROM pages),
k AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_replace(lower(u.h), '^www\\.', ''), '.')), ',') || ')' || CASE WHEN u.p = '' THEN '/' ELSE lower(u.p) END || CASE WHEN length(u.q) > 1 THEN '?' || array_to_string(list_sort(string_split(lower(u.q[2:]), '&')), '&') ELSE '' END AS url_key FROM u)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url_key, 0 AS span, row_number() OVER (ORDER BY url_key, page_id) - 1 AS place FROM d JOIN k USING (page_id)""",
    "op1_decontaminate": f"""WITH {_shingles("documents", "doc_id", "d", _PLAIN)}, {_shingles("benchmark", "item_id", "b", _PLAIN)},
q AS (SELECT item_id, count(*) AS n_item_shingles FROM b GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment FROM m JOIN q USING (item_id) WHERE 10 * n_shared >= 8 * n_item_shingles""",
    "op5_jaccard_join": f"""WITH RECURSIVE {_shingles("documents", "doc_id", "d")},
c AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b USING (s) JOIN c x ON x.doc_id = a.doc_id JOIN c y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM documents LEFT JOIN c USING (doc_id) JOIN r ON r.a = doc_id GROUP BY doc_id""",
    "op7_substrings": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS k FROM i),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM t WHERE c > 1),
n AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM w),
x AS (SELECT n.doc_id, string_agg(n.w[n.j], ' ' ORDER BY n.j) FILTER (g.j IS NULL) AS kept, count(g.j) AS gone FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.j = n.j GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN x USING (doc_id)""",
}
