"""Main text of web pages: what a host repeats on many pages is its template and goes, and so does what the markup itself names as something else.

Every page is read into a tree. Each block element's subtree gets a hash of its tags and text; Spark counts for each host on how many different pages a hash
occurs. Subtrees that recur on many pages of their host are deleted, then the text of what is left of the article is put together by blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidegraph.llm.common import bounded_batches, free_name, quoted, stored

# names of elements, by what HTML says of them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
HEAD = frozenset("base link meta title style script noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold running text; inside the article they are content, however often they recur.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt dl td th tr figcaption caption summary".split())
#: Start tags that end an open p, as BLOCK but for the parts of tables and lists, which have rules of their own.
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
#: What a start tag ends, and where the search stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of an article's text.
NEVER = RAW | frozenset("head nav footer aside form button select option datalist input label fieldset dialog menu object embed canvas svg math audio video map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in the class or id of elements that are not part of an article's text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar widget widgets footer masthead topbar comment comments commentlist disqus respond replies share sharing social newsletter subscribe subscription signup login paywall related recommended recommendations toolbar pagination pager copyright disclaimer".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?\]\]>|[!?][^>]*>?|/(?![a-zA-Z])[^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
#: Elements open at once; deeper ones count as part of their parent.
DEEPEST = 512


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    parts: list[Node | str] = field(default_factory=list)
    mark: int = 0

    def elements(self) -> Iterator[Node]:
        """This element and all below it, in page order."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def named(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attributes)} if self.attributes else {}


def tree(html: str) -> Node:
    """The elements of a page. Open elements end where HTML says that others end them; end tags without a start are passed over, elements open at the end
    of the page end there. Text is decoded; that of scripts, styles and the like is left out."""
    root = Node("html")
    stack, at = [root], 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(unescape(piece) if "&" in piece else piece)

    while (m := _TAG.search(html, at)) is not None:
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK and stack[i].tag != "p":  # an inline end tag ends nothing outside its block
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body":
                del stack[1:]
                root.attributes += m[3] or ""
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in ENDS:
            ended, stop = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    del stack[i:]
                    break
                if stack[i].tag in stop:
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        node = Node(tag, m[3] or "")
        stack[-1].parts.append(node)
        if tag not in VOID and not (m[3] or "").endswith("/") or tag in BLOCK and tag not in VOID:
            if len(stack) < DEEPEST:
                stack.append(node)
    text(html[at:])
    return root


def hashed(root: Node) -> list[int]:
    """Sets mark of each block element to a hash of its subtree (tags and text, white space as one space) and returns those with text in them."""
    found: list[int] = []

    def finish(node: Node, inner: list[bytes]) -> bytes:
        """What the element adds to its parent's hash."""
        if node.tag not in BLOCK:
            return b" ".join(inner)
        body = b" ".join(b" ".join(inner).split())
        mark = xxhash.xxh3_64_intdigest(b"<" + node.tag.encode() + b">" + body)
        node.mark = mark - (1 << 64) if mark >> 63 else mark
        if body:
            found.append(node.mark)
            return b"<" + mark.to_bytes(8, "big").hex().encode() + b">"
        return b""

    stack: list[tuple[Node, Iterator[Node | str], list[bytes]]] = [(root, iter(root.parts), [])]
    while True:
        node, rest, inner = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            made = finish(node, inner)
            if not stack:
                return found
            stack[-1][2].append(made)
        elif isinstance(child, Node):
            stack.append((child, iter(child.parts), []))
        else:
            inner.append(child.encode("utf-8", "replace"))


def foreign(node: Node, holds_article: bool) -> bool:
    """Whether the markup says that an element is not part of an article's text."""
    if node.tag in NEVER:
        return True
    if not node.attributes:
        return False
    a = node.named()
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if holds_article:
        return False
    if a.get("role", "").lower() in ROLES:
        return True
    return any(w.lower() in NAMES for name in (a.get("class", ""), a.get("id", "")) for w in _WORD.findall(name))


def cleared(root: Node) -> None:
    """Deletes what the markup itself says is no article: by element, role, name, or as hidden."""
    above: dict[int, Node] = {}
    holders: set[int] = set()
    every = list(root.elements())
    for node in every:
        for p in node.parts:
            if isinstance(p, Node):
                above[id(p)] = node
    for node in every:
        if node.tag in ("article", "main"):
            up = above.get(id(node))
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = above.get(id(up))
    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.parts = [p for p in node.parts if not isinstance(p, Node) or not foreign(p, id(p) in holders)]
        waiting += [p for p in node.parts if isinstance(p, Node)]


def articles(root: Node) -> list[Node]:
    """The outermost article elements; else the main element; else the page."""
    out: list[Node] = []
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.named().get("role", "").lower() == "main"):
        waiting = [root]
        while waiting:
            node = waiting.pop()
            if wanted(node):
                out.append(node)
            else:
                waiting += [p for p in reversed(node.parts) if isinstance(p, Node)]
        if out:
            return out
    return [root]


def without(root: Node, template: set[int], inside: bool) -> None:
    """Deletes the subtrees of the template below root; inside an article its running text stays."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.parts = [p for p in node.parts if not (isinstance(p, Node) and p.mark in template and not (inside and p.tag in TEXT))]
        waiting += [p for p in node.parts if isinstance(p, Node) and not (inside and p.tag in TEXT)]


def menu_like(node: Node) -> bool:
    """Whether a list or container consists of links: three at least, with nine tenths of the characters."""
    links = inside = total = 0
    waiting: list[tuple[Node | str, bool]] = [(node, False)]
    while waiting:
        part, linked = waiting.pop()
        if isinstance(part, str):
            n = len(part.strip())
            total, inside = total + n, inside + n * linked
            continue
        links += part.tag == "a"
        waiting += [(p, linked or part.tag == "a") for p in part.parts]
    return links >= 3 and 10 * inside >= 9 * total


def block_texts(roots: list[Node]) -> list[str]:
    """The texts of blocks in page order, white space as one space; those without text are left out."""
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now and (line := " ".join("".join(now).split())):
            blocks.append(line)
        now.clear()

    for root in roots:
        stack: list[Node | str | None] = [root]
        while stack:
            part = stack.pop()
            if part is None:
                close()
            elif isinstance(part, str):
                now.append(part)
            elif part.tag in BLOCK:
                close()
                stack.append(None)
                stack += reversed(part.parts)
            elif part.tag in ("br", "wbr", "img"):
                now.append("" if part.tag == "wbr" else " ")
            else:
                stack += reversed(part.parts)
        close()
    return blocks


def page_hashes(html: str) -> tuple[int, list[int]]:
    """A hash of the page's article (what makes pages of a host different) and those of all its block elements with text, each once."""
    root = tree(html)
    marks = hashed(root)
    found = articles(root)
    body = hash_of("\n".join(str(n.mark) for n in found))
    return body, sorted(set(marks))


def hash_of(text: str) -> int:
    x = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return x - (1 << 64) if x >> 63 else x


def extracted(html: str, template: set[int]) -> tuple[str, int]:
    """The main text of a page, and how many block elements were deleted as template."""
    root = tree(html)
    before = 0
    if template:
        hashed(root)
        before = sum(1 for n in root.elements() if n.tag in BLOCK)
    found = articles(root)
    whole = found == [root]
    if template:
        if whole:
            without(root, template, False)
        else:
            for node in found:
                without(node, template, True)
            own = {id(n) for n in found}
            waiting = [root]
            while waiting:  # outside of the articles everything that recurs goes
                node = waiting.pop()
                node.parts = [p for p in node.parts if not (isinstance(p, Node) and id(p) not in own and p.mark in template and not any(id(x) in own for x in p.elements()))]
                waiting += [p for p in node.parts if isinstance(p, Node) and id(p) not in own]
    gone = before - sum(1 for n in root.elements() if n.tag in BLOCK) if template else 0
    cleared(root)
    found = articles(root)
    if found == [root]:
        waiting = [root]
        while waiting:
            node = waiting.pop()
            node.parts = [p for p in node.parts if not (isinstance(p, Node) and (p.tag == "header" or p.tag in ("ul", "ol", "div", "section", "table") and menu_like(p)))]
            waiting += [p for p in node.parts if isinstance(p, Node)]
    return "\n".join(block_texts(found)), gone


STRUCT = "struct<text: string, n_chars: bigint, n_template: bigint>"


def host() -> F.Column:
    """The host of url, in lower case and without user and port; null where there is none."""
    found = F.regexp_extract(F.lower("url"), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(found, F.lit(""))


def templates(pages: DataFrame, least_pages: int = 5, least_share: float = 0.1) -> DataFrame:
    """host, template: the hashes of block elements that occur on at least least_pages different pages of the host and on least_share of them.

    Pages of a host with the same article count as one. At most 1 / least_share times as many hashes are kept as a page of the host has block elements on average.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [page_hashes(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([b for b, _ in made], pa.int64()), pa.array([m for _, m in made], pa.list_(pa.int64()))], ["host", "body", "marks"])

    seen = pages.select(host().alias("host"), "html").where("host is not null").mapInArrow(run, "host string, body long, marks array<long>")
    # null mark: the page itself
    each = seen.select("host", "body", F.explode(F.concat("marks", F.array(F.lit(None).cast("long")))).alias("mark")).distinct()
    counted = stored(each.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")), "marks")
    many = counted.where("mark is null").select("host", F.col("n").alias("pages"))
    often = counted.where(F.col("mark").isNotNull() & (F.col("n") >= least_pages)).join(many, "host").where(F.col("n") >= F.lit(least_share) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("mark").alias("template"))


def main_text(pages: DataFrame, least_pages: int = 5, least_share: float = 0.1, into: str = "__main") -> DataFrame:
    """pages (url, html and any others) with one more column at the end: struct of text, n_chars (code points) and n_template, block elements deleted as template.

    The article is the outermost article elements, else main, else the page. Subtrees of the host's template go (see templates): anywhere outside the article,
    and inside it unless they are running text (paragraphs, headings, items, cells), so that sentences which an author repeats stay. Then go scripts, styles, menus,
    footers, sidebars, forms and hidden elements, and elements whose role, class or id names them as adverts, notices, comments and the like; on pages without an article also headers and lists of links.
    Character references are decoded, white space in a block becomes one space, blocks are joined by a line break in page order.

    The column is called ``into``, with underscores after it where pages has one of that name. A null or empty html gives an empty text. Pages without a host (null or odd url) have no template.
    Repeated rows and null ids stay as they are; very long pages are read whole, in memory that grows with the page. Template sets reach pages by a join whose way Spark picks by their size.
    """
    spark = pages.sparkSession
    found = stored(templates(pages, least_pages, least_share), "templates")
    rest = [c for c in pages.columns if c != "html"]
    joined = pages.select(F.struct(*[F.col(quoted(c)) for c in rest]).alias("rest"), "html", host().alias("host")).join(found, "host", "left").select("rest", "html", "template")
    schema = StructType([*joined.schema.fields[:2], StructField("found", _parse_datatype_string(STRUCT))])
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("template")
            known: dict[tuple, set[int]] = {}
            out = []
            for html, code in zip(batch.column("html").to_pylist(), codes.to_pylist(), strict=True):
                key = tuple(code or ())
                text, gone = extracted(html or "", known.setdefault(key, set(key)))
                out.append((text, len(text), gone))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["text", "n_chars", "n_template"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], made], ["rest", "html", "found"])

    out = joined.mapInArrow(run, schema)
    columns = [F.col("html") if c == "html" else F.col("rest").getField(c).alias(c) for c in pages.columns]
    return out.select(*columns, F.col("found").alias(free_name(pages.columns, into)))
