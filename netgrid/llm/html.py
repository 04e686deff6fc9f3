"""Main text of web pages, with what a site repeats on many pages removed.

Element subtrees are hashed, the hashes counted per host in Spark, and the
subtrees that recur on many pages of a host deleted, beside the elements that
name themselves menus, adverts and the like. Bare prose (headings and
paragraphs) directly in an article is never taken for template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netgrid.llm.memory import released, small_batches
from netgrid.plans.storage import materialise

#: A subtree on at least so many pages of a host, and this part of them, is template. Besides bare prose, whose words may
#: well return on a large host, MANY_PAGES are enough however many pages the host has.
LEAST_PAGES, LEAST_SHARE, MANY_PAGES = 5, 0.2, 10
#: A subtree with more than this part of a page's text is never deleted for recurring, nor is anything in it.
MAIN_SHARE = 2 / 3
#: Up to so many recurring hashes are sent to every task; beyond that a join brings them.
MOST_SENT = 200_000

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|template)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<[!?][^>]*>
    |</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>
    |<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>""",
    re.X | re.S | re.I,
)
_attr = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_space = re.compile(r"\s+")
# fixed values: kinds of elements of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption optgroup option".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption b i em strong a span br".split())
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "caption", "tbody", "tfoot", "thead", "tr"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DROPPED = set("head nav footer aside form button select input label fieldset dialog menu svg math canvas object embed audio video map script style".split())
# fixed values: words by which elements name themselves
NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar ad ads adv advert adverts advertisement advertising adsense "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert banner popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments respond reply replies disqus discussion widget toolbar pagination pager "
    "masthead topbar copyright disclaimer legal skip search hidden".split()
)
# fixed values: of these, words that a part of an article may have in its name as well; they count beside words of layout alone
WEAK = set("related legal search hidden social share sharing discussion notice alert banner menu comment comments reply replies respond promo subscription".split())
LAYOUT = set(
    "post posts article articles link links list box section block area container wrapper wrap inner content item items news story stories reading page pages topics left right "
    "top bottom main site form bar icon icons button buttons title heading header footer message messages info text group row col column panel card cards thread count".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())


def _telling(words: list[str]) -> list[str]:
    """The words of one name, without weak ones that stand beside others than words of layout: ``related-work`` is no list of links."""
    alone = all(w in WEAK or w in LAYOUT or w in NAMES or w.isdigit() for w in words)
    return [w for w in words if alone or w not in WEAK]


class Node:
    __slots__ = ("tag", "names", "drop", "children")

    def __init__(self, tag: str, names: frozenset[str] = frozenset(), drop: bool = False):
        self.tag, self.names, self.drop = tag, names, drop
        self.children: list[Node | str] = []


def _open(tag: str, attrs: str) -> Node:
    names, drop = set(), tag in DROPPED
    if attrs and not attrs.isspace():
        for k, v in _attr.findall(attrs):
            k, v = k.lower(), v.strip("\"'")
            if k in ("class", "id"):
                for name in html.unescape(v).split():
                    names.update(_telling([w.lower() for w in _word.findall(name)]))
            elif k == "role":
                drop |= v.lower() in ROLES
                names.update(["role-main"] if v.lower() == "main" else [])
            elif k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and re.search(r"display\s*:\s*none", v, re.I)):
                drop = True
    return Node(tag, frozenset(names), drop)


def parse(text: str) -> Node:
    """The tree of a page; end tags may be missing, and stray ones are ignored."""
    root = Node("#")
    stack, at = [root], 0
    for m in _token.finditer(text):
        if m.start() > at:
            stack[-1].children.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if end := m["end"]:
            end = end.lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == end:
                    del stack[i:]
                    break
            else:
                if end == "br":
                    stack[-1].children.append(" ")
        elif tag := m["tag"] or m["odd"]:
            tag, attrs = tag.lower().rstrip("/"), m["attrs"] or m["rest"] or ""
            if tag in CLOSES_P:
                _close(stack, {"p"}, {"#", "td", "th", "table", "button"})
            if tag in SIBLING:
                _close(stack, SIBLING[tag], SCOPE[tag])
            node = _open(tag, attrs)
            stack[-1].children.append(node)
            if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
                stack.append(node)
    if at < len(text):
        stack[-1].children.append(html.unescape(text[at:]))
    return root


def _close(stack: list[Node], tags: set[str], barrier: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in barrier:
            return


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def digests(root: Node) -> dict[int, int]:
    """Hash of every element's subtree (tags and text, white space aside), by the element's identity."""
    out: dict[int, int] = {}
    for n in reversed(list(walk(root))):
        h = xxhash.xxh64(n.tag)
        for c in n.children:
            h.update(_space.sub(" ", c.strip()) if isinstance(c, str) else out[id(c)].to_bytes(8, "little"))
            h.update(b"\0")
        out[id(n)] = h.intdigest()
    return out


def has_text(n: Node) -> bool:
    return any(not c.isspace() for x in walk(n) for c in x.children if isinstance(c, str))


def template_candidates(root: Node) -> list[Node]:
    """Elements that may be site template: any with text, but bare prose inside an article or main part."""
    out, stack = [], [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag in ("article", "main")
        if n.tag not in ("#", "html", "body", "head", "article", "main") and not (inside and n.tag in PROSE and not n.names) and n.tag not in VOID:
            out.append(n)
        if n.tag != "head":
            stack += [(c, inside) for c in n.children if isinstance(c, Node)]
    return [n for n in out if has_text(n)]


def signed(n: Node, digest: int) -> int:
    """A candidate's digest as a signed number, odd for bare prose and even for others."""
    return int(np.uint64(digest & ~1 | (n.tag in PROSE and not n.names)).view(np.int64))


def subtree_hashes(page: str | None) -> set[int]:
    """Signed hashes of a page's candidate subtrees."""
    if not page:
        return set()
    root = parse(page)
    h = digests(root)
    return {signed(n, h[id(n)]) for n in template_candidates(root)}


def _size(n: Node) -> int:
    return sum(len(c.strip()) for x in walk(n) for c in x.children if isinstance(c, str))


def main_text(page: str | None, recurring: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of the page's articles in page order, parted by an empty line; empty when there are none.

    The main elements are taken where the articles in them hold less than half
    of their text, and the whole page where there is neither.
    """
    if not page:
        return ""
    root = parse(page)
    if recurring:
        h, whole, kept = digests(root), _size(root), set()
        for n in template_candidates(root):  # parents before children
            if id(n) not in kept and signed(n, h[id(n)]) in recurring:
                if _size(n) > MAIN_SHARE * whole:
                    kept |= {id(x) for x in walk(n)}
                else:
                    n.drop = True
    holds = {id(n) for n in walk(root) if n.tag in ("article", "main") or "role-main" in n.names}
    above: dict[int, bool] = {}
    for n in reversed(list(walk(root))):
        above[id(n)] = id(n) in holds or any(above[id(c)] for c in n.children if isinstance(c, Node))

    def dropped(n: Node, inside: bool) -> bool:
        if n.tag in ("html", "body", "article", "main", "#"):
            return False
        if n.drop:
            return n.tag in DROPPED or not above[id(n)]
        if n.tag == "header" or "header" in n.names:
            return not inside and not above[id(n)]
        return bool(n.names & NAMES) and not above[id(n)]

    # drop first, so that the choice of the main part sees what is left
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside = inside or n.tag == "article"
        n.children = [c for c in n.children if isinstance(c, str) or not dropped(c, inside)]
        stack += [(c, inside) for c in n.children if isinstance(c, Node)]
    tops = outermost([root], lambda n: n.tag == "main" or "role-main" in n.names)
    articles = outermost(tops or [root], lambda n: n.tag == "article")
    if articles and (not tops or 2 * sum(map(_size, articles)) >= sum(map(_size, tops))):
        tops = articles
    return "\n\n".join(x for top in tops or [root] for x in blocks(top))


def outermost(tops: list[Node], wanted) -> list[Node]:
    """In page order, the wanted nodes at or below ``tops`` that lie in no other such node."""
    out, stack = [], tops[::-1]
    while stack:
        n = stack.pop()
        if wanted(n):
            out.append(n)
        else:
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def blocks(top: Node) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def flush():
        text = _space.sub(" ", "".join(now)).strip()
        if text:
            out.append(text)
        now.clear()

    stack: list = [top]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            now.append(n)
        elif n.tag in BLOCK or n is top:
            flush()
            stack.append(None)
            stack += reversed(n.children)
        else:
            if n.tag in ("br", "td", "th", "img"):
                now.append(" ")
            if n.tag in ("td", "th"):
                stack.append(" ")
            stack += reversed(n.children)
    flush()
    return out


def host(url) -> F.Column:
    """Lower-case host of a url, without user and port; empty when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """``(host, page, h)``: the candidate subtrees of every page, and a row without h that counts it. ``pages``: host, page, html."""

    def run(batches):
        for b in batches:
            hosts, keys, hashes = [], [], []
            for x, key, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = subtree_hashes(page)
                hosts += [x] * (len(own) + 1)
                keys += [key] * (len(own) + 1)
                hashes += [None, *own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "page", "h"])

    return pages.select("host", "page", "html").mapInArrow(released(run), "host string, page long, h long")


def recurring_subtrees(pages: DataFrame) -> DataFrame:
    """``(host, h)``: subtrees that recur on many pages of a host; equal pages count once. ``pages``: host, page, html."""
    counts = page_subtrees(pages).distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    many = counts.where("h is not null").where(F.col("n") >= LEAST_PAGES)
    total = counts.where("h is null").select("host", F.col("n").alias("pages"))
    share = LEAST_SHARE * F.col("pages")
    least = F.when(F.col("h").bitwiseAND(F.lit(1)) == 1, share).otherwise(F.least(share, F.lit(float(MANY_PAGES))))
    return many.join(total, "host").where(F.col("n") >= least).select("host", "h")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row. Null or empty html gives an empty text.

    Repeated rows are each extracted, but equal html counts as one page of its
    host; pages without a host share the empty one. Extra columns are ignored.
    A subtree that as many pages of a host have as are needed is template,
    ties at that number included. Hosts of fewer than LEAST_PAGES distinct pages have no template, so
    what recurs there stays unless its names tell what it is.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html")).withColumn("page", F.xxhash64("html"))
    small_batches(pages.sparkSession)
    found = materialise(recurring_subtrees(src), "template")
    if found.count() <= MOST_SENT:
        t = found.toArrow()
        by: dict[str, set[int]] = {}
        for x, h in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            by.setdefault(x, set()).add(h)
        sent = pages.sparkSession.sparkContext.broadcast(by)
        rows = src.withColumn("own", F.lit(None).cast("array<long>"))
    else:  # a page's own ones among them, bounded by its size
        sent = None
        own = page_subtrees(src).where("h is not null").distinct().join(found, ["host", "h"]).groupBy("host", "page").agg(F.collect_list("h").alias("own"))
        rows = src.join(own, ["host", "page"], "left")

    def run(batches):
        for b in batches:
            text = []
            for x, page, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                text.append(main_text(page, sent.value.get(x, frozenset()) if sent else frozenset(own or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = src.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.select("page_id", "url", "host", "html", "own").mapInArrow(released(run), schema)
