"""Main text of web pages: subtrees that a host repeats on many pages go, then what is named as boilerplate.

Every block element's subtree is hashed (tags, text and structure, no attributes), wherever it stands, and
so is every run of loose text between blocks.  For each host and hash Spark counts the distinct pages, where
pages of the same whole text count once, so mirrored copies of an article do not make its paragraphs look
like a template.  A subtree on at least LEAST_PAGES such pages and a share of LEAST_SHARE of the host's is
template and goes; the article is looked for in what is left.  Mirrors may differ in a line: where templates
of less than COMMON_SHARE would leave less than LEAST_LEFT of a page's text, they are taken for its article
and stay.

Text blocks (paragraphs, headings, lists, tables and the like) inside an ``article`` or ``main`` element need
more evidence, because articles do quote the same passages: they go if they stand on a share of COMMON_SHARE
of the host's pages and in an unbroken run of such blocks at the body's start or end, or, at any place, if
they stand on EVERYWHERE_PAGES pages and a share of EVERYWHERE_SHARE.  What counts by name (navigation,
footers, forms, adverts, comments and so on, by tag, role, class or id) goes whether it recurs or not: menus
and adverts that differ from page to page, and hosts of few pages, have nothing to count.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator, Mapping, Set
from dataclasses import dataclass
from hashlib import blake2b
from types import MappingProxyType
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.shared import in_arrow, written
from weftgraph.llm.words import chunks

LEAST_PAGES = 3
LEAST_SHARE = 0.01
#: For text blocks of an article: at its edge, and anywhere.
COMMON_SHARE = 0.5
EVERYWHERE_PAGES, EVERYWHERE_SHARE = 10, 0.9
LEAST_LEFT = 0.1
#: What a template's share of its host's pages lets it do, from LEAST_SHARE on.
RARE, COMMON, EVERYWHERE = 1, 2, 3
#: Template lists of at most so many entries on all pages are broadcast; beyond it the join shuffles.
BROADCAST_ENTRIES = 2_000_000
#: Templates of at most so many (host, subtree) are broadcast; beyond it the join shuffles.
BROADCAST_SUBTREES = 1_000_000
HASHES = "page_id long, url string, host long, page long, boxes array<long>, texts array<long>"
OUT = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Text blocks that inside an article need more evidence than others.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr figcaption ol ul dl table tbody article main body html".split())
DROP = frozenset("head script style noscript template iframe object embed svg canvas audio video map nav footer aside form button select option optgroup input textarea label fieldset dialog menu title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What names boilerplate: a class or id, or its last part, but for parts that say where or how much.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar navigation navi menu menus breadcrumb breadcrumbs masthead topbar footer foot colophon sidebar side rail aside"
    " widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist reply replies respond disqus"
    " discussion feedback pagination pager skip toolbar copyright disclaimer paywall header".split()
)
GENERIC = frozenset("area section wrapper wrap container list box bar block link links button buttons slot unit item items inner outer left right top bottom main primary secondary".split())
#: A part that says what an element has, or that it is the article's own, not what it is.
NOT_NAMES = frozenset("no has have with without not non is".split())
OWN = frozenset("article entry post story content".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Elements across which an open paragraph or formatting element is not closed.
SCOPE = frozenset("td th table caption html body button object article aside section div nav header footer main form blockquote li dd dt figure fieldset".split())
#: A quoted value must end before a space, / or >; a tag whose quotes do not ends at its first >.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "children", "digest")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children, self.digest = tag, attrs, [], 0


def parse(page: str) -> Node:
    """A forgiving tree: missing end tags are implied, stray ones ignored, raw text elements kept apart."""
    root = Node("#root", "")
    stack = [root]
    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].children.append(m["cdata"].replace("&", "&amp;"))
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # an inline end tag does not close blocks around it
                if tag not in BLOCK and stack[i].tag in SCOPE:
                    break
            else:
                if tag == "p":
                    stack[-1].children.append(Node("p", ""))
            continue
        if tag in BLOCK and tag not in ("html", "body", "option", "optgroup"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        if (rule := CLOSES.get(tag)) is not None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in rule[1]:
                    break
                if stack[i].tag in rule[0]:
                    del stack[i:]
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        node = Node(tag, m["attrs"])
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        if not m["attrs"].rstrip().endswith("/") or tag in BLOCK:
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def names(value: str, in_article: bool) -> bool:
    """Whether a class attribute or id names boilerplate."""
    for token in value.split():
        parts = [x.lower() for x in _PART.findall(token)]
        if not parts or NOT_NAMES & set(parts):
            continue
        last = len(parts)
        while last > 1 and parts[last - 1] in GENERIC:
            last -= 1
        for name in (parts[last - 1], "".join(parts)):
            if name in NAMES and not (name == "header" and (in_article or OWN & set(parts))):
                return True
    return False


def named(node: Node, in_article: bool, kept: Set[int] = frozenset(), cut: Set[int] = frozenset()) -> bool:
    """Whether the element is in ``cut``, or tag, role, class or id say that it is not the article's text; for those in ``kept`` only the tag does."""
    if node.tag in DROP or id(node) in cut:
        return True
    if node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("html", "body") or id(node) in kept:
        return False
    for name, *values in _ATTR.findall(node.attrs):
        value = values[0] or values[1] or values[2]
        name = name.lower()
        if name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name != "aria-label" and names(value, in_article):
            return True
    return False


def in_order(root: Node) -> list[tuple[Node, Node | None]]:
    """All elements with their parents, each before what it holds, in page order."""
    out: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        out.append(pair := todo.pop())
        todo += [(c, pair[0]) for c in reversed(pair[0].children) if not isinstance(c, str)]
    return out


def never_named(root: Node, cut: Set[int] = frozenset()) -> set[int]:
    """Elements (by ``id``) that stay whatever their name: most of the page's text, its largest ``article`` and ``main``, and what holds them."""
    size: dict[int, int] = {}
    up: dict[int, int] = {}
    largest: dict[str, tuple[int, int]] = {}
    gone: set[int] = set()
    every = in_order(root)
    for node, parent in every:
        if parent is not None and (id(parent) in gone or node.tag in DROP or id(node) in cut):
            gone.add(id(node))
            continue
        up[id(node)] = id(parent) if parent is not None else 0
        size[id(node)] = sum(len(text_of(c)) for c in node.children if isinstance(c, str))
    for node, parent in reversed(every):
        if id(node) not in gone:
            if parent is not None:
                size[id(parent)] += size[id(node)]
            if node.tag in ("article", "main") and size[id(node)] > largest.get(node.tag, (-1, 0))[0]:
                largest[node.tag] = size[id(node)], id(node)
    out = {x for x, n in size.items() if 2 * n > size[id(root)]}
    for _, at in largest.values():
        while at:
            out.add(at)
            at = up[at]
    return out


def text_of(raw: str) -> str:
    return " ".join((_html.unescape(raw) if "&" in raw else raw).split())


def mark(root: Node) -> None:
    """Set the digests of all subtrees; 0 where there is no text."""
    for node, _ in reversed(in_order(root)):
        h = blake2b(node.tag.encode("utf-8", "replace"), digest_size=8)
        some = False
        words: list[str] = []
        for child in [*node.children, None]:
            if isinstance(child, str):
                words.append(child)
            elif child is None or child.tag not in RAW or child.tag == "textarea":
                if words and (said := text_of("".join(words))):
                    h.update(said.encode("utf-8", "replace"))
                    some = True
                words = []
                if child is not None and child.digest:
                    h.update(child.digest.to_bytes(8, "little", signed=True))
                    some = True
        node.digest = int.from_bytes(h.digest(), "little", signed=True) or 1 if some else 0


def bodies(root: Node, kept: Set[int] = frozenset(), cut: Set[int] = frozenset()) -> list[tuple[Node, bool]]:
    """The elements that hold the article: its outermost ``article``s, else ``main``s, else the whole page."""
    for tag in ("article", "main"):
        out: list[Node] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == tag or tag == "main" and "main" in (v.lower() for n, *vs in _ATTR.findall(node.attrs) if n.lower() == "role" for v in vs):
                out.append(node)
                continue
            todo += [c for c in reversed(node.children) if not isinstance(c, str) and not named(c, False, kept, cut)]
        if out:
            return [(n, True) for n in out]
    return [(root, False)]


def digest_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Leaf:
    """A block's text and the innermost ``scope`` it stands in, an index into those of its page."""

    said: str
    scope: int


@dataclass
class Scopes:
    """The hashed subtrees around a page's leaves: each one's parent (-1: none), digest, and whether it is a text block of an article."""

    parent: list[int]
    digest: list[int]
    text: list[bool]

    def add(self, parent: int, digest: int, text: bool) -> int:
        self.parent.append(parent)
        self.digest.append(digest)
        self.text.append(text)
        return len(self.parent) - 1

    def levels(self, template: Mapping[int, int]) -> list[tuple[bool, int]]:
        """For each scope whether it is in a box of ``template``, and the greatest level of the text blocks it is in."""
        out: list[tuple[bool, int]] = []
        for parent, digest, text in zip(self.parent, self.digest, self.text, strict=True):
            boxed, level = out[parent] if parent >= 0 else (False, 0)
            found = template.get(digest, 0)
            out.append((boxed, max(level, found)) if text else (boxed or found > 0, level))
        return out


def leaves(root: Node, cut: Set[int] = frozenset()) -> tuple[list[list[Leaf]], Scopes]:
    """The blocks of each of the page's bodies in page order, without named boilerplate and the elements in ``cut``."""
    out: list[list[Leaf]] = []
    scopes = Scopes([], [], [])
    kept = never_named(root, cut)
    holds = block_holders(root)
    words: list[str] = []

    def end(in_article: bool, scope: int, mixed: bool) -> None:
        if words:
            if said := text_of("".join(words)):
                if mixed:
                    scope = scopes.add(scope, digest_of(f"#text {said}"), in_article)
                out[-1].append(Leaf(said, scope))
            words.clear()

    for body, in_article in bodies(root, kept, cut):
        out.append([])
        # (children to come, is a block, innermost scope, whether loose text is a block by itself)
        todo = [(iter(body.children), True, -1, True)]
        while todo:
            children, block, scope, mixed = todo[-1]
            child = next(children, None)
            if child is None:
                if block:
                    end(in_article, scope, mixed)
                todo.pop()
            elif isinstance(child, str):
                words.append(child)
            elif child.tag == "br":
                words.append(" ")
            elif named(child, in_article, kept, cut):
                if child.tag in BLOCK:
                    end(in_article, scope, mixed)
            elif child.tag not in BLOCK:
                todo.append((iter(child.children), False, scope, mixed))
            else:
                end(in_article, scope, mixed)
                inner = scopes.add(scope, child.digest, in_article and child.tag in TEXT) if child.digest else scope
                todo.append((iter(child.children), True, inner, not child.digest or id(child) in holds))
    return out, scopes


def block_holders(root: Node) -> set[int]:
    """Elements (by ``id``) that hold block elements."""
    out: set[int] = set()
    for node, parent in reversed(in_order(root)):
        if parent is not None and (node.tag in BLOCK or id(node) in out):
            out.add(id(parent))
    return out


def outer(root: Node) -> list[Node]:
    """Block elements with text that stand outside every ``article`` and ``main`` and hold none, whatever their names."""
    inside: set[int] = set()
    holders: set[int] = set()
    every = in_order(root)
    for node, parent in every:
        if node.tag in ("article", "main") or parent is not None and id(parent) in inside:
            inside.add(id(node))
    for node, parent in reversed(every):
        if parent is not None and (id(node) in inside or id(node) in holders):
            holders.add(id(parent))
    return [n for n, _ in every if n.digest and n.tag in BLOCK and n.tag not in ("html", "body") and id(n) not in inside and id(n) not in holders]


def blocks(root: Node, template: Mapping[int, int] = MappingProxyType({})) -> list[str]:
    """The article's blocks in page order, without what ``template`` (digest: RARE, COMMON, EVERYWHERE) takes and named boilerplate."""
    page, scopes = leaves(root)
    if not template:
        return [leaf.said for body in page for leaf in body]
    found = [leaf for body in page for leaf in body]
    levels = scopes.levels(template)
    if sum(len(x.said) for x in found if x.scope < 0 or not levels[x.scope][0]) < LEAST_LEFT * sum(len(x.said) for x in found):
        template = {d: level for d, level in template.items() if level != RARE}
    if cut := {id(n) for n in outer(root) if n.digest in template}:
        page, scopes = leaves(root, cut)
    levels = scopes.levels(template)
    out: list[str] = []
    for body in page:
        at = [levels[leaf.scope] if leaf.scope >= 0 else (False, 0) for leaf in body]
        gone = [boxed or level == EVERYWHERE for boxed, level in at]
        for way in (range(len(body)), range(len(body) - 1, -1, -1)):
            for i in way:
                # a box at the edge ends the run: what stands inside of it is not at the edge
                if at[i][0] or not gone[i] and at[i][1] < COMMON:
                    break
                gone[i] = True
        out += [leaf.said for leaf, g in zip(body, gone, strict=True) if not g]
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def at_host(digest: int, host: int) -> int:
    """A subtree's name among those of all hosts."""
    return digest ^ host


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        rows: list[tuple] = []
        for page, url, raw in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            root = parse(raw or "")
            mark(root)
            host = digest_of(host_of(url))
            page_leaves, scopes = leaves(root)
            found = [leaf for body in page_leaves for leaf in body]
            held = set()
            for leaf in found:
                at = leaf.scope
                while at >= 0 and at not in held:
                    held.add(at)
                    at = scopes.parent[at]
            texts = {at_host(scopes.digest[i], host) for i in held if scopes.text[i]}
            boxes = {at_host(scopes.digest[i], host) for i in held if not scopes.text[i]} | {at_host(n.digest, host) for n in outer(root)}
            name = digest_of("\n".join(leaf.said for leaf in found))
            rows.append((page, url, host, name, list(boxes), list(texts)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=["page_id", "url", "host", "page", "boxes", "texts"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        texts = []
        for url, raw, gone in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "template")), strict=True):
            root = parse(raw or "")
            if gone:
                mark(root)
            host = digest_of(host_of(url)) if gone else 0
            texts.append("\n".join(blocks(root, {at_host(x["subtree"], host): x["level"] for x in gone or ()})))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null html and pages without an article's text give an empty text; a null or broken url is a host of
    empty name; pages of equal page_id and url share the template found in either; repeated rows give
    repeated results; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    seen = written(in_arrow(pages, _hashes, HASHES), "page-subtrees")
    n_pages = seen.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    rows = lambda *c: seen.select(*c, F.explode("boxes").alias("subtree"), F.lit(True).alias("box")).unionByName(seen.select(*c, F.explode("texts").alias("subtree"), F.lit(False).alias("box")))
    distinct = rows("host", "page").groupBy("host", "page", "subtree").agg(F.max("box").alias("box"))
    often = distinct.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.max("box").alias("box")).where(F.col("n") >= least_pages)
    share = F.col("n") / F.col("of")
    level = F.when((F.col("n") >= EVERYWHERE_PAGES) & (share >= EVERYWHERE_SHARE), EVERYWHERE).when(share >= COMMON_SHARE, COMMON).when(F.col("box") & (share >= least_share), RARE)
    often = written(often.join(n_pages, "host").select("subtree", level.alias("level")).where("level is not null"), "page-templates")
    if often.count() <= BROADCAST_SUBTREES:
        often = F.broadcast(often)
    gone = rows("page_id", "url").join(often, "subtree").groupBy("page_id", "url").agg(F.collect_set(F.struct("subtree", "level")).alias("template"))
    gone = written(gone.select(F.col("page_id").alias("p"), F.col("url").alias("u"), "template"), "page-templates")
    if (gone.agg(F.sum(F.size("template"))).first()[0] or 0) <= BROADCAST_ENTRIES:
        gone = F.broadcast(gone)
    rows = pages.join(gone, F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")), "left")
    return in_arrow(rows.select("page_id", "url", "html", "template"), _texts, OUT)
