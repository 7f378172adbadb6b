"""Main text of web pages, with site templates removed.

A page becomes a small tree: the spans of its elements, with the tags HTML lets authors leave
open closed where they end.  Every element that holds text is hashed with all below it; Spark
counts on how many pages of a host each hash occurs, and subtrees that recur on many of them are
the host's template and are deleted before the main text is chosen.  What a page marks as menu,
header, footer, sidebar, notice, advert, form, comments, script or style goes as well.  The
rest is read as blocks.

Inside ``article`` and ``main`` only containers (``CONTAINERS``) are deleted as templates, so
single paragraphs that pages share stay.  An article or main that itself recurs is deleted only if
the rest of the page holds more text; else the page is a copy of others and is read whole inside it.

Defined cases: null or empty html gives an empty text; text without any element is one block;
unclosed elements end with their parent; a null or odd url is a host of its own; repeated
pages count once each towards a template and are read alike; an empty table gives no rows;
long pages are read whole; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import small, table

#: A subtree is a template if it is on at least so many pages of its host, and on that share of them.
MIN_PAGES = 5
MIN_SHARE = 0.2

# Elements by what HTML says of them, and names that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may be templates inside an article or main.
CONTAINERS = frozenset("address center details dir div dl fieldset figure hgroup ol section table ul".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog".split()) | RAW
#: Opening the first ends an open one of the second, inside the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FURNITURE = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored banner promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar footer "
    "site-header page-header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist respond disqus replies share sharing social related recommended widget pagination pager toolbar search".split()
)
#: Furniture words that boxes of an article's own text have as well.
BOXES = frozenset("alert banner menu notice overlay popup promo search sponsor toolbar".split())
#: Names of readers' comments: an element that holds other than a heading or paragraph is theirs also by its id.
READERS = frozenset("comment comments commentlist respond disqus reply replies".split())
#: Elements that are never furniture inside the main text by their name, and those that a reader clicks.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLICKED = frozenset("a button".split())
#: Parts that may stand beside a furniture word in a name; a name with any other part ("has-sidebar", "search-results") marks no furniture.
NEUTRAL = frozenset(
    "site main page top bottom left right primary secondary global local inner outer box bar area list item items block section container wrapper wrap "
    "panel slot unit button buttons btn link links icon icons form field post posts article articles story stories widget widgets sticky fixed desktop mobile "
    "sub header footer media thread reader user".split()
)
#: Names of the main text itself: an element that also has one of them is no furniture.
CONTENT = frozenset("content main-content page-content article article-body article-content story story-body entry entry-content post post-body post-content".split())
#: Articles with such a name, or inside an element with one, are not the page's own.
OTHERS = frozenset("teaser teasers comment comments commentlist respond disqus reply replies related recommended".split())
#: An article is preferred to the main element around it if it holds this share of its text.
MAIN_SHARE = 0.5
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
#: Foreign elements may close themselves; those of the second set are elements, so without an end tag the page goes on after them.
FOREIGN = frozenset(("svg", "math"))
UNCLOSED = FOREIGN | {"object", "canvas", "template"}
_ends = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE | re.ASCII) for t in RAW}
#: A slash that belongs to an unquoted value closes nothing.
_bare_value = re.compile(r"=\s*[^\s\"'=]*/\Z")
_attribute = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_space = re.compile(r"[\s ]+")


@lru_cache(maxsize=20_000)
def marked_as(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names is of words: it is a word, or made of words and neutral parts alone."""
    tokens = names.lower().split()
    if not CONTENT.isdisjoint(tokens):
        return False
    for token in tokens:
        if token.strip("-_") in words:
            return True
        parts = [p for p in (q.rstrip("0123456789") for q in re.split(r"[-_]+", token)) if p]
        if any(p in words for p in parts) and all(p in words or p in FURNITURE or p in NEUTRAL for p in parts):
            return True
    return False


FURNITURE_OUTSIDE = FURNITURE | {"header"}


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str
    children: list = field(default_factory=list)  # elements and strings

    def found(self) -> dict[str, str]:
        if not self.attributes or self.attributes.isspace():
            return {}
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _attribute.finditer(self.attributes)}

    def kind(self) -> str:
        """article or main, by tag or role; empty for all other elements."""
        if self.tag in ("article", "main"):
            return self.tag
        role = self.found().get("role", "").lower() if "role" in self.attributes.lower() else ""
        return role if role in ("article", "main") else ""

    def named(self, words: frozenset[str], keys: tuple[str, ...] = ("class", "id")) -> bool:
        found = self.found()
        return any(marked_as(found[k], words) for k in keys if found.get(k))

    def holds_articles(self) -> bool:
        todo = [self]
        while todo:
            inner = [c for c in todo.pop().children if isinstance(c, Element)]
            if any(c.kind() == "article" for c in inner):
                return True
            todo += inner
        return False

    def mostly_links(self) -> bool:
        """Whether at least half of its text is in links or buttons, or it has none."""
        linked, whole, todo = 0, 0, [(self, self.tag in CLICKED)]
        while todo:
            e, inside = todo.pop()
            for c in e.children:
                if isinstance(c, str):
                    n = len(_space.sub(" ", c).strip())
                    whole, linked = whole + n, linked + n * inside
                else:
                    todo.append((c, inside or c.tag in CLICKED))
        return 2 * linked >= whole

    def left_out(self, inside_main: bool) -> bool:
        """Whether the page itself takes it out of the text, by tag, role or style."""
        if self.tag in DROPPED or (self.tag == "header" and not inside_main):
            return True
        found = self.found()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return True
        return bool(re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE)) or found.get("role", "").lower() in FURNITURE_ROLES

    def dropped(self, inside_main: bool) -> bool:
        """Outside the main text names of class and id count.  Inside, headings and paragraphs stay; ids, which are made from titles,
        and classes that an article's own boxes have count where a second sign agrees: links and buttons, or articles of others.
        """
        if self.left_out(inside_main):
            return True
        if self.tag in ("body", "html", "main"):
            return False
        if not inside_main:
            return self.named(FURNITURE_OUTSIDE)
        if self.tag in PROSE:
            return False
        if self.named(FURNITURE - BOXES, ("class",)) or self.named(READERS):
            return True
        return self.named(FURNITURE) and (self.mostly_links() or self.holds_articles())


def parse(page: str) -> Element:
    """The page's tree.  Raw elements keep no content; an end tag without an open element is passed over."""
    root = Element("#root", "")
    stack = [root]
    at = 0
    while True:
        found = _token.search(page, at)
        if found is None:
            break
        if found.start() > at:
            stack[-1].children.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        closes = CLOSES.get(tag)
        if closes:
            k = len(stack) - 1
            while k and stack[k].tag not in closes[1]:
                if stack[k].tag in closes[0]:
                    del stack[k:]
                k -= 1
        elif tag in BLOCKS:
            # an open paragraph ends where a block begins, and with it what is open inside it
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in BLOCKS), 0)
            if stack[k].tag == "p":
                del stack[k:]
        element = Element(tag, found[3] or "")
        stack[-1].children.append(element)
        if tag in RAW:
            attributes = found[3] or ""
            if tag in FOREIGN and attributes.endswith("/") and not _bare_value.search(attributes):
                continue
            end = _ends[tag].search(page, at)
            at = end.end() if end else at if tag in UNCLOSED else len(page)
        elif tag not in VOID and not (found[3] or "").rstrip().endswith("/"):
            stack.append(element)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def text_size(top: Element) -> int:
    """Characters of the text below top, without what its page leaves out."""
    size, todo = 0, [top]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            size += len(_space.sub(" ", e).strip())
        elif e is top or not e.left_out(True):
            todo.extend(e.children)
    return size


def main_content(root: Element) -> tuple[list[Element], frozenset[int], list[Element]]:
    """The elements that hold the main text, the ids of elements not to be dropped by their names, and others' articles.

    Articles and main elements are looked for below any wrapper that is not left out.  Articles of
    others (teasers, comments) are never chosen; the rest is chosen where it is outside of furniture,
    or holds more text than all that is.  A main element is read instead of articles, unless one of
    these holds ``MAIN_SHARE`` of its text.
    """
    mains: list[Element] = []
    plain: list[Element] = []
    within: list[Element] = []  # inside furniture
    others: list[Element] = []
    above: dict[int, list[int]] = {}
    todo: list[tuple[Element, bool, bool, bool, bool, tuple]] = [(root, False, False, False, False, ())]
    while todo:
        e, in_main, in_article, furnished, foreign, path = todo.pop()
        kind = e.kind()
        if kind == "main" and not in_main:
            mains.append(e)
            in_main = True
            above[id(e)] = list(_ids(path))
        if kind == "article" and not in_article:
            in_article = True
            if foreign or e.named(OTHERS):
                others.append(e)
            else:
                (within if furnished or e.named(FURNITURE) else plain).append(e)
                above[id(e)] = [*_ids(path), id(e)]
        elif e is not root and e.tag not in ("body", "html", "main"):
            if not in_article:
                foreign = foreign or e.named(OTHERS)
                furnished = furnished or e.named(FURNITURE_OUTSIDE)
        path = (e, path)
        for c in reversed(e.children):
            if isinstance(c, Element) and not c.left_out(in_main or in_article):
                todo.append((c, in_main, in_article, furnished, foreign, path))
    kept = frozenset(i for ids in above.values() for i in ids)
    sizes = {id(a): text_size(a) for a in plain + within} if mains or within else {}
    outside = sum(sizes.get(id(a), 0) for a in plain)
    chosen = {id(a) for a in plain} | {id(a) for a in within if sizes[id(a)] > outside}
    articles = [a for a in _in_order(root, chosen)] if within else plain
    if mains:
        whole = sum(text_size(m) for m in mains)
        if whole and not any(sizes[id(a)] >= MAIN_SHARE * whole for a in articles):
            return mains, kept, others
    return articles or mains, kept, others


def _ids(path: tuple) -> Iterator[int]:
    while path:
        yield id(path[0])
        path = path[1]


def _in_order(root: Element, wanted: set[int]) -> Iterator[Element]:
    todo = [root]
    while todo:
        e = todo.pop()
        if id(e) in wanted:
            yield e
        todo.extend(c for c in reversed(e.children) if isinstance(c, Element))


def subtree_hashes(root: Element) -> dict[int, int]:
    """id(element) -> hash, for every element that may be a template; the hash covers tag, words and everything below.

    Outside of article and main that is any element with text that holds neither of them.
    """
    hashed: dict[int, int] = {}
    out: dict[int, int] = {}
    holds: set[int] = set()
    order: list[tuple[Element, bool, str]] = []
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        kind = e.kind()
        order.append((e, inside, kind))
        todo.extend((c, inside or bool(kind)) for c in e.children if isinstance(c, Element))
    for e, inside, kind in reversed(order):
        parts = [e.tag]
        for c in e.children:
            if isinstance(c, Element):
                if id(c) in holds:
                    holds.add(id(e))
                if id(c) in hashed:
                    parts.append(f"<{hashed[id(c)]}>")
            else:
                words = _space.sub(" ", c).strip()
                if words:
                    parts.append(words)
        if len(parts) > 1 and e.tag not in ("#root", "html", "body", "head"):
            hashed[id(e)] = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
            if kind or (id(e) not in holds and (not inside or e.tag in CONTAINERS)):
                out[id(e)] = hashed[id(e)]
        if kind:
            holds.add(id(e))
    return out


def without_templates(root: Element, template: frozenset[int]) -> Element:
    """The tree with its templates emptied; the tree itself is changed."""
    hashes = subtree_hashes(root)
    if template.isdisjoint(hashes.values()):
        return root

    def emptied(e: Element) -> Element:
        return Element("div" if e.tag in BLOCKS else "span", "")  # where it stood, a block still ends

    again: list[tuple[Element, int]] = []  # recurring articles and main elements: parent and place
    todo = [root]
    while todo:
        e = todo.pop()
        for k, c in enumerate(e.children):
            if isinstance(c, Element):
                if hashes.get(id(c)) not in template:
                    todo.append(c)
                elif c.kind():
                    again.append((e, k))
                else:
                    e.children[k] = emptied(c)
    if again and 2 * sum(text_size(e.children[k]) for e, k in again) < text_size(root):
        for e, k in again:
            e.children[k] = emptied(e.children[k])
    return root


def blocks(top: Element, inside_main: bool, kept: frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks below top, in page order, white space and references resolved."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _space.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list[Element | str | None] = [top]
    while todo:
        e = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            run.append(html.unescape(e))  # piece by piece: a reference never spans a tag
        elif e is not top and (e.left_out(inside_main) if id(e) in kept else e.dropped(inside_main)):
            if e.tag in BLOCKS:
                flush()
        elif e.tag in ("br", "wbr"):
            run.append(" " if e.tag == "br" else "")
        else:
            if e.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(e.children))
    flush()
    return out


def extract(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page, without subtrees whose hash is in template."""
    if not page:
        return ""
    root = parse(page)
    if template:
        root = without_templates(root, template)
    content, kept, others = main_content(root)
    if content:
        return "\n".join(b for e in content for b in blocks(e, True, kept))
    return "\n".join(blocks(root, False) or [b for e in others for b in blocks(e, True)])


def page_hashes(page: str | None) -> list[int]:
    """The distinct hashes of a page's subtrees that may be templates."""
    return sorted(set(subtree_hashes(parse(page)).values())) if page else []


def host_of(url: str):
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/?#:]*)", 1)


def templates(pages: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, hash and pages of the subtrees that recur on min_pages pages of a host and on min_share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, n = [], [], []
            # counted per host before they travel: a hot host's template is a few rows a batch
            counts: dict[tuple[str, int], int] = {}
            for h, p in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for x in page_hashes(p):
                    counts[h, x] = counts.get((h, x), 0) + 1
            for (h, x), c in counts.items():
                hosts.append(h)
                hashes.append(x)
                n.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, "int64"), pa.array(n, "int64")], ["host", "hash", "pages"])

    thin = pages.select(host_of(url).alias("host"), F.col(page).alias("html"))
    counted = thin.mapInArrow(run, "host string, hash long, pages long").groupBy("host", "hash").agg(F.sum("pages").alias("pages"))
    common = counted.where(F.col("pages") >= min_pages)
    sizes = pages.groupBy(host_of(url).alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    return common.join(sizes, "host").where(F.col("pages") >= min_share * F.col("host_pages")).select("host", "hash", "pages")


def extract_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE
) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages.

    A host keeps fewer than ``subtrees per page / min_share`` templates, so their list per host is short whatever
    the host's size; the lists are broadcast up to a checked number of hosts and shuffled beyond it.
    """
    known = table(templates(pages, url, page, min_pages, min_share), "html-templates")
    lists = small(known.groupBy("host").agg(F.collect_list("hash").alias("template")), 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                extract(p, frozenset(t or ()))
                for p, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    thin = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(url).alias("host"))
    out = thin.join(lists, "host", "left").select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
