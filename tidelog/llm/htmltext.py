"""HTML extraction by site template removal.

Every page is parsed to a tree. Each block subtree is hashed (its tags and its text), whatever it is called; lists of links
are hashed by their shape too (tags, classes, no text, repeated items once), as menus change their items from page to page. The hashes
are counted per host in Spark, once for each content (copies of an article count as one page), and subtrees that recur on many
pages of a host are site template: they are deleted before the text is taken. How many are enough grows with the logarithm of the
host's pages, so that a box that only some sections or some days show goes too.

For hosts with few pages, and for boxes whose text never recurs, what a page itself declares to be a menu, header, footer, sidebar,
notice, advert, form, script, style or comments section (by tag, role, or a word of its class or id) is deleted as well. Within the
article only that goes: its ``header`` (with the headline), captions, formulas and boxes of other names stay. ``declared=False`` leaves
this step away.

A paragraph, heading, list item or table inside the main article, or whatever holds prose there, is never template: copies of an article on many pages of its host, or
a passage that many articles quote, stay whole; nor are lists of links there. The text is that of the ``article`` (or ``main``) elements if there are
any, else of the body. Character references are decoded, white space within a block becomes one space, blocks are joined
in page order by one space.

Template counting shuffles hashes only. Template hashes of all hosts are broadcast while there are at most
``BROADCAST_ROWS`` of them; beyond, pages get theirs by a join on the host in which hot hosts are salted.

Defined results: null and empty html, and pages without text, give ''; unclosed, misnested and stray tags are repaired
as a browser would, roughly; a quote that nothing closes is a character like any other; pages without a host share one; repeated
rows count as pages of their own; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_hot, materialize, ship

#: HTML element names by their role in parsing.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROP = frozenset("script style noscript template iframe svg head title nav header footer aside form button select option textarea input dialog menu object embed canvas audio video map noembed noframes".split())
#: Elements whose open p or li a new block ends.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article section div main body ul ol dl table td th blockquote aside nav header footer form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|header|masthead"
    r"|cookies?|consent|gdpr|notice|popup|comments?|commentlist|disqus|replies)(?:$|[\s_-])",
    re.I,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
IN_TAG = re.compile(r"[^>\"']*")
ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f\v\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x85\x1c-\x1f]+")

#: Within the article these hold its words, however short and often repeated.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr table tbody thead caption figure address".split())
#: A subtree is template if it is on at least this many pages of different content, and one more for each doubling of the host's pages over MANY.
MIN_PAGES, MANY = 3, 16
#: A list of links: at least so many, with this share of the subtree's text.
LINKS, LINK_SHARE = 3, 0.8
#: Within the article, more words than this are prose.
PROSE_WORDS = 12


class Element:
    __slots__ = ("chars", "children", "digest", "drop", "inline", "linked", "links", "name", "prose", "shape", "tag")

    def __init__(self, tag: str, drop: bool, name: str = ""):
        self.tag, self.drop, self.name, self.children = tag, drop, name, []
        self.inline, self.digest, self.prose = tag in INLINE, 0, False
        self.shape = self.chars = self.linked = self.links = 0


def _declared(tag: str, attrs: str) -> tuple[bool, str]:
    """Does the page declare this element to be no content; and its class and id."""
    drop, name = tag in DROP, ""
    if not attrs:
        return drop, name
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            name += f" {value}"
        if tag in ("html", "body", "main", "article"):
            continue
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)) or (key == "role" and value.lower() in ROLES):
            drop = True
        if key in ("class", "id") and NOISE.search(value):
            drop = True
    return drop, name


def _attributes(page: str, at: int) -> int:
    """Where the tag whose attributes begin at ``at`` ends: before its '>', which quotes may hide, or at the page's end."""
    while True:
        at = IN_TAG.match(page, at).end()
        if at == len(page) or page[at] == ">":
            return at
        close = page.find(page[at], at + 1)
        at = at + 1 if close < 0 else close + 1


def parse(page: str) -> Element:
    """The tree of a page: elements and strings (character references decoded). A line break is a string of one space."""
    root = Element("#root", False)
    stack, at, n = [root], 0, len(page)
    open_: Counter[str] = Counter()

    def put(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def cut(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    def close(names, stop) -> None:
        if not any(open_[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                return cut(k)
            if stack[k].tag in stop:
                return

    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        end = _attributes(page, at)
        tag, attrs = m[2].lower(), page[at:end]
        at = end + 1
        if m[1]:
            if open_[tag]:
                close({tag}, ())
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in SAME:
            close(SAME[tag], SCOPE - SAME[tag] if tag not in ("tr", "td", "th") else {"table"})
        if tag in ("br", "hr"):
            stack[-1].children.append(" ")
            continue
        drop, name = _declared(tag, attrs)
        if tag == "header" and (open_["article"] or open_["main"]):
            drop = False
        node = Element(tag, drop, name)
        stack[-1].children.append(node)
        if tag in VOID or attrs.endswith("/") and tag == "svg":
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = m.end() if m else n
            continue
        stack.append(node)
        open_[tag] += 1
    return root


def walk(root: Element) -> Iterator[Element]:
    """Elements, children before parents, without recursion: pages may nest deeply."""
    todo, out = [root], []
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str))
    return reversed(out)


def digest(root: Element) -> None:
    """Hash every subtree by its text and by its shape, count the text that is in links, and mark those that hold prose of their own."""
    for node in walk(root):
        h, shape = xxhash.xxh64(node.tag), xxhash.xxh64(f"{node.tag}|{node.name}")
        words, last = 0, -1
        for c in node.children:
            if isinstance(c, str):
                text = " ".join(c.split())
                h.update(text.encode("utf-8", "surrogatepass"))
                node.chars += len(text)
                words += c.count(" ") + 1
            else:
                h.update(c.digest.to_bytes(8, "little"))
                if c.shape != last:  # items of a list count once
                    shape.update(c.shape.to_bytes(8, "little"))
                last = c.shape
                node.chars += c.chars
                node.linked += c.chars if c.tag == "a" else c.linked
                node.links += 1 if c.tag == "a" else c.links
                if c.inline and c.tag != "a":
                    words += PROSE_WORDS * c.prose
                node.prose |= c.prose and not c.drop
        node.digest, node.shape = h.intdigest(), shape.intdigest()
        node.prose |= words > PROSE_WORDS


def articles(root: Element) -> list[Element]:
    """The elements that hold the content, in page order: articles, else main, else the whole tree. What is dropped holds none."""
    found: dict[str, list[Element]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.drop and node.tag not in found:
            continue
        if node.tag in found:
            found[node.tag].append(node)
            if node.tag == "article":
                continue
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return found["article"] or found["main"] or [root]


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def removable(node: Element, inside: bool) -> bool:
    """May this subtree be template? inside: it lies in an article."""
    if node.inline or not node.children or node.tag in ("#root", "html", "body", "article", "main"):
        return False
    return not (inside and (node.prose or node.tag in TEXT))


def hashes(node: Element, inside: bool) -> list[int]:
    """Hashes, as signed longs, by which this subtree may be known as template: of its text, and of its shape if it is a list of links."""
    out = [signed(node.digest)] if removable(node, inside) else []
    if out and not inside and node.links >= LINKS and node.linked >= LINK_SHARE * node.chars:
        out.append(signed(node.shape))
    return out


def candidates(page: str | None) -> tuple[set[int], int]:
    """Hashes of the block subtrees of a page that may be template, and the hash of its content."""
    if not page:
        return set(), 0
    root = parse(page)
    digest(root)
    content = articles(root)
    whole = content[0] is root
    out: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or (not whole and any(node is c for c in content))
        out.update(hashes(node, inside))
        todo.extend((c, inside) for c in node.children if not isinstance(c, str))
    return out, signed(content[0].digest)


def taken(page: str | None, template=frozenset(), declared: bool = True, select: bool = True) -> tuple[str, int]:
    """The text of a page without the subtrees whose hashes are in ``template``, and how many of these the page has.

    declared: also without what the page declares to be no content. select: only that of its articles, if it has any.
    """
    if not page:
        return "", 0
    root = parse(page)
    digest(root)
    content = articles(root)
    whole = content[0] is root
    known = {id(c) for c in content} if not whole else set()
    pieces: list[str] = []
    gone = 0
    todo: list = [(root, False, not select or whole)]  # node, in an article, is its text taken
    while todo:
        node, inside, take = todo.pop()
        if isinstance(node, str):
            if take:
                pieces.append(node)
            continue
        if id(node) in known:
            inside = take = True
        elif len(template) and any(h in template for h in hashes(node, inside)):
            gone += 1
            continue
        elif node.tag in RAW or node.tag == "head" or (declared and node.drop):
            continue
        if not node.inline and take:
            pieces.append(" ")
            todo.append((" ", inside, take))
        todo.extend((c, inside, take) for c in reversed(node.children))
    return SPACE.sub(" ", "".join(pieces)).strip(), gone


def main_text(page: str | None, template=frozenset(), declared: bool = True, select: bool = True) -> str:
    """The text of ``taken``."""
    return taken(page, template, declared, select)[0]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [candidates(h) for h in batch.column("html").to_pylist()]
        # subtree 0 with every page, so that contents without candidates count
        rows = [(host, x, c) for host, (hashes, c) in zip(batch.column("host").to_pylist(), found, strict=True) for x in (0, *hashes)]
        host, subtree, content = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(subtree, pa.int64()), pa.array(content, pa.int64())], names=["host", "subtree", "content"])


def _extracted(batch: pa.RecordBatch, templates: list) -> pa.RecordBatch:
    found = [taken(h, t) for h, t in zip(batch.column("html").to_pylist(), templates, strict=True)]
    columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_template"])


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree): hashes of subtrees that are on enough contents of their host."""
    ship(pages.sparkSession)
    seen = pages.select("host", "html").mapInArrow(_count_batches, "host string, subtree long, content long")
    # a content's hashes are dealt by all three columns, and a subtree's by two, each after partial aggregation
    counts = seen.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    counts = materialize(counts, "subtrees")
    totals = counts.where("subtree = 0").select("host", F.floor(F.greatest(F.lit(0.0), F.log2(F.col("n") / MANY))).alias("more"))
    return counts.where("subtree <> 0").join(totals, "host").where(F.col("n") >= min_pages + F.col("more")).select("host", "subtree")


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.withColumn("host", host)


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_template (template subtrees deleted) for each page."""
    ship(pages.sparkSession)
    pages = with_host(pages.select("page_id", "url", "html"))
    subtrees = template_subtrees(pages, min_pages)
    few = subtrees.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        by_host: dict[str, set[int]] = {}
        for host, subtree in few:
            by_host.setdefault(host, set()).add(subtree)
        known = pages.sparkSession.sparkContext.broadcast(by_host)

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _extracted(batch, [known.value.get(host, ()) for host in batch.column("host").to_pylist()])

        rows = pages
    else:
        sets = subtrees.groupBy("host").agg(F.collect_set("subtree").alias("subtrees"))  # a host has at most its subtrees / min_pages
        rows = join_hot(pages, sets, ["host"], pages.count(), F.xxhash64("page_id", "url"))

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _extracted(batch, [frozenset(s or ()) for s in batch.column("subtrees").to_pylist()])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_template long")
