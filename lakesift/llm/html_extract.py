"""Main text of web pages, with site template removal.

Every block element's subtree is hashed (tags and text).  Spark counts, for
each host and each section of it (first part of the path), on how many pages of
different content a subtree occurs; subtrees that recur across many of them are
template and are deleted from the pages of that host or section.  What markup
itself names as page furniture (menus, headers, footers, sidebars, adverts,
notices, forms, comments, scripts, styles) goes too.  If a page marks its
article, only that is text, and plain text blocks in it (paragraphs, headings,
lists, quotes, tables) are no template unless they are named as furniture:
articles may quote the same passage.

Names are weaker than tags, as ids are often slugs of headings.  In an article
only a class or role deletes (a section's only as a whole), and no paragraph or
heading; all else that is named there goes only if it recurs too.  An element that is never closed
holds whatever comes after it, so its name deletes nothing.

Counting first makes each subtree distinct for (host or section, content) and then counts
with partial aggregation, so neither a host with a third of all pages nor a
large group of copies of one page is a hot group; copies count once.

Edge cases: a null html counts as empty (empty text); a page without an
article is its whole body less what is deleted; unclosed and stray tags are
repaired; a null url or one without a host belongs to the empty host; equal
rows have equal results; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import lower_ascii, on_workers, small_side, staged

#: A subtree is template if it occurs on this many pages of different content
#: of its host or section, and on this share of those.
MIN_PAGES = 5
MIN_SHARE = 0.1
#: Bytes of a page's row (key and template hashes) when broadcast.
PAGE_ROW_BYTES = 200

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset((
    "script style title head noscript template svg math canvas object embed iframe audio video map "
    "nav footer aside form button select textarea input label fieldset dialog menu noembed noframes xmp").split())
BLOCKS = frozenset((
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address header footer nav aside form hgroup details summary hr br center "
    "fieldset dialog menu search").split())
TEXT_BLOCKS = frozenset((
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption").split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: Elements whose end tag may be left out.
END_OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "caption", "thead", "tbody", "tfoot", "li", "dt", "dd"}
# Words of class, id and role that name page furniture.
FURNITURE = frozenset((
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe "
    "subscription share sharing social comment comments disqus respond replies related recommended login signup search "
    "pagination pager toolbar skip masthead complementary contentinfo alert").split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag, children (nodes and texts), whether its tag or
    attributes drop it, how clearly it is named furniture and whether it is closed."""

    __slots__ = ("tag", "children", "dropped", "named", "closed", "hash", "inside")

    def __init__(self, tag: str, dropped: bool = False, named: int = 0):
        self.tag, self.children, self.dropped, self.named, self.hash, self.inside = tag, [], dropped, named, 0, False
        self.closed = tag in END_OPTIONAL


#: How clearly an element is named: by a word of its id, its whole id, a word
#: of a class or role, a whole class or role.
SLUG, ID, WORD, WHOLE = 1, 2, 3, 4


def _named(tag: str, attributes: str) -> int:
    best = 0
    if tag in ("html", "body", "article", "main") or not attributes:
        return best
    for m in _NAMES.finditer(attributes):
        value = next(g for g in m.groups()[1:] if g is not None).lower()
        is_id = m[1].lower() == "id"
        if any(n in FURNITURE for n in value.split()):
            best = max(best, ID if is_id else WHOLE)
        elif any(n in FURNITURE for n in _SPLIT.split(value)):
            best = max(best, SLUG if is_id else WORD)
    return best


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    return tag not in ("html", "body", "article", "main") and bool(attributes and _HIDDEN.search(attributes))


def _furniture(n: Node) -> bool:
    """True if tag, attributes or name alone delete the element."""
    if n.dropped:
        return True
    if not n.named or not n.closed:
        return False
    if n.inside:
        return n.tag not in PROSE and (n.named == WHOLE or n.named == WORD and n.tag != "section")
    return n.named > SLUG or n.tag not in PROSE and n.tag != "section"


def parse(page: str) -> Node:
    """Element tree of a page; unclosed paragraphs and list items end where the
    next one starts, end tags close what is open inside them."""
    root = Node("")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            stack[-1].children.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    stack[i].closed = True
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th"):
            stops = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",))
            ends = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in stops or (tag in ("td", "th") and stack[i].tag == "tr"):
                    break
        node = Node(tag, _dropped(tag, m[3]), _named(tag, m[3]))
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at: close.start() if close else end])
            at = close.end() if close else end
            continue
        stack.append(node)
    return root


def _walk(node: Node):
    """Nodes in document order, without recursion."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


def articles(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, that aren't in
    furniture; if there are none, those in elements named by a word only."""
    for words in (False, True):
        for tag in ("article", "main"):
            found, todo = [], [root]
            while todo:
                n = todo.pop()
                if n.tag == tag:
                    found.append(n)
                elif not _furniture(n) or words and not n.dropped and n.named < WHOLE:
                    todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
            if found:
                return found
    return []


def _mark(root: Node) -> None:
    """Hash every subtree (children first) and mark what is inside an article."""
    order = list(_walk(root))
    for n in reversed(order):
        h = blake2b(n.tag.encode(), digest_size=8)
        for c in n.children:
            if isinstance(c, Node):
                h.update(b"\x00" + c.hash.to_bytes(8, "little"))
            elif text := " ".join(c.split()):
                h.update(b"\x01" + text.encode("utf-8", "surrogatepass"))
        n.hash = int.from_bytes(h.digest(), "little")
    for a in articles(root):
        for n in _walk(a):
            n.inside = True


def _candidate(n: Node) -> bool:
    """Subtrees that may be template: blocks, but no text blocks of an article
    without a name of furniture, and nothing that is an article or the page."""
    if n.tag in ("html", "body", "article", "main", "br", "hr"):
        return False
    return bool(n.named) or n.tag in BLOCKS and not (n.inside and n.tag in TEXT_BLOCKS)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def subtree_hashes(page: str) -> tuple[list[int], int]:
    """Distinct hashes of the candidate subtrees, and a digest of the page's
    content: that of its articles, else its longest text."""
    root = parse(page)
    _mark(root)
    found, longest = set(), ""
    for n in _walk(root):
        if n.tag in RAW:
            continue
        for c in n.children:
            if isinstance(c, str) and len(c) > len(longest):
                longest = c
        if _candidate(n):
            found.add(_signed(n.hash))
    content = b"".join(a.hash.to_bytes(8, "little") for a in articles(root)) or longest.encode("utf-8", "surrogatepass")
    return sorted(found), int.from_bytes(blake2b(content, digest_size=8).digest(), "little", signed=True)


def main_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    """Text of the article: blocks in page order, each with single spaces."""
    root = parse(page)
    _mark(root)
    parts = articles(root) or [root]
    blocks, current = [], []

    def end_block():
        text = _SPACE.sub(" ", "".join(current)).strip()
        if text:
            blocks.append(text)
        current.clear()

    todo: list = [("node", p) for p in reversed(parts)]
    while todo:
        kind, x = todo.pop()
        if kind == "text":
            current.append(x)
        elif kind == "end":
            end_block()
        elif _furniture(x) or (x.tag == "header" and not x.inside) or (templates and _candidate(x) and _signed(x.hash) in templates):
            if x.tag in BLOCKS:
                end_block()
        else:
            block = x.tag in BLOCKS
            if block:
                end_block()
                todo.append(("end", None))
            for c in reversed(x.children):
                todo.append(("node", c) if isinstance(c, Node) else ("text", c))
    end_block()
    return " ".join(blocks)


# --- Spark -----------------------------------------------------------------------

def host_of(url) -> F.Column:
    """Host of a url column, A-Z lower-cased; empty without one."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "^[\\s\\S]*?://([^/?#]*)", 1))


def section_of(url) -> F.Column:
    """First part of a url column's path; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[\\s\\S]*?://[^/?#]*/([^/?#]*)/", 1)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, found): subtrees of each page that are template on its host or in
    its section.  ``pages`` has ``key``, ``host``, ``section`` (hashes) and ``html``."""

    def run(batches):
        for batch in batches:
            keys, hosts, sections, hashes, digests = [], [], [], [], []
            for key, host, section, page in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                found, digest = subtree_hashes(page.as_py() or "")
                keys += [key] * len(found)
                hosts += [host] * len(found)
                sections += [section] * len(found)
                hashes += found
                digests += [digest] * len(found)
            kind = pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in (keys, hosts, sections, hashes, digests)], ["key", "host", "section", "h", "content"])

    rows = staged(pages.select("key", "host", "section", "html").mapInArrow(
        run, "key bigint, host bigint, section bigint, h bigint, content bigint"), "subtrees")
    # a page counts for its host and for its section
    rows = rows.select("key", "h", "content", F.explode(F.array("host", "section")).alias("place"))
    contents = rows.select("place", "content").distinct().groupBy("place").agg(F.count(F.lit(1)).alias("pages"))
    # the share's bound on a place's size keeps this side as small as the places
    counted = rows.select("place", "h", "content").distinct().groupBy("place", "h").agg(F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= min_pages).join(contents, "place").where(F.col("n") >= F.col("pages") * min_share)
    often = staged(often.select("place", "h"), "templates")
    # template hashes of each page; places with many pages are split by their pages' keys
    salts = 16
    spread = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = rows.withColumn("salt", F.pmod("key", F.lit(salts)).cast("int")).join(spread, ["place", "h", "salt"])
    return hits.select("key", "h").distinct().groupBy("key").agg(F.collect_list("h").alias("found"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, ``text`` and ``n_chars`` (code points)."""
    spark = pages.sparkSession
    on_workers(spark)
    rows = pages.select(
        F.xxhash64(F.col(url_col), F.col(html_col)).alias("key"), F.xxhash64(host_of(F.col(url_col))).alias("host"),
        F.xxhash64(host_of(F.col(url_col)), section_of(F.col(url_col))).alias("section"),
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = staged(templates(rows), "page-templates")
    side = small_side(found, found.count(), PAGE_ROW_BYTES)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [
                main_text(page.as_py() or "", frozenset(hashes.as_py() or ()))
                for page, hashes in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    out = rows.join(side, "key", "left").select("id", "url", "html", "found").mapInArrow(run, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
