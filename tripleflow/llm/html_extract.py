"""Main text of web pages by tree scoring.

A page is read tag by tag into a tree.  Text between the borders of block elements is a
block.  Each block passes points for its length and its commas to the containers above it,
ever fewer with distance; a container's points are discounted by the share of its text
that stands in links.  The best container, lifted to the article it belongs to, and those
of its siblings that look like more of the same are kept, in page order.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++)))?|\"[^\"]*+\"|'[^']*+'")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element names of HTML and words that mark parts around an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head button select option textarea iframe object embed svg canvas math audio "
    "video dialog menu title".split()
)
# Left out like what is named so, unless the article itself stands in them.
AROUND_TAGS = frozenset("nav footer aside form".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address".split())
CONTAINERS = frozenset(
    "html body article main section div header footer nav aside form fieldset ul ol dl table thead tbody "
    "tfoot tr figure details summary center hgroup hr".split()
)
BLOCKS = PARAGRAPHS | CONTAINERS
# What the opening tag of an item closes, and the elements it does not look beyond.
ITEMS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "thead", "tbody", "tfoot"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
ITEM_OF = {"li": "li", "dt": "dd", "dd": "dd", "td": "td", "th": "td", "tr": "tr", "option": "option"}
ITEM_TAGS = frozenset().union(*(closed | border for closed, border in ITEMS.values()))
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer header masthead topbar "
    "comment comments disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget widgets toolbar search form skip".split()
)
# Words that leave the sense of a word above as it is.
BESIDE = frozenset(
    "area articles bar block body bottom box button buttons card center column container content count footer group "
    "header holder home icon icons inline inner item items js left link links list main message messages meta outer "
    "page panel post posts primary reader readers region right row secondary section site slot small stories text "
    "thread title top unit user users wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ARTICLE_WORDS = frozenset("article content main post entry story".split())
HEADERS = frozenset({"header", "banner", "masthead"})
ARTICLES = frozenset({"article", "main"})


class _Node:
    """An element; ``at`` is its place on the stack, ``block`` the nearest block element, itself included.

    ``items`` gives the place of the open item that the next one of each kind would close.
    ``gone``: never shown.  ``around``: named as a part around an article.  ``doubtful``: only
    a part of its name says so.
    """

    __slots__ = (
        "tag", "parent", "gone", "in_article", "named", "around", "doubtful", "points", "chars", "linked", "order",
        "at", "block", "items",
    )

    def __init__(self, tag: str, parent: _Node | None, order: int, at: int):
        self.tag, self.parent, self.order, self.at = tag, parent, order, at
        self.gone = parent.gone if parent else False
        self.in_article = bool(parent and (parent.in_article or parent.tag in ARTICLES))
        self.named = self.around = self.doubtful = False
        self.points = 0.0
        self.chars = self.linked = 0
        self.block: _Node = self if parent is None or tag in BLOCKS else parent.block
        self.items: dict[str, int] = parent.items if parent else {}
        if tag in ITEM_TAGS:
            self.items = {k: v for k, v in self.items.items() if tag not in ITEMS[k][1]}
            for kind, (closed, _) in ITEMS.items():
                if tag in closed:
                    self.items.setdefault(kind, at)


def _judge(node: _Node, attributes: str) -> None:
    """Marks elements that are not part of an article by tag, class, id, role or hiding."""
    tag = node.tag
    if tag in DROPPED:
        node.gone = True
    node.around = tag in AROUND_TAGS or (tag == "header" and not node.in_article)
    if not attributes or node.gone:
        return
    plain = 0  # names without a word of the parts around an article
    around = doubtful = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            node.gone = True
        elif key == "role":
            around = around or bool(set(value.lower().split()) & (ROLES - HEADERS if node.in_article else ROLES))
        elif key in ("class", "id"):
            for name in value.split():
                words = {w.lower() for w in NAME_PARTS.findall(name)}
                bad = words & (AROUND - HEADERS if node.in_article else AROUND)
                if not bad:
                    plain += 1
                    node.named = node.named or bool(words & ARTICLE_WORDS)
                elif words <= AROUND | BESIDE:
                    around = True
                else:
                    doubtful = True
    if tag in ("html", "body", "main") or (tag == "article" and plain):
        return
    node.around = node.around or around
    node.doubtful = doubtful and tag != "article"


def blocks_of(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """The tree's nodes in page order, and the blocks: innermost block element, text, characters in links.

    Time grows with the page's length alone, however broken its markup: no search starts
    behind the last ``>``, and open elements are found by name and by kind, never by walking
    up the stack.
    """
    root = _Node("#", None, 0, 0)
    nodes, stack, blocks = [root], [root], []
    places: dict[str, list[int]] = defaultdict(list)  # of open elements, by name
    buffer: list[str] = []
    links = linked = 0  # open links; characters of the buffer in links

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((stack[-1].block, text, min(linked, len(text))))
        linked = 0

    def text_of(part: str) -> None:
        nonlocal linked
        if part and not stack[-1].gone:
            part = html.unescape(part) if "&" in part else part
            buffer.append(part)
            if links:
                linked += len(part.strip())

    def close_to(at: int) -> None:
        """Closes the element at this place of the stack and all inside it."""
        nonlocal links
        if stack[-1].block.at >= at:
            flush()
        while len(stack) > at:
            node = stack.pop()
            if node.tag:
                places[node.tag].pop()
                links -= node.tag == "a"

    at, end, last = 0, len(page), page.rfind(">") + 1
    while at < end:
        m = TAG.search(page, at, last)
        if not m:
            comment = page.find("<!--", at)
            text_of(page[at : comment if comment >= 0 else end])
            break
        text_of(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if at == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        name = name.lower()
        if m[1] or m[4]:
            if places[name]:
                node = stack[places[name][-1]]
                if name in BLOCKS or node.gone or stack[-1].block.at < node.at:
                    close_to(node.at)
                else:  # blocks opened inside an inline element outlive it
                    places[name].pop()
                    links -= name == "a"
                    node.tag = ""
            continue
        attributes = m[3] or m[6] or ""
        if name in BLOCKS:  # every block closes a paragraph, so an open one is the nearest block
            block = stack[-1].block
            if block.tag == "p" and block.gone == stack[-1].gone:  # (not from inside what is never shown)
                close_to(block.at)
            flush()
        kind = ITEM_OF.get(name)
        if kind in stack[-1].items:
            close_to(stack[-1].items[kind])
        if name == "br":
            buffer.append(" ")
        if name in VOID:
            continue
        if name in RAW:
            close = RAW_ENDS[name].search(page, at, last)
            at = close.end() if close else end
            continue
        node = _Node(name, stack[-1], len(nodes), len(stack))
        _judge(node, attributes)
        if attributes.rstrip().endswith("/") and name not in BLOCKS and name not in ("a", "b", "i", "span"):
            continue
        nodes.append(node)
        places[name].append(len(stack))
        stack.append(node)
        links += name == "a"
    flush()
    return nodes, blocks


RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in RAW}


def _sum_up(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Characters and characters in links of every element."""
    for node in nodes:
        node.chars = node.linked = 0
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
    for node in reversed(nodes):  # parents come before children
        if node.parent:
            node.parent.chars += node.chars
            node.parent.linked += node.linked


def _left_out(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> list[bool]:
    """Which elements, by ``order``, belong to the parts around the article.

    A name decides alone only where all of it says so (``share-buttons``), and not where it
    holds the page's only article.  Where a part says so (``share-price``), the element must
    also hold no article and be mostly links, or short and outside an article.
    """
    _sum_up(nodes, blocks)
    inside, article, within, holds = ([False] * len(nodes) for _ in range(4))
    free = False  # an article stands outside all parts so named
    for node in nodes:
        k, up = node.order, node.parent.order if node.parent else 0
        inside[k] = node.around or inside[up]
        within[k] = article[up] or within[up]
        article[k] = holds[k] = not node.around and (node.tag in ARTICLES or node.named)
        free = free or (article[k] and not inside[k])
    for node in reversed(nodes):
        if node.parent and holds[node.order]:
            holds[node.parent.order] = True
    out = [False] * len(nodes)
    for node in nodes:
        k = node.order
        only = holds[k] and not free and not within[k]
        poor = not holds[k] and (2 * node.linked >= node.chars or (not within[k] and node.chars < 200))
        out[k] = bool(node.parent and out[node.parent.order]) or (node.around and not only) or (node.doubtful and poor)
    return out


def main_blocks(page: str) -> list[str]:
    """The blocks of the article, in page order."""
    nodes, blocks = blocks_of(page)
    out = _left_out(nodes, blocks)
    blocks = [b for b in blocks if not out[b[0].order]]
    if not blocks:
        return []
    _sum_up(nodes, blocks)
    for node, text, _ in blocks:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        if len(text) < 25:
            points *= len(text) / 100
        up = node.parent if node.tag in PARAGRAPHS else node
        share = 1.0
        for level in range(6):
            if up is None:
                break
            up.points += points * share
            share = 0.5 if level == 0 else 1 / (3 * (level + 1))
            up = up.parent

    def density(node: _Node) -> float:
        return node.linked / max(1, node.chars)

    def score(node: _Node) -> float:
        bonus = 1.25 if node.tag in ARTICLES or node.named else 1.0
        return bonus * node.points * (1 - density(node))

    best = max(nodes, key=lambda n: (score(n), -n.order))
    if score(best) <= 0:
        return []
    # the article that the best container belongs to, if that is text and not a list of links
    up, lifted = best, None
    while up is not None:
        if density(up) < 0.5 and (up.tag == "article" or (up.tag == "main" and lifted is None)):
            lifted = up
        up = up.parent
    wanted = lifted or best
    least = max(10.0, 0.2 * score(wanted))
    kept = {wanted}
    for node in nodes:
        if node.parent is wanted.parent and node is not wanted and node.chars:
            alike = node.tag == wanted.tag and node.tag in ("article", "section", "div")
            if density(node) < 0.5 and (score(node) >= least or alike and score(node) > 0):
                kept.add(node)
            elif node.tag in PARAGRAPHS and density(node) < 0.25 and wanted.tag not in ARTICLES:
                kept.add(node)
    inside: dict[int, bool] = {}
    for node in nodes:
        inside[node.order] = node in kept or bool(node.parent and inside[node.parent.order])
    return [text for node, text, _ in blocks if inside[node.order]]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: one row per row.

    The article's blocks joined by line feeds, white space inside a block as one space,
    character references decoded.  A null or empty page, or one without text outside the
    parts around an article, gives the empty text.  Broken markup is read as far as it goes,
    in time linear in the page's length; long pages are read whole.  Repeated rows and null
    ids or addresses are kept as they come, an empty table gives none, other columns are not
    looked at.
    """

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text", "n_chars"]
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                texts = ["\n".join(main_blocks(page.as_py())) for page in some.column(2)]
                counts = pa.array([len(t) for t in texts], pa.int64())
                yield pa.record_batch([some.column(0), some.column(1), pa.array(texts, pa.string()), counts], names)

    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")
    ).mapInArrow(main_text, "page_id long, url string, text string, n_chars long")
