"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with the path of tags from the root down to it. Blocks on one
path are taken together: text outside links and punctuation marks per block of the path. Both
ratios are laid out in page order, smoothed over neighbouring blocks, fused into one score per
path, and paths over a threshold are content. The page's article is where content is: all marked
articles, if they hold half of the content text, else the lowest node that holds ``MOST`` of it.
Its blocks are returned but for lists of links; in a node that is the whole page also those
between content, headings, and lists and quotations around it. Elements that are no article by
their tag or class (menus, headers, footers, asides, forms, adverts, notices, comments, scripts,
styles) never count, unless nothing would be left; words that also name parts of a text (such as
related or social) count only as a class of their own.

Pages are independent. Null html is an empty page; a page without text gives an empty string.
Unclosed tags end where HTML ends them; a page cut off in the middle is read to its end. Work is
linear in a page's length, however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_RAW = frozenset("script style noscript template textarea iframe title".split())
#: What follows such a tag is its content to the page's end, if it has no end tag.
_RAW_TO_END = frozenset("script style".split())
_HIDDEN = frozenset("svg canvas select".split())
#: Elements inside are parts of a formula or drawing, not of the page.
_FOREIGN = frozenset("svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr svg math object canvas select option".split()
)
#: A start tag that ends an open element of the set, looked for up to the nearest scope.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_NO_ARTICLE = frozenset("head nav footer aside form dialog menu button fieldset".split())
_NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_NO_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|banner|sidebar|side-bar|aside|comments?|commentlist|replies|respond|disqus|"
    r"footer|nav|navbar|navigation|menu|breadcrumbs?|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|"
    r"popup|modal|overlay|pagination|pager|toolbar|masthead|site-header|skip-link)(?=$|[\s_-])"
    r"|(?:^|\s)(?:promos?|promotions?|notices?|alert|share|sharing|social|related|recommended|widget)"
    r"(?:[_-](?:area|articles?|bar|block|box|boxes|buttons?|content|icons?|items?|links?|list|media|message|news|posts?|section|share|sharing|stories|text|wrapper))?(?=$|\s)",
    re.IGNORECASE,
)
_PUNCTUATION = re.compile(r"[,.;:!?¿¡…，。；：！？、]")


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    depth: int
    parent: Node | None
    skip: bool
    article: bool
    inline: bool
    foreign: bool


@dataclass(slots=True)
class Block:
    """Text between two block boundaries, in one node."""

    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _skipped(tag: str, attributes: str, inside: Node, lenient: bool) -> bool:
    if tag in _HIDDEN:
        return True
    if tag in _NO_ARTICLE:
        return not (lenient and tag in ("form", "fieldset"))
    if tag == "header" and not inside.article:
        return True
    if lenient or tag in ("html", "body", "article", "main") and "comment" not in attributes.lower():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id") and _NO_CLASS.search(value):
            return True
        if name == "role" and value.lower() in _NO_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str, lenient: bool = False) -> list[Block]:
    """Blocks with text in page order, without those of skipped elements."""
    root = Node("", 0, 0, None, False, False, False, False)
    #: A path is numbered by the number of its start and its last tag.
    paths: dict[tuple[int, str], int] = {}
    stack, out, links = [root], [], 0
    #: Places of block elements in the stack, and how many elements of a tag are open.
    block_at, open_tags = [0], Counter()
    here = Block(root)
    lower = None

    def flush() -> None:
        nonlocal here
        if here.parts:
            text = "".join(here.parts)
            here.text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if here.text:
                out.append(here)
        k = block_at[-1]
        if here.parts:
            here = Block(stack[k])
        else:
            here.node = stack[k]

    def say(text: str) -> None:
        if text and not stack[-1].skip:
            here.parts.append(text)
            if links:
                here.linked += len(text)

    def leave(to: int) -> None:
        nonlocal links
        block = False
        for node in stack[to:]:
            block = block or not node.inline
            links -= node.tag == "a"
            open_tags[node.tag] -= 1
        del stack[to:]
        while block_at[-1] >= to:
            block_at.pop()
        if block:
            flush()

    def close(tags: set[str] | frozenset[str], scope: set[str]) -> None:
        if not any(open_tags[t] for t in tags):
            return None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return leave(i)
            if stack[i].tag in scope:
                return None
        return None

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            cut = page.rfind("<", at)
            # A tag that the page's end cuts off is no text.
            say(page[at:cut] if cut >= 0 and re.match(r"<[/!]?[a-zA-Z]", page[cut:]) else page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            close({tag}, {"table"} if tag in ("p", "li", "div") else set())
            continue
        if tag in _RAW:
            if attributes.rstrip().endswith("/"):
                continue
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at)
            if end >= 0 or tag in _RAW_TO_END:
                at = n if end < 0 else end
            if not stack[-1].foreign:
                flush()
            continue
        if tag in ("br", "hr"):
            say(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        parent = stack[-1]
        inline = tag in _INLINE or parent.foreign
        if tag in _ENDS and not parent.foreign:
            close(*_ENDS[tag])
        if not inline:
            close({"p"}, {"table", "td", "div", "article", "section", "li", "blockquote"})
        parent = stack[-1]
        node = Node(
            tag, paths.setdefault((parent.path, tag), len(paths) + 1), parent.depth + 1, parent, parent.skip or _skipped(tag, attributes, parent, lenient),
            parent.article or tag in ("article", "main"), inline, parent.foreign or tag in _FOREIGN,
        )
        if attributes.rstrip().endswith("/") and (not inline or node.foreign):
            continue
        if not inline:
            flush()
            block_at.append(len(stack))
        stack.append(node)
        open_tags[tag] += 1
        links += tag == "a"
        if not inline:
            here.node = node
    flush()
    return out


def path_scores(found: list[Block], reach: int = 2) -> dict[int, float]:
    """Fused, smoothed ratio of each path."""
    text: dict[int, list[float]] = {}
    for b in found:
        sums = text.setdefault(b.node.path, [0.0, 0.0, 0.0])
        sums[0] += max(0, len(b.text) - b.linked)
        sums[1] += len(_PUNCTUATION.findall(b.text)) * (1 - min(1.0, b.linked / len(b.text)))
        sums[2] += 1
    ratio = [(text[b.node.path][0] / text[b.node.path][2], text[b.node.path][1] / text[b.node.path][2]) for b in found]
    kernel = [math.exp(-(d * d) / 2) for d in range(-reach, reach + 1)]
    total: dict[int, list[float]] = {}
    for i, b in enumerate(found):
        near = [(kernel[j - i + reach], ratio[j]) for j in range(max(0, i - reach), min(len(found), i + reach + 1))]
        weight = sum(k for k, _ in near)
        chars, marks = sum(k * r[0] for k, r in near) / weight, sum(k * r[1] for k, r in near) / weight
        own = ratio[i]
        # Smoothing lends to short blocks amid text; a path without own text gets nothing.
        fused = math.sqrt((own[0] + chars) / 2 * (1 + (own[1] + marks) / 2))
        sums = total.setdefault(b.node.path, [0.0, 0.0])
        sums[0] += fused if own[0] else 0.0
        sums[1] += 1
    return {path: s / k for path, (s, k) in total.items()}


#: Share of the content text that the article holds, of all paths' best score that content has,
#: and of its characters in links at which a block is a menu.
MOST = 0.95
_SHARE = 0.3
_LINKED = 0.8
_HEADING = re.compile(r"h[1-6]$")
_AROUND = frozenset("li dt dd blockquote pre figcaption caption td th".split())
_TEXT_TAGS = frozenset("p li td th tr tbody dt dd pre blockquote h1 h2 h3 h4 h5 h6".split())


def _held(found: list[Block], chosen: set[int]) -> tuple[dict[int, float], list[Node]]:
    """Content text in each node and below it, and the nodes, lowest first."""
    nodes: dict[int, Node] = {}
    held: dict[int, float] = {}
    for b in found:
        node = b.node
        held[id(node)] = held.get(id(node), 0.0) + (max(0, len(b.text) - b.linked) if b.node.path in chosen else 0.0)
        while node is not None and id(node) not in nodes:
            nodes[id(node)] = node
            node = node.parent
    order = sorted(nodes.values(), key=lambda n: -n.depth)
    for node in order:
        if node.parent is not None:
            held[id(node.parent)] = held.get(id(node.parent), 0.0) + held.get(id(node), 0.0)
    return held, order


def _with_title(found: list[Block], node: Node) -> Node:
    """The node, or the nearest one around it, below the page's body, that has a title."""
    titled: set[int] = set()
    for b in found:
        if b.node.tag in ("h1", "h2"):
            up = b.node
            while up is not None and id(up) not in titled:
                titled.add(id(up))
                up = up.parent
    up = node
    while up is not None and up.tag not in ("", "html", "body"):
        if id(up) in titled:
            return up
        up = up.parent
    return node


def content(found: list[Block]) -> list[Block]:
    """Blocks of the article among ``found``."""
    if not found:
        return []
    scores = path_scores(found)
    top = max(scores.values())
    chosen = {p for p, s in scores.items() if s >= _SHARE * top}
    held, order = _held(found, chosen)
    total = max(held.values())
    if not total:
        return []
    # Outermost marked articles with content, if half of it is theirs.
    marked = [n for n in order if n.tag in ("article", "main") and not n.parent.article and held.get(id(n), 0.0) > 0]
    if len(marked) == 1:
        # Of nested ones the innermost that has nearly all.
        inner = [n for n in order if n.article and n.tag in ("article", "main") and held.get(id(n), 0.0) >= MOST * held[id(marked[0])]]
        marked = [inner[0]] if inner else marked
    if sum(held[id(n)] for n in marked) < 0.5 * total:
        lowest = next(n for n in order if held.get(id(n), 0.0) >= MOST * total and n.tag not in _TEXT_TAGS and not n.inline)
        marked = [_with_title(found, lowest)]
    whole = any(n.tag in ("", "html", "body") for n in marked)
    inside: dict[int, bool] = {id(n): True for n in marked}

    def within(node: Node | None) -> bool:
        way = []
        while node is not None and id(node) not in inside:
            way.append(node)
            node = node.parent
        known = node is not None and inside[id(node)]
        inside.update((id(n), known) for n in way)
        return known

    at = [i for i, b in enumerate(found) if b.node.path in chosen and within(b.node)]

    def kept(i: int, b: Block) -> bool:
        if not within(b.node):
            return False
        if b.node.path in chosen:
            return True
        if b.linked > _LINKED * len(b.text):
            return False
        return not whole or at[0] < i < at[-1] or bool(_HEADING.match(b.node.tag)) or (b.node.tag in _AROUND and 2 * b.linked <= len(b.text))

    return [b for i, b in enumerate(found) if kept(i, b)]


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by an empty line."""
    if not page:
        return ""
    kept = content(blocks(page)) or content(blocks(page, lenient=True))
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url, "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url)}
    return pages.select(F.col(id_col), F.col(url), F.col(html)).mapInArrow(
        each, f"`{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, text string, n_chars long"
    )
