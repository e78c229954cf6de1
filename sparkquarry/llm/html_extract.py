"""Main text of web pages by tag-path ratios.

Text blocks are grouped by the path of tags (with their classes) from the root. For each path, text length and punctuation
per block make two ratios; both are smoothed over paths in page order and fused. Paths in an article or main element count
more, paths in elements that are named as menus, adverts and the like far less, and paths above a threshold are content. The
least container of all content gives its other blocks too, but for those in so named elements: titles, short lines and lists belong
to the article around them. Where that is the page itself, each part of it that has content does. Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: A comment, declaration or tag. In a tag, quotes are marks of a value only behind ``=``; else they are characters of a name.
TAG = re.compile(r"""<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(?:>|$))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content is not markup: fixed values of HTML.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that an opening tag of the same kind closes, and what a paragraph's end is implied by.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of a page that are never its article, by tag or role; a header is, if it stands in an article or main element.
NEVER_TAGS = frozenset("nav footer aside form script style noscript template iframe button select option textarea input label menu dialog svg canvas object head".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: Words of a class or id that hint at such parts, words that say nothing beside them, and words of parts that hold what readers
#: wrote. A hint does not count for an element that holds a first-level heading, nor (but for readers' words) for an article, a
#: main element or a line of text.
HINTS = frozenset(
    "nav navbar navigation menu menubar header masthead footer foot sidebar aside widget ad ads advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent notice gdpr popup modal overlay share sharing social related recommended breadcrumb breadcrumbs pagination pager search login signup subscribe newsletter tags toolbar skip".split()
)
NEUTRAL = frozenset("left right top bottom wrap wrapper box block container inner outer list item items section site page main area links link bar buttons button content text row col column post article the a".split())
READERS = frozenset("comment comments reply replies respond disqus".split())
#: Words before a hint that turn it into a remark on the element's surroundings.
REMARKS = frozenset("has with no without is not hide show".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Share of the mean fused score at which a path is content, and the weights of neighbours when smoothing.
THRESHOLD, KERNEL = 0.5, (0.25, 0.5, 0.25)
#: What the score of a path is multiplied by: in an article or main element, and for each element whose names are all hints, or partly.
ARTICLE, HINTED, PARTLY = 2.0, 0.1, 0.7
#: Headings of what readers wrote.
READERS_HEADING = re.compile(r"\W*(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|replies|responses|reactions|discussion|leave a (?:comment|reply)|join the (?:conversation|discussion))(?:\s*\(?\d+\)?)?\W*", re.I)
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Elements that are a line of their container, and those that are the page.
LINES = frozenset("p li h1 h2 h3 h4 h5 h6 pre dt dd td th tr figcaption summary".split())
PAGE = frozenset(("html", "body"))
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass(eq=False, slots=True)
class Node:
    """An element: its place among all, its ancestors' sums, and ``last``, the place of the last element in it."""

    tag: str
    parent: "Node | None"
    key: int
    path: int
    hint: int
    never: bool
    article: bool
    depth: int = 0
    last: int = 1 << 60
    heads: bool = False
    weight: float | None = None


@dataclass(slots=True)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())


def _hinted(names: str) -> int:
    """2 if a name is made of hints, 1 if one has a hint as first or last word, else 0."""
    found = 0
    for words in map(_words, names.split()):
        if words and words[0] not in REMARKS:
            hints = [w in HINTS for w in words]
            if any(hints) and all(h or w in NEUTRAL for h, w in zip(hints, words)):
                return 2
            found = max(found, hints[0] or hints[-1])
    return int(found)


def _of_readers(names: str) -> bool:
    return any(words and words[0] not in REMARKS and (words[0] in READERS or words[-1] in READERS) for words in map(_words, names.split()))


@lru_cache(maxsize=20_000)
def describe(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """(label in paths, whether it is never part of an article, how far its names hint at that, whether it marks an article)."""
    values = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{values.get('class', '')} {values.get('id', '')}"
    words = set(_words(names.replace(" ", "-")))
    role = values.get("role", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    readers = tag not in PAGE and _of_readers(names)
    marks = (tag in ARTICLE_TAGS or role in ("main", "article") or values.get("itemprop") == "articleBody") and not readers
    never = tag in NEVER_TAGS or role in NEVER_ROLES or hidden or readers
    hint = 0 if tag in PAGE or marks else min(_hinted(names), 1 if tag in LINES else 2)
    return tag + "".join(f".{w}" for w in sorted(words)), never, hint, marks and not never


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """Text blocks in page order, and all elements. Inline tags don't end a block, ``br`` is white space in it; unclosed tags end
    with their parent."""
    root = Node("", None, 0, 0, 0, False, False)
    stack, nodes, paths, tags = [root], [root], {}, Counter()
    blocks: list[Block] = []
    current: Block | None = None
    at, links, size = 0, 0, len(page)

    def add(text: str) -> None:
        nonlocal current
        if not text or (current is None and not text.strip()):
            return
        if current is None:
            current = Block(stack[-1])
            blocks.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.last = nodes[-1].key
            tags[node.tag] -= 1

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name == "a":
                links = max(0, links - 1)
            if tags[name] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != name:
                    depth -= 1
                close(depth)
                current = None
            elif name in BLOCK:
                current = None
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "a":
            links += 1
        if name == "br":
            add(" ") if current is not None else None
            continue
        label, never, hint, article = describe(name, m[3])
        if name == "header":
            never = never or not stack[-1].article
        elif name == "h1" or (article and name == "main"):
            for node in reversed(stack):
                if node.heads:
                    break
                node.heads = True
        if name in BLOCK:
            current = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in SIBLINGS.get(name, ()):
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        elif never or hint:
            current = None
        if name not in VOID and not m[0].endswith("/>") and (name in BLOCK or never or hint):
            above = stack[-1]
            path = paths.setdefault((above.path, label), len(paths) + 1)
            node = Node(name, above, len(nodes), path, hint, never or above.never, article or above.article, above.depth + 1)
            nodes.append(node)
            stack.append(node)
            tags[name] += 1
    close(1)
    return blocks, nodes


def _weights(nodes: list[Node]) -> None:
    """What the names of an element and of those around it multiply a score by."""
    for node in nodes:  # parents come first
        own = 1.0 if not node.hint or node.heads else (HINTED if node.hint == 2 else PARTLY)
        node.weight = own * (node.parent.weight if node.parent else 1.0)


def _of_readers_heading(blocks: list[tuple[Block, str]]) -> set[int]:
    """Numbers of the blocks from a heading of readers' words on, as far as its parent goes or the next heading there of its rank."""
    out: set[int] = set()
    parent = rank = None
    for i, (block, text) in enumerate(blocks):
        node = block.node
        if parent is not None and (not parent.key <= node.key <= parent.last or (node.tag in HEADINGS or node.tag == "h1") and node.tag <= rank and node.parent is parent):
            parent = None
        if parent is None and node.tag in HEADINGS and READERS_HEADING.fullmatch(text):
            parent, rank = node.parent, node.tag
        if parent is not None:
            out.add(i)
    return out


def path_scores(blocks: list[tuple]) -> dict:
    """Fused ratio of each path, from (path, characters, punctuation marks, linked characters) of blocks in page order."""
    order: dict = {}
    for path, *_ in blocks:
        order.setdefault(path, len(order))
    sums = np.zeros((len(order), 4))
    for path, chars, marks, linked in blocks:
        sums[order[path]] += (1, max(0, chars - linked), marks, chars)
    length, punctuation = sums[:, 1] / sums[:, 0], sums[:, 2] / sums[:, 0]

    def smooth(x: np.ndarray) -> np.ndarray:
        padded = np.r_[x[0], x, x[-1]]
        return np.maximum(x, np.convolve(padded, KERNEL, "valid"))

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.max() if x.max() > 0 else x

    fused = np.sqrt(scaled(smooth(length)) * scaled(smooth(punctuation)))
    if not fused.any():  # no punctuation at all: length alone
        fused = scaled(smooth(length))
    return dict(zip(order, fused))


def main_text(page: str) -> str:
    found, nodes = blocks_of(page)
    blocks = [(block, text) for block in found if (text := " ".join(html.unescape("".join(block.parts)).split()))]
    readers = _of_readers_heading(blocks)
    kept = [(b, t) for i, (b, t) in enumerate(blocks) if not b.node.never and i not in readers]
    if not kept:
        return ""
    _weights(nodes)
    # a path whose elements hold a heading in one place and none in another has different weights there
    path = lambda n: (n.path, n.weight, n.article)
    fused = path_scores([(path(b.node), len(t), len(PUNCTUATION.findall(t)), b.linked) for b, t in kept])
    plain = {p: score * (ARTICLE if p[2] else 1.0) for p, score in fused.items()}
    least = THRESHOLD * float(np.mean([*plain.values()]))
    content = {p for p, score in plain.items() if score > 0 and score * p[1] >= least}
    named = lambda n: n.weight <= HINTED
    own = [b.node for b, _ in kept if path(b.node) in content]
    if not own:
        return "\n".join(text for block, text in kept if not named(block.node))
    holders = [n.parent if n.tag in LINES and n.parent else n for n in own]
    low, high = min(holders, key=lambda n: n.key), max(holders, key=lambda n: n.key)
    top = low  # the least common ancestor of the first and the last is that of all
    while not (top.key <= high.key <= top.last):
        top = top.parent
    if top.parent is not None and top.tag not in PAGE:
        inside = lambda n: top.key <= n.key <= top.last
    else:  # the page itself: its parts with content, and its own lines
        starts = [n.key for n in nodes if n.parent is top]
        part = lambda n: bisect_right(starts, n.key)
        parts = {part(n) for n in own}
        inside = lambda n: n is top or part(n) in parts or (n.parent is top and n.tag in LINES)
    return "\n".join(text for block, text in kept if path(block.node) in content or (inside(block.node) and not named(block.node)))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page from its whole html; n_chars counts code points.

    White space inside a block is one space, blocks are joined by a line feed. Null or empty html, and pages without
    text outside of menus, notices and the like, have an empty text. Repeated rows and null ids give a row each; other
    columns are ignored. One narrow pass without shuffle; a page is one value.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind, url = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return source.mapInArrow(run, f"id {kind}, url {url}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
