"""Main text of HTML pages by a minimum cut.

A page becomes blocks of text. A linear classifier gives each block evidence for content or for boilerplate, from the elements,
classes and roles it stands in, its links, length and punctuation; that evidence is the capacity of the block's edge to the
source or to the sink. Blocks that follow each other, and blocks next to each other in the same container, are joined by edges
whose capacity falls with their distance in the document tree. The maximum flow separates content from boilerplate at the
least total cost, so weak blocks go with their surroundings.

A block is the text between two boundaries of block elements; a line break inside it is white space. Scripts, styles, the
title, and other elements without readable text are left out as a whole; end tags that HTML lets out may be missing. An element that
wraps the page (a form around everything, a layout named after its sidebar) is no evidence. Work is in proportion to the page.

Names in classes and ids are weighed by where they stand. The id of a heading or a paragraph is made from its own words and is no
evidence. Inside an article, a main element or a container named as content, a name that may also be a subject (`discussion`,
`privacy`, `related`) counts only if it has no other subject in it (`share-price-table`), and if what it names does not read as a part
of the text: few links, and a heading that says the same or enough running text. Where articles or main elements hold most of a
page's running text, what stands outside them is at a disadvantage, above all behind them: it has unnamed columns and comments.

Defined cases: null html counts as empty; a page without content blocks has empty text; rows with a null page_id or url and
repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, up to the nearest of the containers named behind it.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Elements whose content is raw text up to their end tag, or to the end of the page; and elements that are left out as a whole if
#: they have an end tag (without one, only the tag is).
RAW = frozenset("script style textarea title".split())
LEFT_OUT = frozenset("template noscript svg math iframe object canvas select audio video".split())
#: Evidence of an element for the text in it (positive: content). The weights were set by hand, to the rule that any one clear sign
#: of boilerplate outweighs a long paragraph inside an article, and that page-wide wrappers count for nothing.
ELEMENTS = {"article": 3.0, "main": 2.5, "nav": -12.0, "footer": -12.0, "aside": -12.0, "menu": -8.0, "dialog": -12.0, "button": -8.0, "option": -8.0, "address": -3.0}
#: The same of elements that can also wrap a whole page, and of names in classes and ids: they count for nothing around it.
WRAPPERS = {"form": -12.0, "fieldset": -6.0, "header": -5.0}
ROLES = {"navigation": -12.0, "banner": -6.0, "contentinfo": -12.0, "complementary": -12.0, "search": -8.0, "dialog": -12.0, "alert": -8.0, "alertdialog": -12.0, "form": -8.0, "menu": -8.0, "menubar": -8.0, "main": 2.5, "article": 3.0}
#: Words in classes and ids, and the evidence for the text in them.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright cta disclaimer discussion disqus feedback footer footnav gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popover popup privacy promo promoted promotion recommended related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored sponsors submenu subscribe subscription tagcloud tags teaser toast toc toolbar topbar tracking trending widget widgets".split()
)
#: Those of them that are also subjects of articles.
SUBJECTS = frozenset(
    "advertising banner consent cookie cookies copyright disclaimer discussion feedback header masthead menu modal navigation notice notification overlay privacy promotion recommended related replies reply respond rss search share sharing skip social sponsor sponsors subscription tags tracking trending widget widgets".split()
)
#: Those of them that name readers' comments, which may be longer than the article.
READERS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
#: Words that add no subject to a name.
PARTS = frozenset(
    "above after area articles bar before below block bottom box button buttons card center column container div element end footer form global group holder icon icons inline inner item items law layout left level link links list message mobile module more outer page panel placeholder policy posts read right row section settings side site slot sticky stories thread title top unit user view wrap wrapper zone".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main post story text prose".split())
#: Words of the article's own heading, where an article is around it or named with it.
HEADING_NAMES = frozenset("header masthead banner".split())
#: A name that begins so tells what is beside or what the page can do, not what the element is.
STATES = frozenset("has with without no is js not hide show can supports".split())
#: Elements whose id is made from their own words.
OWN_IDS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd figcaption caption".split())
BAD_NAME, GOOD_NAME, HIDDEN = -12.0, 1.5, -20.0
#: Share of a page's running text that an element with an h1 or a main element in it (or a form) must hold to be a wrapper.
WRAPS = 0.6
#: An element with another heading is a wrapper if the running text that no name speaks against is below this share of its own.
BARE = 0.1
#: What a part with a doubtful name must hold to be text: characters of running text; and the most it may have in links.
READS, LINKED = 200, 0.1
#: Share of the running text that articles (or main elements) must hold to speak against what is outside them, without and with an h1
#: in them; evidence before and behind the first of their blocks.
HOLDS, HEADED, BEFORE, BEHIND = 0.6, 0.25, -2.0, -7.0
SMOOTH = 1.6  # capacity between neighbours with the same parent

_TAGS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.IGNORECASE) for t in RAW | LEFT_OUT}
_NAMES = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_LINKS = frozenset(("a",))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTS = {"article": 2, "main": 1}


@dataclass(slots=True)
class _Node:
    tag: str
    parent: _Node | None
    depth: int
    own: float  # evidence of this element alone, wherever it stands
    soft: float  # evidence that does not count if the element wraps the page
    inside: int  # 2 in an article, 1 in a main element, 0 elsewhere
    named: bool = False  # in a container named as content
    doubt: float = 0.0  # evidence that only counts if the part does not read as text
    subjects: frozenset = frozenset()  # the words of that evidence
    doubtful: _Node | None = None  # the nearest such element around it, itself included
    readers: bool = False  # it is named as readers' comments
    total: int = 0  # characters of text below it
    linked: int = 0  # of them in links
    running: int = 0  # of them running text
    agrees: bool = False  # a heading in it has one of its subjects
    heads: bool = False  # an h1 or a main element is in it
    titled: bool = False  # a heading is in it
    firm: float = 0.0  # evidence of all elements around the text: in one part, in the other, and in all
    softly: float = 0.0
    evidence: float = 0.0


@dataclass(slots=True)
class Block:
    node: _Node
    text: str
    linked: int  # characters in links
    place: float = 0.0  # evidence of its place outside the articles


def _name_evidence(value: str, inside: int, named: bool) -> tuple[float, frozenset, bool, bool]:
    """Of a class or an id, each of its names alone: evidence, doubtful words, is it named as content, as readers' comments."""
    out, doubtful, content, readers = 0.0, frozenset(), False, False
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in STATES:
            continue
        bad, good = BAD_NAMES.intersection(words), GOOD_NAMES.intersection(words)
        if bad and bad <= HEADING_NAMES and (inside or good):
            continue
        if bad and (inside or named) and bad <= SUBJECTS:
            if all(len(w) < 3 or w in BAD_NAMES or w in PARTS or w in GOOD_NAMES for w in words):
                doubtful |= bad
        elif bad:
            out += BAD_NAME
        elif good:
            out += GOOD_NAME
            content = True
        readers |= not READERS.isdisjoint(bad)
    return min(max(out, BAD_NAME), GOOD_NAME), doubtful, content, readers


def _weigh(node: _Node, attributes: str) -> None:
    """The evidence of an element's tag and attributes; where it stands is known."""
    tag, up = node.tag, node.parent
    node.own, node.soft = ELEMENTS.get(tag, 0.0), WRAPPERS.get(tag, 0.0)
    node.named, node.doubtful = up.named, up.doubtful
    if tag == "header" and node.inside:
        node.soft = 0.0  # the article's own heading
    if not attributes or attributes.isspace():
        return
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role":
            if not (value.lower() == "banner" and node.inside):
                node.own += ROLES.get(value.lower(), 0.0)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            node.own += HIDDEN
        elif name == "class" or (name == "id" and tag not in OWN_IDS):
            if tag not in ("html", "body", "main"):
                out, subjects, content, readers = _name_evidence(value, up.inside, up.named)
                node.soft += out
                node.subjects |= subjects
                node.readers |= readers
                node.named |= content and out > 0
    if node.subjects:
        node.doubt, node.doubtful = BAD_NAME, node


def blocks(html: str) -> list[Block]:
    """The page's blocks of text in their order."""
    root = node = _Node("#", None, 0, 0.0, 0.0, 0)
    nodes: list[_Node] = [root]
    opened: Counter = Counter()  # of each tag, how many elements are open
    closed: set[str] = set()  # elements to leave out that have no end tag any more
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(node, text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def leave(last: _Node) -> None:
        """Closes all elements up to this one."""
        nonlocal node
        while True:
            opened[node.tag] -= 1
            done, node = node, node.parent
            if done is last:
                return

    while m := _TAGS.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _ENDS:
            parts.append(" ")
            if not end and tag not in closed and not attributes.endswith("/"):
                if stop := _ENDS[tag].search(html, at):
                    at = stop.end()
                elif tag in RAW:
                    at = len(html)
                else:
                    closed.add(tag)
        elif tag in BLOCKS:
            close()
            in_link = 0
            if end:
                if opened[tag]:
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    leave(up)
                continue
            if node.tag == "p":
                leave(node)  # a paragraph has no blocks in it
            if tag in CLOSES:
                shut, until = (x.split() for x in CLOSES[tag])
                up, last = node, None
                if any(opened[t] for t in shut):
                    while up is not root and up.tag not in until:
                        if up.tag in shut:
                            last = up
                        up = up.parent
                if last is not None:
                    leave(last)
            if tag not in VOID:
                node = _Node(tag, node, node.depth + 1, 0.0, 0.0, node.inside)
                _weigh(node, attributes)
                node.inside = max(node.inside, _TEXTS.get(tag, 0))
                node.heads, node.titled = tag in ("h1", "main"), tag in _HEADINGS
                nodes.append(node)
                opened[tag] += 1
        elif tag in _LINKS:
            in_link = 0 if end else 1
        elif tag == "br":
            parts.append(" ")
    add(html[at:])
    close()
    _surroundings(nodes, out)
    return out


def _runs(b: Block) -> bool:
    return b.text.count(" ") >= 9 and 2 * b.linked < len(b.text)


def _surroundings(nodes: list[_Node], found: list[Block]) -> None:
    """The evidence around every element and of every block's place; parents stand before their children."""
    for b in found:
        b.node.total += len(b.text)
        b.node.linked += b.linked
        b.node.running += len(b.text) if _runs(b) else 0
        if b.node.tag in _HEADINGS and (around := b.node.doubtful):
            around.agrees |= not around.subjects.isdisjoint(w.lower() for w in _WORDS.findall(b.text))
    for n in reversed(nodes[1:]):
        up = n.parent
        up.total += n.total
        up.linked += n.linked
        up.running += n.running
        up.heads |= n.heads
        up.titled |= n.titled
    for n in nodes[1:]:
        reads = n.linked <= LINKED * n.total and (n.agrees or n.running >= max(READS, n.total / 2))
        n.soft += 0.0 if reads else n.doubt
    whole = WRAPS * nodes[0].running
    _add_up(nodes, whole)
    bare = sum(len(b.text) for b in found if b.node.evidence >= 0 and _runs(b))
    if bare < BARE * nodes[0].running:
        _add_up(nodes, whole, bare / BARE)
    runs = [(b.node.inside, len(b.text)) for b in found if b.node.evidence >= 0 and _runs(b)]
    for least in (2, 1):
        headed = any(b.node.tag == "h1" and b.node.inside >= least and b.node.evidence >= 0 for b in found)
        if sum(n for i, n in runs if i >= least) > (HEADED if headed else HOLDS) * sum(n for _, n in runs):
            behind = False
            for b in found:
                if b.node.inside >= least:
                    behind |= b.node.evidence >= 0
                elif b.node.tag != "h1":
                    b.place = BEHIND if behind else BEFORE
            return


def _add_up(nodes: list[_Node], whole: float, least: float | None = None) -> None:
    """Evidence of each element with all that are around it; with `least`, elements with any heading can be wrappers."""
    for n in nodes[1:]:
        around, soft = n.parent.softly, n.soft
        if n.running > whole and soft < 0 and (n.heads or (n.tag == "form" and not n.inside) or (least is not None and n.titled and not n.readers and n.running > least)):
            soft = 0.0
        if n.tag in ("article", "main") and soft >= 0 and (n.heads or n.running > whole):
            around = max(around, 0.0)  # names around the page's article do not speak against it
        n.softly, n.firm = around + soft, n.parent.firm + n.own
        n.evidence = n.firm + n.softly


def evidence(block: Block) -> float:
    """Log-odds of content."""
    text, n = block.text, len(block.text)
    words = text.count(" ") + 1
    out = max(block.node.evidence, -20.0) + block.place - 0.6
    out += min(words, 60) / 12
    out -= 5.0 * min(1.0, block.linked / n)
    if text[-1] in ".!?…\"'”»:" and words > 3:
        out += 0.8
    if block.node.tag in _HEADINGS:
        out += 1.2
    elif block.node.tag in ("p", "blockquote", "pre"):
        out += 1.0
    elif block.node.tag in ("li", "td", "th", "dd", "dt"):
        out -= 0.2
    if words < 12 and ("©" in text or "all rights reserved" in text.lower()):
        out -= 4.0
    return out


def distance(a: _Node, b: _Node) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source after a maximum flow (Dinic). Edges carry their capacity both ways."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if source[i] > 0:
            join(s, i, source[i], 0.0)
        if sink[i] > 0:
            join(i, t, sink[i], 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque((s,))
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if cap[e] <= eps)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(out[a]):
                path.append(out[a][nxt[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                e = path.pop()
                a = to[e ^ 1]
                nxt[a] += 1


def neighbours(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, and between blocks that follow each other within one container."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, SMOOTH / (1 + max(0, distance(found[i - 1].node, b.node) - 2))))
        up = b.node.parent
        if up is not None:
            j = last.get(id(up))
            if j is not None and j < i - 1:
                out.append((j, i, SMOOTH / 2))
            last[id(up)] = i
    return out


def main_text(html: str) -> str:
    found = blocks(html)
    if not found:
        return ""
    scores = [evidence(b) for b in found]
    kept = min_cut([max(0.0, s) for s in scores], [max(0.0, -s) for s in scores], neighbours(found))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=_SCHEMA)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    short_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.col(c).cast("string").alias(c) for c in ("url", "html")))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op3_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
