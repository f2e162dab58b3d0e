"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import blocks, in_batches

#: Comments, declarations and tags; a quote opens a value behind "=" only, and nothing is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
_UNENDED = re.compile(r"<(?=[/a-zA-Z!?])")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAME_PART = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What lies between these tags is not text of the page.
_RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes audio video canvas".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Menus and what only forms hold never are text of the page.
_NEVER = frozenset("nav head button select option datalist legend".split())
#: Parts that seldom are its main text, by tag, by role, and by name in class or id: their ratios weigh less.
_TAGS = frozenset("header footer aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset("menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget notice notices cookie cookies consent banner ad ads advert adverts advertisement sponsor sponsored promo form search login newsletter subscribe share social related comment comments replies disqus".split())
#: Such a name beside one of these says how a page is made, not what the element is.
_STATES = frozenset("has no not with without is open closed enabled disabled active".split())
_HEADS = frozenset("header masthead topbar banner".split())
_MAIN = frozenset(["article", "main"])
#: What a part that seldom is main text weighs, and the share of a page's text over which an element is no part but a wrapper.
PART_WEIGHT, WRAPPER = 0.02, 0.8
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS_ITEMS = frozenset("ul ol dl table tbody thead select".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th figure figcaption".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def _named(value: str, heads: bool) -> bool:
    """Whether a class or id names a part that seldom is main text; names of headers count if ``heads`` is set."""
    for name in value.split():
        words = {w.lower() for w in _NAME_PART.findall(_CAMEL.sub(" ", name))}
        if words & _NAMES and not words & _STATES and (heads or words & (_NAMES - _HEADS)):
            return True
    return False


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[str, bool, bool, bool]:
    """Path step of an element; whether it is never shown as text, is a part that seldom is main text, and is a main part."""
    never, part, main, label = tag in _NEVER, tag in _TAGS and not (tag == "header" and in_main), tag in _MAIN, ""
    if tag == "a" or not attributes.strip():
        return tag, never, part, main
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            part |= tag not in ("html", "body") and _named(value, not in_main)
            label = label or (value if name == "class" else "")
        elif name == "role":
            part |= value.lower() in _ROLES
            main |= value.lower() in ("main", "article")
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            never = True
    return f"{tag}.{label}" if label else tag, never, part, main


class Page:
    """Blocks of text in page order, the tree of their tag paths, and which blocks parts and main parts hold.

    A tag path is a node: ``parent`` and ``step`` by number, parents before their
    children. ``parts`` and ``mains`` are ranges of blocks.
    """

    def __init__(self) -> None:
        self.parent, self.step = [-1], [""]
        self._child: dict[tuple[int, str], int] = {}
        self.texts: list[str] = []
        self.node: list[int] = []
        self.linked: list[int] = []
        self.parts: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int]] = []

    def child(self, node: int, step: str) -> int:
        key = (node, step)
        if key not in self._child:
            self._child[key] = len(self.parent)
            self.parent.append(node)
            self.step.append(step)
        return self._child[key]


class _Element:
    __slots__ = ("main", "never", "node", "part", "tag", "begin")

    def __init__(self, tag: str, node: int, never: bool, part: bool, main: bool, begin: int) -> None:
        self.tag, self.node, self.never, self.part, self.main, self.begin = tag, node, never, part, main, begin


def parse(html_text: str) -> Page:
    """Time is linear in the page: nothing but the elements that a tag closes is looked at twice."""
    page = Page()
    stack: list[_Element] = []
    open_: Counter[str] = Counter()
    texts: list[str] = []
    linked = never = mains = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = _SPACE.sub(" ", html.unescape("".join(texts))).strip()
            if text:
                page.texts.append(text)
                page.node.append(stack[-1].node if stack else 0)
                page.linked.append(min(linked, len(text)))
            texts.clear()
        linked = 0

    def pop() -> None:
        nonlocal never, mains
        e = stack.pop()
        open_[e.tag] -= 1
        never -= e.never
        mains -= e.main
        if e.part:
            page.parts.append((e.begin, len(page.texts)))
        if e.main:
            page.mains.append((e.begin, len(page.texts)))

    def close(tag: str) -> None:
        while stack and stack[-1].tag != tag:
            pop()
        if stack:
            pop()

    def add(text: str) -> None:
        nonlocal linked
        if text and not never:
            texts.append(text)
            if open_["a"]:
                linked += len(text.strip())

    at = 0
    # Behind the last ">" no tag can end; so no tag is sought there.
    for m in _TOKEN.finditer(html_text, 0, html_text.rfind(">") + 1):
        if m.start() < at:
            continue
        add(html_text[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html_text)
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if closing:
            if tag == "br":
                add(" ")
            elif tag in _INLINE:
                i = len(stack) - 1
                while i >= 0 and stack[i].tag != tag and stack[i].tag in _INLINE:
                    i -= 1
                if i >= 0 and stack[i].tag == tag:  # an inline end tag doesn't close blocks
                    close(tag)
            elif open_[tag] or tag == "p":
                flush()
                if open_[tag]:
                    close(tag)
            continue
        if tag in _RAW:
            if tag != "svg" and tag != "math":
                flush()
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html_text, at)
                at = end.end() if end else len(html_text)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            flush()
            if open_["p"]:
                close("p")
            closes = _CLOSED_BY.get(tag)
            if closes and any(open_[c] for c in closes):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in _HOLDS_ITEMS:
                        break
                    if stack[i].tag in closes:
                        while len(stack) > i:
                            pop()
                        break
        if tag in _VOID:
            continue
        step, is_never, is_part, is_main = _kind(tag, m[3], mains > 0)
        above = stack[-1].node if stack else 0
        inline = tag in _INLINE
        stack.append(_Element(tag, above if inline else page.child(above, step), is_never, is_part and not inline, is_main, len(page.texts)))
        open_[tag] += 1
        never += is_never
        mains += is_main
    if at < len(html_text):
        add(_UNENDED.split(html_text[at:], maxsplit=1)[0])
    flush()
    while stack:
        pop()
    return page


def _held(ranges: list[tuple[int, int]], n: int) -> list[int]:
    """How many of the ranges hold each of n blocks."""
    change = [0] * (n + 1)
    for a, b in ranges:
        change[a] += 1
        change[b] -= 1
    return list(accumulate(change))[:n]


def ratio(length: int, marks: int, blocks_: int) -> float:
    """Text a block, weighted by the punctuation a block."""
    return length / blocks_ * (1 + math.log1p(marks / blocks_)) if blocks_ else 0.0


def path_ratios(page: Page, among: list[int]) -> list[float]:
    """The ratio of each tag path: of the text outside links and the punctuation of the blocks on it and below it."""
    n = len(page.parent)
    length, marks, count = [0] * n, [0] * n, [0] * n
    for i in among:
        node = page.node[i]
        length[node] += len(page.texts[i]) - page.linked[i]
        marks[node] += len(_PUNCTUATION.findall(page.texts[i]))
        count[node] += 1
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        length[up] += length[node]
        marks[up] += marks[node]
        count[up] += count[node]
    return [ratio(*x) for x in zip(length, marks, count, strict=True)]


def main_blocks(page: Page, threshold: float = 0.25) -> list[int]:
    """The blocks whose tag paths hold the page's text, by number.

    1. Text outside links, punctuation and blocks are summed by root-to-leaf path,
       and so for each of its beginnings. A path's ratio is text a block, weighted
       by punctuation a block.
    2. The ratios of neighbouring blocks are smoothed in page order, and fused with
       the ratio of the path's parent by their geometric mean. In parts that seldom
       are main text they weigh PART_WEIGHT; an element that holds more than
       WRAPPER of the page's text is no such part, whatever its name.
    3. Blocks over ``threshold`` of the length-weighted mean, and not mostly links,
       are content. As the mean is relative, a page all of whose text is in such
       parts keeps it. The deepest path that holds nine tenths of the content is
       its container: other blocks in it join, from elements of text or from
       branches that hold content, if they are no links and in no part.
    If the page marks articles or main parts that hold half of its text, only
    blocks in them are considered.
    """
    n = len(page.texts)
    own_length = [len(t) - k for t, k in zip(page.texts, page.linked, strict=True)]
    before = list(accumulate(own_length, initial=0))
    total = before[-1]
    parts = [(a, b) for a, b in page.parts if before[b] - before[a] <= WRAPPER * total]
    weight = [PART_WEIGHT if h else 1.0 for h in _held(parts, n)]
    in_main = _held(page.mains, n)
    among = [i for i in range(n) if in_main[i]]
    if not among or 2 * sum(own_length[i] for i in among) < sum(k for k, w in zip(own_length, weight, strict=True) if w == 1):
        among = list(range(n))
    if len(among) < 2:
        return among
    ratios = path_ratios(page, among)
    own = [ratios[page.node[i]] for i in among]
    smooth = [0.25 * own[max(j - 1, 0)] + 0.5 * own[j] + 0.25 * own[min(j + 1, len(own) - 1)] for j in range(len(own))]
    fused = [weight[i] * math.sqrt(s * ratios[max(page.parent[page.node[i]], 0)]) for s, i in zip(smooth, among, strict=True)]
    size = [len(page.texts[i]) for i in among]
    least = threshold * sum(f * k for f, k in zip(fused, size, strict=True)) / sum(size)
    plain = {i for i in among if 2 * page.linked[i] <= len(page.texts[i])}
    chosen = {i for i, f in zip(among, fused, strict=True) if f >= least and i in plain}
    inside = [0] * len(page.parent)
    for i in chosen:
        inside[page.node[i]] += len(page.texts[i])
    for node in range(len(inside) - 1, 0, -1):
        inside[page.parent[node]] += inside[node]
    home = max((node for node, k in enumerate(inside) if 10 * k >= 9 * inside[0]), default=0)
    while home and page.step[home].split(".")[0] in _TEXT_TAGS:
        home = page.parent[home]
    # The branch below the container that each path is on; -1: none.
    branch = [-1] * len(page.parent)
    for node in range(1, len(branch)):
        branch[node] = node if page.parent[node] == home else branch[page.parent[node]]

    def joins(i: int) -> bool:
        at = page.node[i]
        if i not in plain or weight[i] < 1:
            return False
        return at == home or branch[at] >= 0 and (page.step[branch[at]].split(".")[0] in _TEXT_TAGS or inside[branch[at]] > 0)

    return [i for i in among if i in chosen or joins(i)]


def main_text(html_text: str) -> str:
    page = parse(html_text)
    return "\n".join(page.texts[i] for i in main_blocks(page))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    A null or empty page has the empty text. Scripts, styles, markup, menus by tag,
    fields of forms and hidden elements are no text; of the rest the tag-path
    ratios decide (see ``main_blocks``), in which headers, footers, sidebars,
    notices, adverts, forms and reader comments weigh less. Character references are decoded, white
    space in a block (line breaks too) is one space, blocks are joined by ``\\n``.
    Rows that repeat an id stay; other columns are ignored; an empty table gives
    an empty result. Each row alone, no shuffle; time is linear in the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [main_text(p) for p in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).transform(in_batches, run, "page_id long, url string, text string, n_chars long")
