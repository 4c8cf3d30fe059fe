"""Main text of web pages by tag-path ratios.

A page becomes a list of text nodes, one for each run of text between block boundaries, each with its root-to-leaf path of
block tags (and the names of ``div``, ``section`` and ``span``). Per path the text length outside links and the punctuation are
aggregated over its nodes; a path's ratio is the root of their product per node. A node's ratio is its path's, weighted down
where a name around it speaks against it. Node ratios are smoothed over their neighbours in page order and fused with
themselves, and each path gets the mean of its nodes' fused values. Thresholds on these, as shares of the page's mean, decide:

* a path from ``CONTENT_SHARE`` up is content, wherever it is, for choosing the root: the deepest element that holds
  ``ROOT_SHARE`` of the content's text, or an ``article`` or ``main`` element that holds ``ARTICLE_SHARE`` of it;
* in the root, paths that are content stay, and paths of headings, items, cells and short paragraphs (in an article element: all
  paths) from ``INSIDE_SHARE`` up, where content stands beside them; so lists of nothing but links, whose ratio is 0, go;
* outside the root, and in blocks whose names speak against them, only paths from ``OUTSIDE_SHARE`` up stay, and a
  headline shortly before the first text that stays.

Elements that never hold article text (scripts, styles, navigation, footers, asides and the like), forms and hidden ones are
left out before that; a form around most of the page's text is a frame of the page. A block around the headline is one too, whatever
its name. Buttons, drawings and the like do not end the line they stand in, and an inline element's name counts only where its block
holds nothing else, but for adverts, which go from sentences too.

Character references are decoded, white space in a block becomes one space, and blocks are joined by a newline in page order.

Cases: null and empty html, and pages without content, give an empty text. Unclosed and misnested tags close as
browsers close them; an unclosed script hides the rest of the page. Nothing is capped: long and deeply nested pages are read
whole in linear time. Ties cannot arise: a value at a threshold stays, of equally deep roots the first is taken. Repeated rows
and rows with null ids or urls are extracted each. Empty tables give empty results. Columns of the table that are called like the
result's are ignored by ``page_texts`` and kept by ``extract``, whose own get an underscore.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankloom.llm.frames import append_columns, fresh, only

# Element names of HTML and usual names of page parts.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
LEFT_OUT = {
    "head", "script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "nav", "menu", "footer",
    "aside", "button", "select", "option", "dialog", "audio", "video", "noframes", "noembed", "xmp",
}
#: Of these, the ones that stand in a line of text, which goes on after them.
LEFT_OUT_INLINE = {"iframe", "object", "svg", "math", "canvas", "button", "select", "audio", "video"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr",
    "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
VOID_INLINE = {"area", "embed", "img", "input", "link", "meta", "param", "source", "track", "wbr", "base", "col"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
}
P_SCOPE = {"article", "section", "div", "td", "th", "li", "table", "blockquote"} | LEFT_OUT_INLINE
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"ul", "ol", "menu", "dl", "table", "select"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SHORT_BLOCKS = HEADINGS | {"p", "li", "td", "th", "dt", "dd", "pre", "blockquote", "figcaption", "caption", "summary", "address"}
#: Elements that group short blocks; the container of a node is its nearest block of another kind.
GROUPS = SHORT_BLOCKS | {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "hgroup", "details", "header"}
ARTICLE = {"article", "main"}
_ADVERTS = r"ads?|advert\w*|sponsor(?:ed)?|promos?|promotions?"
_PARTS = (
    rf"{_ADVERTS}|comments?|commentlist|replies|respond|disqus|discussions?|feedback|reactions|responses|sidebars?|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"footer|masthead|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|share|sharing|social|pagination|pager|toolbar|popup|modal|banner"
)
_TAILS = r"list|lists|area|section|box|wrap\w*|container|notice|bar|block|widget|form|links?|inner|content|top|bottom|left|right|thread|policy|\d+"
#: Names that speak strongly against a block, and names that speak weakly against it.
AGAINST = re.compile(rf"(?!(?:has|no|with|without|is)[-_])(?:\w+[-_])*?(?:{_PARTS})(?:[-_](?:{_TAILS}))*", re.I)
ADVERT = re.compile(rf"(?:\w+[-_])*?(?:{_ADVERTS})(?:[-_](?:{_TAILS}))*", re.I)
DOUBTFUL = re.compile(rf"(?:{_PARTS}|side|related|recommended|popular|notice|copyright|legal|widget|reply)(?:[-_](?:{_TAILS}|posts?|articles?|stories|items?))*", re.I)

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_MARK = re.compile("[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_ENTRY = re.compile(r"(?:^|[\s_-])(?:entry|post|article|story|content)[_-]", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")

#: A path is content from this share of the page's mean ratio of text characters up.
CONTENT_SHARE = 0.35
#: In the root, paths of short blocks stay from this share up, or from a ratio of ``INSIDE_LEAST`` (one character outside links).
INSIDE_SHARE, INSIDE_LEAST = 0.004, 0.5
#: Outside the content root a path stays only from this share up.
OUTSIDE_SHARE = 0.8
#: Least share of content that the root holds; that an article element must hold to be the root.
ROOT_SHARE, ARTICLE_SHARE = 0.8, 0.2
#: A form that holds this share of the page's text, a headline or a paragraph in it, is the page's frame and not a form to fill in.
FORM_SHARE = 0.5
#: What a name that speaks strongly, or weakly, against a block leaves of its ratios.
STRONGLY, WEAKLY = 0.05, 0.3
#: A headline stays if at most this many nodes lie between it and the first text that stays.
HEADLINE_GAP = 2


@dataclass
class Node:
    """A run of text: its path and element by number, its words, and its characters inside links."""

    path: int
    element: int
    words: str
    linked: int


@dataclass
class Page:
    """Text nodes, the elements (parent, tag) they stand in, and the paths' last steps. Element 0 and path 0 are the page."""

    nodes: list[Node] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    priors: list[float] = field(default_factory=lambda: [1.0])
    steps: dict[tuple[int, str], int] = field(default_factory=dict)


@dataclass
class _Open:
    tag: str
    element: int
    path: int
    out: bool
    link: bool
    inline: bool
    quiet: bool = False
    against: bool = False


class _TagEnds:
    """Where tags end: at the first > outside quotes, or at the first > at all where a quote stays open.

    A search that fails has seen the rest of the page; later ones that start between the quotes it saw would fail alike and are
    not made, so the work stays linear in the page.
    """

    def __init__(self, html: str):
        self.html, self.failed = html, []

    def find(self, at: int) -> int:
        """The place of the >, or -1."""
        for first, opened, closed in self.failed:
            k = bisect_right(opened, at) - 1
            if at >= first and (k < 0 or at > closed[k]):
                return self.html.find(">", at)
        opened, closed, place = [], [], at
        while m := _MARK.search(self.html, place):
            if m[0] == ">":
                return m.start()
            end = self.html.find(m[0], m.end())
            if end < 0:
                break
            opened.append(m.start())
            closed.append(end)
            place = end + 1
        self.failed.append((at, opened, closed))
        return self.html.find(">", at)


def prior_of(named: str) -> float:
    """What the names of a block leave of its ratios."""
    tokens = named.lower().split()
    if any(AGAINST.fullmatch(t) for t in tokens):
        return STRONGLY
    return WEAKLY if any(DOUBTFUL.fullmatch(t) for t in tokens) else 1.0


def parse(html: str) -> Page:
    """The text nodes of a page that no left-out or hidden element holds. Linear in the page, however deep it nests."""
    page = Page()
    stack: list[_Open] = [_Open("", 0, 0, False, False, False)]
    open_: Counter[str] = Counter()
    hidden = links = quiet = doubted = 0
    text: list[str] = []
    linked: list[str] = []
    plain = False  # whether the block has text outside inline elements whose names speak against them

    def flush() -> None:
        nonlocal plain
        if quiet:  # inside an element that stands in a line: the line goes on after it
            return
        if text:
            if not plain:
                text.clear()
            words = " ".join("".join(text).split())
            if words:
                top = stack[-1]
                page.nodes.append(Node(top.path, top.element, words, len(" ".join("".join(linked).split()))))
            text.clear()
            linked.clear()
        plain = False

    def push(tag: str, element: int, path: int, out: bool, link: bool, inline: bool, still: bool = False, against: bool = False) -> None:
        nonlocal hidden, links, quiet, doubted
        stack.append(_Open(tag, element, path, out, link, inline, still, against))
        open_[tag] += 1
        hidden += out
        links += link
        quiet += still
        doubted += against

    def pop() -> None:
        nonlocal hidden, links, quiet, doubted
        top = stack.pop()
        open_[top.tag] -= 1
        hidden -= top.out
        links -= top.link
        quiet -= top.quiet
        doubted -= top.against

    def close(names: set[str], within: set[str], inline: bool = False) -> None:
        if not any(open_[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in within or inline and not stack[k].inline:
                return

    def say(raw: str) -> None:
        nonlocal plain
        if raw and not hidden:
            words = unescape(raw)
            text.append(words)
            plain = plain or not doubted and not words.isspace()
            if links:
                linked.append(words)

    at, end, ends = 0, len(html), _TagEnds(html)
    while at < end:
        m = _START.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        if m[1] or m[2]:
            stop = html.find("-->", m.end()) if m[1] else html.find(">", m.end())
            at = end if stop < 0 else stop + (3 if m[1] else 1)
            continue
        stop = ends.find(m.end())
        if stop < 0:  # no tag ends any more
            say(html[m.start() :].partition("<!--")[0])
            break
        at, tag, closing, attributes = stop + 1, m[4].lower(), m[3], html[m.end() : stop]
        if tag in VOID_INLINE:
            continue
        if tag == "br":
            if not hidden:
                text.append("\n")
            continue
        if tag in INLINE:
            if closing or tag == "a":
                close({tag}, set(), inline=True)
            if not closing:
                named = _names(attributes) if attributes else ""
                against = bool(named) and prior_of(named) == STRONGLY
                unseen = bool(attributes and _UNSEEN.search(attributes)) or against and any(ADVERT.fullmatch(t) for t in named.split())
                push(tag, stack[-1].element, stack[-1].path, unseen, tag == "a" and bool(_HREF.search(attributes)), True, against=against)
            continue
        if tag in LEFT_OUT_INLINE and tag not in RAW:
            if closing and open_[tag]:
                close({tag}, set())
            elif not closing and not attributes.endswith("/"):
                if tag == "button":
                    close({tag}, SCOPE)
                push(tag, stack[-1].element, stack[-1].path, True, False, False, True)
            continue
        if closing:
            if open_[tag]:
                while quiet and not any(o.tag == tag for o in stack[next(k for k, o in enumerate(stack) if o.quiet) :]):
                    pop()  # elements in a line end with its block
                flush()
                close({tag}, set())
            continue
        flush()
        if tag in CLOSES_P:
            close({"p"}, P_SCOPE)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE)
        if tag == "hr" or attributes.endswith("/") and tag not in RAW and tag not in CLOSES_P:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = html.find(">", stop.end()) + 1 or end if stop else end
            continue
        named = _names(attributes) if attributes else ""
        out = tag in LEFT_OUT or (tag == "header" and not any(open_[t] for t in ARTICLE) and not _ENTRY.search(named)) or bool(attributes and _UNSEEN.search(attributes))
        prior = prior_of(named) if named and tag not in ("html", "body", "article", "main") else 1.0
        step = f"{tag}.{named}" if named and (tag in ("div", "section") or prior < 1) else tag
        path = page.steps.setdefault((stack[-1].path, step), len(page.steps) + 1)
        page.parents.append(stack[-1].element)
        page.tags.append(tag)
        page.priors.append(prior)
        if tag in ("h1", "main"):  # a block around the headline is a frame of the page, whatever its name
            above = page.parents[-1]
            while above > 0 and page.priors[above] >= 0:
                page.priors[above] = -1.0  # no name of it counts, and its own frames are known
                above = page.parents[above]
        push(tag, len(page.tags) - 1, path, out, False, False)
    while quiet:
        pop()
    flush()
    page.priors = [1.0 if p < 0 else p for p in page.priors]
    _drop_forms(page)
    return page


def _drop_forms(page: Page) -> None:
    """Leave out what is in forms, but for a form that holds most of the page's text."""
    if "form" not in page.tags:
        return
    form, held = [-1] * len(page.tags), [0] * len(page.tags)
    told = [t in ("h1", "p", *ARTICLE) for t in page.tags]
    for n in page.nodes:
        held[n.element] += len(n.words)
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
        told[page.parents[e]] |= told[e]
    for e in range(1, len(held)):  # parents come first
        above = form[page.parents[e]]
        own = page.tags[e] == "form" and not (told[e] and held[e] >= FORM_SHARE * held[0])
        form[e] = e if own else above
    page.nodes = [n for n in page.nodes if form[n.element] < 0]


def _names(attributes: str) -> str:
    return " ".join(x.strip("\"'") for x in _NAMED.findall(attributes))


def path_ratios(nodes: list[Node]) -> dict[int, float]:
    """Root of (characters outside links per node) times (one and punctuation marks per node), of each path."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        length[n.path] += len(n.words) - min(n.linked, len(n.words))
        marks[n.path] += len(_PUNCTUATION.findall(n.words))
        count[n.path] += 1
    return {p: (length[p] / count[p] * (1 + marks[p] / count[p])) ** 0.5 for p in count}


def smoothed(values: list[float]) -> list[float]:
    """Weighted means of neighbours (1, 2, 1); the ends count themselves again."""
    last = len(values) - 1
    return [(values[max(k - 1, 0)] + 2 * values[k] + values[min(k + 1, last)]) / 4 for k in range(len(values))]


def select_content(page: Page) -> list[str]:
    """Texts of the nodes that are content, in page order."""
    nodes, parents, tags = page.nodes, page.parents, page.tags
    if not nodes:
        return []
    weight, strong, container = [1.0] * len(tags), [-1] * len(tags), list(range(len(tags)))
    for e in range(1, len(tags)):  # parents come first
        weight[e] = min(weight[parents[e]], page.priors[e])
        strong[e] = e if page.priors[e] == STRONGLY else strong[parents[e]]  # nearest block that its name speaks strongly against
        container[e] = container[parents[e]] if tags[e] in GROUPS else e
    ratio = path_ratios(nodes)
    own = [ratio[n.path] * weight[n.element] for n in nodes]
    fused: dict[int, float] = defaultdict(float)
    times = Counter(n.path for n in nodes)
    for n, a, b in zip(nodes, own, smoothed(own), strict=True):
        fused[n.path] += (a * b) ** 0.5 / times[n.path]
    chars = [(len(n.words) - min(n.linked, len(n.words))) * weight[n.element] for n in nodes]
    total = sum(chars)
    mean = sum(fused[n.path] * c for n, c in zip(nodes, chars, strict=True)) / total if total else 0.0
    if not mean:
        return []
    content = [fused[n.path] >= CONTENT_SHARE * mean for n in nodes]
    roots, named = content_roots(page, [c if keep else 0.0 for c, keep in zip(chars, content, strict=True)])
    root = [-1] * len(tags)
    for e in range(len(tags)):
        root[e] = e if e in roots else root[parents[e]] if e else -1
    beside = {container[n.element] for n, is_content in zip(nodes, content, strict=True) if is_content}
    least = min(INSIDE_SHARE * mean, INSIDE_LEAST)
    kept = []
    for n, is_content in zip(nodes, content, strict=True):
        e, value = n.element, fused[n.path]
        if root[e] >= 0 and strong[e] == strong[root[e]]:
            short = named or tags[e] in SHORT_BLOCKS and container[e] in beside
            kept.append(is_content or short and value >= least)
        else:
            kept.append(value >= OUTSIDE_SHARE * mean)
    first = kept.index(True) if any(kept) else len(nodes)
    if first < len(nodes) and not any(tags[n.element] == "h1" for n, keep in zip(nodes, kept, strict=True) if keep):
        for k in range(first - 1, max(first - 2 - HEADLINE_GAP, -1), -1):
            if tags[nodes[k].element] == "h1" and weight[nodes[k].element] == 1 and nodes[k].linked < len(nodes[k].words):
                kept[k] = True
                break
    return [n.words for n, keep in zip(nodes, kept, strict=True) if keep]


def content_roots(page: Page, chars: list[float]) -> tuple[set[int], bool]:
    """The elements that hold the content, and whether they are article elements; ``chars`` are content characters of nodes.

    Article elements side by side that all hold enough are parts of one article; any other root is one element.
    """
    held, depth = [0.0] * len(page.tags), [0] * len(page.tags)
    for n, c in zip(page.nodes, chars, strict=True):
        held[n.element] += c
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    for e in range(1, len(held)):
        depth[e] = depth[page.parents[e]] + 1
    articles = [e for e in range(len(held)) if page.tags[e] in ARTICLE and held[e] >= ARTICLE_SHARE * held[0] and held[e] > 0]
    if articles:
        most = max(articles, key=lambda e: (held[e], depth[e], -e))
        return {e for e in articles if page.parents[e] == page.parents[most]}, True
    roots = [e for e in range(len(held)) if held[e] >= ROOT_SHARE * held[0] and (page.tags[e] not in GROUPS or page.tags[e] == "td")]
    return {max(roots, key=lambda e: (depth[e], -e))}, False


def main_text(html: str | None) -> str:
    return "\n".join(select_content(parse(html or "")))


def extract(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """``pages`` with text and n_chars, and the names these columns got."""
    names = fresh(pages, "text", "n_chars")

    def compute(lists: Iterator[list]) -> Iterator[list[pa.Array]]:
        for pages_html in lists:
            texts = [main_text(h) for h in pages_html]
            yield [pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string()), pa.array(map(len, texts), pa.int64())]

    return append_columns(pages, "html", [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())], compute), names


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extract(only(pages, "page_id", "url", "html"))[0].drop("html")
