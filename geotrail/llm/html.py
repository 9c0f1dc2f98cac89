"""Main text of web pages by tag-path ratios.

Text is grouped by its root-to-leaf tag path, the paths of different containers (div, section, td ...) being different
paths.  A path's text length outside links and its punctuation, a node each, are

1. smoothed over near paths: those of the same container, of the one around it and of those directly inside, by
   the length of their text,
2. fused by their product, with the share of text that isn't linked, and what tags and names say of the path, as factors (``ASSERTED`` inside an article or main
   element, ``WEAK`` and ``STRONG`` for names of something else),
3. held against a threshold: the paths above ``LEAST`` of the page's greatest score are content.

Content paths select their blocks.  Blocks of other paths belong to the article only with them: where they stand in
the smallest element around all content (the article or main element, if one is around it) and nothing names them something
else, or, if that is the body, between the first and the last content.  Of several article elements side by side all that nothing
names something else belong to it.  Tags, roles and states (menus, headers, footers, asides, forms, dialogs, what is
hidden) only veto.

A name counts as a whole word of a class or id, as it is or with a usual companion (``comment-list``, ``site-footer``).
It says nothing of an element with most of the page's text outside links, unless it names
reader comments or an article or main element beside it has text, nor when no other text is left.

Defined cases: a null or empty page, or one without text or with links only, gives an empty text; broken markup is read as
browsers do (tags end with their parents, a paragraph with the next block); paths that tie share their fate; equal rows give equal
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.grams import parts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|object|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Tags that end an open paragraph, and the tags that end at a sibling.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BOUNDS = frozenset("ul ol dl table article section div main body td th".split())
CONTAINERS = frozenset("article section div main body td th blockquote details figure".split())
OTHER_TAGS = frozenset("nav header footer aside form button menu dialog fieldset head".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Names of something else than the article: surely, and perhaps (fixed values).
STRONG_NAMES = (
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead "
    "comment comments commentlist disqus replies respond cookie cookies consent gdpr popup modal overlay signup login toolbar pagination pager"
)
WEAK_NAMES = "banner promo promotion notice alert newsletter subscribe share sharing social related recommended widget"
_WITH = r"(?:(?:site|page|top|bottom|left|right|main|global|primary|secondary|reader|user)-)?(?:{})(?:-(?:list|area|section|box|bar|wrapper|container|block|banner|slot|unit|form|links|buttons|thread|notice|message{}))?"


def _named(words: str, more: str = "") -> re.Pattern[str]:
    return re.compile(rf"(?:^|\s){_WITH.format('|'.join(words.split()), more)}(?=$|\s)", re.I)


STRONG, WEAK, COMMENT_NAMES = _named(STRONG_NAMES), _named(WEAK_NAMES), _named("comment comments commentlist disqus replies respond reply", "|body|text|content|item|entry|author|meta")
#: Names that inside an article are its title's.
TITLE_NAMES = _named("header masthead")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAMES = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[,.;:!?、。，！？…]")
#: Share of the greatest score from which a path is content; weights of near paths: of the same container, and around or inside.
LEAST, SAME, NEAR = 0.1, 0.25, 0.05
#: Factors of a score: inside an article or main element, weakly and strongly named something else.
ASSERTED, IF_WEAK, IF_STRONG = 4.0, 0.3, 1e-4
#: What an element is told to be: other by tag, role or state; by a weak name, by a strong one, reader comments.
OTHER, MAYBE, NAMED, COMMENTS = 1, 2, 3, 4


class Node:
    """An element; ``other`` holds for all inside, ``marked`` is the nearest element around that a name marks."""

    __slots__ = ("tag", "parent", "path", "other", "kind", "marked", "link", "container")

    def __init__(self, tag: str, parent: Node | None, kind: int):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.other = kind == OTHER or bool(parent and parent.other)
        self.marked = self if kind in (MAYBE, NAMED, COMMENTS) else parent and parent.marked
        self.container = self if tag in CONTAINERS or not parent else parent.container
        #: Tags below the container; the container itself stands for those above.
        self.path = "" if self.container is self else f"{parent.path}.{tag}"
        self.link = tag == "a" or bool(parent and parent.link)


def _kind(tag: str, attributes: str, open_tags: list[str]) -> int:
    """What an element is by its tag and attributes; a main element can only be hidden, of another role, or a reader's comment."""
    inside = "article" in open_tags or "main" in open_tags
    if tag in OTHER_TAGS:
        return 0 if tag == "header" and inside else OTHER
    if not attributes or tag in ("html", "body"):
        return 0
    kind = 0
    for name, *value in NAMES.findall(attributes):
        name, value = name.lower(), "".join(value)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in OTHER_ROLES) or (name == "style" and HIDDEN.search(value)):
            return OTHER
        if name in ("class", "id"):
            value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).replace("_", "-")
            value = TITLE_NAMES.sub(" ", value) if inside else value
            said = COMMENTS if COMMENT_NAMES.search(value) else 0
            kind = max(kind, said or (0 if tag == "main" else NAMED if STRONG.search(value) else MAYBE if WEAK.search(value) else 0))
    return kind


def _up(node: Node | None, tags: tuple[str, ...]) -> list[Node]:
    """The element itself and those around it that have one of the tags, inner ones first."""
    out = []
    while node:
        if node.tag in tags:
            out.append(node)
        node = node.parent
    return out


def _marks(told: list[tuple[Node, list[tuple[Node, str]]]]) -> set[Node]:
    """Elements whose names hold: not those with most of the text outside links and no article beside them, and none if nothing is left."""
    held: dict[Node, int] = defaultdict(int)
    whole, articles = 0, set()
    for _, parts in told:
        for node, text in parts:
            if not node.other:
                size = 0 if node.link else len(text.strip())
                whole += size
                if size and not node.marked:
                    articles |= set(_up(node, ("article", "main"))[:1])
                at = node.marked
                while at:
                    held[at] += size
                    at = at.parent and at.parent.marked
    marks = {n for n, size in held.items() if n.kind == COMMENTS or 2 * size <= whole or not articles <= set(_up(n, ("article", "main")))}
    left = any(text.strip() and not node.link and not _is_other(node, marks) for _, parts in told for node, text in parts)
    return marks if left or not whole else set()


def _is_other(node: Node, marks: set[Node]) -> bool:
    return node.other or _mark(node, marks) > 0


def _mark(node: Node, marks: set[Node]) -> int:
    """The strongest name that holds for an element: MAYBE, NAMED, COMMENTS or 0."""
    kind, at = 0, node.marked
    while at:
        if at in marks:
            kind = max(kind, at.kind)
        at = at.parent and at.parent.marked
    return kind


def blocks(page: str) -> list[tuple[Node, list[tuple[Node, str]]]]:
    """A page's blocks in order, each with its element and its text nodes."""
    stack, out, told = [Node("html", None, 0)], [], []

    def end_block() -> None:
        nonlocal told
        if told:
            owner = told[0][0]
            while owner.tag in INLINE and owner.parent:
                owner = owner.parent
            out.append((owner, told))
            told = []

    def close(upto: int) -> None:
        if any(n.tag not in INLINE for n in stack[upto:]):
            end_block()
        del stack[upto:]

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            told.append((stack[-1], page[at : m.start()]))
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                told.append((stack[-1], m[0][9:].removesuffix("]]>")))
            elif m[1] and m[1].lower() in ("select", "textarea", "object"):
                told.append((stack[-1], " "))
            continue
        if m[2]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k and not (tag in INLINE and any(n.tag not in INLINE for n in stack[k + 1 :])):
                close(k)
            elif tag == "p":
                end_block()
            continue
        if tag == "br":
            told.append((stack[-1], " "))
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag not in INLINE:
            ends = SIBLINGS.get(tag, set()) | ({"p"} if tag not in VOID or tag == "hr" else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in BOUNDS and stack[k].tag not in ends:
                    break
            if tag not in VOID or tag == "hr":
                end_block()
        if tag in VOID or m[4].endswith("/") and tag not in ("p", "div", "a", "span", "li"):
            continue
        stack.append(Node(tag, stack[-1], _kind(tag, m[4], [n.tag for n in stack])))
    if at < len(page):
        told.append((stack[-1], page[at:]))
    end_block()
    return out


Key = tuple[Node, str]


def path_scores(texts: list[tuple[Key, int, int, float]]) -> dict[Key, float]:
    """Fused, smoothed ratios by path, of text nodes (path, length, punctuation, factor)."""
    total: dict[Key, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, length, points, factor in texts:
        told = total[path]
        for k, x in enumerate((1, length, points, factor)):
            told[k] += x
    # of each container, and of the containers directly inside: text length, and length times either ratio
    own: dict[Node | None, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    inside: dict[Node | None, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    part = {}
    for path, (n, length, points, _) in total.items():
        part[path] = (length, length * length / n, length * (1 + points / n))
        up = path[0].parent and path[0].parent.container
        for sums in (own[path[0]], inside[up]):
            for k, x in enumerate(part[path]):
                sums[k] += x
    out = {}
    for path, (n, _, _, factor) in total.items():
        at, up = path[0], path[0].parent and path[0].parent.container
        around = own[up] if up else (0.0, 0.0, 0.0)
        near = zip(part[path], own[at], inside[at], around, strict=True)
        weight, length, points = (x + SAME * (same - x) + NEAR * (below + above) for x, same, below, above in near)
        out[path] = length * points / (weight * weight) * factor / n if weight > 0 else 0.0
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    told, found = [], blocks(page or "")
    marks = _marks(found)
    for owner, parts in found:
        parts = [(n, s) for n, s in parts if not n.other]
        said = _mark(owner, marks)
        # what is named something else inside a block of another kind goes
        parts = [(n, s) for n, s in parts if _mark(n, marks) <= said]
        text = " ".join(html.unescape("".join(s for _, s in parts)).split())
        if text:
            linked = sum(len(s.strip()) for n, s in parts if n.link)
            told.append((owner, parts, text, linked / max(1, sum(len(s.strip()) for _, s in parts)), said))
    texts = []
    for owner, parts, text, share, said in told:
        leaf = max(parts, key=lambda x: len(x[1]))[0]
        asserted = len(_up(owner, ("article", "main"))) > 0
        factor = (ASSERTED if asserted else 1.0) * (IF_STRONG if said >= NAMED else IF_WEAK if said else 1.0)
        texts.append(((leaf.container, leaf.path), round(len(text) * (1 - share)), len(PUNCTUATION.findall(text)), factor * (1 - share)))
    score = path_scores(texts)
    least = LEAST * max(score.values(), default=0.0)
    content = [k for k, (path, *_) in enumerate(texts) if score[path] >= least > 0]
    if not content:
        return ""
    inside: dict[Node, int] = defaultdict(int)
    for k in content:
        node = told[k][0]
        while node:
            inside[node] += 1
            node = node.parent
    article = told[content[0]][0]
    while article.parent and (inside[article] < len(content) or article.tag not in BOUNDS):
        article = article.parent
    article = next(iter((_up(article, ("article",)) or _up(article, ("main",)))[-1:]), article)
    first, last = (content[0], content[-1]) if article.tag in ("html", "body") else (0, len(told))
    while first and first == content[0] and article.tag in ("html", "body") and told[first - 1][0].tag in HEADINGS:
        first -= 1
        content.insert(0, first)
    chosen = set(content)
    out = [text for k, (owner, _, text, _, said) in enumerate(told) if k in chosen or (not said and (first <= k <= last and _within(owner, article) or _beside(owner, article)))]
    return " ".join(out)


def _beside(node: Node, article: Node) -> bool:
    """Whether an element is in an article element that stands beside the article, one of several on a page."""
    return article.tag == "article" and any(x.parent is article.parent for x in _up(node, ("article",)))


def _within(node: Node | None, outer: Node) -> bool:
    while node and node is not outer:
        node = node.parent
    return node is outer


def extract_pages(df: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages in parts(iter([batch]), 2):
                text = pa.array([extract(x.decode("utf-8", "replace")) for x in pages], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], names=["page_id", "url", "text"])

    rows = df.select("page_id", "url", F.col(html_col).cast("string").alias("page"))
    types = dict(rows.dtypes)
    out = rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
