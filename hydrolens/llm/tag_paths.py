"""Main text of web pages by tag-path ratios.

Every text of a page hangs on a path of tags from the root. Texts of one path are
added up: characters and marks of punctuation per text. Both ratios are fused, spread
over the neighbours in page order (smoothed), and paths above the threshold, a part of
the standard deviation, are content. Menus share a path with many short texts, so
their ratio is low; paragraphs have a high one.

Paths through elements that say what they are (menus, headers, footers, sidebars,
notices, adverts, forms, comments; by tag, role, class or id) take no part. A class or id
may tell of a layout only (``page-header-fixed``), so what it marks does take part if it
holds ``main``, articles that are half of the content, or most of the content around it
(what is named as comments only if it holds all); names like ``no-sidebar`` mark nothing.
``main``, and articles that are most of the page, take part within other boilerplate too. The
content's containers are the articles and ``main`` that hold content paths (of several in
one article or ``main`` what is around them all), or else the deepest element around the
surest content (by a higher threshold) and the articles there are. Of the texts in them that
aren't set apart so, those on content paths are returned, and paragraphs and headings, short
ones too. Where an article or ``main`` holds content, nothing outside them is. A paragraph
whose class is all of such words (``cookie-notice``) is set apart as well.

A block is what stands between the borders of block elements. In a block, white space
(a ``br`` too) becomes one space.

Defined cases: a null or empty page has an empty text; broken markup is read leniently
(unclosed elements end with their parent or where the next of their kind begins), and any
page, however long and broken, in time in proportion to its length; equal ratios are equally content; rows are independent, so repeated rows get equal results and
null ids and urls pass through; an empty table gives an empty table. Results have the
columns named here only, so extra columns can't clash.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img br".split()
)
BOILERPLATE_TAGS = set("nav header footer aside form menu dialog button fieldset head".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login comment comments respond reply replies disqus "
    "related recommended share sharing social widget widgets pagination pager toolbar copyright".split()
)
COMMENT_WORDS = set("comment comments respond reply replies disqus".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = {"article", "main"}
#: Elements that another of the named kinds ends.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
ENDING = set().union(*ENDED_BY.values())
LISTS = {"ul", "ol", "dl", "table", "select"}

THRESHOLD = 0.5  # of the standard deviation of the smoothed ratios
CORE = 2.0  # the same, for texts that tell where the content is if no element does
KERNEL = (0.25, 0.5, 0.25)
MOST = 0.7  # of the content around it that shows an element to be a layout

PUNCTUATION = set(string.punctuation) | set("。，、；：？！…–—«»“”„‘’¿¡")
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|(?P<closed><svg\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>)"
    r"|<(?P<raw>script|style|template|noscript|iframe|textarea|select|svg|title|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*|/)?)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*)(?P<rest2>[^>]*)>",
    re.IGNORECASE | re.DOTALL,
)


def tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and raw elements in order, in linear time: a tag is looked for only
    where one may begin and only while a ``>`` lies ahead."""
    last, at = page.rfind(">"), page.find("<")
    while at >= 0:
        if at < last or page.startswith(("<!--", "<![CDATA["), at):
            if token := _TOKEN.match(page, at):
                yield token
                at = page.find("<", token.end())
                continue
        elif at > last and (at := page.find("<!", at)) >= 0 and not page.startswith(("<!--", "<![CDATA["), at):
            at += 1
            continue
        elif at >= 0:
            continue
        at = page.find("<", at + 1) if at >= 0 else at


_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.IGNORECASE)
_LAYOUT = re.compile(r"(?:no|has|with|without|hide|show)[^a-z]")  # begins names that tell what else a page has
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|display\s*:\s*none", re.IGNORECASE)


class Element:
    """An element with what its tags' path from the root says."""

    def __init__(self, name: str, above: Element | None, path: int, rest: str = ""):
        self.name, self.above, self.path = name, above, path
        self.hidden = bool(above and above.hidden or rest and name not in ("html", "body") and _HIDDEN.search(rest))
        self.said = self.hidden or _said(name, rest)  # boilerplate by itself
        self.mark = _mark(name, rest)
        self.apart = False  # boilerplate, or within it
        self.depth = above.depth + 1 if above else 0
        self.inside = self if name in CONTAINERS else above.inside if above else None
        # Of articles in articles the outermost counts.
        self.outer = above.outer if above and above.outer and above.outer.name == "article" else self.inside
        # Itself or the nearest above: a block element, and one that a like one or a list ends.
        self.block = above.block if above and name in INLINE else self
        self.ended = self if name in ENDED_BY or name in LISTS else above.ended if above else None
        self.chosen = False


@dataclass
class Text:
    element: Element
    block: int
    text: str
    score: float = field(default=0.0)
    ratio: float = field(default=0.0)  # its path's own, not smoothed


def _words(value: str) -> list[str]:
    return re.split(r"[^a-z]+", value.strip("\"'").lower())


def _said(name: str, rest: str) -> bool:
    """Whether the element's tag or role says that it is boilerplate."""
    if name in BOILERPLATE_TAGS:
        return True
    if not rest or name in ("html", "body"):
        return False
    roles = (_words(value) for key, value in _ATTRIBUTE.findall(rest) if key.lower() == "role")
    return any(BOILERPLATE_ROLES.intersection(words) for words in roles)


def _mark(name: str, rest: str) -> str:
    """What the element's class or id says: ``part`` of a name is a word of boilerplate, a
    whole ``name`` is, or one for ``comments``; or nothing."""
    if not rest or name in ("html", "body"):
        return ""
    mark = ""
    for key, value in _ATTRIBUTE.findall(rest):
        if key.lower() == "role":
            continue
        names = [own for own in value.strip("\"'").lower().split() if not _LAYOUT.match(own)]
        words = BOILERPLATE_WORDS.intersection(_words(" ".join(names)))
        if name in HEADINGS | {"p"} and any(BOILERPLATE_WORDS.issuperset(_words(own)) for own in names):
            return "name"  # all of a class names boilerplate
        if not words or name in CONTAINERS | HEADINGS | {"p"} and not {"comment", "comments"} & words:
            continue
        whole = words.intersection(names)
        if whole & COMMENT_WORDS:
            return "comments"
        mark = "name" if whole else mark or "part"
    return mark


def _within(element: Element | None, names: set[str]) -> Element | None:
    while element is not None and element.name not in names:
        element = element.above
    return element


def texts(page: str) -> tuple[list[Text], list[Element]]:
    """The page's texts with their blocks, and its elements, in order."""
    here = root = Element("", None, 0)
    elements, paths = [root], {}
    found: list[Text] = []
    block = at = 0
    # How many elements of a name are open, inline ones by the block element around them.
    opened: Counter[tuple[Element | None, str]] = Counter()

    def scope(e: Element) -> tuple[Element | None, str]:
        return (e.block if e.name in INLINE else None, e.name)

    def close(to: Element) -> Element:
        """Closes all up to ``to``, and it; each element is closed once."""
        one = here
        while one is not to.above:
            opened[scope(one)] -= 1
            one = one.above
        return one or root

    def take(end: int) -> None:
        if end > at:
            found.append(Text(here, block, html.unescape(page[at:end]) if "&" in page[at:end] else page[at:end]))

    for token in tokens(page):
        take(token.start())
        at = token.end()
        name = token["name"] or token["name2"]
        if not name:
            block += bool(token["closed"] or token["raw"] and token["raw"].lower() not in ("script", "style", "template"))
            continue
        name, rest = name.lower(), token["rest"] or token["rest2"] or ""
        if name == "br":
            found.append(Text(here, block, " "))
            continue
        block += name not in INLINE
        if token["end"] or token["end2"]:
            # Nothing but inline elements may lie between an inline end tag and its element.
            if opened[(here.block if name in INLINE else None, name)]:
                here = close(_within(here, {name}))
            continue
        if name in VOID:
            continue
        if name not in INLINE:  # a paragraph ends where a block begins
            around = here.block
            if around.name == "p" or around.name in HEADINGS and name in HEADINGS:
                here = close(around)
        if name in ENDING:
            same = here.ended
            if same is not None and name in ENDED_BY.get(same.name, ()):
                here = close(same)
        if not rest.rstrip().endswith("/") or name not in INLINE:
            path = paths.setdefault((here.path, name), len(paths) + 1)
            here = Element(name, here, path, rest)
            opened[scope(here)] += 1
            elements.append(here)
    take(len(page))
    _set_apart(found, elements)
    return found, elements


def _spread(elements: list[Element], spared: set[Element], reset: set[Element]) -> None:
    """Sets apart what says that it is boilerplate, and all in it."""
    for e in elements[1:]:  # parents come first
        if e.above.apart and e not in reset:
            e.apart = not (e.name in HEADINGS and e.above.name == "header" and e.above.inside)
        else:
            e.apart = e.said or bool(e.mark) and e not in spared


def _content(found: list[Text], elements: list[Element], every: bool = False) -> dict[Element, int]:
    """Characters of content in each element, or of all texts that take part."""
    nodes, threshold = scored(found)
    chars = dict.fromkeys(elements, 0)
    for node in nodes:
        if every or node.score >= threshold:
            chars[node.element] += len(node.text.strip())
    for e in reversed(elements[1:]):
        chars[e.above] += chars[e]
    return chars


def _below(elements: list[Element], tops: set[Element]) -> set[Element]:
    """These elements and all that lie in them."""
    below: set[Element] = set()
    for e in elements:
        if e in tops or e.above in below:
            below.add(e)
    return below


def _set_apart(found: list[Text], elements: list[Element]) -> None:
    """Sets boilerplate apart, but not what is only laid around the content."""
    root, marked, reset = elements[0], {e for e in elements if e.mark}, set()
    _spread(elements, marked, reset)
    lost = {e for e in elements if e.name in CONTAINERS and e.apart and not e.hidden and not e.said and e.mark != "comments"}
    if lost:  # articles in a form, an aside and the like
        below = _below(elements, lost)
        inner = sum(len(node.text.strip()) for node in found if node.element in below)
        outer = sum(len(node.text.strip()) for node in found if node.element not in below and not node.element.apart)
        reset = {e for e in lost if e.name == "main" or inner >= MOST * (inner + outer)}
        _spread(elements, marked, reset)
    marked = {e for e in marked if not e.apart}
    if not marked:
        return

    chars = _content(found, elements)
    every = _content(found, elements, every=True) if any(e.mark == "comments" for e in marked) else {}
    below = _below(elements, marked)
    containers = [e for e in elements if e.name in CONTAINERS and chars[e]]
    plain = any(e not in below for e in containers)
    held = {e for e in containers if e in below and e.mark != "comments" and (e.outer is e or e.outer.name == "main")}
    inside = _below(elements, held)
    much = 2 * sum(chars[e] for e in held if e.above not in inside) >= chars[root]
    around: set[Element] = set()  # what holds articles
    for e in held:
        if e.name == "main" or much:
            while e is not None and e not in around:
                around.add(e)
                e = e.above

    def laid_around(e: Element) -> bool:
        if e.mark != "comments" and e in around:
            return True
        scope = e.above.outer
        if not chars[e] or scope is None and plain:
            return False
        if e.mark == "comments":
            return every[e] == every[scope or root]
        return chars[e] >= MOST * chars[scope or root]

    parts = {e for e in marked if e.mark == "part"}
    spared = {e for e in marked - parts if laid_around(e)}
    _spread(elements, spared | parts, reset)
    chars = _content(found, elements)  # without what is surely boilerplate
    _spread(elements, spared | {e for e in parts if laid_around(e)}, reset)
    if not any(node.text.strip() for node in found if not node.element.apart):  # several hold the content
        _spread(elements, spared | parts, reset)


def scored(page: list[Text]) -> tuple[list[Text], float]:
    """Texts that take part with their smoothed score, and the threshold."""
    nodes = [node for node in page if not node.element.apart and node.text.strip()]
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for node in nodes:
        total = sums[node.element.path]
        total[0] += 1
        total[1] += len(node.text.strip())
        total[2] += sum(map(PUNCTUATION.__contains__, node.text))
    fused = {path: chars / n * (1 + marks / n) for path, (n, chars, marks) in sums.items()}
    raw = [fused[node.element.path] for node in nodes]
    for i, node in enumerate(nodes):
        around = raw[i - 1] if i else raw[i], raw[i], raw[i + 1] if i + 1 < len(raw) else raw[i]
        node.ratio = raw[i]
        node.score = sum(weight * value for weight, value in zip(KERNEL, around))
    return nodes, THRESHOLD * pstdev([node.score for node in nodes]) if nodes else 0.0


def _around(given: list[Element], elements: list[Element]) -> Element:
    """The deepest element that holds all of these."""
    held = dict.fromkeys(elements, 0)
    for e in set(given):
        held[e] = 1
    for e in reversed(elements[1:]):  # parents come first
        held[e.above] += held[e]
    return max((e for e in elements if held[e] == held[elements[0]]), key=lambda e: e.depth)


def containers(content: list[Text], nodes: list[Text], threshold: float, elements: list[Element]) -> list[Element]:
    """The elements to return the texts of."""
    marked = list(dict.fromkeys(node.element.outer for node in content if node.element.outer))
    if marked:
        common = _around(marked, elements)
        return [common] if common.inside else marked
    # Short articles beside long other texts count too.
    given = [node.element for node in nodes if node.element.outer and node.element.outer.name == "article"]
    # What is little above the threshold, or lifted by its neighbours, doesn't widen the container.
    core = threshold * CORE / THRESHOLD
    surest = [node for node in content if node.score >= core] or content
    given += [node.element for node in surest if node.ratio >= core] or [node.element for node in surest]
    if not given:
        return []
    common = _around(given, elements)
    while common.above and common.name in INLINE | HEADINGS | {"p"}:
        common = common.above
    return [common]


def main_text(page: str | None) -> str:
    found, elements = texts(page or "")
    nodes, threshold = scored(found)
    content = [node for node in nodes if node.score >= threshold]
    chosen = containers(content, nodes, threshold, elements)
    for element in elements:  # parents come first
        element.chosen = element in chosen or bool(element.above and element.above.chosen)
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0])
    for node in nodes:  # a path counts by all its texts, so that a neighbour lifts none alone
        sums[node.element.path][0] += node.score
        sums[node.element.path][1] += 1
    paths = {path for path, (total, n) in sums.items() if total >= n * threshold}
    blocks: dict[int, list[Text]] = {}
    for node in found:
        if node.element.chosen and not node.element.apart:
            blocks.setdefault(node.block, []).append(node)
    # A block is content if a text of it lies on a content path, or if it is a heading or paragraph.
    named = HEADINGS | {"p"}
    kept = (part for part in blocks.values() if any(n.element.path in paths or n.element.block.name in named for n in part))
    lines = (" ".join("".join(node.text for node in part).split()) for part in kept)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars``, its code points, for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    columns = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
