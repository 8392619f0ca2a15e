"""Main text of web pages by line-block distribution.

Markup is stripped into blocks (lines), one for each run of text between
block-level tags. Every line weighs the length of its text outside links; text
of menus, headers, footers, sidebars, notices, adverts, forms and comments
weighs nothing. The sum of weights over a sliding window of lines surges where
the main text begins and dives to nothing where it ends; the text between is
kept, the stretch of most text first. If a page marks articles, the largest of
them is measured against the largest stretch outside: if it holds as much, the
marked lines are the text; if not, marks count for nothing.

White space is what Unicode calls so, no-break spaces too.

Defined results: null or empty html, and pages without text, give an empty
text; unclosed tags end with the page; repeated rows give a row each; equal
stretches are taken in page order; an empty table gives an empty result; only
page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import lean

#: Lines of a sliding window.
WINDOW = 3
#: A window surges with at least this much text.
SURGE = 60

#: Fixed values of HTML: elements whose content is no text, void elements, and elements within a line.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "canvas", "audio", "video", "title", "textarea")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    # Formulas and drawings: their text stands within a line.
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup "
    "msup mtable mtd mtext mtr munder munderover semantics svg g text tspan textpath path rect circle ellipse line polygon polyline use defs symbol".split()
)
#: Elements that hold no main text, whatever they say.
ASIDE = frozenset("nav footer aside form button select option menu dialog fieldset datalist head".split())
#: Words of class, id and role that name such elements, whole or beside words of layout alone.
NAMED = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|masthead|menu|menubar|modal|nav|"
    r"navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|reply|respond|share|sharing|"
    r"sidebar|social|sponsor\w*|subscribe|toolbar|topbar|widget|complementary|contentinfo|search",
    re.I,
)
REPLIES = re.compile(r"comments?|replies|reply", re.I)
LAYOUT = re.compile(
    r"\d*|main|primary|secondary|site|page|global|post|posts|article|articles|top|bottom|left|right|inner|outer|header|box|block|bar|"
    r"list|item|items|container|wrapper|wrap|section|area|region|panel|group|row|col|column|slot|unit|button|buttons|link|links|icons?|"
    r"form|body|text|content|thread|signup|overlay|stories|google|js",
    re.I,
)
PART = re.compile(r"[-_]")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
MAIN = frozenset(["article", "main"])
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p li dd dt td th blockquote pre figcaption".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<!\[CDATA\[.*?(?:\]\]>|$)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    weight: int
    region: int  # the number of the outermost marked element around the line, or 0
    aside: bool
    holder: int  # the number of the element around the line's paragraph, heading or item, or 0


def _names(value: str, words: re.Pattern[str]) -> bool:
    """Whether a name in an attribute is made of `words` and words of layout, one of `words` at least."""
    for name in value.split():
        parts = PART.split(name)
        if any(map(words.fullmatch, parts)) and all(words.fullmatch(x) or LAYOUT.fullmatch(x) for x in parts):
            return True
    return False


def _is_aside(name: str, rest: str, in_main: bool) -> bool:
    if name in ASIDE or name == "header" and not in_main:
        return True
    if not rest or name in ("html", "body"):
        return False
    own: dict[str, str] = {}
    for key, a, b, c in ATTRIBUTE.findall(rest):
        own.setdefault(key.lower(), a or b or c)
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or HIDDEN.search(own.get("style", "")):
        return True
    if name in TITLES:
        return False
    if name in MAIN:
        return any(_names(own.get(k, ""), REPLIES) for k in ("class", "id", "role"))
    if _names(own.get("class", ""), NAMED) or _names(own.get("role", ""), NAMED):
        return True
    # The id of a text block, or of a part of the article, is an anchor: it names its subject.
    return name not in HEADINGS and _names(own.get("id", ""), REPLIES if in_main else NAMED)


def lines(page: str) -> list[Line]:
    """The blocks of a page, with what they weigh and where they stand."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, int]] = []  # open block elements: name, aside, region, holder
    text: list[str] = []
    linked, links = 0, 0
    aside, region, regions, holder, holders = False, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                out.append(Line(line, 0 if aside else max(0, len(line) - linked), region, aside, holder))
            text.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            part = page[at : m.start()]
            text.append(part)
            if links:
                linked += len(part)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
        elif name == "a":
            links = max(0, links - 1) if m["end"] else links + 1
        elif name in INLINE:
            continue
        elif m["end"]:
            flush()
            links = 0
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if k >= 0:
                del stack[k:]
                aside, region, holder = stack[-1][1:] if stack else (False, 0, 0)
        else:
            flush()
            links = 0
            if name in VOID or m["rest"].rstrip().endswith("/"):
                continue
            # A paragraph or list item that was left open ends where the next begins.
            if name in HEADINGS and stack and stack[-1][0] in HEADINGS and (name == stack[-1][0] or stack[-1][0] == "p"):
                stack.pop()
                aside, region, holder = stack[-1][1:] if stack else (False, 0, 0)
            if name in MAIN and not region:
                region = regions = regions + 1
            aside = aside or _is_aside(name, m["rest"], region > 0)
            if name not in HEADINGS:
                holder = holders = holders + 1
            stack.append((name, aside, region, holder))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def stretches(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, after last) of every stretch between a surge and the dive that follows.

    The sum over `window` lines from line i on surges at the first i at which it
    reaches `surge` and line i weighs something; it dives where the window holds nothing.
    """
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    block = [total[min(n, i + window)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if weights[i] and block[i] >= surge:
            j = i
            while j < n and block[j] > 0:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def extract(page: str | None) -> str:
    """The main text of a page, blocks joined by a line feed."""
    if not page:
        return ""
    found = [x for x in lines(page) if not x.aside]
    marked: dict[int, int] = {}
    for x in found:
        if x.region and x.weight:
            marked[x.region] = marked.get(x.region, 0) + x.weight
    if marked:
        outside = [0 if x.region else x.weight for x in found]
        if max(marked.values()) >= max((sum(outside[a:b]) for a, b in stretches(outside)), default=0):
            # Within a marked article links are text as well.
            return "\n".join(x.text for x in found if x.region)
    weights = [x.weight for x in found]
    if not any(weights):
        return ""
    spans = stretches(weights) or stretches(weights, surge=1)
    # From the first to the last of those that hold a fair share of what the largest one holds.
    size = [sum(weights[a:b]) for a, b in spans]
    spans = [s for s, z in zip(spans, size) if z >= 0.2 * max(size)]
    # And on to every line of text in the elements that hold them: a closing paragraph after links is no end of the text.
    own = {found[i].holder for a, b in spans for i in range(a, b) if weights[i]}
    there = [i for i, x in enumerate(found) if weights[i] and x.holder in own]
    first, last = min(spans[0][0], there[0]), max(spans[-1][1], there[-1] + 1)
    # A short line right above, such as a heading, belongs to the text.
    while first and weights[first - 1]:
        first -= 1
    return "\n".join(x.text for x in found[first:last])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [extract(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    own = pages.select("page_id", "url", "html")
    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.mapInArrow(lean(run), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
