"""Main text of web pages by the distribution of text over their lines.

Markup is stripped so that every block element is a line. Elements only set a line's weight: in an article element it is all
its characters and a surplus, elsewhere those outside links, a quarter of them on a page with articles, and none inside
elements that are never an article's text. Weights are summed over sliding windows of lines: a text starts where the sum
surges and ends where it dives or where an article begins or ends. Of the texts found the heavy ones are kept.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, functions as F

WINDOW = 3
SURGE = 40  # weight in a window from which a line can start a text, and an article line's surplus
SHARE = 0.25  # of the heaviest text that another one on the page must reach
OUTSIDE = 4  # a line outside an article weighs one part in this many on a page with articles

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form head button select dialog menu".split())
LOOSE = frozenset("p li dt dd tr td th option".split())  # end tags may be left out
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|"
    r"subscribe|subscription|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|site-header|page-header|header|topbar|toolbar|"
    r"comments?|commentlist|replies|disqus|related|recommended|share|sharing|social|widget|search|login|signup|skip|pagination|pager|tags|copyright|disclaimer)"
    r"(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())


def _apart(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's text is never the article's."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        return True
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and MARKED.search(value):
            return True
        if (name == "role" and value.lower() in ROLES) or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters outside links, set apart, number of the outermost article or 0) of every line with text, in page order."""
    lines: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, apart, article
    articles = 0
    parts: list[str] = []
    links: list[str] = []
    in_link = 0

    def close_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
            top = stack[-1] if stack else ("", False, 0)
            lines.append((text, max(0, len(text) - linked), top[1], top[2]))
        parts.clear()
        links.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                links.append(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m.group(2), m.group(4) or ""
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE and not (not closing and tag != "a" and attributes and _apart(tag, attributes, True)):
            if closing and any(e[0] == tag for e in stack):
                close_line()
                while stack.pop()[0] != tag:
                    pass
            continue
        close_line()
        if closing:
            if any(e[0] == tag for e in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in LOOSE and stack and stack[-1][0] == tag:
            stack.pop()
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        above = stack[-1] if stack else ("", False, 0)
        home = above[2]
        if tag == "article" and not home:
            articles += 1
            home = articles
        stack.append((tag, above[1] or _apart(tag, attributes, above[2] > 0), home))
    if at < len(page):
        parts.append(page[at:])
    close_line()
    return lines


def weights_of(lines: list[tuple[str, int, bool, int]]) -> list[int]:
    articles = any(home and not apart for _, _, apart, home in lines)
    return [0 if apart else len(text) + SURGE if home else outside // OUTSIDE if articles else outside for text, outside, apart, home in lines]


def spans_of(weights: list[int], homes: list[int]) -> list[tuple[int, int]]:
    """Texts as (first line, line behind the last): from a surge of the window sums to a dive, within one article or outside all."""
    n = len(weights)
    before = [0, *accumulate(weights)]
    ahead = [before[min(n, i + WINDOW)] - before[i] for i in range(n)]
    behind = [before[i + 1] - before[max(0, i - WINDOW + 1)] for i in range(n)]
    spans, start = [], None
    for i in range(n):
        on = weights[i] > 0 and max(ahead[i], behind[i]) >= SURGE
        if start is not None and (homes[i] != homes[start] or (not on and ahead[i] < SURGE)):
            spans.append((start, i))  # dive
            start = None
        if on and start is None:
            start = i  # surge
    return spans if start is None else [*spans, (start, n)]


def main_text(page: str) -> str:
    """The lines of the heavy texts of a page, joined by one space; empty for a page without text.

    The texts found in one article weigh together. A page on which no window surges keeps every line that weighs something,
    or, should all text be in links, every line that is not set apart.
    """
    lines = lines_of(page)
    weights, homes = weights_of(lines), [home for *_, home in lines]
    spans = spans_of(weights, homes)
    if not spans:
        some = any(weights)
        return " ".join(text for (text, _, apart, _), w in zip(lines, weights) if (w > 0 if some else not apart))
    heft: dict[tuple[int, int], int] = {}
    groups = [(homes[a], 0 if homes[a] else a) for a, _ in spans]
    for group, (a, b) in zip(groups, spans):
        heft[group] = heft.get(group, 0) + sum(weights[a:b])
    need = SHARE * max(heft.values())
    return " ".join(lines[i][0] for group, (a, b) in zip(groups, spans) if heft[group] >= need for i in range(a, b) if weights[i] > 0)


def extracted(page: Column) -> Column:
    """Main text of a page, blocks joined by one space; empty for null, for empty pages and for pages without text."""

    def of(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) if p else "" for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(of, "string")(F.coalesce(page, F.lit("")))
