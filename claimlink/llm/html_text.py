"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one a block element); text lengths are summed over sliding windows of lines; the text lies between
the points where these sums surge and dive. Lines within elements that never hold the article (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments, scripts, styles) are empty ones there, and so are lines outside the article
or main element where a page has one; the text of links has no length outside it. So such places look like gaps, not like text.
An element that is an aside by its name only, or a form, may wrap the page itself (has-sidebar, content-sidebar-wrap); it is
taken as a wrapper if it holds the main element or more text than is outside.

Scanning takes time in proportion to the page, whatever the markup is; a tag or comment that is cut off by the page's end is left out.
"""

from __future__ import annotations

import collections
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimlink.llm.shared import arrow_batches

WINDOW, SURGE, DIVE = 3, 60, 1
#: Scans of a page, each of which may find a wrapper; where that isn't enough, all names are taken as those of wrappers.
ROUNDS = 8

#: A tag up to its end. Quotes count after an equals sign only, where they are closed; nothing in it can be tried in two ways.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_CUT_OFF = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_SPACE = re.compile(r"\s+")
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title", "xmp", "noembed", "noframes"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"})
ASIDE = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset", "option", "datalist"})
MAIN = frozenset({"article", "main"})
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice\w*|popup|modal|newsletter|subscribe|subscription|signup|sign-up|login|"
    r"nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar\w*|side-bar|aside|rail|widget\w*|related|recommend\w*|more-from|trending|popular|share|sharing|social\w*|"
    r"comments?|comment-\w+|replies|reply|respond|disqus|discussion|feedback|pagination|pager|toolbar|search\w*|skip-link|disclaimer|alert\w*|toc)(?:$|[\s_-])",
    re.I,
)
#: Names that stand for a layout at times, and so on a wrapper of the page; others are taken so only where nothing else is left.
_LAYOUT_NAME = re.compile(r"(?:^|[\s_-])(?:nav\w*|menu\w*|header|masthead|sidebar\w*|side-bar|aside|rail|widget\w*|toolbar)(?:$|[\s_-])", re.I)
_ASIDE_ROLE = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"})


#: What an element is: no aside, an aside whatever it holds, one by its name, one by a name that may be that of a layout.
TEXT, NEVER, NAMED, LAYOUT = range(4)


def _aside(tag: str, attributes: str) -> int:
    if tag == "form":
        return LAYOUT
    if tag in ASIDE:
        return NEVER
    if not attributes or attributes.isspace() or tag in ("html", "body") or tag in MAIN:
        return TEXT
    found = TEXT
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return NEVER
        if name == "role" and value.strip().lower() in _ASIDE_ROLE:
            return NEVER
        if name in ("class", "id") and _ASIDE_NAME.search(value):
            found = max(found, LAYOUT if _LAYOUT_NAME.search(value) else NAMED)
    return found


class Aside:
    """What an outermost aside holds that may be a wrapper: lengths outside links of all its text and of articles in it."""

    def __init__(self, at: int, kind: int) -> None:
        self.at, self.kind = at, kind
        self.length = self.marked = 0
        self.main = False

    def wraps(self, marked: int, shown: int) -> bool:
        """marked, shown: lengths of the lines of articles, and of all lines."""
        outside = marked or shown
        held = self.marked if marked or self.marked else self.length
        return held > 0 and ((self.main and not marked) or outside == 0 or (self.kind == LAYOUT and held > outside))


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, length outside links, whether in an article or main element) of each line; lines within asides outside these are empty."""
    wrappers: set[int] = set()
    for _ in range(ROUNDS):
        lines, asides = _scan(page, wrappers)
        marked, shown = sum(n for _, n, m in lines if m), sum(n for _, n, _ in lines)
        found = max((a for a in asides if a.wraps(marked, shown)), key=lambda a: (a.main, a.marked, a.length), default=None)
        if found is None:
            return lines
        wrappers.add(found.at)
    return _scan(page, None)[0]


def _tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """Text and the tag that ends it; comments and declarations are left out, scripts and the like with all that they hold."""
    at, begin, last = 0, 0, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[begin:at], None
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        if at > last:  # no tag ends any more
            if _CUT_OFF.match(page, at):
                yield page[begin:at], None
                return
            at += 1
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            yield page[begin:at], None
            at = begin = page.find(">", at) + 1
            continue
        tag = _TAG.match(page, at) or _BARE_TAG.match(page, at)
        if not tag:
            at += 1
            continue
        yield page[begin:at], tag
        at = begin = tag.end()
        if tag[2].lower() in RAW and not tag[1] and not _SELF_CLOSED.search(tag[3]):
            close = re.compile(rf"</{re.escape(tag[2])}\s*+>", re.I).search(page, at)
            at = begin = close.end() if close else len(page)
    yield page[begin:], None


def _scan(page: str, wrappers: set[int] | None) -> tuple[list[tuple[str, int, bool]], list[Aside]]:
    """The lines, and the asides that may be wrappers; those that begin at wrappers are none. Without wrappers nothing is an
    aside by its name, and no form is."""
    asides: list[Aside] = []
    held: Aside | None = None  # the aside of asides that is being read, while nothing in it is an aside whatever it holds
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool, Aside | None]] = []  # tag, aside, main, link, held: each holds for all within
    open_: collections.Counter[str] = collections.Counter()
    skip = main = link = hidden = False

    def end_line() -> None:
        nonlocal linked, hidden
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            lines.append((text, max(0, len(text) - linked), main))
        elif hidden and not main:
            lines.append(("", 0, False))
        parts.clear()
        linked, hidden = 0, False

    def close(depth: int) -> None:
        nonlocal skip, main, link, held
        for tag, *_ in stack[depth:]:
            open_[tag] -= 1
        del stack[depth:]
        _, skip, main, link, held = stack[-1] if stack else ("", False, False, False, None)

    for text, token in _tokens(page):
        if text and not skip:
            parts.append(text)
            linked += len(text) * link
        elif text and not text.isspace():
            hidden = True
            if held and not link:
                n = len(text.strip())
                held.length += n
                held.marked += n * main
        if token is None:
            continue
        tag = token[2].lower()
        if tag not in INLINE:
            end_line()
        if token[1]:  # an end tag closes the nearest element of its name, and all within it
            if open_[tag] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in RAW or tag in VOID or _SELF_CLOSED.search(token[3]):
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)  # these end where the next of their kind begins
        kind = _aside(tag, token[3])
        if kind != NEVER and (wrappers is None or token.start() in wrappers):
            kind = TEXT
        if kind and not skip:
            end_line()
            if kind != NEVER and tag not in INLINE and not main:
                held = Aside(token.start(), kind)
                asides.append(held)
        elif kind:
            held = held if kind == LAYOUT else None  # one wrapper may hold another
        if held and tag == "main":
            held.main = True
        skip, main, link = skip or kind != TEXT, main or tag in MAIN, link or tag == "a"
        stack.append((tag, skip, main, link, held))
        open_[tag] += 1
    end_line()
    return lines, asides


def surge_to_dive(lengths: np.ndarray) -> tuple[int, int]:
    """The lines [first, end) of the text by the lengths of all lines.

    A window is WINDOW lines. The text holds all windows whose sums reach SURGE, from the first to the last of them, and goes
    on in both directions until the sums dive below DIVE. Without any surge it is all from the first line with a length to the last.
    """
    filled = np.flatnonzero(lengths >= DIVE)
    if not len(filled):
        return 0, 0
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of the window that begins at each line
    surges = np.flatnonzero((sums >= SURGE) & (lengths >= DIVE))
    if not len(surges):
        return int(filled[0]), int(filled[-1]) + 1
    dives = np.flatnonzero(np.diff(filled) > WINDOW)  # between two lines of which a window of empty ones lies
    runs = np.searchsorted(filled[dives + 1], [surges[0], surges[-1]], side="right") if len(dives) else [0, 0]
    heads, tails = np.append(filled[0], filled[dives + 1]), np.append(filled[dives], filled[-1])
    return int(heads[runs[0]]), int(tails[runs[1]]) + 1


def main_text(page: str) -> str:
    """The lines between the first surge and the last dive of the windowed text lengths, joined by newlines.

    Where the page has an article or main element, lines outside it are empty, and all lines within it are text, links as well. An empty page, or
    one of links only, has an empty text; of a page that is cut off within a tag, what comes before is read.
    """
    lines = page_lines(page)
    marked = any(m for _, _, m in lines)
    lengths = np.array([(len(text) if m else 0) if marked else n for text, n, m in lines], np.int64)
    first, end = surge_to_dive(lengths)
    if marked and (own := np.flatnonzero(lengths)).size:  # what a page marks as its article stays, however far from the longest text
        first, end = min(first, int(own[0])), max(end, int(own[-1]) + 1)
    return "\n".join(text for (text, _, m), n in zip(lines[first:end], lengths[first:end], strict=True) if text and (n or not marked))


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, with text and n_chars, one row for each page; a null page has an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            texts = [main_text(x) if x else "" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string, n_chars long"])
    return pages.select(pages[html_column].alias("_html"), *keep).mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
