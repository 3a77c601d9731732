"""Main text of web pages by line-block distribution.

A page is read into lines: the text of one block element each, in page order. Markup is stripped; a line weighs as
many characters as it has, but nothing where it is made of links, and lines inside elements that hold no article text
(menus, footers, forms, adverts, comments and so on, by element and by whole names and known compounds in class, id
and role) are none of the article's. Such a name does not count on an element around the page's only article or main,
or, on pages without these, around most of the text; where there is text in an article or main, lines outside weigh
nothing.

Block lengths are sums of weights over sliding windows of ``WINDOW`` lines. Text surges where the windows rise from
nothing and dives where they fall back to nothing. All lines between a surge and its dive are kept but those of other
elements, lines of links in the middle of text among them. Outside an article or main a stretch counts only if its
windows reach ``SURGE`` characters or a line of it ends as a sentence does; where none counts, all do.

Defined results: null or empty html gives empty text; a page of markup alone gives empty text; an element left open
ends with its parent or the page; quotes count only at the start of an attribute's value; character references are
decoded once; repeated lines and repeated pages are kept; a null key or url stays null; long pages are read whole; an
empty table gives an empty table; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from loomspan.llm.common import slices, stream

#: Lines summed in a window, and characters in a window at which text without a sentence's end has surged.
WINDOW, SURGE = 3, 40

#: Element names of the markup language.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "select", "option", "fieldset", "dialog", "head", "input", "label"}
#: Words of class, id and role that mark parts which are not the article.
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "toolbar", "copyright", "complementary", "contentinfo", "search", "login", "alert", "dialog", "hidden", "skip"}
#: What a compound such as "share-buttons" ends in, and first parts that name a state or the article's own.
HOLDERS = {"area", "bar", "block", "box", "buttons", "container", "content", "form", "inner", "item", "items", "label", "links", "list", "panel", "posts", "section", "slot", "text", "thread", "title", "unit", "wrap", "wrapper"}
STATES = {"no", "not", "has", "with", "without", "overflow", "hide", "show", "entry", "post", "article", "content", "main", "story"}
OWN = {"header", "hidden", "side", "notice", "alert", "search"}
#: Closing one of these by opening another: an open paragraph ends at a block, an item at the next.
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu", "select"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?", re.I)
_JOINT = re.compile(r"[-_]+")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f]['\")\]\u2019\u201d\u00bb]*$")
_SPACE = re.compile(r"\s+")


def _named_aside(name: str, inside: bool) -> bool:
    """Whether one name in class, id or role marks a part that is not the article."""
    if name in ASIDE_WORDS:
        return name != "header" or not inside
    first, *_, last = _JOINT.split(name) if "-" in name or "_" in name else (name, name)
    if first == last or first in STATES and (first in ("no", "not", "has", "with", "without", "overflow", "hide", "show") or last in OWN):
        return False
    return last in ASIDE_WORDS and (last != "header" or not inside) or first in ASIDE_WORDS and last in HOLDERS


def _aside(name: str, marks: str, inside: bool) -> int:
    """1 where an element is no part of an article, 2 where only its names say so; ``inside``: in an article or main."""
    if name in ASIDE or name == "header" and not inside:
        return 1
    if not marks or name in ("html", "body", "article", "main"):
        return 0
    named = 0
    for kind, *values in _MARK.findall(marks):
        kind, value = kind.lower(), "".join(values).lower()
        if kind == "hidden" or kind == "aria-hidden" and value == "true":
            return 1
        if kind == "style":
            if "display:none" in value.replace(" ", ""):
                return 1
        elif any(_named_aside(x, inside) for x in value.split()):
            named = 2
    return named


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, whether inside an article or main, whether of another element) of each line with text."""
    out: list[tuple[str, int, bool, tuple[int, ...], bool]] = []
    # open elements: name, how aside (see _aside), whether article or main
    open_: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    # elements that are aside by name: those open, how many so far, those around an article or main
    named: tuple[int, ...] = ()
    n_named, around = 0, set()
    linked = asides = regions = links = 0
    at, size = 0, len(page)

    def line() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()
            if text:
                weight = 0 if asides or not regions and 2 * linked > len(raw) else len(text)
                out.append((text, weight, regions > 0, named, asides > 0))
            parts.clear()
            linked = 0

    def shut(n: int) -> None:
        nonlocal asides, regions, links, named
        while len(open_) > n:
            name, aside, region = open_.pop()
            if name in BLOCK:
                line()
            asides -= aside == 1
            named = named[:-1] if aside == 2 else named
            regions -= region
            links -= name == "a"

    while at < size:
        tag = _TAG.search(page, at)
        text = page[at : tag.start() if tag else size]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if tag[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    shut(i)
                    break
                if name not in BLOCK and open_[i][0] in BLOCK:
                    break
            else:
                if name in BLOCK:
                    line()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            parts.append(" ")
            continue
        if name in BLOCK:
            line()
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in PEERS.get(name, ()) or open_[i][0] == "p" and name != "br":
                    shut(i)
                    break
                if open_[i][0] in SCOPES or open_[i][0] in BLOCK and name not in PEERS:
                    break
        if name in VOID or tag[3].endswith("/"):
            continue
        region = name in ("article", "main")
        aside = _aside(name, tag[3], regions > 0)
        open_.append((name, aside, region))
        asides += aside == 1
        if aside == 2:
            named, n_named = (*named, n_named), n_named + 1
        if region:
            around.update(named)
        regions += region
        links += name == "a"
    line()
    shut(0)
    return _weighed(out, around)


def _weighed(lines: list[tuple[str, int, bool, tuple[int, ...], bool]], around: set[int]) -> list[tuple[str, int, bool, bool]]:
    """Lines inside elements that are aside by name are aside, unless such an element holds the page's article."""
    lifted: set[int] = set()
    if not any(w and inside and not names for _, w, inside, names, _ in lines):
        if any(w and inside and around.issuperset(names) for _, w, inside, names, _ in lines):
            lifted = around
        else:
            held: dict[int, int] = {}
            for _, w, _, names, _ in lines:
                for x in names:
                    held[x] = held.get(x, 0) + w
            total = sum(w for _, w, *_ in lines)
            lifted = {x for x, w in held.items() if 2 * w > total}
    return [(t, w if (own := lifted.issuperset(names)) else 0, inside, aside or not own) for t, w, inside, names, aside in lines]


def block_lengths(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sums over ``window`` lines: entry i is of the lines i - window + 1 .. i, the last entries reach past the end."""
    sums, total, n = [], 0, len(weights)
    for i in range(n + window - 1):
        total += weights[i] if i < n else 0
        total -= weights[i - window] if i >= window else 0
        sums.append(total)
    return sums


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, line after the last, greatest window) between each surge point and the next dive point."""
    out, begin, peak = [], None, 0
    for i, s in enumerate([*block_lengths(weights, window), 0]):
        if s and begin is None:
            begin, peak = i, s
        elif not s and begin is not None:
            out.append((begin, i - window + 1, peak))
            begin = None
        peak = max(peak, s)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, one block a line."""
    lines = lines_of(page or "")
    whole = any(w for _, w, inside, _ in lines if inside)
    if whole:
        lines = [(t, w if inside else 0, inside, aside or not inside) for t, w, inside, aside in lines]
    runs = stretches([w for _, w, *_ in lines])
    prose = [r for r in runs if whole or r[2] >= SURGE or any(w and _SENTENCE.search(t) for t, w, *_ in lines[r[0] : r[1]])]
    return "\n".join(t for first, end, _ in prose or runs for t, _, _, aside in lines[first:end] if not aside)


def extract(pages: DataFrame, key: str = "page_id", markup: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns ``also``, text and n_chars (code points) of every page."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in slices(batch, markup):
                text = [main_text(x) for x in part[markup]]
                yield {c: part[c] for c in (key, *also)} | {"text": text, "n_chars": [len(t) for t in text]}

    kept = [pages.schema[c] for c in (key, *also)]
    return stream(pages.select(key, *also, markup), StructType([*kept, *StructType.fromDDL("text string, n_chars long").fields]), rows)
