"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped to lines, one for each block of the page, with the length of
what is no link text. Sums of these lengths over sliding windows of lines rise
steeply where an article begins (surge) and fall where it ends (dive); what lies
between is kept. Elements that name themselves as something else (menus,
adverts, comments, …) hold no lines, and lines in an article or main element
weigh more.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import text_slices

#: Lines of a window, and characters that a window inside an article has at least.
WINDOW, SURGE = 3, 80
#: Runs of lines with less than this share of the largest run's weight are no part of the article.
MINOR = 0.3
#: An article or main element counts if it holds this share of the text outside of named boilerplate.
HINT = {"article": 0.25, "main": 0.5}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select|object)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*|[^<>]*)>|<[!?][^<>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELL = {"td", "th"}
#: What an element of this name closes when it opens.
CLOSES = {"a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": CELL, "th": CELL}
PARAGRAPH = {"p"}
NEVER = set("nav footer aside form button dialog menu".split())
OFF = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside widget widgets footer masthead comment comments reply replies respond disqus discussion share sharing social related recommended recommendations pagination pager toolbar search complementary contentinfo".split())
COMMENTS = set("comment comments reply replies respond disqus discussion".split())
#: Words beside which those above only describe a layout.
LAYOUT = set("has with no without is layout page wrapper container".split())
SITE = set("header site page global top main app".split())


class Line(NamedTuple):
    text: str
    plain: int  # characters outside of links
    heading: bool
    place: str  # "article", "main" or ""


def _named_off(name: str, attributes: str, inside: bool) -> str:
    """"" for an element that may hold the article, "comment" for reader comments, else "off"."""
    if name in NEVER or name == "header" and not inside:
        return "off"
    if not attributes or name in ("html", "body", "main"):
        return ""
    if _HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: m[0] if "display" in m[0] else '""', attributes)):
        return "off"
    for m in _NAMES.finditer(attributes):
        for one in (m[2] or m[3] or m[4] or "").split():
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()))
            if words & COMMENTS and not words & {"has", "with", "no"}:
                return "comment"
            if words & OFF and not words & LAYOUT or "header" in words and words <= SITE and not inside:
                return "off"
    return ""


def lines(page: str) -> list[Line]:
    """The page's blocks of text in order, without those of elements that are named as no part of an article."""
    out: list[Line] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements, and why they hold no text: "off", "comment" or ""
    count: dict[str, int] = {}  # open elements by name
    off = plain = links = 0
    heading, at = False, 0

    def flush() -> None:
        nonlocal plain, heading
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Line(joined, plain, heading, "article" if count.get("article") else "main" if count.get("main") else ""))
            text.clear()
        plain, heading = 0, False

    def pop() -> None:
        nonlocal off, links
        name, why = stack.pop()
        count[name] -= 1
        off -= bool(why)
        links -= name == "a"

    for m in _TAG.finditer(page):
        if m.start() > at and not off:
            run = page[at : m.start()]
            run = html.unescape(run) if "&" in run else run
            text.append(run)
            if not links:
                plain += len(run.strip())
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name == "br" or name in CELL:
            text.append(" ")
        if name in VOID:
            continue
        if not m[2]:
            closed = CLOSES.get(name, PARAGRAPH if name in BLOCK else ())
            if any(count.get(c) for c in closed):  # an open one of these, if only inline elements are inside it, ends here
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] not in closed and stack[depth][0] not in BLOCK | CELL:
                    depth -= 1
                if depth >= 0 and stack[depth][0] in closed:
                    while len(stack) > depth or stack and stack[-1][0] in closed:
                        pop()
            inside = bool(count.get("article") or count.get("main"))
            why = _named_off(name, m[4], inside)
            if name in HINT and not why and off and not any(s[1] == "comment" for s in stack):
                stack[:] = [(n, "") for n, _ in stack]  # what holds an article is no menu, whatever it is called
                off = 0
            stack.append((name, why))
            count[name] = count.get(name, 0) + 1
            off += bool(why)
            links += name == "a"
            heading = heading or name in HEADING
        elif count.get(name):
            block = name in BLOCK or name in CELL
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name or not block and stack[k][0] in BLOCK), -1)
            if depth >= 0 and stack[depth][0] == name:
                while len(stack) > depth:
                    pop()
    if at < len(page) and not off:
        text.append(html.unescape(page[at:]))
        plain += len(page[at:].strip())
    flush()
    return out


def _place(found: list[Line]) -> str:
    """The name of the element in which the article is, "" if none of those names tells."""
    total = sum(x.plain for x in found)
    inside = {place: sum(x.plain for x in found if x.place == place or place == "main" and x.place) for place in HINT}
    return next((p for p, share in HINT.items() if inside[p] and inside[p] >= share * total), "")


def kept(found: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[Line]:
    """The lines between surge and dive points of the sums of weights over windows of lines."""
    place = _place(found)
    if place:  # lines in that element surge by themselves, others hold nothing
        weights = [x.plain + surge if x.place == place or place == "main" and x.place else 0 for x in found]
    else:
        weights = [x.plain if 2 * x.plain >= len(x.text) else 0 for x in found]
    upto = [0, *accumulate(weights)]
    n = len(found)
    sums = [upto[min(n, k + window)] - upto[k] for k in range(n)]
    runs, k = [], 0
    while k < n:
        if weights[k] and sums[k] >= surge:
            end = k
            while end < n and sums[end] >= surge:  # the dive: a window with little text
                end += 1
            end = min(n, end + window - 1) if end < n else n
            while not weights[end - 1]:
                end -= 1
            runs.append((k, end))
            k = end
        else:
            k += 1
    if not runs:
        return []
    mass = [upto[b] - upto[a] for a, b in runs]
    runs = [r for r, x in zip(runs, mass) if x >= MINOR * max(mass)]
    out: list[Line] = []
    for a, b in runs:
        if not place:  # at the rims of a run: single words of menus that the window took in
            rim = lambda x: not x.heading and len(x.text) < 25 and x.text[-1] not in ".!?:;…。！？\"”»"
            while a < b and rim(found[a]):
                a += 1
            while a < b and rim(found[b - 1]):
                b -= 1
        out += [x for x, w in zip(found[a:b], weights[a:b]) if w or not place]
    return out


def main_text(page: str) -> str:
    return "\n".join(x.text for x in kept(lines(page)))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text in the place of the column of HTML; other columns stay as they are (one named text goes)."""
    rest = [f for f in pages.schema.fields if f.name not in (column, "text")]
    numbered = [StructField(f"_{k}", f.dataType) for k, f in enumerate(rest)]  # whatever their names hold
    out = StructType([*numbered, StructField("text", StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                found = pa.array([main_text(x or "") for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in numbered], found], names=out.names)

    own = lambda name: F.col("`" + name.replace("`", "``") + "`")
    found = pages.select(*[own(f.name).alias(n.name) for f, n in zip(rest, numbered)], own(column).alias("html")).mapInArrow(texts, out)
    return found.toDF(*[f.name for f in rest], "text")


def main_text_report(pages: DataFrame) -> DataFrame:
    """page_id, url, the page's main text and its code points; see the contract of op12.

    A null or empty page, and one without any text that surges, has the empty text. Equal pages have equal texts, each
    row is a page of its own (repeated and null ids too), and other columns are not read. No rows give no rows.
    """
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.char_length("text").cast("long"))
