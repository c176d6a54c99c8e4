"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and words. Each tag scores a negative weight; a word scores by its container: the
nearest enclosing element whose name, class or id is telling, and below zero once any of these tells of boilerplate. One
linear scan finds the contiguous region with the greatest sum. The main text is the region's words that score above zero, in
blocks, so an advert between two paragraphs goes without its neighbours.

The weights come from labelled pages: for container names a log ratio of words inside and outside the main text, for
tags, links, boilerplate and words without a telling container the values that find the labelled text best. There is no
table of such pages, so they are part of the module: some written out (``LABELLED``) and one built around each name that
sites give to what is not their text (``OUTSIDE``), inside and beside containers of the names that they give to it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

# Element names by role, from the HTML standard.
RAW = frozenset("script style noscript template svg math iframe object select textarea title head canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol search section span table td ul p".split())
ALWAYS = frozenset("article aside footer form header main menu nav search dialog".split())

#: Pages with the main text between the comments [ and ].
LABELLED = (
    '<html><head><title>Rivers</title></head><body><header class="site-header"><a href="/">The Daily</a><p>News since 1890</p></header><nav class="menu"><ul><li><a>Home</a></li><li><a>World</a></li><li><a>Sports</a></li></ul></nav>'
    "<article><!--[--><h1>Rivers rise again</h1><p>After three days of rain the rivers of the north have risen by more than a metre and some roads are closed.</p><p>People in the lower towns were asked to move to higher ground before the night.</p><!--]-->"
    '<div class="ad">Buy now and save half of the price today only</div><!--[--><p>The next report is expected in the morning, said the office.</p><!--]--></article>'
    '<aside class="sidebar"><h3>Most read</h3><ul><li><a>Ten tips for a better garden</a></li><li><a>What to cook this week</a></li></ul></aside><footer>&copy; The Daily. All rights reserved. Terms. Privacy.</footer></body></html>',
    '<body><div id="cookie-notice" class="cookie banner notice"><p>We use cookies to give you the best experience.</p><button>Accept</button></div><div class="header"><a>Blog</a> <a>About</a></div><div id="content" class="content main"><div class="post entry-content"><!--[--><h2>On keeping bees</h2>'
    "<p>The first thing to know about <a>bees</a> is that they do not need you at all, and the second is that they will let you know.</p><ul><li>A hive in the shade stays calm for most of the day.</li><li>Water must be near.</li></ul><p>In autumn the colony grows smaller and prepares for the cold.</p><!--]--></div>"
    '<div class="share social">Share this on all your networks</div><div class="related promo"><h4>Related</h4><a>How to build a hive</a> <a>Wax and candles</a></div></div><section id="comments" class="comments"><h3>Comments</h3><article class="comment"><p>Great post, I learned a lot from it!</p></article><article class="comment"><p>Mine died last winter, what a pity.</p></article>'
    '<form class="reply"><label>Leave a reply</label><input></form></section><div class="sidebar widget"><p>Subscribe to the newsletter and never miss a post</p></div><div class="footer"><p>Powered by a blog engine</p></div></body>',
    '<html><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li><li><a href="/d">Four</a></li></ul></nav><div class="ad advert advertisement sponsored">A short line that sells something to you.</div>'
    "<main><!--[--><h1>Notes</h1><p>Short.</p><p>Then a longer paragraph follows that has many words and tells a story from its beginning to its end without any link in between.</p><blockquote><p>And a quotation of some length, which is part of it as well.</p></blockquote><table><tr><td>Some</td><td>figures</td></tr></table><!--]--></main>"
    '<div class="newsletter popup modal"><form><p>Sign up for our letter</p></form></div><footer><p>Imprint and contact of the house</p><p>Part of a group</p></footer></body></html>',
    '<html><body><header><h1>Site name</h1><form class="search"><input></form></header><div class="breadcrumb breadcrumbs"><a>Home</a> / <a>Texts</a></div><article class="article story"><header><!--[--><h1>The old mill</h1><!--]--></header><!--[--><p>By the water stands a mill that has not turned for forty years, and nobody remembers who ground the last sack.</p>'
    "<p>Its wheel is gone and <b>the roof</b> has fallen in.</p><figure><figcaption>The mill in spring</figcaption></figure><p>Still the children play there every day of the summer.</p><!--]--><footer><p>Filed under places. Tagged old, water.</p></footer></article></body></html>",
    '<body><table class="menu"><tr><td><a>Start</a></td><td><a>Links</a></td></tr></table><!--[--><p>This page has no sections at all, only paragraphs that follow each other, as pages had in the early days of the web.</p><p>The second paragraph goes on about the same matter and has no end in sight for the patient reader.</p><!--]--><p class="footer copyright">Last changed in May</p></body>',
)

#: Names of containers, singular: of main text, and of what surrounds it.
INSIDE = "article story post entry content main body text prose".split()
OUTSIDE = (
    "ad advert advertisement advertising adsense adslot alert aside author-bio banner breadcrumb colophon comment consent contact cookie copyright credit cta "
    "discussion disqus feedback follow footer gdpr guestbook hidden imprint legal login masthead menu modal nav navbar navigation newsletter notice outbrain "
    "overlay pager pagination paywall popular popup privacy promo promotion rail recommendation recommended related remark reply respond response search share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription taboola toast toolbar topbar trending widget"
).split()
_LINES = (
    "Seven words that belong to nothing here",
    "The river had risen in the night and by the morning it stood in the lower fields where nobody had seen it before.",
    "They took the boat from the barn and rowed across to the mill to see whether the old man was safe.",
)


def built_pages() -> tuple[str, ...]:
    """A labelled page for each name of OUTSIDE, which stands before, behind or inside the main text, by turns."""
    pages = []
    for i, name in enumerate(OUTSIDE):
        tag = ("div", "section", "ul")[i % 3]
        odd = f'<{tag} class="{name}"><li><a>{_LINES[0]}</a></li><p>{_LINES[0]}</p></{tag}>'
        place = i // 3 % 3
        first, last = (f"<!--[--><p>{line}</p><!--]-->" for line in _LINES[1:])
        own = f'<div class="{INSIDE[i % len(INSIDE)]}">{first}{odd if place == 2 else ""}{last}</div>'
        pages.append(f"<html><body>{odd if place == 0 else ''}{own}{odd if place == 1 else ''}</body></html>")
    return tuple(pages)


_TOKEN = re.compile(r"<!--(.*?)(?:-->|$)|<!?(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|<[!?][^>]*>|<[!/?a-zA-Z][^<>]*$|([^<]+|<)", re.S)
_CLOSE = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Weights:
    names: dict[str, float] = field(default_factory=dict)
    tag: float = -0.5
    word: float = 0.5
    boilerplate: float = -0.5
    link: float = 0.5


def _hints(name: str, attributes: str, inside: bool) -> list[list[str]]:
    """Names that tell of a container: the element's, marked where it lies inside main text, and for each of its classes,
    ids and roles the words that this is made of."""
    own = [[name + "/in" if inside and name in ("header", "footer") else name]] if name in ALWAYS else []
    for found in _HINT.finditer(attributes):
        for given in (found[1] or found[2] or found[3] or "").split():
            parts = [p.lower() for p in _PART.findall(given)]
            own.append(["." + (p[:-1] if len(p) > 3 and p.endswith("s") else p) for p in parts])
    return own


def _told(hints: list[list[str]], names: dict[str, float]) -> float:
    """The sum of what a container's names tell. In a name of several words the one for boilerplate decides: comments of
    an article are comments."""
    values = ([names.get(h, 0.0) for h in own] for own in hints if own)
    return sum(min(v) if min(v) <= -1 else sum(v) for v in values)


@cache
def _closing(name: str) -> re.Pattern[str]:
    return re.compile(f"</{name}(?![a-z0-9:-])[^>]*(>|$)", re.I)


def tokens(page: str, weights: Weights):
    """Yield (kind, value, score, main, hints): kind is "tag" for tags, "text" for decoded text.

    score is a word's; main tells whether a label is open; hints are the names of the containers around a text.
    """
    last_close: dict[str, int] = {}
    links = 0
    # Open containers: name, score, and the innermost names around, which one without any hands on. Names that are open
    # are counted, so that an unmatched closing tag need not go through the stack.
    stack: list[tuple[str, float, list[str]]] = []
    opened: Counter[str] = Counter()
    main, at, end = False, 0, len(page)

    def last_of(name: str) -> int:
        """Where the page's last closing tag of that name begins; -1 where it has none."""
        if not last_close:
            last_close[""] = -1
            for found in _CLOSE.finditer(page):
                last_close[found[1].lower()] = found.start()
        return last_close.get(name, -1)

    while at < end:
        found = _TOKEN.match(page, at)
        if found is None:
            at += 1
            continue
        at = found.end()
        comment, slash, name, attributes, text = found.groups()
        if comment is not None:
            main = comment == "[" or (main and comment != "]")
        elif name is not None:
            name = name.lower()
            if name == "a":
                links = 0 if slash else 1
            if slash:
                while opened[name]:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        break
            elif name in RAW and not attributes.endswith("/"):
                if last_of(name) >= at:
                    at = _closing(name).search(page, at).end()
                elif name not in ("head", "title"):
                    at = end
            elif name in CONTAINERS and not attributes.endswith("/"):
                if last_of(name) >= at:
                    above = stack[-1][1] if stack else None
                    hints = _hints(name, attributes, above is not None and above > 0)
                    told = _told(hints, weights.names)
                    score = above if above is not None and (above < 0 or abs(told) < 1) else max(-4.0, min(4.0, told)) if abs(told) >= 1 else None
                    stack.append((name, score, [h for own in hints for h in own] or (stack[-1][2] if stack else [])))
                    opened[name] += 1
            yield "tag", name, weights.tag, main, ()
        elif text is not None:
            score = stack[-1][1] if stack else None
            score = weights.word if score is None else max(score, weights.boilerplate)
            score = min(score, weights.link) if links else score
            yield "text", html.unescape(text), score, main, stack[-1][2] if stack else []


def region(items: list[tuple[float, int]]) -> tuple[int, int]:
    """Start and end of the contiguous run of (score each, count) with the greatest sum; empty where none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, (score, n) in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += score * n
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str | None, weights: Weights | None = None) -> str:
    """The main text of one page; empty for null and for pages without any."""
    weights = weights or trained()
    seen = list(tokens(page or "", weights))
    first, last = region([(score, len(value.split()) if kind == "text" else 1) for kind, value, score, *_ in seen])
    blocks, own = [], []
    for kind, value, score, *_ in seen[first:last]:
        if kind == "tag":
            if value in BLOCKS:
                blocks.append("".join(own))
                own = []
            elif value == "br":
                own.append(" ")
        elif score > 0:
            own.append(value)
    blocks.append("".join(own))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def _truth(page: str) -> set[tuple[int, str]]:
    words = [(w, main) for kind, value, _, main, _ in tokens(page, Weights()) if kind == "text" for w in value.split()]
    return {(i, w) for i, (w, main) in enumerate(words) if main}


def _found(page: str, weights: Weights) -> set[tuple[int, str]]:
    seen = list(tokens(page, weights))
    first, last = region([(score, len(value.split()) if kind == "text" else 1) for kind, value, score, *_ in seen])
    words = [(w, first <= i < last and score > 0) for i, (kind, value, score, *_) in enumerate(seen) if kind == "text" for w in value.split()]
    return {(i, w) for i, (w, kept) in enumerate(words) if kept}


@cache
def trained(pages: tuple[str, ...] | None = None) -> Weights:
    """Weights from labelled pages."""
    pages = LABELLED + built_pages() if pages is None else pages
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        neutral = Weights({"article": 2.0, "main": 2.0})
        for kind, value, _, main, hints in tokens(page, neutral):
            if kind == "text" and (n := len(value.split())):
                # The innermost names tell; an outer one would take the blame for what lies in it.
                for h in set(hints):
                    (inside if main else outside)[h] += n
    names = {h: math.log((inside[h] + 0.5) / (outside[h] + 0.5)) for h in inside | outside}
    choices = [Weights(names, -tag, word, -over, link) for tag in (0.2, 0.5, 1.0, 2.0) for word in (0.2, 0.5, 1.0) for over in (0.1, 0.5, 1.0, 4.0) for link in (0.05, 0.2)]
    return min(choices, key=lambda w: sum(len(_truth(p) ^ _found(p, w)) for p in pages))


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars) for every row of ``pages``.

    Null html counts as empty and gives an empty text. Null ids and repeated rows are returned as they come; columns not
    kept are ignored; an empty table gives an empty result. White space inside a block becomes one space, blocks are
    joined by a line feed in page order, character references are decoded, and nothing of a page is cut off.
    """
    weights = trained()
    columns = [id_col, *keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [extract(h.as_py(), weights) for h in batch.column(len(columns))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())], names=[*columns, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.select(c).schema[0].dataType.simpleString()}" for c in columns)
    return map_rows(pages, [*columns, html_col], f"{kinds}, text string, n_chars bigint", run)
