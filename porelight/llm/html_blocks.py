"""Leaf blocks of an HTML page, and their features."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

#: Fixed values of the HTML language.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select datalist audio video".split())
RAW_TEXT = frozenset("script style textarea title iframe noscript".split())  # no tags inside
FOREIGN = frozenset(["svg", "math"])
#: A start tag of these ends foreign content.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main aside nav header footer".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var img wbr".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
} | dict.fromkeys("p div article section aside nav header footer main form ul ol dl table pre blockquote figure h1 h2 h3 h4 h5 h6 address fieldset hr".split(), frozenset(["p"]))
#: An element that a closing tag or an implied end must not reach beyond.
BARRIER = frozenset("table ul ol dl article section aside nav header footer main div form body html td".split())

ANCESTORS = ("nav", "header", "footer", "aside", "article", "main", "section", "form", "table", "ul", "ol", "li", "dl", "figure", "figcaption", "blockquote", "pre", "a", "button", "label", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "address", "menu", "details", "dialog", "fieldset", "small", "td")
#: Words in classes and ids, by what they tell.
CLUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toolbar skip topbar pagination pager toc",
    "head": "header masthead banner logo branding hero",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget widgets related recommended trending popular more archive tags tag taglist",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog warning message paywall",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp",
    "form": "form login signup register search newsletter subscribe subscription contact",
    "comment": "comment comments reply replies disqus respond discussion thread reader readers responses review reviews guestbook",
    "share": "share sharing social follow twitter facebook buttons tools meta byline author date",
    "body": "content article post entry body main story text page single prose",
}
_CLUE_OF = {w: kind for kind, ws in CLUES.items() for w in ws.split()}
#: Words in a block's text that tell of page furniture.
SAYINGS = {
    "rights": "© copyright rights reserved",
    "cookie": "cookie cookies consent privacy policy terms",
    "subscribe": "subscribe newsletter sign login register email password submit search",
    "comment": "comment comments reply replies posted",
    "advert": "advertisement sponsored advert promoted",
    "share": "share tweet follow facebook twitter",
}
_SAYING_OF = {w: kind for kind, ws in SAYINGS.items() for w in ws.split()}

NAMES = tuple(
    ["bias", "first", "last"]
    + [f"in:{t}" for t in ANCESTORS]
    + [f"clue:{c}" for c in CLUES]
    + [f"near:{c}" for c in CLUES]
    + ["hidden", "no article or main", "outside article or main", "role:navigation", "role:other"]
    + [f"says:{s}" for s in SAYINGS]
    + ["words<4", "words<12", "words<40", "words>=40", "links<.3", "links<.8", "links>=.8", "ends in a stop", "no stop", "digits", "inner form or comment", "furniture in article"]
)
INDEX = {n: k for k, n in enumerate(NAMES)}


@dataclass
class Block:
    text: str
    features: list[int]


class _Open:
    __slots__ = ("tag", "clues", "hidden", "role")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.clues, self.hidden, self.role = tag, (), False, ""
        if attrs:
            clues = set()
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    clues |= {k for w in _NAME.findall(_CAMEL.sub(r"\1 \2", value)) if (k := _CLUE_OF.get(w.lower()))}
                elif name == "role":
                    self.role = value.lower()
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.hidden = True
            self.clues = tuple(sorted(clues))


@lru_cache(None)  # a fixed set of tags
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order. Inline tags don't end a block; every other tag does."""
    out: list[tuple[str, tuple, float]] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = total = 0
    in_link, raw, raw_depth, at = 0, "", 0, 0
    state: tuple | None = None

    def flush() -> None:
        nonlocal linked, total, state
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, state, linked / max(total, 1)))
            parts.clear()
        linked = total = 0
        state = None

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at and not raw:
            text = page[at:end]
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            n = len(text)
            total += n
            if in_link:
                linked += n
            if state is None and not text.isspace():
                state = tuple(stack)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        closing = bool(m[1])
        if raw:
            if tag == raw:
                raw_depth += -1 if closing else 1
                if not raw_depth:
                    raw = ""
                continue
            if raw not in FOREIGN or closing or tag not in BREAKOUT:
                continue
            raw, raw_depth = "", 0
        if tag in RAW:
            if closing:
                continue
            if tag not in INLINE:
                flush()
            if tag in RAW_TEXT:
                stop = _end_of(tag).search(page, at)
                at = stop.end() if stop else size
            elif not m[3].rstrip().endswith("/") and (tag in FOREIGN or _end_of(tag).search(page, at)):
                raw, raw_depth = tag, 1  # one that is never closed hides nothing
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            if tag not in VOID:
                if not closing:
                    stack.append(_Open(tag, m[3]))
                else:
                    _close(stack, tag)
            continue
        flush()
        if tag in VOID or tag == "head":  # what may stand in a head is void or hidden by itself; all else is of the body
            continue
        if closing:
            _close(stack, tag)
            if tag not in ("p", "li"):
                in_link = 0
        else:
            if ends := CLOSED_BY.get(tag):
                _imply(stack, ends)
            stack.append(_Open(tag, m[3]))
    flush()
    whole = any(o.tag in ("article", "main") for _, s, _ in out for o in s)
    return [Block(text, _features(text, s, links, k, len(out), whole)) for k, (text, s, links) in enumerate(out)]


def _close(stack: list[_Open], tag: str) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in BARRIER and tag not in BARRIER:
            return


def _imply(stack: list[_Open], ends: frozenset[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].tag in ends:
            del stack[k:]
            return
        if stack[k].tag in BARRIER:
            return


def _features(text: str, stack: tuple, links: float, k: int, n: int, whole: bool) -> list[int]:
    on = {"bias"}
    if k == 0:
        on.add("first")
    if k == n - 1:
        on.add("last")
    tags = {o.tag for o in stack}
    on |= {f"in:{t}" for t in tags if f"in:{t}" in INDEX}
    furniture = False
    inside = False
    for depth, o in enumerate(reversed(stack)):
        for c in o.clues:
            on.add(f"clue:{c}")
            if depth < 2:
                on.add(f"near:{c}")
            furniture |= c not in ("body", "head")
        if o.hidden:
            on.add("hidden")
        if o.role:
            on.add("role:navigation" if o.role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert") else "role:other")
        inside |= o.tag in ("article", "main")
    if not whole:
        on.add("no article or main")
    elif not inside:
        on.add("outside article or main")
    words = text.split()
    said = Counter(_SAYING_OF[w] for x in words if (w := x.strip(".,;:!?()").lower()) in _SAYING_OF)
    on |= {f"says:{kind}" for kind, times in said.items() if times * 12 >= len(words)}  # a rate, for any long text says each once
    on.add("words<4" if len(words) < 4 else "words<12" if len(words) < 12 else "words<40" if len(words) < 40 else "words>=40")
    if links:
        on.add("links<.3" if links < 0.3 else "links<.8" if links < 0.8 else "links>=.8")
    on.add("ends in a stop" if text[-1:] in ".!?…\"”»:" else "no stop")
    if sum(map(str.isdigit, text)) * 5 > len(text):
        on.add("digits")
    if tags & {"form", "button", "label", "fieldset"} or "clue:comment" in on:
        on.add("inner form or comment")
    if inside and (furniture or tags & {"nav", "aside", "footer", "form", "button"}):
        on.add("furniture in article")
    return sorted(INDEX[x] for x in on)
