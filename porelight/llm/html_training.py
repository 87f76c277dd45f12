"""Labelled pages to train the block labeller on: invented text in the many layouts that pages have."""

from __future__ import annotations

import random

_SYLLABLES = ("an en in on er re th st ti nd ou ea ha or at es he wh ly ed", "ch ei ung sch ge ver be lich keit au ß ie pf zu ö", "eau que é è tion ment oi le ai ou ç vi ré", "ción os ar ñ ll rr ado mente que la ue ie ja", "ka mo su ri ta no ki yo ha ne")


def _word(r: random.Random, s: list[str]) -> str:
    return "".join(r.choice(s) for _ in range(r.randint(1, 4)))


def _text(r: random.Random, least: int, most: int, stop: float = 0.9) -> str:
    s = r.choice(_SYLLABLES).split()
    words = [_word(r, s) for _ in range(r.randint(least, most))]
    if r.random() < 0.15:
        words = [w + r.choice(["###", "***", " |", "$$$", "!!", "&amp;&amp;"]) for w in words]
    out = " ".join(words)
    return (out.upper() if r.random() < 0.05 else out.capitalize()) + (r.choice(".!?") if r.random() < stop else "")


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{k}">{_text(r, 1, 3, 0.1)}</a></li>' for k in range(n))


def page(r: random.Random) -> list[tuple[str, int | None]]:
    """A page as pieces (html, label): the label of a piece's text, or None for markup alone."""
    out: list[tuple[str, int | None]] = [("<!DOCTYPE html><html><head><title>" + _text(r, 2, 8) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>", None)]

    def box(name: str, inner: list[tuple[str, int | None]], tag: str = "div") -> list[tuple[str, int | None]]:
        attr = f' class="{name}"' if name and r.random() < 0.8 else f' id="{name}"' if name else ""
        return [(f"<{tag}{attr}>", None), *inner, (f"</{tag}>", None)]

    def said(tag: str, text: str, label: int) -> list[tuple[str, int | None]]:
        return [(f"<{tag}>", None), (text, label), (f"</{tag}>", None)]

    def several(make, least: int, most: int) -> list[tuple[str, int | None]]:
        return [x for _ in range(r.randint(least, most)) for x in make()]

    def menu():
        items = [("<ul>", None), *((x, 0) for x in [_links(r, 1) for _ in range(r.randint(2, 8))]), ("</ul>", None)]
        return box("", items, "nav") if r.random() < 0.6 else box(r.choice(["menu", "nav", "navbar", "main-navigation", "breadcrumbs", "site-nav"]), items, r.choice(["div", "ul", "header"]))

    def header():
        inner = said(r.choice(["h1", "h2", "p", "div"]), _text(r, 1, 6, 0.2), 0) + (menu() if r.random() < 0.5 else [])
        return box("", inner, "header") if r.random() < 0.6 else box(r.choice(["header", "masthead", "site-header", "top-banner", "logo"]), inner)

    def footer():
        text = r.choice(["&copy; ", "Copyright ", "", "&copy; 2024 "]) + _text(r, 1, 25) + r.choice(["", " All rights reserved.", " &middot; " + _text(r, 2, 12)])
        inner = [(text, 0)] if r.random() < 0.5 else said("p", text, 0) + (menu() if r.random() < 0.3 else [])
        return box("", inner, "footer") if r.random() < 0.7 else box(r.choice(["footer", "site-footer", "bottom", "copyright"]), inner)

    def advert():
        inner = [(_text(r, 2, 40), 0)] if r.random() < 0.6 else said("p", _text(r, 3, 60), 0)
        return [(f"<!-- ad {r.randint(0, 9)} -->", None)] * r.randint(0, 1) + box(r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner", "ad-slot"]), inner, r.choice(["div", "div", "section", "aside"]))

    def side():
        inner = said(r.choice(["h2", "h3", "h4"]), _text(r, 1, 4, 0.1), 0) + (several(lambda: said("p", _text(r, 4, 60), 0), 1, 3) if r.random() < 0.6 else [("<ul>" + _links(r, r.randint(2, 6)) + "</ul>", 0)])
        return box("", inner, "aside") if r.random() < 0.6 else box(r.choice(["sidebar", "related", "widget", "right-rail", "popular"]), inner, r.choice(["div", "section"]))

    def notice():
        inner = [(r.choice(["We use cookies. ", "", ""]) + _text(r, 3, 40), 0)] if r.random() < 0.5 else said("p", _text(r, 3, 40), 0) + said("button", r.choice(["OK", "Accept", _text(r, 1, 2, 0)]), 0)
        return box(r.choice(["notice", "cookie", "cookie-notice", "consent", "alert", "popup", "modal"]), inner, r.choice(["div", "div", "section", "p"]))

    def form():
        inner = [("<label>", None), (_text(r, 1, 4, 0.1), 0), ("</label><input type=text>", None), ("<button>", None), (r.choice(["Submit", "Send", _text(r, 1, 2, 0)]), 0), ("</button>", None)]
        if r.random() < 0.4:
            inner = said("p", _text(r, 3, 30), 0) + inner
        return box(r.choice(["", "search", "newsletter", "login-form", "subscribe"]), inner, "form")

    def comments():
        one = lambda: box(r.choice(["comment", "comment-body", "reply", ""]), said("p", _text(r, 2, 80), 0), r.choice(["div", "li", "article", "div"]))
        return box(r.choice(["comments", "comment-list", "responses", "discussion", "reader-comments"]), said(r.choice(["h2", "h3"]), r.choice(["Comments", _text(r, 1, 3, 0)]), 0) + several(one, 1, 5), r.choice(["section", "div", "ul", "ol"]))

    def share():
        return box(r.choice(["share", "social", "share-buttons", "follow"]), [("<ul>" + _links(r, r.randint(2, 4)) + "</ul>", 0)])

    extras = [advert, side, notice, form, comments, share]

    def body():
        def paragraph():
            long = r.random()
            text = _text(r, 1, 3) if long < 0.2 else _text(r, 4, 30) if long < 0.5 else _text(r, 20, 120)
            if r.random() < 0.1:
                text = text.replace(" ", ' <a href="#">', 1) + "</a>" if " " in text else text
            return [("<p>", None), (text, 1), ("</p>" if r.random() < 0.9 else "", None)]

        def other():
            kind = r.random()
            if kind < 0.3:
                return said(r.choice(["h2", "h3"]), _text(r, 1, 8, 0.3), 1)
            if kind < 0.5:
                return [("<ul>", None), *((f"<li>{_text(r, 2, 25)}</li>", 1) for _ in range(r.randint(1, 5))), ("</ul>", None)]
            if kind < 0.65:
                return [("<blockquote>", None), *said("p", _text(r, 5, 60), 1), ("</blockquote>", None)]
            if kind < 0.8:
                return [("<p><b>", None), (_text(r, 2, 40), 1), ("<br>", None)]
            if kind < 0.9:
                return [("<table><tr><td>", None), (_text(r, 1, 6), 1), ("</td><td>", None), (_text(r, 1, 6), 1), ("</td></tr></table>", None)]
            return [("<pre>", None), (_text(r, 3, 30), 1), ("</pre>", None)]

        def inner_extra():
            return r.choice(extras)()

        parts = said("h1", _text(r, 2, 12, 0.5), 1) if r.random() < 0.85 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            parts += paragraph() if kind < 0.75 else other() if kind < 0.93 else inner_extra()
        return parts

    before = [x for make in (menu, header, advert, notice, form, side) if r.random() < (0.7 if make in (menu, header) else 0.35) for x in make()]
    after = [x for make in (comments, side, advert, share, form, notice) if r.random() < 0.35 for x in make()] + (footer() if r.random() < 0.85 else [])
    shape = r.random()
    if shape < 0.5:
        main = box(r.choice(["", "", "post", "entry"]), body(), "article")
    elif shape < 0.65:
        main = box("", body(), "main")
    elif shape < 0.75:
        main = box("", box("", body(), "article") + (comments() if r.random() < 0.4 else []), "main")
    elif shape < 0.93:
        main = box(r.choice(["content", "article-body", "post", "entry-content", "story", "main-text"]), body())
    else:
        main = box("", body())
    if r.random() < 0.1:  # little but a short article
        bare = several(lambda: said("p", _text(r, 1, 8), 1), 1, 2)
        before, after = (before, after) if r.random() < 0.3 else ([], [])
        main = box("", bare, r.choice(["article", "main", "div"])) if r.random() < 0.8 else bare
    wrapped = before + main + after
    return out + (box("page", wrapped) if r.random() < 0.15 else wrapped) + [("</body></html>" if r.random() < 0.9 else "", None)]


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text piece, label)]) of ``n`` pages, the same for one seed."""
    r = random.Random(seed)
    found = []
    for _ in range(n):
        pieces = page(r)
        found.append(("".join(p for p, _ in pieces), pieces))
    return found
