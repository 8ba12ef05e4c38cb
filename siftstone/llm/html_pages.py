"""Labelled example pages to train the extraction model on.

Pages are composed from layouts and parts that are common on the web, with
random words. Every block-level part is written with its label, so the label of
each DOM node is known without any rule about tags.
"""

from __future__ import annotations

import random

#: Names of containers and parts, as web sites use them: fixed values.
CONTENT_TAGS = ["article", "main", "div", "div", "section", "td"]
CONTENT_NAMES = ["content", "main-content", "post", "entry-content", "article-body", "story", "post-content", "text", "page-content", "article", "body-text", "", ""]
WRAPPER_NAMES = ["wrapper", "container", "page", "site", "layout", "row", "columns", "inner", "root", "app", ""]
BOILERPLATE = [
    ("nav", ["", "main-nav", "navigation", "site-nav"], "links"),
    ("div", ["menu", "nav", "navbar", "top-menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc-links"], "links"),
    ("ul", ["menu", "nav", "links", "tags", "social"], "items"),
    ("header", ["", "site-header", "page-header", "masthead"], "head"),
    ("div", ["header", "banner", "top-bar", "masthead", "logo"], "head"),
    ("footer", ["", "site-footer", "footer"], "foot"),
    ("div", ["footer", "bottom", "copyright", "legal", "credits"], "foot"),
    ("aside", ["", "sidebar", "widget-area", "related"], "side"),
    ("div", ["sidebar", "side", "widget", "related", "recommended", "popular", "more-stories", "trending", "see-also"], "side"),
    ("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "sponsor", "adsense", "promotion"], "prose"),
    ("section", ["promo", "ad", "newsletter", "related"], "prose"),
    ("div", ["cookie", "cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "gdpr", "disclaimer", "warning", "paywall"], "prose"),
    ("div", ["share", "social", "social-share", "follow", "meta", "byline-links", "tags"], "links"),
    ("form", ["", "search", "newsletter", "login", "subscribe", "contact"], "form"),
    ("div", ["search", "newsletter", "subscribe", "signup", "login"], "form"),
    ("div", ["comments", "comment-list", "comments-area", "discussion", "responses", "replies", "reader-comments", "disqus"], "comments"),
    ("section", ["comments", "comment-section", "responses"], "comments"),
    ("ol", ["comments", "commentlist", "comment-list"], "comments"),
]
#: Parts that also stand inside an article.
INSIDE = [p for p in BOILERPLATE if p[2] in ("prose", "links", "side", "form")]
SYLLABLES = "an be co du el fa ge hi in jo ka lu me no or pa qui re sa te un ver wi ya zo".split()

#: A part: (tag, attributes, label, children), children being parts and texts.
Part = tuple


def _word(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _say(r: random.Random, low: int, high: int) -> str:
    """Sentences of ``low`` to ``high`` words in all."""
    n, out = r.randint(low, high), []
    while n > 0:
        k = min(n, r.randint(3, 16))
        words = [_word(r) for _ in range(k)]
        for i in range(len(words) - 1):
            if r.random() < 0.08:
                words[i] += ","
        out.append(" ".join(words).capitalize() + r.choice([".", ".", ".", "!", "?"]))
        n -= k
    return " ".join(out)


def _named(r: random.Random, name: str) -> str:
    return f' {r.choice(["class", "class", "id"])}="{name}{r.choice(["", "", " c1", " box"])}"' if name else ""


def _links(r: random.Random, label: int, n: int) -> list[Part]:
    return [("li", "", label, [("a", ' href="/x"', label, [" ".join(_word(r) for _ in range(r.randint(1, 5)))])]) for _ in range(n)]


def _boilerplate(r: random.Random, kinds: list) -> Part:
    tag, names, kind = r.choice(kinds)
    inside: list
    if kind == "links":
        inside = [("ul", "", 0, _links(r, 0, r.randint(1, 9)))] if r.random() < 0.7 else [("a", "", 0, [_word(r)]) for _ in range(r.randint(1, 6))]
    elif kind == "items":
        inside = _links(r, 0, r.randint(1, 9))
    elif kind == "head":
        inside = [(r.choice(["h1", "div", "p", "a"]), "", 0, [_say(r, 1, 6)])]
        if r.random() < 0.5:
            inside.append(("nav", "", 0, [("ul", "", 0, _links(r, 0, 4))]))
    elif kind == "foot":
        inside = [r.choice(["&copy; ", "Copyright 2020 ", ""]) + _say(r, 1, 14)] if r.random() < 0.6 else [("p", "", 0, [_say(r, 2, 20)]), ("ul", "", 0, _links(r, 0, 4))]
    elif kind == "side":
        inside = [("h3", "", 0, [_say(r, 1, 4)]), ("ul", "", 0, _links(r, 0, r.randint(2, 7)))]
        if r.random() < 0.4:
            inside.append(("p", "", 0, [_say(r, 3, 40)]))
    elif kind == "prose":
        inside = [_say(r, 2, 15)] if r.random() < 0.5 else [("p", "", 0, [_say(r, 3, 40)]) for _ in range(r.randint(1, 2))]
    elif kind == "form":
        inside = [("label", "", 0, [_say(r, 1, 4)]), ("input", "", 0, []), ("button", "", 0, [_word(r)])]
        if r.random() < 0.3:
            inside.insert(0, ("p", "", 0, [_say(r, 3, 15)]))
    else:
        item = "li" if tag == "ol" else r.choice(["div", "article", "p"])
        inside = [] if tag == "ol" else [("h3", "", 0, [_say(r, 1, 3)])]
        for _ in range(r.randint(1, 5)):
            body = [_say(r, 3, 60)] if item == "p" else [("p", "", 0, [_say(r, 3, 60)])]
            inside.append((item, r.choice(["", _named(r, "comment")]), 0, body))
    return (tag, _named(r, r.choice(names)), 0, inside)


def _content(r: random.Random) -> Part:
    inside: list = []
    if r.random() < 0.8:
        title = (r.choice(["h1", "h1", "h2"]), "", 1, [_say(r, 1, 10)])
        inside.append(title if r.random() < 0.8 else ("header", "", 1, [title]))
    for _ in range(r.randint(1, 12)):
        x = r.random()
        if x < 0.72:
            inside.append(("p", r.choice(["", "", "", ' class="lead"']), 1, [_say(r, *r.choice([(1, 4), (4, 30), (30, 120)]))]))
        elif x < 0.78:
            inside.append((r.choice(["h2", "h3", "h4"]), "", 1, [_say(r, 1, 6)]))
        elif x < 0.84:
            inside.append((r.choice(["ul", "ol"]), "", 1, [("li", "", 1, [_say(r, 1, 25)]) for _ in range(r.randint(2, 6))]))
        elif x < 0.88:
            inside.append(("blockquote", "", 1, [("p", "", 1, [_say(r, 4, 40)])]))
        elif x < 0.91:
            inside.append(("table", "", 1, [("tr", "", 1, [("td", "", 1, [_say(r, 1, 5)]) for _ in range(2)]) for _ in range(2)]))
        elif x < 0.93:
            inside.append(("figure", "", 1, [("figcaption", "", 1, [_say(r, 2, 12)])]))
        elif x < 0.95:
            inside.append(("details", "", 1, [("summary", "", 1, [_say(r, 1, 5)]), _say(r, 2, 30) if r.random() < 0.5 else ("p", "", 1, [_say(r, 2, 30)])]))
        else:
            inside.append(_boilerplate(r, INSIDE))
    tag = r.choice(CONTENT_TAGS)
    name = r.choice(CONTENT_NAMES) if tag in ("article", "main") else r.choice([n for n in CONTENT_NAMES if n])
    part = (tag, _named(r, name), 1, inside)
    return ("table", "", 0, [("tr", "", 0, [part])]) if tag == "td" else part


def _bare(r: random.Random) -> Part:
    """A page that is hardly more than its article: one element, loose paragraphs or plain text."""
    x = r.random()
    if x < 0.5:
        few = [("p", "", 1, [_say(r, *r.choice([(1, 6), (4, 30)]))]) for _ in range(r.randint(1, 2))]
        if r.random() < 0.3:
            few.insert(0, ("h1", "", 1, [_say(r, 1, 6)]))
        inside: list = [(r.choice(["article", "article", "main", "section", "div"]), "", 1, few)]
        within = 0
    elif x < 0.7:
        inside, within = [("p", "", 1, [_say(r, 1, 40)]) for _ in range(r.randint(1, 4))], 0
    else:
        inside, within = [_say(r, 2, 40)], 1
    if r.random() < 0.5:
        inside, within = [("html", "", 0, [("body", "", within, inside)])], 0
    return ("#page", "", within, inside)


def labelled_page(seed: int) -> Part:
    r = random.Random(seed)
    if r.random() < 0.15:
        return _bare(r)
    parts = [_boilerplate(r, BOILERPLATE) for _ in range(r.randint(0, 4))]
    parts.append(_content(r))
    parts += [_boilerplate(r, BOILERPLATE) for _ in range(r.randint(0, 4))]
    for _ in range(r.choice([0, 0, 1, 2])):
        parts = [("div", _named(r, r.choice(WRAPPER_NAMES)), 0, parts)]
    return ("#page", "", 0, parts if r.random() < 0.1 else [("html", "", 0, [("body", "", 0, parts)])])


def page_html(part: Part | str) -> str:
    if isinstance(part, str):
        return part
    tag, attributes, _, inside = part
    within = "".join(map(page_html, inside))
    return within if tag == "#page" else f"<{tag}{attributes}>{within}" + ("" if tag == "input" else f"</{tag}>")
