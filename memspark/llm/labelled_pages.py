"""Labelled pages for fitting the main-text model: page layouts in common markup, filled with invented words.

Every layout says for each of its blocks whether it is main text. The parts are drawn anew for each page, so that no single
tag or class name decides alone.
"""

from __future__ import annotations

import random

CONTENT_CLASSES = ["content", "post", "entry", "article-body", "story", "main-content", "post-content", "entry-content", "text", "body-copy"]
PLAIN_CLASSES = ["wrapper", "container", "row", "col", "inner", "page", "site", "layout", "box", "section", "block", "clearfix"]
MENU = ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "main-menu", "pagination", "toc"]
HEADER = ["header", "masthead", "site-header", "banner", "branding", "top"]
FOOTER = ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"]
SIDEBAR = ["sidebar", "widget", "related", "recommended", "popular", "trending", "side", "secondary", "rail"]
NOTICE = ["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "gdpr-banner", "message", "disclaimer", "overlay"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad-slot", "banner-ad", "sponsor"]
FORM = ["newsletter", "subscribe", "search", "login", "signup", "contact-form", "search-form"]
COMMENTS = ["comments", "comment", "comment-list", "replies", "discussion", "disqus", "responses", "reader-comments"]
SHARE = ["share", "social", "share-buttons", "follow", "tags", "meta", "byline"]


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.html, self.labels = r, [], []

    def word(self) -> str:
        return "".join(self.r.choice(["an", "be", "ti", "ro", "le", "un", "so", "mi", "da", "ke"]) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        out = [self.word() for _ in range(self.r.randint(low, high))]
        return " ".join(out).capitalize() + self.r.choice([".", ".", "", "!"])

    def tag(self, tags: list[str], names: list[str], share: float = 0.9) -> tuple[str, str]:
        tag = self.r.choice(tags)
        if tag in ("div", "section", "ul", "p", "span") or self.r.random() < 0.4:
            if self.r.random() < share:
                return f'<{tag} {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}">', f"</{tag}>"
        return f"<{tag}>", f"</{tag}>"

    def block(self, tags: list[str], low: int, high: int, main: bool, link: float = 0.0) -> None:
        tag = self.r.choice(tags)
        body = self.words(low, high)
        if self.r.random() < link:
            body = f'<a href="/{self.word()}">{body}</a>'
        elif main and self.r.random() < 0.3:
            body = body.replace(" ", f" <a href='/x'>{self.word()}</a> ", 1) if self.r.random() < 0.5 else f"<b>{body}</b>"
        self.html.append(f"<{tag}>{body}" + ("" if tag in ("p", "li") and self.r.random() < 0.2 else f"</{tag}>"))
        self.labels.append(main)

    def within(self, tags: list[str], names: list[str], fill, share: float = 0.9) -> None:
        start, end = self.tag(tags, names, share)
        self.html.append(start)
        fill()
        self.html.append(end)

    def links(self, names: list[str], tags: list[str]) -> None:
        def fill():
            self.html.append("<ul>")
            for _ in range(self.r.randint(2, 7)):
                self.block(["li"], 1, 4, False, 0.95)
            self.html.append("</ul>")
        self.within(tags, names, fill)

    def prose(self, names: list[str], tags: list[str], most: int = 3) -> None:
        self.within(tags, names, lambda: [self.block(self.r.choice([["p"], ["p", "div", "li", "h3"]]),
                                                     2, 40, False, 0.2) for _ in range(self.r.randint(1, most))])

    def bare(self, names: list[str], tags: list[str]) -> None:
        """Text right inside the element."""
        start, end = self.tag(tags, names)
        self.html.append(start + self.r.choice(["", "&copy; "]) + self.words(2, 20) + end)
        self.labels.append(False)

    def form(self) -> None:
        start, end = ("<form>", "</form>") if self.r.random() < 0.6 else self.tag(["form", "div"], FORM, 1.0)
        self.html.append(start)
        self.block(["h3", "p"], 1, 8, False)
        self.block(["p", "div"], 1, 12, False)
        self.html.append('<input type="text">')
        if self.r.random() < 0.3:
            self.block(["textarea"], 1, 12, False)
        if self.r.random() < 0.7:
            self.block(["button"], 1, 2, False)
        self.html.append(end)

    def comments(self) -> None:
        def fill():
            self.block(["h2", "h3"], 1, 4, False)
            for _ in range(self.r.randint(1, 5)):
                self.within(["article", "div", "li", "p", "blockquote"], COMMENTS, lambda: self.block(["p", "div"], 3, 60, False), 0.7)
        start, end = self.tag(["section", "div", "aside"], COMMENTS, 1.0)
        self.html.append(start)
        fill()
        self.html.append(end)

    def boilerplate(self, kinds: list[str]) -> None:
        kind = self.r.choice(kinds)
        if kind == "menu":
            self.links(MENU, ["nav", "nav", "div", "header", "menu"])
        elif kind == "header":
            self.r.choice([self.prose, self.bare, self.links])(HEADER, ["header", "header", "div"])
        elif kind == "footer":
            self.r.choice([self.prose, self.bare, self.bare, self.links])(FOOTER, ["footer", "footer", "div"])
        elif kind == "sidebar":
            self.r.choice([self.prose, self.links, self.bare])(SIDEBAR, ["aside", "aside", "div", "section"])
        elif kind == "notice":
            self.r.choice([self.prose, self.bare])(NOTICE, ["div", "section", "p", "aside", "noscript"])
        elif kind == "advert":
            self.r.choice([self.prose, self.bare, self.bare])(ADVERT, ["div", "aside", "section", "p"])
        elif kind == "share":
            self.r.choice([self.links, self.bare])(SHARE, ["div", "ul", "p"])
        elif kind == "form":
            self.form()
        else:
            self.comments()

    def article(self) -> None:
        def fill():
            if self.r.random() < 0.85:
                self.block(["h1", "h1", "h2"], 2, 14, True)
            for _ in range(self.r.choice([0, 1, 2, 3, 5, 8, 14])):
                x = self.r.random()
                if x < 0.74:
                    self.block(["p"], 1, 120, True, 0.02)
                elif x < 0.82:
                    self.block(["h2", "h3", "h4"], 1, 8, True)
                elif x < 0.87:
                    self.block(["blockquote", "pre", "figcaption", "div"], 3, 40, True)
                elif x < 0.92:
                    self.html.append("<ul>")
                    for _ in range(self.r.randint(1, 4)):
                        self.block(["li"], 1, 30, True, 0.1)
                    self.html.append("</ul>")
                else:
                    self.boilerplate(["advert", "share", "form", "sidebar", "notice", "advert"])
            if self.r.random() < 0.12:
                self.boilerplate(["comments"])
        x = self.r.random()
        if x < 0.55:
            self.html.append(self.r.choice(["<article>", '<article class="post">', f'<article id="{self.word()}">']))
            fill()
            self.html.append("</article>")
        elif x < 0.75:
            self.html.append(self.r.choice(["<main>", '<main id="main">', '<main class="content">']))
            fill()
            self.html.append("</main>")
        else:
            self.within(["div", "section"], CONTENT_CLASSES, fill, 1.0)


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[bool]]]:
    """``n`` pages with a label per block, true for main text."""
    r, out = random.Random(seed), []
    while len(out) < n:
        p = _Page(r)
        p.html.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        depth = r.randint(0, 2)
        for _ in range(depth):
            p.html.append(p.tag(["div"], PLAIN_CLASSES)[0])
        for _ in range(r.randint(0, 4)):
            p.boilerplate(["menu", "menu", "header", "notice", "advert", "form"])
        p.article()
        for _ in range(r.randint(0, 5)):
            p.boilerplate(["footer", "footer", "sidebar", "comments", "advert", "share", "form", "notice", "menu"])
        p.html.append("</div>" * depth + ("</body></html>" if r.random() < 0.9 else ""))
        out.append(("".join(p.html), p.labels))
    return out
