"""Labelled pages for the tree model: layouts of many kinds, filled with invented words.

Each page is HTML and a label for every block of text in page order. Words are
random, so that only structure, names and lengths can be learned.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go ha in jo ka lu me no or pe qui ra so ti un ver wo xi yo ze".split()
_CONTENT = ["content", "post-content", "entry-content", "article-body", "story", "post", "main-content", "article", "text", "body-copy", "page-content", "blog-post"]
_NOISE = {
    "nav": ["nav", "menu", "main-nav", "navbar", "breadcrumbs", "topbar", "pagination", "toc-links"],
    "header": ["header", "site-header", "masthead", "banner", "page-header", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon"],
    "side": ["sidebar", "side", "aside", "widget", "related", "related-posts", "popular", "tags", "trending", "recommended", "author-bio"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "sponsor"],
    "notice": ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "cookie-banner", "overlay"],
    "form": ["form", "newsletter", "subscribe", "search", "signup", "login", "contact-form"],
    "comments": ["comments", "comment-list", "comment", "responses", "discussion", "reader-comments", "replies"],
    "share": ["share", "social", "share-buttons", "follow-us", "print"],
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int, stops: bool = True) -> str:
        out, rng = [], self.rng
        for i in range(rng.randint(low, high)):
            w = self.word()
            if i == 0 or out[-1].endswith("."):
                w = w.capitalize()
            out.append(w + ("." if stops and rng.random() < 0.12 else "," if stops and rng.random() < 0.08 else ""))
        text = " ".join(out)
        return text + ("." if stops and not text.endswith(".") else "")

    def raw(self, markup: str) -> None:
        self.out.append(markup)

    def block(self, tag: str, text: str, content: bool, attributes: str = "") -> None:
        end = "" if tag in ("p", "li") and self.rng.random() < 0.15 else f"</{tag}>"
        self.out.append(f"<{tag}{attributes}>{text}{end}")
        self.labels.append(content)

    def bare(self, text: str, content: bool) -> None:
        self.out.append(text)
        self.labels.append(content)

    def named(self, names: list[str]) -> str:
        name, rng = self.rng.choice(names), self.rng
        if rng.random() < 0.2:
            name = f"{name} {self.word()}"
        return rng.choice([f' class="{name}"', f' id="{name}"', f" class='{name}'", f' class="{self.word()} {name}"'])

    def links(self, content: bool = False) -> None:
        self.raw("<ul>")
        for _ in range(self.rng.randint(2, 8)):
            self.block("li", f'<a href="/{self.word()}">{self.words(1, 3, False)}</a>', content)
        self.raw("</ul>")

    def noise(self, kind: str) -> None:
        rng, names = self.rng, _NOISE[kind]
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "section" if kind == "comments" else "div")
        tag = semantic if rng.random() < 0.55 else rng.choice(["div", "section", "div"])
        attributes = self.named(names) if tag != semantic or semantic in ("div", "section") or rng.random() < 0.4 else ""
        self.raw(f"<{tag}{attributes}>")
        if kind in ("nav", "share"):
            self.links()
        elif kind == "header":
            self.block(rng.choice(["p", "div", "h1", "h2"]), self.words(1, 5, False), False)
            if rng.random() < 0.5:
                self.links()
        elif kind == "footer":
            if rng.random() < 0.4:
                self.links()
            text = f"&copy; {self.word()}.example &middot; {self.words(3, 14)}"
            self.bare(text, False) if rng.random() < 0.5 else self.block("p", text, False)
        elif kind == "side":
            if rng.random() < 0.6:
                self.block(rng.choice(["h2", "h3", "h4"]), self.words(1, 3, False), False)
            self.links() if rng.random() < 0.6 else [self.block("p", self.words(5, 40), False) for _ in range(rng.randint(1, 3))]
        elif kind == "ad":
            text = self.words(3, 30)
            self.bare(text, False) if rng.random() < 0.6 else self.block("p", text, False)
        elif kind == "notice":
            self.block("p", self.words(6, 35), False) if rng.random() < 0.6 else self.bare(self.words(5, 30), False)
            if rng.random() < 0.5:
                self.block("button", self.words(1, 2, False), False)
        elif kind == "form":
            self.bare(f"<label>{self.words(1, 5, False)}</label><input type=text>", False)
            self.block("button", self.words(1, 2, False), False)
        elif kind == "comments":
            self.block(rng.choice(["h2", "h3"]), self.words(1, 3, False), False)
            for _ in range(rng.randint(1, 5)):
                inner = rng.choice(["div", "article", "li"])
                self.raw(f"<{inner}{self.named(['comment', 'comment-body', 'reply'])}>" if rng.random() < 0.8 else f"<{inner}>")
                if rng.random() < 0.5:
                    self.block("div", self.words(1, 3, False), False)
                for _ in range(rng.randint(1, 2)):
                    self.block("p", self.words(4, 70), False)
                self.raw(f"</{inner}>")
        self.raw(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.66:
                length = rng.random()
                text = self.words(1, 2, length < 0.08) if length < 0.16 else self.words(1, 12) if length < 0.28 else self.words(15, 160)
                if rng.random() < 0.2:
                    text = f"<b>{text}"
                if rng.random() < 0.2:
                    text += f' <a href="/x">{self.words(1, 4, False)}</a> <em>{self.words(1, 20)}</em>'
                self.block("p", f"{text}<br>" if rng.random() < 0.15 else text, True)
            elif kind < 0.76:
                self.block(rng.choice(["h2", "h3", "h4"]), self.words(1, 8, False), True)
            elif kind < 0.86:
                self.raw("<ul>" if rng.random() < 0.6 else "<ol>")
                for _ in range(rng.randint(2, 5)):
                    self.block("li", self.words(3, 25), True)
                self.raw("</ul>" if self.out[-1] else "")
            elif kind < 0.91:
                self.raw("<table>")
                for _ in range(rng.randint(1, 3)):
                    self.raw("<tr>")
                    for _ in range(2):
                        self.block("td", self.words(1, 5, False), True)
                    self.raw("</tr>")
                self.raw("</table>")
            elif kind < 0.96:
                self.block(rng.choice(["blockquote", "pre", "figcaption"]), self.words(4, 40), True)
            else:
                self.noise(rng.choice(["ad", "share", "side", "form"]))

    def page(self) -> tuple[str, list[bool]]:
        rng = self.rng
        self.raw(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t = '</p>';</script></head><body>")
        for kind in ("notice", "header", "nav", "ad", "form"):
            if rng.random() < {"nav": 0.85, "ad": 0.5}.get(kind, 0.4):
                self.noise(kind)
        wrapped = rng.random()
        opened = []
        if wrapped < 0.35:
            opened.append(rng.choice(["<div class='container'>", "<div id=wrapper>", "<main>", "<div>"]))
        opened.append("<article>" if rng.random() < 0.5 else rng.choice([f"<div{self.named(_CONTENT)}>", f"<section{self.named(_CONTENT)}>", f"<main{self.named(_CONTENT)}>", f"<article{self.named(_CONTENT)}>"]))
        for tag in opened:
            self.raw(tag)
        if rng.random() < 0.85:
            self.block("h1", self.words(2, 12), True)
        self.article()
        after = rng.random()
        if after < 0.25:
            self.noise("comments")
        for tag in reversed(opened):
            self.raw(f"</{tag[1:].split()[0].rstrip('>')}>")
        for kind in ("share", "side", "ad", "comments", "form", "nav", "footer"):
            if rng.random() < {"footer": 0.85, "comments": 0.35}.get(kind, 0.3):
                self.noise(kind)
        if rng.random() < 0.85:
            self.raw("</body></html>")
        return "".join(self.out), self.labels


def labelled(n: int = 240, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """``n`` pages with labels, the same for one seed."""
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]
