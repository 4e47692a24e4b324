"""Labelled page layouts to train the block labeller on: articles in many wrappings, with the furniture of pages around them."""

from __future__ import annotations

import random

# fixed values: how pages name their parts
ARTICLE = ("article", "main", "div.post-content", "div#content", "section.entry", "div.article-body", "div.story", "main#main", "div.text", "div.blog-post", "section.body", "div.main-content")
WRAPS = ("div", "div.container", "div.wrapper", "div#page", "section", "div.row", "div.layout", "div.col")
FURNITURE = {
    "nav": ("nav", "div.menu", "ul.navigation", "div#nav", "div.navbar", "div.breadcrumbs", "nav.main-menu", "div.topnav", "div.pagination", "div.toc"),
    "header": ("header", "div.header", "div#masthead", "div.site-header", "div.banner", "header.top", "div.logo"),
    "footer": ("footer", "div.footer", "div#footer", "div.site-footer", "footer.bottom", "div.copyright", "div.legal"),
    "side": ("aside", "div.sidebar", "div.widget", "div#sidebar", "aside.related", "div.related-posts", "div.recommended", "section.popular", "div.tags"),
    "notice": ("div.cookie-notice", "div#cookie-banner", "div.consent", "div.alert", "div.notice", "div.gdpr", "div.popup", "div.modal", "div.newsletter", "div.subscribe"),
    "ad": ("div.ad", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div#ad-top", "ins.adsbygoogle", "aside.ad", "div.banner-ad", "section.sponsor", "div.ads"),
    "form": ("form", "form.search", "div.login-form", "form#contact", "fieldset", "form.signup", "div.search-box"),
    "comments": ("div.comments", "section#comments", "ol.comment-list", "div.comment-thread", "div.responses", "section.discussion", "div#disqus", "div.reader-comments", "ul.replies"),
    "share": ("div.share", "div.social", "ul.social-links", "div.sharing-buttons"),
    "byline": ("div.byline", "p.meta", "div.author-box", "div.post-meta"),
}
PHRASES = {
    "nav": "home about contact news products services blog archive next previous menu login search".split(),
    "footer": "copyright all rights reserved privacy policy terms imprint contact sitemap".split(),
    "notice": "we use cookies to improve your experience accept decline settings subscribe newsletter consent".split(),
    "ad": "sponsored advertisement buy now offer sale discount free shop click here deal".split(),
    "form": "name email password submit send search message username login sign up".split(),
    "comments": "reply says posted ago like report great thanks agree comment user".split(),
    "side": "related popular recent posts tags read more trending see also".split(),
    "share": "share tweet facebook email print link".split(),
    "header": "welcome site logo daily the magazine online".split(),
    "byline": "by author published updated min read".split(),
}
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zu an en in on er st th ing ed le".split()


class Layouts:
    """Random pages as html, with the text and label of each block in order."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

        self.language()

    def language(self) -> None:
        """Every page has words of its own, the first of them frequent."""
        self.words = ["".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 4))) for _ in range(150)]

    def word(self) -> str:
        return self.words[int(150 * self.random.random() ** 2)]

    def prose(self, least: int, most: int) -> str:
        words = [self.word() for _ in range(self.random.randint(least, most))]
        for i in range(0, len(words), 9):
            words[i] = words[i].capitalize()
            words[i - 1] += self.random.choice(".,")
        return " ".join(words)

    def phrase(self, role: str) -> str:
        own = PHRASES[role]
        return " ".join(self.random.choice(own) if self.random.random() < 0.6 else self.word() for _ in range(self.random.randint(1, 8)))

    def tag(self, name: str) -> tuple[str, str]:
        kind, *more = name.replace("#", " #").replace(".", " .").split()
        attributes = "".join(f' {"id" if m[0] == "#" else "class"}="{m[1:]}"' for m in more)
        return f"<{kind}{attributes}>", f"</{kind}>"

    def furniture(self, role: str, out: list) -> None:
        pick, r = self.random.choice, self.random.random
        # pages use html's own tag for a part as often as all other names together
        begin, end = self.tag(FURNITURE[role][0] if r() < 0.4 else pick(FURNITURE[role]))
        out.append((begin, None))
        prosaic = {"ad": 0.6, "footer": 0.8, "comments": 0.8, "notice": 0.5, "side": 0.5, "header": 0.4}.get(role, 0.4)
        for _ in range(self.random.randint(1, 7 if role in ("nav", "comments", "side", "form") else 3)):
            text = self.prose(1, pick((3, 8, 60)) if role != "nav" else 3) if r() < prosaic else self.phrase(role)
            if role == "footer" and r() < 0.5:
                text = f"\u00a9 {self.word()}.{self.word()} \u00b7 {text}"
            if role == "nav" or (role in ("side", "footer", "share") and r() < 0.6):
                out += [("<li>" if begin.startswith("<ul") or r() < 0.6 else "<div>", None), (f'<a href="/{self.word()}">{text}</a>', 0), ("</li>" if r() < 0.9 else "", None)]
            elif role == "form":
                out += [("<label>", None), (text, 0), ("</label><input>", None), (("<button>Send</button>", 0) if r() < 0.3 else ("", None))]
            elif role == "comments":
                out += [(pick(("<div class='comment'>", "<li class='comment'>", "<div>", "<p>")), None), (text, 0), ("</div>" if r() < 0.5 else "", None)]
            elif r() < 0.3:
                out.append((text, 0))
            else:
                out += [(pick(("<p>", "<div>", "<span>", "")), None), (text, 0), (pick(("</p>", "</div>", "")), None)]
        out.append((end, None))

    def article(self, out: list) -> None:
        r, pick = self.random.random, self.random.choice
        if r() < 0.9:
            out += [("<h1>", None), (self.prose(2, 14), 1), ("</h1>", None)]
        if r() < 0.2:
            self.furniture("byline", out)
        for _ in range(self.random.randint(1, 12)):
            kind = pick(("p",) * 10 + ("h2", "h3", "blockquote", "pre", "ul", "table", "div", "broken"))
            if kind == "ul":
                out.append(("<ul>", None))
                for _ in range(self.random.randint(1, 5)):
                    out += [("<li>", None), (self.prose(1, 25), 1), ("</li>", None)]
                out.append(("</ul>", None))
            elif kind == "table":
                out += [("<table><tr><td>", None), (self.prose(1, 10), 1), ("</td></tr></table>", None)]
            elif kind == "broken":
                out += [("<p><b>", None), (self.prose(1, 80), 1), ("<br><p>", None), (self.prose(1, 80), 1), ("</p>", None)]
            else:
                text = self.prose(1, 120) if r() < 0.8 else f'{self.prose(1, 20)} <a href="/{self.word()}">{self.word()}</a> {self.prose(1, 20)}'
                out += [(f"<{kind}>", None), (text, 1), (f"</{kind}>", None)]
            if r() < 0.06:
                self.furniture(pick(("ad", "notice", "share", "side")), out)

    def page(self) -> list[tuple[str, int | None]]:
        """Pieces of html; those with text have a label."""
        r, pick = self.random.random, self.random.choice
        self.language()
        out: list[tuple[str, int | None]] = [("<html><body>", None)]
        ends = []
        for _ in range(pick((0, 0, 1, 2))):
            begin, end = self.tag(pick(WRAPS))
            out.append((begin, None))
            ends.append(end)
        for role in ("notice", "header", "nav", "ad", "form", "side"):
            if r() < 0.5:
                self.furniture(role, out)
        begin, end = self.tag(ARTICLE[0] if r() < 0.3 else pick(ARTICLE)) if r() < 0.92 else ("", "")
        out.append((begin, None))
        self.article(out)
        if r() < 0.15:
            self.furniture("comments", out)
        out.append((end, None))
        for role in ("share", "comments", "side", "form", "ad", "nav", "notice", "footer"):
            if r() < 0.45:
                self.furniture(role, out)
        if r() < 0.8:
            out += [(e, None) for e in reversed(ends)] + [("</body></html>", None)]
        return out
