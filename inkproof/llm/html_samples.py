"""Made-up pages with known main content, from which the extraction model is trained.

Every block carries data-y: m (mixed), c (main content) or d (dropped); the model never sees it. The
layouts vary in elements, names, nesting and order, with and without telling names.
"""

from __future__ import annotations

import random

#: Names (fixed values) that sites give to the parts of a page.
NAMES = {
    "content": "article content post entry main story body text post-content entry-content article-body page-content blog-post main-content hentry".split(),
    "wrap": "page wrapper container site layout row col inner wrap grid outer root app".split(),
    "header": "header masthead top topbar site-header branding page-header logo banner-top".split(),
    "menu": "nav menu navbar navigation main-menu breadcrumb breadcrumbs links tabs nav-links pagination pager toc".split(),
    "footer": "footer site-footer bottom copyright colophon page-footer legal foot".split(),
    "side": "sidebar aside side widget secondary rail right-column widget-area related popular recent archive tags".split(),
    "ad": "ad ads advert advertisement sponsored promo banner ad-slot sponsor adsbox promotion".split(),
    "notice": "cookie notice alert gdpr consent cookie-banner message warning popup modal overlay subscribe-notice".split(),
    "form": "search form login newsletter subscribe signup contact search-form comment-form register".split(),
    "comments": "comments comment responses discussion comment-list replies disqus comments-area reader-comments feedback".split(),
    "share": "share social sharing share-buttons follow author-box meta byline tags-links".split(),
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.r
        out = []
        for i in range(r.randint(least, most)):
            w = "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.choice((1, 1, 2, 2, 3, 4))))
            out.append(w + r.choice(("", "", "", "", "", "", ",", ".")))
        return " ".join(out).capitalize() + r.choice((".", ".", "", "!"))

    def open(self, kind: str, y: str, tags: tuple[str, ...], named: float = 0.8) -> tuple[str, str]:
        r = self.r
        tag = r.choice(tags)
        bare = tag not in ("div", "section", "ul", "ol", "table", "td") and r.random() < 0.6
        attributes = ""
        if not bare and r.random() < named:
            own = r.choice(NAMES[kind]) + (f" {r.choice(NAMES[kind])}" if r.random() < 0.3 else "")
            attributes = f' {r.choice(("class", "class", "id"))}="{own}"'
        return f'<{tag}{attributes} data-y="{y}">', f"</{tag}>"

    def box(self, kind: str, y: str, tags: tuple[str, ...], inner: str, named: float = 0.9) -> str:
        a, b = self.open(kind, y, tags, named)
        return f"{a}{inner}{b}"

    def paragraph(self, least: int = 5, most: int = 90) -> str:
        r = self.r
        text = self.words(least, most)
        if r.random() < 0.25:
            text = f"<a href='/x'>{self.words(1, 4)}</a> {text}"
        if r.random() < 0.2:
            text = f"<b>{text}<br>" + ("</b>" if r.random() < 0.5 else "")
        return text

    def menu(self) -> str:
        r = self.r
        links = [f"<a href='/{i}'>{self.words(1, 3)}</a>" for i in range(r.randint(2, 14))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
        return r.choice((" | ", " ", "")).join(links)

    def article(self) -> str:
        r = self.r
        parts = [f"<h1>{self.words(2, 10)}</h1>"] if r.random() < 0.8 else []
        if r.random() < 0.12:  # hardly anything
            return "".join(parts) + f"<p>{self.paragraph(1, 4)}</p>"
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14, 25))):
            kind = r.random()
            if kind < 0.74:
                parts.append(f"<p>{self.paragraph(1 if r.random() < 0.25 else 5)}</p>")
            elif kind < 0.8:
                parts.append(f"<h2>{self.words(1, 7)}</h2>")
            elif kind < 0.85:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.88:
                parts.append(f"<blockquote><p>{self.words(8, 40)}</p></blockquote>")
            elif kind < 0.9:
                parts.append(f"<pre>{self.words(5, 30)}</pre>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 8)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.95:
                parts.append(f"<figure><img src='a.png'><figcaption>{self.words(3, 12)}</figcaption></figure>")
            elif kind < 0.97:
                parts.append(f"<div><p>{self.words(8, 40)}</p></div>")
            else:
                parts.append(self.noise())
        if r.random() < 0.15:
            parts.append(self.noise())
        return "".join(parts)

    def noise(self) -> str:
        """What stands inside or beside an article without being part of it."""
        r = self.r
        kind = r.choice(("ad", "share", "notice", "form", "side"))
        inner = {"ad": self.words(2, 20), "share": self.menu(), "notice": f"<p>{self.words(4, 30)}</p>", "form": self.form(), "side": f"<h3>{self.words(1, 3)}</h3>{self.menu()}"}[kind]
        return self.box(kind, "d", ("form", "div") if kind == "form" else ("aside", "div") if kind == "side" else ("div", "div", "section", "aside"), inner, 1.0)

    def form(self) -> str:
        return f"<label>{self.words(1, 4)}</label><input name='q'><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(3, 12)}</p>" if self.r.random() < 0.4 else "")

    def comments(self) -> str:
        r = self.r
        items = []
        for _ in range(r.randint(1, 8)):
            body = f"<b>{self.words(1, 2)}</b> <p>{self.words(3, 60)}</p>" + (f"<p>{self.words(3, 40)}</p>" if r.random() < 0.3 else "")
            items.append(self.box("comments", "d", ("div", "li", "article"), body, 0.7))
        return self.box("comments", "d", ("section", "div", "ol"), (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(items), 1.0)

    def side(self) -> str:
        r = self.r
        inner = ""
        for _ in range(r.randint(1, 4)):
            inner += self.box("side", "d", ("div", "section", "div"), r.choice((f"<h3>{self.words(1, 3)}</h3>{self.menu()}", f"<h4>{self.words(1, 3)}</h4><p>{self.words(3, 35)}</p>")), 0.7)
        return self.box("side", "d", ("aside", "aside", "div"), inner, 1.0)

    def page(self) -> str:
        r = self.r
        chance = lambda p: r.random() < p
        before = []
        if chance(0.4):
            before.append(self.box("notice", "d", ("div", "section"), f"<p>{self.words(5, 35)}</p>" + ("<button>ok</button>" if chance(0.6) else ""), 1.0))
        if chance(0.6):
            before.append(self.box("header", "d", ("header", "div"), (f"<h1>{self.words(1, 4)}</h1>" if chance(0.5) else f"<p>{self.words(1, 5)}</p>") + (self.box("menu", "d", ("nav", "div"), self.menu()) if chance(0.4) else "") + (self.words(2, 10) if chance(0.3) else "")))
        if chance(0.7):
            before.append(self.box("menu", "d", ("nav", "nav", "div", "ul"), self.menu()))
        if chance(0.4):
            before.append(self.box("form", "d", ("form", "div"), self.form(), 1.0))
        if chance(0.5):
            before.append(self.box("ad", "d", ("div", "aside", "section"), self.words(2, 25), 1.0))
        r.shuffle(before)
        body = self.article()
        if chance(0.85):
            tags = ("article", "article", "main", "div", "div", "section", "td")
            main = self.box("content", "c", tags, body, 0.85 if chance(0.9) else 0.0)
        else:
            main = body.replace("<p>", '<p data-y="c">').replace("<h1>", '<h1 data-y="c">').replace("<h2>", '<h2 data-y="c">')
            for tag in ("ul", "blockquote", "pre", "table", "figure", "div"):
                main = main.replace(f"<{tag}>", f'<{tag} data-y="c">')
        after = [self.comments()] if chance(0.45) else []
        if chance(0.5):
            after.append(self.side())
        if chance(0.3):
            after.append(self.noise())
        r.shuffle(after)
        if chance(0.15):
            before.append(self.side())
        middle = "".join([main, *after])
        for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
            middle = self.box("wrap", "m", ("div", "div", "section", "main"), middle, 0.7)
        foot = [self.box("footer", "d", ("footer", "footer", "div"), (f"&copy; {self.words(2, 14)}" if chance(0.6) else f"<p>{self.words(3, 30)}</p>") + (self.menu() if chance(0.3) else ""))] if chance(0.85) else []
        if chance(0.2):
            foot.append(self.box("notice", "d", ("div",), f"<p>{self.words(5, 30)}</p>", 1.0))
        page = "".join([*before, middle, *foot])
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            page = self.box("wrap", "m", ("div",), page, 0.7)
        head = f"<head data-y='d'><meta charset='utf-8'><title>{self.words(2, 6)}</title><style>p{{}}</style></head>" if chance(0.8) else ""
        return f'<!DOCTYPE html><html data-y="m">{head}<body data-y="m">{page}</body></html>'.replace("data-y='d'", 'data-y="d"')


def pages(n: int, seed: int = 1) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
