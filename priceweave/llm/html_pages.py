"""Made-up web pages with known main text, from a seed: what the extraction model is fitted on."""

from __future__ import annotations

import random

_SYLLABLES = "an ber cor del en fo gri hal in jo ka lor men nu or pel qui ros sta tor und ver wil xa yor zen tion ment eau ble ing".split()
_MAIN = ["article", "article", "article", "article", "main", "main", "div class=content", "div id=content", "div class=post-body", "section class=entry", "div class='article-text story'", "td", "div", "section", "div itemprop=articleBody", "div role=main", "div class=page-main"]


class Page:
    """Pieces of html; main text is marked by a private-use character at its start that the labelling removes."""

    MARK = ""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.4 and len(words) > 4:
            words[len(words) // 2] += ","
        if self.r.random() < 0.1:
            words[0] = f"<a href=/{words[0]}>{words[0]}</a>"
        return " ".join(words).capitalize() + "."

    def text(self, low: int = 1, high: int = 7) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        return out.replace(" ", self.r.choice((" ", " ", " ", "### ", "&amp; ")), 3)

    def title(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(2, 9))).capitalize()

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def wrap(self, opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def links(self, n: int) -> str:
        items = [f"<a href=/{self.word()}>{self.title() if self.r.random() < 0.3 else self.word()}</a>" for _ in range(n)]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" if self.r.random() < 0.9 else f"<li>{i}" for i in items) + "</ul>"
        return self.pick(" | ", " ", " &middot; ").join(items) if style < 0.85 else "".join(f"<div>{i}</div>" for i in items)

    def menu(self) -> str:
        return self.wrap(self.pick("nav", "nav class=main-nav", "div class=menu", "div id=navigation", "div class='navbar top'", "ul class=breadcrumb", "div role=navigation", "div class=toc-menu"), self.links(self.r.randint(3, 12)))

    def header(self) -> str:
        return self.wrap(self.pick("header", "div class=header", "div id=masthead", "header class=site-header", "div class=top-bar"), f"<{(t := self.pick('div', 'p', 'span', 'h2', 'h1'))}>{self.title()}</{t}>" + (self.menu() if self.r.random() < 0.5 else "") + (f"<p>{self.sentence()}</p>" if self.r.random() < 0.3 else ""))

    def footer(self) -> str:
        inner = f"{self.pick('&copy; ', 'Copyright ', '')}{self.word()}.example.net {self.pick('&middot;', '-', '')} {self.sentence()}"
        inner = self.pick(inner, f"<p>{inner}</p>", f"<div>{inner}</div>") + (self.links(self.r.randint(2, 6)) if self.r.random() < 0.5 else "") + (f"<p>{self.text(1, 3)}</p>" if self.r.random() < 0.3 else "")
        return self.wrap(self.pick("footer", "footer", "div class=footer", "div id=footer", "footer class=site-footer", "div class='bottom legal'"), inner)

    def advert(self) -> str:
        return self.wrap(self.pick("div class=ad", "div class=advert", "aside class=ads", "div id=ad-slot-3", "div class='banner promo'", "div class=sponsored", "p class=advertisement", "ins class=adsbygoogle", "section class=promo-box"), self.pick(self.text(1, 3), f"<p>{self.text(1, 2)}</p>", f"<a href=/x>{self.sentence()}</a>", f"<h4>{self.title()}</h4><p>{self.text(1, 2)}</p>"))

    def notice(self) -> str:
        return self.wrap(self.pick("div class=cookie-notice", "div id=cookie-banner", "div class='consent overlay'", "div role=dialog", "div class=alert", "div class=gdpr", "section class=notice", "div class=popup"), self.pick(self.text(1, 3), f"<p>{self.text(1, 3)}</p><button>{self.word()}</button>"))

    def sidebar(self) -> str:
        inner = "".join(self.pick(f"<h3>{self.title()}</h3>{self.links(self.r.randint(2, 7))}", f"<p>{self.text(1, 2)}</p>", f"<div class=widget><h4>{self.title()}</h4><p>{self.text(1, 3)}</p></div>") for _ in range(self.r.randint(1, 3)))
        return self.wrap(self.pick("aside", "div class=sidebar", "div id=sidebar", "aside class=widget-area", "div class='right rail'", "div role=complementary"), inner)

    def related(self) -> str:
        return self.wrap(self.pick("div class=related", "section class=recommended", "div class=more-stories", "aside class=see-also", "div class='share social'"), f"<h3>{self.title()}</h3>" + self.links(self.r.randint(2, 6)))

    def form(self) -> str:
        return self.wrap(self.pick("form", "form class=newsletter", "form id=search", "div class=subscribe", "form action=/login"), f"<label>{self.sentence(2, 6)}</label><input name=q>" + self.pick("", f"<p>{self.text(1, 2)}</p>") + f"<button>{self.word()}</button>")

    def comments(self) -> str:
        one = self.pick("div class=comment", "li class=comment-body", "article class=comment", "div class=reply", "li", "div class=user-post")
        body = lambda: self.pick(self.text(1, 4), f"<p>{self.text(1, 4)}</p>", f"<b>{self.word()}</b><p>{self.text(1, 4)}</p>")
        inner = "".join(self.wrap(one, body()) for _ in range(self.r.randint(1, 7)))
        inner = f"<h3>{self.title()}</h3>" * (self.r.random() < 0.6) + (f"<ol>{inner}</ol>" if one.startswith("li") else inner) + (self.form() if self.r.random() < 0.3 else "")
        return self.wrap(self.pick("div class=comments", "section id=comments", "div id=disqus_thread", "section class=discussion", "div class=comment-list", "div class=responses"), inner)

    def article(self, opening: str) -> str:
        m = self.MARK
        parts = [f"<{(h := self.pick('h1', 'h1', 'h2'))}>{m}{self.title()}</{h}>"] if self.r.random() < 0.85 else []
        if parts and self.r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        bare = self.r.random() < 0.06
        for _ in range(self.r.choice((1, 1, 2, 3, 4, 5, 6, 9, 14))):
            kind = self.r.random()
            if bare:
                parts.append(f"<div>{m}{self.text()}</div>" if kind < 0.5 else f"{m}{self.text()}<hr>")
            elif kind < 0.74:
                parts.append(f"<p>{m}{self.text(1, self.r.choice((1, 3, 9)))}" + "</p>" * (self.r.random() < 0.9))
            elif kind < 0.8:
                parts.append(f"<p>{m}<b>{self.text(1, 2)}<br>")
            elif kind < 0.84:
                parts.append(f"<{(h := self.pick('h2', 'h3'))}>{m}{self.title()}</{h}>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{m}{self.sentence()}</li>" for _ in range(self.r.randint(1, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote><p>{m}{self.text(1, 3)}</p></blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{m}{self.word()}</td><td>{m}{self.sentence(1, 5)}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>")
            elif kind < 0.97:
                parts.append(f"<pre>{m}{self.sentence()}\n{self.sentence()}</pre>")
            else:
                parts.append(f"<figure><img src=x><figcaption>{m}{self.sentence()}</figcaption></figure>")
        for extra, chance in ((self.advert, 0.15), (self.related, 0.1), (self.form, 0.06), (self.menu, 0.04), (self.comments, 0.06)):
            if self.r.random() < chance:
                parts.insert(self.r.randint(0, len(parts)) if extra == self.advert else len(parts), extra())
        inner = "".join(parts)
        if self.r.random() < 0.2:
            inner = self.wrap(self.pick("div", "div class=inner", "section", "div class=body"), inner)
        return self.wrap(opening, inner)

    def html(self) -> str:
        parts = []
        for make, chance in ((self.notice, 0.2), (self.header, 0.45), (self.menu, 0.7), (self.advert, 0.5), (self.form, 0.12), (self.sidebar, 0.15)):
            if self.r.random() < chance:
                parts.append(make())
        opening = self.r.choice(_MAIN)
        body = self.article(opening)
        if opening == "td":
            body = f"<table><tr>{f'<td>{self.links(5)}</td>' if self.r.random() < 0.7 else ''}{body}</tr></table>"
        parts.append(body)
        for make, chance in ((self.advert, 0.15), (self.related, 0.2), (self.comments, 0.35), (self.sidebar, 0.25), (self.form, 0.12), (self.notice, 0.1), (self.footer, 0.85)):
            if self.r.random() < chance:
                parts.append(make())
        inner = "".join(parts)
        if self.r.random() < 0.3:
            inner = self.wrap(self.pick("div", "div id=wrapper", "div class=container", "div class=page"), inner)
        return f"<!DOCTYPE html><html><head><title>{self.title()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{inner}" + "</body></html>" * (self.r.random() < 0.9)
