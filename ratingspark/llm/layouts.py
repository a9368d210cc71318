"""Generated web pages whose blocks have known roles: frames of many kinds, with
and without telling elements and attributes, around invented prose. An element
with ``data-truth`` says whether its text is main text (``main``) or not
(``other``); what is below it shares its role."""

from __future__ import annotations

import random
from collections.abc import Iterator

_LETTERS = "etaoinsrhldcumfpgwybvkxjqzäéñßøжщ"
_NEUTRAL = ["row", "col-8", "c12", "box", "wrap", "inner", "grid", "x1", "block", "container", "wrapper", "css-1a2b"]


class _Page:
    def __init__(self, draw: random.Random):
        self.draw = draw
        self.loose = draw.random() < 0.3  # ends of paragraphs and items left out
        self.telling = draw.random() < 0.75  # attributes that tell the role
        self.marks = draw.choice([0.0, 0.1, 0.4])
        self.sentences = draw.random() < 0.85  # or prose without marks

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def word(self) -> str:
        return "".join(self.draw.choices(_LETTERS, range(len(_LETTERS), 0, -1), k=self.draw.randint(1, 10)))

    def words(self, least: int, most: int) -> str:
        text = " ".join(self.word() for _ in range(self.draw.randint(least, most)))
        if self.chance(self.marks):  # titles and links have marks, too
            text = self.draw.choice(["{}.", "{},", "{}!", "{}?", "{}:", "{}..."]).format(text)
        return text

    def prose(self, least: int, most: int) -> str:
        left, out = self.draw.randint(least, most), []
        while left > 0:
            n = min(left, self.draw.randint(3, 18))
            sentence = self.words(n, n)
            if self.chance(0.4) and self.sentences:
                sentence = sentence.replace(" ", ", ", 1)
            if self.chance(0.05):
                sentence = f'<a href="/{self.word()}">{sentence}</a>'
            elif self.chance(0.08):
                sentence = f"<{(t := self.draw.choice(['b', 'i', 'em', 'strong', 'span']))}>{sentence}</{t}>"
            out.append(sentence.capitalize() + self.draw.choice("....?!") if self.sentences else sentence)
            left -= n
        return self.draw.choice([" ", " ", " ", " &amp; ", " | "]).join(out)

    def attrs(self, names: list[str], truth: str = "", plain: float = 0.0) -> str:
        out = ""
        if names and self.telling and not self.chance(plain):
            name = self.draw.choice(names)
            out = self.draw.choice([f' class="{name}"', f' id="{name}"', f" class='{name} {self.draw.choice(_NEUTRAL)}'"])
        elif self.chance(0.5):
            out = f' class="{self.draw.choice(_NEUTRAL)}"'
        return out + (f' data-truth="{truth}"' if truth else "")

    def links(self, least: int, most: int) -> str:
        many, end = self.draw.randint(least, most), "" if self.loose else "</li>"
        style = self.draw.random()
        if style < 0.7:
            tag = self.draw.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 5)}</a>{end}' for _ in range(many)) + f"</{tag}>"
        if style < 0.85:
            return "".join(f'<div><a href="#">{self.words(1, 4)}</a></div>' for _ in range(many))
        return self.draw.choice([" | ", " ", "<br>"]).join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(many))

    def paragraph(self, least: int, most: int) -> str:
        body = self.prose(least, most)
        if self.chance(0.15):
            body = f"<b>{body}<br>"
            return f"<p>{body}"
        return f"<p>{body}" + ("" if self.loose and self.chance(0.5) else "</p>")

    # parts that are not main text

    def nav(self) -> str:
        tag = self.draw.choice(["nav", "nav", "div"])
        names = ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "topnav"]
        return f"<{tag}{self.attrs(names, 'other')}>{self.links(2, 14)}</{tag}>"

    def ad(self) -> str:
        tag = self.draw.choice(["div", "div", "div", "aside", "section", "p"])
        names = ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement", "ad_banner"]
        inner = self.prose(1, 25) if self.chance(0.7) else f'<a href="#">{self.words(2, 12)}</a>'
        telling, self.telling = self.telling, True  # nothing else would tell it
        out = f"<{tag}{self.attrs(names, 'other')}>{inner}</{tag}>"
        self.telling = telling
        return out

    def header(self) -> str:
        inner = self.draw.choice([f"<a href='/'>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 8)}</p>",
                                  f"<div class='logo'>{self.words(1, 2)}</div>", f"<h2>{self.words(1, 4)}</h2><p>{self.words(3, 9)}</p>"])
        if self.chance(0.5):
            inner += self.nav()
        if self.chance(0.25):
            inner += self.form()
        tag = self.draw.choice(["header", "header", "div"])
        telling, self.telling = self.telling, self.telling or tag == "div"
        out = f"<{tag}{self.attrs(['header', 'site-header', 'masthead', 'topbar', 'branding'], 'other')}>{inner}</{tag}>"
        self.telling = telling
        return out

    def footer(self) -> str:
        tag = self.draw.choice(["footer", "footer", "footer", "div"])
        inner = self.draw.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose(2, 20)}", f"<p>&copy; 2024 {self.words(1, 8)}</p>",
                                  self.links(2, 8), f"<p>{self.prose(4, 30)}</p>{self.links(2, 5)}", f"Copyright {self.words(1, 6)}"])
        telling, self.telling = self.telling, self.telling or tag == "div"
        out = f"<{tag}{self.attrs(['footer', 'site-footer', 'copyright', 'legal', 'foot'], 'other')}>{inner}</{tag}>"
        self.telling = telling
        return out

    def sidebar(self) -> str:
        tag = self.draw.choice(["aside", "aside", "div", "section"])
        inner = "".join(self.draw.choice([f"<h3>{self.words(1, 4)}</h3>{self.links(2, 9)}", f"<p>{self.prose(4, 30)}</p>",
                                          f"<div class='widget'><h4>{self.words(1, 3)}</h4><p>{self.prose(3, 20)}</p></div>", self.ad()])
                        for _ in range(self.draw.randint(1, 4)))
        telling, self.telling = self.telling, self.telling or tag != "aside"
        out = f"<{tag}{self.attrs(['sidebar', 'side-bar', 'rail', 'widgets', 'right-sidebar', 'secondary'], 'other')}>{inner}</{tag}>"
        self.telling = telling
        return out

    def notice(self) -> str:
        names = ["cookie-notice", "cookie-banner", "consent", "gdpr", "alert", "notice", "popup", "privacy-notice", "notification"]
        inner = self.draw.choice(["<p>{}</p>", "{}", "<div><p>{}</p></div>"]).format(self.prose(4, 40))
        if self.chance(0.6):
            inner += f"<button>{self.words(1, 2)}</button>"
        tag = self.draw.choice(["div", "div", "section", "aside", "dialog"])
        telling, self.telling = self.telling, True
        out = f"<{tag}{self.attrs(names, 'other')}>{inner}</{tag}>"
        self.telling = telling
        return out

    def form(self) -> str:
        inner = (f"<label>{self.words(1, 4)}</label><input type='text'><button>{self.words(1, 2)}</button>"
                 + (f"<p>{self.prose(3, 20)}</p>" if self.chance(0.4) else "") + ("<select><option>a</select>" if self.chance(0.2) else ""))
        inner = f"<form action='/'{self.attrs(['search', 'newsletter', 'signup', 'login'], plain=0.5)}>{inner}</form>"
        if self.chance(0.5):
            return f"<div{self.attrs(['newsletter', 'subscribe', 'search-box', 'signup'], 'other')}><h3>{self.words(1, 5)}</h3>{inner}</div>"
        return f"<div data-truth=\"other\">{inner}</div>"

    def related(self) -> str:
        names = ["related", "share", "social-links", "more-stories", "recommended", "tags", "popular"]
        tag = self.draw.choice(["div", "section", "aside"])
        return f"<{tag}{self.attrs(names, 'other')}>" + (f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.6) else "") + f"{self.links(2, 8)}</{tag}>"

    def comments(self) -> str:
        tag, item = self.draw.choice([("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article"), ("aside", "div")])
        names = ["comments", "comment-list", "disqus_thread", "reader-comments", "discussion", "responses"]
        inner = "".join(f"<{item}{self.attrs(['comment', 'comment-body', 'reply', 'comment-item'], plain=0.3)}>"
                        + (f"<h4>{self.words(1, 2)}</h4>" if self.chance(0.4) else "")
                        + "".join(f"<p>{self.prose(2, 60)}</p>" for _ in range(self.draw.randint(1, 2))) + f"</{item}>"
                        for _ in range(self.draw.randint(1, 7)))
        if tag != "ol" and self.chance(0.6):
            inner = f"<h3>{self.words(1, 3)}</h3>" + inner
        if self.chance(0.3) and tag != "ol":
            inner += self.form()
        telling, self.telling = self.telling, True
        out = f"<{tag}{self.attrs(names, 'other')}>{inner}</{tag}>"
        self.telling = telling
        return out

    # main text

    def article(self) -> str:
        style = self.draw.random()
        most = self.draw.choice([1, 1, 2, 4, 8, 16, 30])
        size = self.draw.choice([(1, 6), (5, 30), (20, 70), (30, 150)])
        title = f"<h1>{self.words(1, 12)}</h1>" if self.chance(0.85) else f"<h2>{self.words(1, 12)}</h2>" if self.chance(0.5) else ""
        parts = []
        for k in range(self.draw.randint(1, most)):
            parts.append(self.paragraph(*size))
            extra = self.draw.random()
            if extra < 0.08:
                parts.append(f"<h{(n := self.draw.choice('23'))}>{self.words(1, 7)}</h{n}>" + self.paragraph(*size))
            elif extra < 0.13:
                parts.append("<ul>" + "".join(f"<li>{self.prose(2, 15)}" + ("" if self.loose else "</li>")
                                              for _ in range(self.draw.randint(2, 6))) + "</ul>")
            elif extra < 0.17:
                parts.append(f"<blockquote><p>{self.prose(4, 40)}</p></blockquote>")
            elif extra < 0.20:
                parts.append(f"<pre><code>{self.words(3, 30)}</code></pre>")
            elif extra < 0.23:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>"
                                                 for _ in range(self.draw.randint(2, 5))) + "</table>")
            elif extra < 0.26:
                parts.append(f"<figure><img src='x.png'><figcaption>{self.prose(2, 15)}</figcaption></figure>")
            elif extra < 0.30:
                parts.append(self.ad())
            elif extra < 0.32:
                parts.append(self.related())
            elif extra < 0.34:
                parts.append(self.form())
        body = "".join(parts)
        if style < 0.35:
            if self.chance(0.2):
                title = f"<header>{title}</header>"
            return f"<article{self.attrs(['post', 'entry', 'story', 'article'], 'main', 0.6)}>{title}{body}</article>"
        if style < 0.5:
            return f"<main{self.attrs(['content', 'main'], 'main', 0.6)}>{title}{body}</main>"
        if style < 0.8:
            names = ["content", "post-content", "entry-content", "article-body", "story", "main", "text", "articleBody", "post"]
            inner = f"<div{self.attrs(names, 'main')}>{title}{body}</div>"
            return f"<div class='post'>{inner}</div>" if self.chance(0.3) else inner
        if style < 0.9:
            return f"<section{self.attrs(['content', 'post', 'story'], 'main')}>{title}{body}</section>"
        return f"<div data-truth=\"main\">{title}{body}</div>"

    def html(self) -> str:
        before, after = [], []
        for part, p in ((self.notice, 0.25), (self.header, 0.55), (self.nav, 0.75), (self.ad, 0.4), (self.form, 0.1)):
            if self.chance(p):
                before.append(part())
        if self.chance(0.3):
            self.draw.shuffle(before)
        for part, p in ((self.ad, 0.2), (self.related, 0.25), (self.comments, 0.4), (self.form, 0.1), (self.footer, 0.85),
                        (self.notice, 0.12)):
            if self.chance(p):
                after.append(part())
        core = self.article()
        if self.chance(0.15):
            core = f"<main>{core}</main>"
        if self.chance(0.45):
            side = self.sidebar()
            core = side + core if self.chance(0.3) else core + side
            if self.chance(0.7):
                core = f"<div class=\"{self.draw.choice(_NEUTRAL)}\">{core}</div>"
        if self.chance(0.1):
            core = f"<table><tr><td>{core}</td></tr></table>"
        body = "".join([*before, core, *after])
        if self.chance(0.3):
            body = f"<div id=\"{self.draw.choice(['page', 'wrapper', 'root', 'app'])}\">{body}</div>"
        return (f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><script>var t='</p>';</script></head>"
                f"<body data-truth=\"other\"><!-- {self.word()} -->{body}" + ("</body></html>" if self.chance(0.8) else ""))


def generated(pages: int, seed: int) -> Iterator[str]:
    """``pages`` page sources, the same for the same seed."""
    for k in range(pages):
        yield _Page(random.Random(f"{seed}:{k}")).html()
