"""Labelled training pages: the blocks of given pages, laid out anew in many ways.

The article's blocks and the other texts of a page come from the page itself
(and from the pages beside it); only their surroundings are drawn: element
names, attribute words, order, nesting, missing end tags.  Blocks of the article
carry the attribute ``data-main``, which no feature sees.
"""

from __future__ import annotations

import html
from random import Random

# Words of class and id attributes by what they usually name.
ROLES = {
    "content": "article content post entry story main body text blog news prose markdown",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topnav tabs pagination pager toc",
    "header": "header head masthead topbar logo brand branding site top",
    "footer": "footer foot bottom copyright legal imprint colophon credits",
    "side": "sidebar side aside rail widget widgets secondary complementary",
    "ad": "ad ads advert advertisement adsense adslot sponsor sponsored promo promoted commercial banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog privacy paywall announcement",
    "form": "form newsletter subscribe subscription signup login search contact register",
    "comment": "comment comments reply replies respond discussion disqus responses feedback",
    "related": "related recommended recommendations popular trending similar teaser teasers",
    "social": "share sharing social follow toolbar tags",
}
ROLES = {k: tuple(v.split()) for k, v in ROLES.items()}
PLAIN = ("box", "wrap", "wrapper", "inner", "container", "block", "area", "section", "col", "row", "left", "right", "page", "list", "item")


def names(rng: Random, role: str | None) -> str:
    """A class or id attribute: a word of the role, plain words, or a generated name that says nothing."""
    kind = rng.random()
    if kind < 0.25:
        return ""
    if kind < 0.45 or not role:
        words = [rng.choice(PLAIN)] if rng.random() < 0.6 else [rng.choice("cjsx") + format(rng.randrange(16 ** 5), "05x")]
    else:
        words = [rng.choice(ROLES[role])]
        if rng.random() < 0.5:
            words.insert(rng.randrange(2), rng.choice(PLAIN))
    style = rng.randrange(3)
    name = "-".join(words) if style == 0 else "_".join(words) if style == 1 else words[0] + "".join(w.title() for w in words[1:])
    return f' {rng.choice(("class", "class", "id"))}="{name}"'


class Layout:
    """Draws one page from an article (heading, paragraphs) and a pool of other texts."""

    def __init__(self, rng: Random, heading: str, paragraphs: list[str], pool: list[str]):
        self.rng, self.heading, self.paragraphs, self.pool = rng, heading, paragraphs, pool
        self.anonymous = rng.random() < 0.25  # a page without telling names
        self.semantic = rng.random() < 0.5  # a page with telling element names
        self.closes = rng.random() < 0.8  # paragraphs have end tags

    def element(self, role: str | None, tags: tuple[str, ...], inside: str, plain: str = "div") -> str:
        tag = self.rng.choice(tags) if self.semantic else plain
        return f"<{tag}{names(self.rng, None if self.anonymous else role)}>{inside}</{tag}>"

    def words(self, low: int, high: int) -> str:
        text = self.rng.choice(self.pool).split() or ["-"]
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(text) - n + 1))
        return html.escape(" ".join(text[at:at + n]), quote=False)

    def sentences(self) -> str:
        return self.words(3, 9) if self.rng.random() < 0.4 else self.words(8, 60)

    def links(self, low: int, high: int, words: int = 3) -> str:
        items = [f'<a href="/{i}">{self.words(1, words)}</a>' for i in range(self.rng.randint(low, high))]
        kind = self.rng.randrange(4)
        if kind < 2:
            return "<ul>" + "".join(f"<li>{x}" + ("</li>" if self.rng.random() < 0.9 else "") for x in items) + "</ul>"
        return (" | " if kind == 2 else "\n").join(items)

    def menu(self) -> str:
        return self.element("menu", ("nav", "nav", "menu"), self.links(2, 12))

    def header(self) -> str:
        name = f"<{(t := self.rng.choice(('h1', 'h2', 'div', 'p')))}><a href='/'>{self.words(1, 4)}</a></{t}>"
        inside = name + (f"<p>{self.words(2, 9)}</p>" if self.rng.random() < 0.5 else "") + (self.menu() if self.rng.random() < 0.4 else "")
        return self.element("header", ("header",), inside)

    def ad(self) -> str:
        text = self.sentences()
        return self.element("ad", ("div", "aside", "section"), f"<p>{text}</p>" if self.rng.random() < 0.5 else text)

    def notice(self) -> str:
        text = self.sentences()
        text = f"<p>{text}</p>" if self.rng.random() < 0.6 else text
        more = f' <a href="/p">{self.words(1, 3)}</a>' if self.rng.random() < 0.6 else ""
        return self.element("notice", ("div", "dialog", "section", "noscript"), text + more + "<button>OK</button>")

    def form(self) -> str:
        rows = "".join(f"<{t}><label>{self.words(1, 3)}</label> <input name=x></{t}>" for t in self.rng.choices(("p", "div", "li"), k=self.rng.randint(1, 4)))
        head = f"<h3>{self.words(1, 5)}</h3>" if self.rng.random() < 0.6 else ""
        text = f"<p>{self.sentences()}</p>" if self.rng.random() < 0.6 else ""
        return self.element("form", ("div", "section", "aside"), f"<form action='/s'{names(self.rng, None)}>{head}{text}{rows}<button>Go</button></form>")

    def side(self) -> str:
        parts = []
        for _ in range(self.rng.randint(1, 4)):
            head = f"<{(t := self.rng.choice(('h2', 'h3', 'h4', 'div')))}>{self.words(1, 4)}</{t}>"
            body = self.links(2, 8, 6) if self.rng.random() < 0.6 else f"<p>{self.sentences()}</p>"
            parts.append(self.element("side", ("div", "section", "aside"), head + body))
        return self.element("side", ("aside",), "".join(parts))

    def comments(self) -> str:
        said = []
        for _ in range(self.rng.randint(1, 6)):
            who = f"<{(t := self.rng.choice(('div', 'h4', 'p')))}>{self.words(1, 3)}</{t}>" if self.rng.random() < 0.7 else f"<b>{self.words(1, 2)}</b>"
            body = "".join(f"<p>{self.sentences()}</p>" for _ in range(self.rng.randint(1, 3)))
            tag = self.rng.choice(("article", "li", "div")) if self.semantic else self.rng.choice(("li", "div"))
            said.append(f"<{tag}{names(self.rng, None if self.anonymous else 'comment')}>{who}{body}</{tag}>")
        head = f"<h3>{self.words(1, 4)}</h3>" if self.rng.random() < 0.8 else ""
        inside = "".join(said)
        return self.element("comment", ("section", "div", "aside"), head + (f"<ol>{inside}</ol>" if self.rng.random() < 0.4 else inside))

    def related(self) -> str:
        head = f"<h3>{self.words(1, 4)}</h3>" if self.rng.random() < 0.8 else ""
        cards = "".join(f'<div><h4><a href="/r">{self.words(3, 10)}</a></h4>' + (f"<p>{self.sentences()}</p>" if self.rng.random() < 0.6 else "") + "</div>"
                        for _ in range(self.rng.randint(2, 6)))
        return self.element("related", ("section", "aside", "div"), head + (cards if self.rng.random() < 0.5 else self.links(2, 8, 10)))

    def share(self) -> str:
        return self.element("social", ("div", "aside"), self.links(2, 6, 1))

    def footer(self) -> str:
        parts = [f"&copy; {self.words(1, 6)}" if self.rng.random() < 0.7 else "", self.links(1, 6) if self.rng.random() < 0.7 else "",
                 f"<p>{self.sentences()}</p>" if self.rng.random() < 0.6 else ""]
        self.rng.shuffle(parts)
        return self.element("footer", ("footer",), "".join(parts) or "&copy;")

    def paragraph(self, text: str) -> str:
        text = html.escape(text, quote=False)
        if self.rng.random() < 0.15:
            words = text.split(" ")
            at = self.rng.randrange(len(words))
            words[at] = self.rng.choice((f"<b>{words[at]}</b>", f"<em>{words[at]}", f'<a href="/x">{words[at]}</a>'))
            text = " ".join(words)
        return text

    def article(self) -> str:
        style, out = self.rng.random(), []
        if self.heading and self.rng.random() < 0.9:
            head = f"<{(t := self.rng.choice(('h1', 'h1', 'h1', 'h2')))} data-main>{self.paragraph(self.heading)}</{t}>"
            out.append(f"<header>{head}</header>" if self.semantic and self.rng.random() < 0.2 else head)
        extras = [f for f in (self.ad, self.share, self.related, self.form, self.side) if self.rng.random() < 0.12]
        for k, text in enumerate(self.paragraphs):
            body, kind = self.paragraph(text), self.rng.random()
            if style < 0.12:
                out.append(f"<div data-main>{body}</div>")
            elif kind < 0.80:
                out.append(f"<p data-main>{body}" + ("</p>" if self.closes else self.rng.choice(("", "<br>"))))
            elif kind < 0.85:
                out.append(f"<h2 data-main>{body}</h2>")
            elif kind < 0.90:
                out.append("<ul data-main>" + "".join(f"<li>{x}</li>" for x in body.split(". ") if x) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote data-main><p>{body}</p></blockquote>")
            elif kind < 0.97:
                out.append(f"<pre data-main>{body}</pre>")
            else:
                out.append(f"<table data-main><tr><td>{body}</td></tr></table>")
            if extras and self.rng.random() < 1 / len(self.paragraphs):
                out.append(extras.pop()())
        inside = "".join(out + [f() for f in extras])
        for _ in range(self.rng.choice((0, 0, 1, 2))):
            inside = f"<div{names(self.rng, None if self.anonymous else 'content')}>{inside}</div>"
        return self.element("content", ("article", "main", "article", "section", "div"), inside)

    def page(self) -> str:
        rng = self.rng
        before = [f for f, p in ((self.notice, 0.2), (self.header, 0.6), (self.menu, 0.7), (self.ad, 0.4), (self.share, 0.1), (self.form, 0.15)) if rng.random() < p]
        after = [f for f, p in ((self.share, 0.2), (self.related, 0.3), (self.comments, 0.4), (self.form, 0.25), (self.ad, 0.3), (self.menu, 0.2)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(before)
            rng.shuffle(after)
        beside = [f() for f, p in ((self.side, 0.45), (self.menu, 0.15)) if rng.random() < p]
        main = self.article()
        late = rng.random() < 0.5 and len(after) > 1
        if late:  # what belongs to the article's column
            main = f"<div{names(rng, None)}>{main}" + "".join(f() for f in after[:1]) + "</div>"
            after = after[1:]
        if beside and rng.random() < 0.15:
            cells = [main, *beside]
            rng.shuffle(cells)
            middle = "<table><tr>" + "".join(f"<td>{c}" + ("</td>" if rng.random() < 0.8 else "") for c in cells) + "</tr></table>"
        else:
            middle = "".join([main, *beside] if rng.random() < 0.6 else [*beside, main])
        parts = "".join(f() for f in before) + (f"<div{names(rng, None)}>{middle}</div>" if rng.random() < 0.5 else middle) + "".join(f() for f in after)
        if rng.random() < 0.85:
            parts += self.footer()
        if rng.random() < 0.25:
            parts += self.notice()
        if rng.random() < 0.3:
            parts = f"<div{names(rng, None)}>{parts}</div>"
        return (f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var a='<p>';</script></head><body>"
                f"{parts}" + ("</body></html>" if rng.random() < 0.9 else ""))
