"""Composed web pages with known main text, on which html_text fits its classifier.

A page is put together from parts, each in one of several markups, by a seeded generator: the
article (by landmark, by name or by neither) and menus, headers, footers, sidebars, notices,
adverts, forms, lists of links and readers' comments around it or inside it. The text is made of
random syllables, so that only markup and shape can be learned from it. Where the main element is marked, the
names of what stands beside it are random letters on most pages.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

SYLLABLES = "ba be bo da de di fa ga ge ka ke ko la le li ma me mi na ne no pa pe ra re ri sa se so ta te ti to va ve".split()


class Composer:
    """One page."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.content: set[str] = set()
        self.nameless = False

    def named(self, name: str) -> str:
        """The name, or on a page whose names mean nothing a few random letters and digits."""
        return "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-", k=self.rng.randint(3, 12))) if self.nameless else name

    def pick(self, *options: str) -> str:
        return self.rng.choice(options)

    def words(self, low: int, high: int, stops: bool = False) -> str:
        words = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high))]
        if not stops:
            return " ".join(words)
        for i in range(9, len(words) - 3, 11):
            words[i] += self.pick(",", ".", ";")
        return " ".join(words).capitalize() + self.pick(".", ".", ".", "!", "?")

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.words(low, high)}</a>'

    def main(self, text: str) -> str:
        self.content.add(" ".join(text.split()))
        return text

    def links(self, n: int = 6) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}" + self.pick("</li>", "") for _ in range(self.rng.randint(2, n))) + "</ul>"

    def paragraph(self) -> str:
        tag = self.pick("p", "p", "p", "div", "blockquote")
        return f"<{tag}>{self.words(*self.rng.choice([(3, 9), (12, 40), (12, 40), (30, 90)]), stops=True)}</{tag}>"

    def article(self) -> str:
        """Blocks of the main text."""
        out = [f"<h1>{self.main(self.words(2, 9))}</h1>"]
        for _ in range(self.rng.randint(1, 9)):
            kind = self.rng.random()
            if kind < 0.7:
                text = self.words(*self.rng.choice([(2, 6), (12, 40), (12, 40), (30, 90)]), stops=self.rng.random() < 0.93)
                out.append(f"<{(tag := self.pick('p', 'p', 'p', 'p', 'div', 'blockquote'))}>{self.main(text)}</{tag}>")
            elif kind < 0.73:
                out.append(f'<div class="info-box"><p>{self.main(self.words(8, 30, stops=True))}</p></div>')
            elif kind < 0.77:
                text = self.words(1, 8, stops=True)
                self.main(text)
                out.append(f'<p><a href="/x">{text}</a></p>')
            elif kind < 0.86:
                out.append(f"<h2 id=\"{self.pick('comment-on-it', 'hidden-costs', 'part-one')}\">{self.main(self.words(1, 6))}</h2>")
            elif kind < 0.95:
                out.append("<ul>" + "".join(f"<li>{self.main(self.words(2, 14, self.rng.random() < 0.6))}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{self.main(self.words(1, 4))}</td><td>{self.main(self.words(1, 3))}</td></tr>" for _ in range(3)) + "</table>")
        return "".join(out)

    def menu(self) -> str:
        start, end = self.rng.choice([("<nav>", "</nav>"), ("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="main-nav">', "</div>"), ("<div>", "</div>"), ('<ul class="navbar"><li>', "</li></ul>"), ('<div class="breadcrumbs">', "</div>")])
        if self.rng.random() < 0.25:
            start, end = self.rng.choice([("<table><tr><td>", "</td></tr></table>"), ("<p>", "</p>"), (start, end)])
            return start + self.pick(" | ", " ", " &middot; ").join(self.link() for _ in range(self.rng.randint(2, 6))) + end
        return start + self.links() + end

    def header(self) -> str:
        inside = self.pick("", f"<p>{self.words(2, 7)}</p>") + self.pick("", self.menu())
        start, end = self.rng.choice([("<header>", "</header>"), ('<div class="site-header">', "</div>"), ('<div id="masthead">', "</div>"), ('<header class="banner">', "</header>")])
        return f"{start}<a href=/>{self.words(1, 4)}</a>{inside}{end}"

    def footer(self) -> str:
        start, end = self.rng.choice([("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="site-footer">', "</div>"), ('<p class="copyright">', "</p>")])
        return f"{start}&copy; {self.words(2, 20, stops=True)}{end}"

    def apart(self) -> str:
        """A sidebar, notice, advert or list of other articles."""
        names = self.pick("sidebar", "sidebar-left", "widget", "related-posts", "related", "ad", "advert", "ad-slot", "sponsored", "cookie-notice", "cookie-banner", "newsletter", "newsletter-signup", "share", "social-links", "popup", "promo", "popular-posts", "tags", "alert-box")
        inside = self.rng.choice([self.paragraph, self.links, lambda: self.words(2, 12, stops=True), lambda: f"<h3>{self.words(1, 3)}{self.pick('', ':', '!')}</h3>" + self.links(), lambda: f"<h3>{self.words(1, 3)}</h3>" + self.paragraph()])()
        names = self.named(names)
        start, end = self.rng.choice([("<aside>", "</aside>")] * (not self.nameless) + [(f'<div class="{names}">', "</div>"), (f'<div class="{names}">', "</div>"), (f'<section id="{names}">', "</section>")] + [(f'<aside class="{names}">', "</aside>")] * (not self.nameless))
        return start + inside + end

    def form(self) -> str:
        return f"<form><label>{self.words(1, 3)}</label><input><p>{self.words(3, 20, stops=True)}</p><button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        names = self.named("comments"), self.named("comment-list"), self.named("commentlist"), self.named("comment-body")
        start, end = self.rng.choice([(f'<section class="{names[0]}">', "</section>"), (f'<div id="{names[0]}">', "</div>"), (f'<div class="{names[1]}">', "</div>"), (f'<ol class="{names[2]}">', "</ol>")])
        one, over = self.rng.choice([("<article>", "</article>"), (f'<div class="{names[3]}">', "</div>"), ("<li>", "</li>"), ("<div>", "</div>"), ("", "")])
        return start + f"<h3>{self.words(1, 3)}{self.pick('', ':')}</h3>" + "".join(one + self.paragraph() * self.rng.randint(1, 2) + over for _ in range(self.rng.randint(1, 9))) + end

    def page(self) -> str:
        rng = self.rng
        body, before, after, beside = self.article(), [], [], ""
        about = self.pick("", "", ' class="post"', ' class="post tag-social category-legal"', ' class="hentry comments-closed"', ' class="related-rates"', ' id="post-17"')
        starts = [(f"<article{about}>", "</article>"), (f"<article{about}>", "</article>"), ("<main>", "</main>"), (f"<main><article{about}>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="entry-content">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>"), (f"<div{about}>", "</div>"), ("<table><tr><td>", "</td></tr></table>")]
        start, end = rng.choice(starts[:4] if rng.random() < 0.3 else starts)
        # What stands beside a marked main element may have any name, or none that means something.
        marked = start.startswith(("<article", "<main"))
        self.nameless = marked and rng.random() < 0.6
        for part, chance, places in ((self.header, 0.6, [before]), (self.menu, 0.7, [before, before, after]), (self.apart, 0.6, [before, after]), (self.apart, 0.6, [after]), (self.form, 0.3, [before, after]), (self.comments, 0.4, [after]), (self.footer, 0.8, [after])):
            if rng.random() < chance:
                rng.choice(places).append(part())
        if start.startswith("<main><article") and rng.random() < 0.5:
            beside = rng.choice([self.comments, self.apart])()
        self.nameless = False  # inside the main element only names tell
        inner = [p() for p, c in ((self.apart, 0.35), (self.form, 0.1), (self.comments, 0.15), (self.footer, 0.05)) if rng.random() < c]
        if inner and rng.random() < 0.5:
            cut = body.find("</p>") + 4
            body = body[:cut] + inner.pop() + body[cut:] if cut > 3 else body
        body += "".join(inner)
        if rng.random() < 0.3:
            tag, name = rng.choice([("header", ""), ("header", ' class="entry-header"'), ("div", ' class="article-head"'), ("div", ' class="page-header"')])
            body = f"<{tag}{name}>{body.replace('</h1>', f'</h1></{tag}>', 1)}"
        if beside:
            end = f"</article>{beside}</main>"
        around = rng.choice([("", ""), ("", ""), ('<div class="content-sidebar-wrap">', "</div>"), ('<div class="social-science">', "</div>"), ('<div id="wrapper">', "</div>"), ("<form>", "</form>")])
        name = self.pick("", "", ' class="no-sidebar"', ' class="right-sidebar"', ' class="has-comments"', ' id="page"')
        return f"<html><head><title>{self.words(1, 5)}</title></head><body{name}>{''.join(before)}{around[0]}{start}{body}{end}{around[1]}{''.join(after)}</body></html>"


def sample_pages(n: int) -> Iterator[tuple[str, set[str]]]:
    """(page, texts of its blocks that are content) of n composed pages."""
    for seed in range(n):
        composer = Composer(seed)
        yield composer.page(), composer.content
