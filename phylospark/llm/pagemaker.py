"""Synthetic web pages whose content blocks are known, to fit the classifier of mincut.

Each page is drawn from a seed: its content is wrapped in article, main, a div with a telling class or a bare div;
around it stand some of the usual kinds of boilerplate, marked by their element, by a class or not at all. Bare
boilerplate is short or full of links, as it is in practice. Sentences are made of random syllables, so no word tells.
"""

from __future__ import annotations

import random

PAGES, SEED = 400, 20240607
_SYLLABLES = "ba be bo da de do fa fi ga ha ka ke ki la le lo ma me mi na no pa po ra re ri sa se so ta te ti to va vi za".split()
_WRAPS = (("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class=entry>", "</article></main>"), ("<div class='post-content'>", "</div>"), ("<div id=main>", "</div>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"))
_MARKED = (
    ("<nav>", "</nav>"), ("<div class=menu>", "</div>"), ("<footer>", "</footer>"), ("<div id=footer>", "</div>"), ("<aside>", "</aside>"), ("<div class='sidebar widget'>", "</div>"), ("<header>", "</header>"),
    ("<form>", "</form>"), ("<div class=ad>", "</div>"), ("<section class=comments>", "</section>"), ("<div class='cookie-notice'>", "</div>"), ("<div class=related>", "</div>"), ("<div role=banner>", "</div>"),
)


class _Maker:
    def __init__(self, seed: int) -> None:
        self.pick, self.made = random.Random(seed), 0

    def words(self, n: int) -> str:
        return " ".join("".join(self.pick.choice(_SYLLABLES) for _ in range(self.pick.randint(1, 4))) for _ in range(n))

    def sentence(self, least: int = 6, most: int = 20) -> str:
        self.made += 1
        return f"{self.words(self.pick.randint(least, most)).capitalize()} {self.made}{self.pick.choice('..!?')}"

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.pick.choice((1, 1, 2, 3, 5, 8))))

    def label(self) -> str:
        self.made += 1
        return f"{self.words(self.pick.randint(1, 3))} {self.made}"

    def content(self, wanted: set[str]) -> str:
        out = []

        def say(tag: str, text: str, shown: str | None = None) -> None:
            wanted.add(text)
            out.append(f"<{tag}>{shown or text}</{tag}>")

        say("h1", self.label())
        for _ in range(self.pick.randint(2, 9)):
            kind = self.pick.random()
            if kind < 0.08:
                say("h2", self.label())
            elif kind < 0.16:
                say("blockquote", self.sentence())
            elif kind < 0.24:
                items = [self.sentence(2, 8) for _ in range(self.pick.randint(2, 4))]
                wanted.update(items)
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            elif kind < 0.32:
                text = self.paragraph()
                first, _, rest = text.partition(" ")
                say("p", text, f"<a href=/x>{first}</a> {rest}")
            elif kind < 0.4:
                say("p", self.label())
            elif kind < 0.48:
                say("div", self.paragraph())
            elif kind < 0.54:
                say(self.pick.choice(("pre", "div", "p")), f"{self.words(self.pick.randint(8, 40))} {self.label()}")
            elif kind < 0.6:
                cells = [self.label() for _ in range(self.pick.randint(2, 6))]
                wanted.update(cells)
                out.append("<table><tr>" + "".join(f"<td>{x}</td>" for x in cells) + "</tr></table>")
            else:
                say("p", self.paragraph())
        return "".join(out)

    def links(self) -> str:
        return "<ul>" + "".join(f"<li><a href=/x>{self.label()}</a></li>" for _ in range(self.pick.randint(2, 7))) + "</ul>"

    def boilerplate(self) -> str:
        if self.pick.random() < 0.25:
            return self.pick.choice((f"<div>{self.links()}</div>", f"<p><a href=/x>{self.label()}</a> | <a href=/y>{self.label()}</a></p>", f"<div>{self.label()}</div>"))
        a, b = self.pick.choice(_MARKED)
        inner = self.pick.choice((self.links, lambda: f"<p>{self.paragraph()}</p>", self.sentence, self.label, lambda: f"<h3>{self.label()}</h3><p>{self.sentence()}</p>"))()
        return f"{a}{inner}{b}"

    def page(self) -> tuple[str, set[str]]:
        wanted: set[str] = set()
        a, b = self.pick.choice(_WRAPS)
        inner = self.content(wanted)
        if self.pick.random() < 0.2:
            x, y = self.pick.choice(_MARKED[8:11])
            inner += f"{x}<p>{self.sentence()}</p>{y}"
        before, after = ("".join(self.boilerplate() for _ in range(self.pick.randint(1, 4))) for _ in "ab")
        return f"<html><body>{before}{a}{inner}{b}{after}</body></html>", wanted


def pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """(html, texts of its content blocks) of each page; every text of a page is different."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
