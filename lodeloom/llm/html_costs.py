"""The classifier whose log-odds are the terminal capacities of the cut: logistic regression on signs of blocks.

It is trained here, on pages made by rule whose blocks are marked: articles in
containers of many kinds, and around and in them the boilerplate that web pages
have. Words are random syllables, so no language and no vocabulary is learnt.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache
from html import escape
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from .html import Page

SIGNS = ["bias", "tag", "name", "hint", "good", "linked", "linked_good", "words", "prose", "long_prose", "outvoted", "sentence", "short", "heading", "mark"]
#: Share of a page's characters beyond which a container's name says nothing about its content.
MOST_OF_PAGE = 0.6
#: Words of a paragraph of prose at least, and its share of linked characters at most.
PROSE, PLAIN = 15, 0.3
#: Marked pages, their seed, the penalty on weights, and the largest cost.
PAGES, SEED, PENALTY, MOST = 400, 11, 0.3, 12.0
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def states(page: Page) -> list[tuple[bool, bool, bool, bool]]:
    """What surrounds each element: a boilerplate tag or state, such a name, a name that hints at it, a container of content."""
    nodes, total = page.nodes, max(page.nodes[0].chars, 1)
    holds_good = [node.good for node in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        holds_good[nodes[k].parent] |= holds_good[k]
    out = [(False, False, False, False)] * len(nodes)
    for k, node in enumerate(nodes[1:], 1):
        tag, name, hint, good = out[node.parent]
        wraps = node.chars > MOST_OF_PAGE * total and (holds_good[k] or not holds_good[0])
        own_tag = node.tag and not (wraps and node.name in ("form", "fieldset", "header"))
        if own_tag and node.name == "header" and good and not tag and not name:
            own_tag = False  # an article's own heading
        out[k] = (tag or own_tag, name or node.bad_name and not wraps, hint or node.hint and not wraps, good or node.good)
    return out


def signs(page: Page) -> list[list[float]]:
    """A row of SIGNS for each block."""
    around, out = states(page), []
    for b in page.blocks:
        tag, name, hint, good = around[b.node]
        good = good and not (tag or name)
        share = min(1.0, b.linked / max(b.chars, 1))
        sentence = b.text[-1] in ".!?:;\"'»”…"
        prose = b.words >= PROSE and sentence and share < PLAIN
        longer = min(math.log(b.words / PROSE), 2.0) if prose else 0.0
        heading = page.nodes[b.node].name in _HEADINGS
        out.append([
            1.0, tag, name, hint, good, 0.0 if good else share, share if good and share > 0.5 and b.words > 40 else 0.0,
            min(math.log1p(b.words), 4.0), prose, longer, longer if hint else 0.0,
            sentence, b.words <= 3 and not heading, heading, b.text[0] == "©" and not good,
        ])
    return out


class _Maker:
    """Pages of random syllables; ``content`` has the texts of the blocks that are content."""

    def __init__(self, r: random.Random):
        self.r, self.content = r, set()

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        return " ".join("".join(self.r.choice("aeioulnrst") for _ in range(self.r.randint(2, 9))) for _ in range(n))

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def text(self, text: str) -> str:
        self.content.add(text)
        return escape(text)

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high).capitalize()}</a>'

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"

    def named(self, *names: str) -> str:
        return f'<div {self.r.choice(["class", "id"])}="{self.r.choice(["", "", "x1 ", "c-"])}{self.r.choice(names)}">'

    def boilerplate(self) -> str:
        r, n = self.r, self.r.randint(2, 8)
        kinds = [
            lambda: f"<nav>{self.links(n)}</nav>",
            lambda: f"{self.named('menu', 'navbar', 'breadcrumb')}{self.links(n)}</div>",
            lambda: f"<div class='{self.words(1, 1)}'>" + " | ".join(self.link() for _ in range(n)) + "</div>",
            lambda: f"{self.named('cookie-notice', 'cookies', 'consent', 'notice', 'newsletter')}<p>{self.sentence(6, 30)}</p></div>",
            lambda: f"{self.named('ad', 'ads', 'advert', 'sponsored', 'promo')}{self.sentence(3, 30)}</div>",
            lambda: f"<aside>{r.choice([self.links(n), f'<p>{self.sentence(5, 40)}</p>'])}</aside>",
            lambda: f"{self.named('sidebar', 'rail', 'widget')}<h3>{self.words(1, 3)}</h3><p>{self.sentence(5, 30)}</p>{self.links(n)}</div>",
            lambda: f"{self.named('comments', 'comment-list', 'disqus')}" + "".join(f"<p>{self.sentence(3, 60)}</p>" for _ in range(n)) + "</div>",
            lambda: f"{self.named('related', 'popular', 'recommended', 'trending')}<h4>{self.words(1, 3)}</h4>{self.links(n)}</div>",
            lambda: f"{self.named('related', 'teasers')}" + "".join(f"<p>{self.link(3, 9)} {self.words(2, 8)}</p>" for _ in range(3)) + "</div>",
            lambda: f"{self.named('share', 'social')}" + "".join(self.link(1, 1) for _ in range(4)) + "</div>",
            lambda: f"<form><label>{self.words(1, 3)}</label><input><p>{self.sentence(4, 20)}</p><button>{self.words(1, 2)}</button></form>",
            lambda: f"<footer><p>© {self.words(2, 8)}</p>{self.links(3)}<p>{self.sentence(5, 30)}</p></footer>",
            lambda: f"{self.named('footer', 'copyright', 'legal', 'disclaimer')}© {self.words(3, 12)}</div>",
            lambda: f"{self.named('legal', 'notice', 'feedback', 'tags')}{self.words(2, 9)}</div>",
            lambda: f"<div>© {self.words(1, 12)}{r.choice(['', '.'])}</div>",
            lambda: f"{self.named('related', 'legal', 'popular', 'disclaimer', 'feedback', 'teaser')}<p>{self.sentence(8, 26)}</p></div>",
            lambda: f"{self.named('notice', 'alert', 'site-notice')}<p>{self.sentence(6, 60)}</p></div>",
            lambda: f"<div {r.choice(['hidden', 'style="display:none"', 'aria-hidden="true"'])}><p>{self.sentence(5, 40)}</p></div>",
            lambda: f"<header><a href='/'>{self.words(1, 3)}</a><p>{self.words(2, 6)}</p></header>",
        ]
        return r.choice(kinds)()

    def paragraph(self, low: int = 8) -> str:
        text = " ".join(self.sentence(4, 25) for _ in range(self.r.randint(1, 6)))
        while text.count(" ") < low:
            text += " " + self.sentence(4, 25)
        if self.r.random() < 0.2:
            first, rest = text.split(" ", 1)
            self.content.add(text)
            return f'<p><a href="/x">{first}</a> {rest}</p>'
        return f"<p>{self.text(text)}</p>"

    def piece(self) -> str:
        r = self.r
        kinds = [
            lambda: f"<h2>{self.text(self.words(1, 8).capitalize())}</h2>",
            lambda: "<ul>" + "".join(f"<li>{self.text(self.sentence(3, 20))}</li>" for _ in range(3)) + "</ul>",
            lambda: f"<blockquote>{self.text(self.sentence(5, 40))}</blockquote>",
            lambda: "<table><tr>" + "".join(f"<td>{self.text(self.words(1, 3))}</td>" for _ in range(3)) + "</tr></table>",
            lambda: f"<p>{self.text(self.sentence(1, 5))}</p>",
            lambda: self.named("legal", "related-work", "feedback", "popular", "survey", "form", "disclaimer") + self.paragraph(40) + "</div>",
            lambda: r.choice([f"<pre>{self.text(self.words(4, 20))}</pre>", f"<figure><figcaption>{self.text(self.sentence(4, 12))}</figcaption></figure>"]),
        ]
        return r.choice(kinds)() if r.random() < 0.4 else self.paragraph()

    def page(self) -> str:
        r = self.r
        if r.random() < 0.1:  # one paragraph in a container that hints at boilerplate
            body = self.named("related-work", "legal", "feedback") + self.paragraph(40) + "</div>"
        else:
            parts = [f"<h1>{self.text(self.words(2, 9).capitalize())}</h1>"] * (r.random() < 0.8)
            for _ in range(r.randint(2, 9)):
                parts.append(self.piece())
                if r.random() < 0.12:
                    parts.append(self.boilerplate())
            tag = r.choice(["<article>", "<main>", "<main><article>", '<div class="post-content">', '<div id="content">', "<div>", "<div>", ""])
            close = {"<main><article>": "</article></main>", "": ""}.get(tag, f"</{tag[1:-1].split(' ')[0]}>")
            body = tag + "".join(parts) + close
        around = [self.boilerplate() for _ in range(r.randint(1, 8))]
        at = r.randint(0, len(around))
        return "<html><body>" + "".join(around[:at]) + body + "".join(around[at:]) + "</body></html>"


def marked_pages(n: int, seed: int) -> list[tuple[str, set[str]]]:
    """Pages and the texts of their content blocks."""
    out = []
    for k in range(n):
        maker = _Maker(random.Random(seed * 1_000_003 + k))
        out.append((maker.page(), maker.content))
    return out


@lru_cache(1)
def trained() -> tuple[float, ...]:
    """Weights of SIGNS: penalised logistic regression on the marked pages, by Newton's method."""
    from .html import parse

    x, y = [], []
    for source, content in marked_pages(PAGES, SEED):
        page = parse(source)
        x += signs(page)
        y += [b.text in content for b in page.blocks]
    x, y = np.array(x, dtype=float), np.array(y, dtype=float)
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + PENALTY * weights
        weights -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(weights)), slope)
    return tuple(weights.tolist())


def costs(page: Page, weights: tuple[float, ...]) -> list[float]:
    """Log-odds of content of each block."""
    return [max(-MOST, min(MOST, sum(a * b for a, b in zip(weights, row, strict=True)))) for row in signs(page)]
