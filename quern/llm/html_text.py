"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

The trees learn from pages written here from rules (layouts of many kinds, with marks of
what is the article), so no table's labels are needed.  A node's logit, weighed by its own
text, speaks for keeping it.  Decoding takes the best set of nodes in which every kept
node's parent is kept too: a node is worth its own weight and its children's, where those
are positive, and a node worth nothing goes with all below it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.boosting import Forest, fit
from quern.llm.html_dom import Node, figures, parse
from quern.llm.shared import chunks, table

TRAINING_PAGES = 500
#: Names of elements on the pages to learn from, by part; a third of the elements have made-up ones instead.
NAMES = {
    "menu": ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "navigation", "hauptmenue", "navegacion"],
    "side": ["sidebar", "side", "widget", "related", "right-rail", "popular", "seitenleiste", "colonne-laterale"],
    "advert": ["ad", "ads", "advert", "sponsored", "promo", "ad-banner", "werbung", "publicite", "anuncio"],
    "notice": ["notice", "cookie-banner", "cookie", "alert", "consent", "message", "hinweis", "aviso"],
    "form": ["search", "newsletter", "subscribe", "login-form", "signup", "suche", "recherche"],
    "comments": ["comments", "comment-list", "discussion", "responses", "reader-comments", "kommentare", "comentarios"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "fusszeile", "pied-page"],
    "header": ["header", "site-header", "masthead", "top", "kopfzeile", "cabecera"],
    "body": ["post", "content", "main-content", "entry-content", "story", "artikel", "contenu"],
}


# --- pages to learn from -----------------------------------------------------------------


class _Writer:
    """Pages with data-mark="1" on the article's elements and "0" on all others that hold text."""

    def __init__(self, seed: int, names: dict[str, list[str]] = NAMES):
        self.r, self.names = random.Random(seed), names

    def name(self, part: str, made_up: float = 0.35) -> str:
        """A name of the part, or one that tells nothing."""
        r = self.r
        return "".join(r.choice("bcdfgklmnprstvwz") + r.choice("aeiou") for _ in range(r.randint(2, 4))) if r.random() < made_up else r.choice(self.names[part])

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 16) + "." for _ in range(self.r.randint(low, high)))

    def links(self, n: int) -> str:
        return "".join(f'<li data-mark="0"><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(n))

    def box(self, tag: str, part: str, inside: str, bare: float = 0.15) -> str:
        """The element by its own tag, or as a div that its class or id names, or without a name."""
        r = self.r
        style = r.random()
        name = self.name(part, 0.35 if bare else 0)
        attribute = r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} box"'))
        if style < bare:
            attribute = ""
            tag = tag if tag in ("nav", "footer", "aside", "form", "header") and r.random() < 0.5 else "div"
        elif style < 0.55:
            tag = "div" if r.random() < 0.7 else "section"
        return f'<{tag}{attribute} data-mark="0">{inside}</{tag}>'

    def menu(self) -> str:
        r = self.r
        items = f"<ul>{self.links(r.randint(2, 12))}</ul>" if r.random() < 0.6 else r.choice((" ", " | ", " &middot; ")).join(f'<a href="/y">{self.words(1, 2)}</a>' for _ in range(r.randint(1, 9)))
        return self.box("nav", "menu", items)

    def side(self) -> str:
        return self.box("aside", "side", f'<h3 data-mark="0">{self.words(1, 3)}</h3><ul>{self.links(self.r.randint(2, 8))}</ul>' + (f'<p data-mark="0">{self.sentences(1, 3)}</p>' if self.r.random() < 0.5 else ""))

    def advert(self) -> str:
        return self.box("div", "advert", self.sentences(1, 3) if self.r.random() < 0.6 else f'<p data-mark="0">{self.sentences(1, 3)}</p>', 0)

    def notice(self) -> str:
        return self.box("div", "notice", f'<p data-mark="0">{self.sentences(1, 3)}</p><a href="/ok">{self.words(1, 1)}</a>' if self.r.random() < 0.6 else self.sentences(1, 2), 0)

    def form(self) -> str:
        return self.box("form", "form", f'<label>{self.words(1, 4)}</label><input type="text"><p data-mark="0">{self.sentences(1, 2)}</p>')

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice((f'<div class="comment" data-mark="0"><p data-mark="0">{self.sentences(1, 5)}</p></div>', f'<li class="comment" data-mark="0"><b>{self.words(1, 2)}</b> {self.sentences(1, 4)}</li>', f'<p data-mark="0">{self.sentences(1, 4)}</p>'))
        head = r.choice(("h2", "h3", "h4", "p"))
        title = r.choice((self.words(1, 2), f"{r.randint(1, 400)} {self.words(1, 1)}", f"{self.words(1, 1)} ({r.randint(0, 99)})"))
        inside = f'<{head} data-mark="0">{title}</{head}>' + "".join(one() for _ in range(r.randint(1, 6)))
        if r.random() < 0.2:  # the box says nothing, its comments do
            inside = inside.replace('<p data-mark="0">', '<p class="comment" data-mark="0">')
            return f'<div id="{self.name("comments", 1)}" data-mark="0">{inside}</div>'
        return self.box("section", "comments", inside, 0)

    def footer(self) -> str:
        r = self.r
        inside = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}", f'<p data-mark="0">&copy; {self.words(2, 6)}</p><ul>{self.links(r.randint(2, 6))}</ul>', self.sentences(1, 2)))
        return self.box("footer", "footer", inside, 0.3)

    def header(self) -> str:
        return self.box("header", "header", f'<a href="/">{self.words(1, 2)}</a>' + (f'<p data-mark="0">{self.words(2, 6)}</p>' if self.r.random() < 0.5 else ""))

    def paragraphs(self) -> str:
        r = self.r
        out = []
        n = r.choice((1, 1, 2, 3, 5, 8, 12, 20))
        for _ in range(n):
            k = r.random() * (0.72 if n == 1 else 1)  # what stands alone is a paragraph
            if k < 0.72:
                text = self.sentences(1, r.choice((1, 3, 6, 12)))
                if r.random() < 0.3:
                    text = f'{text} <a href="/z">{self.words(1, 4)}</a> {self.sentences(1, 2)}'
                if r.random() < 0.1:
                    text = f"<b>{self.words(2, 8)}<br>"
                tag = "p" if self.tidy else "div"
                out.append(f'<{tag} data-mark="1">{text}</{tag}>')
            elif k < 0.8:
                out.append(f'<h2 data-mark="1">{self.words(1, 7)}</h2>')
            elif k < 0.86:
                out.append('<ul data-mark="1">' + "".join(f'<li data-mark="1">{self.words(2, 14)}</li>' for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.9:
                out.append(f'<blockquote data-mark="1">{self.sentences(1, 3)}</blockquote>')
            elif k < 0.93:
                out.append('<table data-mark="1">' + "".join(f'<tr data-mark="1"><td data-mark="1">{self.words(1, 3)}</td><td data-mark="1">{self.words(1, 3)}</td></tr>' for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(r.choice((self.advert, self.side, self.form, self.notice))())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        self.tidy = r.random() < 0.8  # paragraphs are p and not div
        title = f'<h1 data-mark="1">{self.words(1, 12)}</h1>'
        if r.random() < 0.2:
            title = f'<header data-mark="1">{title}</header>'
        if r.random() < 0.3:
            title = ""
        inside = title + self.paragraphs()
        if r.random() < 0.25:
            inside += r.choice((self.comments, self.form, self.side))()
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        attribute = r.choice(("", f' class="{self.name("body")}"', f' id="{self.name("body")}"'))
        body = f'<{tag}{attribute} data-mark="1">{inside}</{tag}>'
        around = {"front": [self.notice, self.header, self.menu, self.advert, self.form], "back": [self.side, self.comments, self.advert, self.form, self.menu, self.notice]}
        front = "".join(f() for f in around["front"] if r.random() < 0.5)
        back = "".join(f() for f in around["back"] if r.random() < 0.35) + (self.footer() if r.random() < 0.85 else "")
        if r.random() < 0.15:  # the article and no more
            front = back = ""
        shape = r.random()
        if shape < 0.3:
            body = f'<div class="{r.choice(("wrapper", "container", "row", "page", self.name("body", 1)))}">{body}{self.side() if r.random() < 0.5 else ""}</div>'
        elif shape < 0.4:  # columns of a table
            body = f'<table><tr><td data-mark="0">{self.menu()}</td><td data-mark="1">{body}</td></tr></table>'
        head = r.choice(("<head><title>x</title></head><body>", "<head><title>x</title>", "<body>"))
        return f"<html>{head}{front}{body}{back}</body></html>"


def _labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes of the article and those around it, 0 for others."""
    keep = {id(x) for x in nodes if x.mark == "1"}
    for x in reversed(nodes):
        if id(x) in keep and x.parent:
            keep.add(id(x.parent))
    return np.array([id(x) in keep for x in nodes], float)


@lru_cache(maxsize=2)
def learned(pages: int = TRAINING_PAGES, seed: int = 3) -> Forest:
    writer = _Writer(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(writer.page())
        xs.append(figures(nodes)), ys.append(_labels(nodes))
    return fit(np.concatenate(xs), np.concatenate(ys))


# --- extraction --------------------------------------------------------------------------


def decode(nodes: list[Node], logits: np.ndarray) -> set[int]:
    """Numbers of the kept nodes: the best set that holds every kept node's parent."""
    number = {id(x): i for i, x in enumerate(nodes)}
    own = np.array([sum(len(b[1]) for b in x.blocks) for x in nodes])
    worth = np.clip(logits, -8, 8) * (0.2 + np.log1p(own))
    parent = [number[id(x.parent)] if x.parent else -1 for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[parent[i]] += worth[i]
    kept = set()
    for i in range(len(nodes)):
        if worth[i] > 0 and (i == 0 or parent[i] in kept):
            kept.add(i)
    return kept - {number[id(x)] for x in _left_alone(nodes, kept, number)}


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _left_alone(nodes: list[Node], kept: set[int], number: dict[int, int]) -> list[Node]:
    """Headings whose parts, up to the next heading, were all left out: they head something that is no article."""
    out = []
    for parent in nodes:
        heading, some, gone = None, False, False
        for x in [*parent.children, None]:
            if x is None or x.tag in _HEADINGS:
                if heading is not None and gone and not some:
                    out.append(heading)
                heading, some, gone = (x if x is not None and number[id(x)] in kept else None), False, False
            elif number[id(x)] in kept:
                some = True
            else:
                gone = True
    return out


def text_of(nodes: list[Node], logits: np.ndarray) -> str:
    kept = decode(nodes, logits)
    blocks = sorted(b for i in kept for b in nodes[i].blocks)
    return "\n".join(b[1] for b in blocks)


def _extract(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 1 << 20):
            pages = [parse(x or "") for x in batch.column(1).to_pylist()]
            logits = forest.logits(np.concatenate([figures(x) for x in pages]))
            ends = np.cumsum([len(x) for x in pages])
            texts = [text_of(x, logits[e - len(x) : e]) for x, e in zip(pages, ends.tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), batch.column(2)], ["page_id", "text", "n_chars", "url"])

    return run


def main_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, text, n_chars, url) for each row of df.

    Null and empty pages, and pages without an article, give an empty text.  Long pages are parsed whole, in time that
    grows with their length; repeated rows give equal texts, null ids and urls stay, other columns are not looked at, and an
    empty table gives no rows.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"))
    return pages.mapInArrow(_extract(learned()), "page_id long, text string, n_chars long, url string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`, from the whole html; null html gives an empty text (see main_text)."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
