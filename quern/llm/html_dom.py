"""A small DOM of blocks, and figures about each node, for main-text extraction."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_TOKENS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "select", "button", "video", "audio", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rt", "rp", "nobr"}
#: An opening tag on the left ends an open element on the right.
_P_ENDERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS = {**dict.fromkeys(_P_ENDERS, {"p"}), "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Start tags that leave an open head open.
_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template"}
#: Elements below this many open ones are put beside each other, as browsers do; it bounds the work for a tag.
DEPTH = 512
_SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "aside", "body", "blockquote", "form"}

TAGS = ["body", "div", "p", "article", "main", "section", "nav", "header", "footer", "aside", "ul", "ol", "li", "form", "table", "tr", "td", "blockquote", "pre", "h1", "h2", "h3", "figure"]
#: Attribute tokens by what they tell.
TOKEN_GROUPS = [
    {"nav", "navbar", "navigation", "navegacion", "menu", "menue", "menubar", "breadcrumb", "crumbs", "toc", "pagination", "pager", "tabs"},
    {"header", "masthead", "top", "topbar", "logo", "brand", "site", "branding", "kopf", "entete", "cabecera", "banner"},
    {"footer", "foot", "bottom", "copyright", "legal", "colophon", "fuss", "pied", "pie", "impressum", "mentions"},
    {"sidebar", "side", "aside", "widget", "rail", "complementary", "left", "right", "column", "seiten", "leiste", "laterale", "lateral", "colonne", "columna"},
    {"notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "overlay", "warning", "message", "dialog", "privacy", "hinweis", "avis", "aviso", "datenschutz", "bandeau"},
    {"ad", "ads", "advert", "sponsor", "promo", "adsense", "dfp", "commercial", "werbung", "anzeige", "pub", "publicite", "anuncio", "publicidad"},
    {"form", "search", "login", "signup", "subscribe", "newsletter", "register", "contact", "suche", "recherche", "buscar", "anmeldung", "formulaire", "formulario"},
    {"comment", "reply", "replies", "discussion", "disqus", "respond", "reader", "responses", "feedback", "thread", "forum", "kommentar", "commentaire", "comentario", "leser", "avis-lecteurs"},
    {"share", "social", "sharing", "related", "recommended", "more", "popular", "trending", "tags", "links", "teaser", "trends", "read", "teilen", "partager", "compartir", "mehr"},
    {"content", "article", "main", "post", "entry", "body", "text", "story", "page", "prose", "paragraph", "inhalt", "artikel", "beitrag", "contenu", "contenido", "texte", "texto", "articulo", "haupt"},
]
COMMENTS = 7  # the group of readers' comments


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "blocks", "depth", "index", "mark")

    def __init__(self, tag: str, tokens: frozenset, parent: "Node | None", mark: str = ""):
        self.tag, self.tokens, self.parent, self.mark = tag, tokens, parent, mark
        self.children: list[Node] = []
        self.blocks: list[tuple[int, str, int]] = []  # place in the page, text, characters in links
        self.depth = parent.depth + 1 if parent else 0
        self.index = len(parent.children) if parent else 0


def parse(source: str) -> list[Node]:
    """Block nodes in page order, parents first; each has the text that lies in it directly, as blocks.

    A head that is not closed ends at the first tag that cannot stand in it.
    """
    root = Node("body", frozenset(), None)
    nodes, here, skip = [root], root, None
    opened: list[str] = []  # tags from the root down, inline ones included
    owners: list[Node] = []  # the block node of each
    parts: list[str] = []
    links, in_link, place = 0, 0, 0
    open_tags: Counter = Counter()  # a closing tag without an opener costs nothing
    never_closed: set[str] = set()

    def flush() -> None:
        nonlocal parts, links, place
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                here.blocks.append((place, text, links))
                place += 1
            parts, links = [], 0

    def close(to: int) -> None:
        nonlocal here, in_link
        if any(t not in INLINE for t in opened[to:]):
            flush()
        in_link -= sum(t == "a" for t in opened[to:])
        open_tags.subtract(opened[to:])
        del opened[to:], owners[to:]
        here = owners[-1] if owners else root

    at, end = 0, len(source)
    last = source.rfind(">") + 1  # no tag ends beyond
    while at < end:
        m = _TOKEN.search(source, at, last) if at < last else None
        text = source[at : m.start() if m else end]
        if text and skip is None:
            parts.append(text)
            if in_link:
                links += len(text)
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name, closing = name.lower(), bool(m.group(1) or m.group(4))
        if name == "head":
            skip = None if closing else name
            continue
        if skip and not closing and name not in _HEAD and name != "html":
            skip = None
        if name in RAW:
            if not closing and name not in never_closed:
                stop = re.compile(f"</{re.escape(name)}\\b[^>]*+>", re.I).search(source, at)
                at = stop.end() if stop else (end if name in ("script", "style") else at)
                if not stop:
                    never_closed.add(name)
            continue
        if skip or name in ("html", "body", "img", "wbr"):
            continue
        if closing:
            for i in range(len(opened) - 1, -1, -1) if open_tags[name] else ():
                if opened[i] == name:
                    close(i)
                    break
                if name in INLINE and opened[i] not in INLINE:
                    break
            continue
        for i in range(len(opened) - 1, -1, -1) if any(open_tags[t] for t in _ENDS.get(name, ())) else ():
            if opened[i] in _ENDS[name]:
                close(i)
                break
            if opened[i] in _SCOPES:
                break
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if len(opened) >= DEPTH:
            close(DEPTH - 1)
        open_tags[name] += 1
        if name in INLINE:
            opened.append(name), owners.append(here)
            in_link += name == "a"
        else:
            flush()
            tokens, mark = set(), ""
            for key, value in _ATTRIBUTE.findall(m.group(3) or m.group(6) or ""):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id", "role"):
                    tokens.update(_TOKENS.findall(value))
                elif key == "data-mark":
                    mark = value
            here = Node(name, frozenset(tokens), here, mark)
            here.parent.children.append(here)
            nodes.append(here)
            opened.append(name), owners.append(here)
    flush()
    return nodes


FEATURES = len(TAGS) + 3 * len(TOKEN_GROUPS) + 19
_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}


@lru_cache(maxsize=1 << 16)
def _token_bits(token: str) -> int:
    """The groups of a token: one of their words, or what begins with one of five letters or more ("sidebarbox", "comments")."""
    return sum(1 << g for g, words in enumerate(TOKEN_GROUPS) if token in words or any(len(w) > 4 and token.startswith(w) for w in words))


#: Semantic tags stand for a token group, for themselves and all below.
_TAG_BITS = {tag: 1 << g for tag, g in (("nav", 0), ("header", 1), ("footer", 2), ("aside", 3), ("form", 6), ("article", 9), ("main", 9))}


def figures(nodes: list[Node]) -> np.ndarray:
    """A row for each node: its tag, tokens (own, above and below), text and link density of its subtree, depth, siblings."""
    n = len(nodes)
    number = {id(x): i for i, x in enumerate(nodes)}
    parent = [number[id(x.parent)] if x.parent else 0 for x in nodes]
    chars, links, marks, blocks, paragraphs = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    own_bits, above, below, alike, digits = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
    for i, x in enumerate(nodes):
        for _, text, linked in x.blocks:
            size = len(text)
            chars[i] += size
            links[i] += min(linked, size)
            digits[i] += sum(map(str.isdigit, text)) if size < 40 else 0
            marks[i] += text.count(". ") + text.endswith(".") + text.count(",")
        blocks[i] = len(x.blocks)
        paragraphs[i] = int(x.tag == "p" and blocks[i] > 0)
        for w in x.tokens:
            own_bits[i] |= _token_bits(w)
        above[i] = (above[parent[i]] | own_bits[parent[i]] if i else 0) | _TAG_BITS.get(x.tag, 0)
        if x.children:
            tags: dict[str, int] = {}
            for y in x.children:
                tags[y.tag] = tags.get(y.tag, 0) + 1
            for y in x.children:
                alike[number[id(y)]] = tags[y.tag]
    own_chars, own_links, elements = np.array(chars), np.array(links), [1] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        below[p] |= below[i] | own_bits[i] | _TAG_BITS.get(nodes[i].tag, 0)
        chars[p] += chars[i]
        links[p] += links[i]
        marks[p] += marks[i]
        blocks[p] += blocks[i]
        paragraphs[p] += paragraphs[i]
        elements[p] += elements[i]
    base, groups = len(TAGS), len(TOKEN_GROUPS)
    out = np.zeros((n, FEATURES), np.float32)
    tag = np.array([_TAG_NUMBER.get(x.tag, -1) for x in nodes])
    known = np.flatnonzero(tag >= 0)
    out[known, tag[known]] = 1
    bits = np.arange(groups)
    out[:, base : base + groups] = np.array(own_bits)[:, None] >> bits & 1
    out[:, base + groups : base + 2 * groups] = np.array(above)[:, None] >> bits & 1
    out[:, base + 2 * groups : base + 3 * groups] = np.array(below)[:, None] >> bits & 1
    rest, up = out[:, base + 3 * groups :], np.array(parent)
    siblings = np.array([len(x.parent.children) if x.parent else 1 for x in nodes])
    c, link, paragraph = np.array(chars), np.array(links), np.array(paragraphs)
    some = np.maximum(1, c)
    rest[:, 0], rest[:, 1] = np.log1p(own_chars), np.log1p(c)
    rest[:, 2] = link / some
    rest[:, 3] = own_links / np.maximum(1, own_chars)
    rest[:, 4] = c / np.array(elements)  # text density of the subtree
    rest[:, 5] = c / np.maximum(1, np.array(blocks))
    rest[:, 6] = np.array(marks) / some * 100
    rest[:, 7] = np.log1p(paragraph)
    rest[:, 8] = c / max(1, chars[0])
    rest[:, 9] = c / some[up]
    rest[:, 10] = [x.depth for x in nodes]
    rest[:, 11], rest[:, 12] = siblings, np.array([x.index for x in nodes]) / np.maximum(1, siblings - 1)
    rest[:, 13] = np.array(alike) / siblings
    rest[:, 14] = link[up] / some[up]
    rest[:, 15] = np.log1p(paragraph[up])
    rest[:, 16] = np.arange(n) / n
    rest[:, 17] = np.array(digits) / np.maximum(1, own_chars)
    # a heading is known by what stands beside it: the comments' bits of its siblings
    beside = np.array([0, *(below[parent[i]] & ~(below[i] | own_bits[i]) for i in range(1, n))])
    rest[:, 18] = beside >> COMMENTS & 1
    return out
