"""Main-text extraction: hand-made pages, broken markup, and layouts and names that the trees have not seen."""

import time

import pytest

from quern.llm.html_dom import figures, parse
from quern.llm.html_text import _Writer, decode, learned, main_text, op2_html_text, text_of

#: Names of parts that neither the training pages nor the token groups hold.
UNSEEN = {"menu": ["mainlnks", "gnbar"], "side": ["secondary", "zusatz"], "advert": ["gespons", "slot300"], "notice": ["hint", "ccbar"], "form": ["lookup", "mailing"], "comments": ["talkback", "antworten"], "footer": ["closing", "smallprint"], "header": ["crown", "titelbild"], "body": ["lesestoff", "copyblock"]}


def extracted(page):
    nodes = parse(page)
    return text_of(nodes, learned().logits(figures(nodes)))


def test_trees_keep_the_article_on_layouts_they_have_not_seen():
    for names, precision, recall in ((None, 0.98, 0.98), (UNSEEN, 0.9, 0.97)):
        writer = _Writer(77, names) if names else _Writer(78)
        kept_right = kept = right = 0
        for _ in range(200):
            nodes = parse(writer.page())
            found = decode(nodes, learned().logits(figures(nodes)))
            for i, x in enumerate(nodes):
                size = sum(len(b[1]) for b in x.blocks)
                kept += size * (i in found)
                right += size * (x.mark == "1")
                kept_right += size * (i in found and x.mark == "1")
        assert kept_right / kept >= precision and kept_right / right >= recall


def test_an_open_head_ends_where_the_page_begins():
    text = "Some text, of a sentence or two. And more of it here, as articles have."
    for head in ("<html><head><title>x</title><article>", "<head><meta charset='utf-8'><script>var a;</script><article>", "<html><head><title>x</title></head><body><article>"):
        assert extracted(f"{head}<h1>Head</h1><p>{text}</p></article>") == f"Head\n{text}"


_WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat sed diam voluptua".split()


def _prose(sentences):
    return " ".join(" ".join(_WORDS[(7 * i) % 11 : (7 * i) % 11 + 9]).capitalize() + "." for i in range(sentences))


@pytest.mark.parametrize("head", ["", "<html><head><title>x</title>", "<head><title>x</title></head><body>"])
@pytest.mark.parametrize("sentences", [2, 6, 20])
@pytest.mark.parametrize("tag", ["article", "main", "div class=content"])
def test_articles_of_one_paragraph(head, sentences, tag):
    text = _prose(sentences)
    assert extracted(f"{head}<{tag}><p>{text}</p></{tag.split()[0]}>") == text


def test_articles_without_headings_among_other_parts():
    """Layouts written by hand, not by the pages' writer."""
    a, b = _prose(4), _prose(7)
    nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6)) + "</ul></nav>"
    foot = "<footer><p>&copy; 2024 Lorem Ltd. All rights reserved.</p></footer>"
    aside = "<aside class=sidebar><h4>Related</h4><ul><li><a href=/a>One more</a></li><li><a href=/b>Another one</a></li></ul></aside>"
    for page in (
        f"<body>{nav}<article><p>{a}</p></article>{foot}</body>",
        f"<body>{nav}<main><p>{a}</p><p>{b}</p></main>{aside}{foot}</body>",
        f"<body><div class=cookie-banner><p>We use cookies. Accept them.</p></div>{nav}<div id=content><p>{a}</p></div>{foot}</body>",
        f"<body><header><a href=/>Lorem</a></header><section class=story><p>{a}</p><p>{b}</p></section>{aside}</body>",
    ):
        got = extracted(page)
        assert got == (f"{a}\n{b}" if b in page else a)


@pytest.mark.parametrize("comment", ["<div class=comment><p>{}</p></div>", "<li class=comment-item>{}</li>", "<p class=comment-body>{}</p>"])
@pytest.mark.parametrize("heading", ["<h3>3 Comments</h3>", "<h2>Comments (12)</h2>", "<h4>Responses</h4>"])
def test_headings_of_comments_go_with_them(comment, heading):
    a, b = _prose(5), _prose(8)
    readers = "".join(comment.format(x) for x in ("Nice one, thanks.", "I do not agree. It was otherwise.", "First!"))
    for box in ("<div id=zx9>{}</div>", "<section class=comments>{}</section>"):
        page = f"<body><article><h1>Title of it</h1><p>{a}</p><p>{b}</p></article>{box.format(heading + readers)}</body>"
        assert extracted(page) == f"Title of it\n{a}\n{b}"


@pytest.mark.parametrize("page", ["<div>" * 70_000 + "</p>" * 70_000, "<svg>" * 150_000, '<a "' * 150_000, "<li><nav>" * 1000 + "<li></li>" * 60_000, "<b>" * 100_000 + "<p>" * 50_000])
def test_time_grows_with_the_page(page):
    began = time.time()
    parse(page)
    assert time.time() - began < 8  # a quadratic parser takes minutes


def test_rows_of_all_kinds(spark):
    page = "<article><h1>A</h1><p>One sentence, and another. It goes on for a while here.</p></article>"
    rows = [(1, "u", page, 5), (1, "u", page, 5), (2, None, None, 5), (None, "v", "", 5), (3, "w", "no tags at all, only a sentence. And one more of them.", 5)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, nodes int")).collect()
    want = "A\nOne sentence, and another. It goes on for a while here."
    assert sorted((str(r["page_id"]), str(r["url"]), r["text"] if r["page_id"] != 3 else "", r["n_chars"] == len(r["text"])) for r in got) == [("1", "u", want, True), ("1", "u", want, True), ("2", "None", "", True), ("3", "w", "", True), ("None", "v", "", True)]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_of_the_small_table(spark, small):
    """Each page's article, taken from its element by hand, is what the trees find."""
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in op2_html_text(spark, small).collect():
        article = parse(re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1))
        assert r["text"] == "\n".join(b[1] for b in sorted(b for x in article for b in x.blocks))
