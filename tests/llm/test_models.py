import random

import numpy as np
import pytest

from quern.llm.bilstm_crf import Tagger
from quern.llm.html_dom import figures, parse
from quern.llm.html_text import learned, text_of
from quern.llm.mixing import mix
from quern.llm.packing import SumOfSquares, Piece
from quern.llm.pii import base_spans, luhn, masked
from quern.llm.quality_rules import quality


def extracted(page):
    nodes = parse(page)
    return text_of(nodes, learned().logits(figures(nodes)))


def test_article_without_the_rest():
    page = """<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/">Blog</a></li></ul></nav>
    <div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p>First   one,<br>of two. It goes on for a while.</p><p>Second &#233;.</p></article>
    <div class="comments"><p>Nice post.</p></div><script>var a = "<p>x</p>";</script><footer>&copy; us</footer></body></html>"""
    assert extracted(page) == "Title & more\nFirst one, of two. It goes on for a while.\nSecond é."


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "</p></div>", "<a" * 50, "<div>" * 300])
def test_broken_pages_do_not_crash(page):
    assert isinstance(extracted(page), str)


def test_base_spans():
    text = "a.b@c.de, 1.2.3.4 and 300.1.1.1 or 4111 1111 1111 1111; +1 (017) 555-7713 x@y"
    assert [(k, text[a:b]) for k, a, b in base_spans(text)] == [(0, "a.b@c.de"), (1, "1.2.3.4"), (2, "4111 1111 1111 1111"), (3, "+1 (017) 555-7713")]
    assert masked(text, base_spans(text)).startswith("[EMAIL], [IP] and 300.1.1.1 or [CARD]; [PHONE]")
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_crf_gradients():
    r = np.random.default_rng(1)
    t = Tagger(5, 3, hidden=4)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = r.integers(0, 5, (3, 6)), r.integers(0, 3, (3, 6))
    _, grads = t.loss_and_gradients(x, y)
    for k, v in t.p.items():
        i = tuple(r.integers(0, n) for n in v.shape)
        keep = v[i]
        v[i] = keep + 1e-3
        up = t.loss_and_gradients(x, y)[0]
        v[i] = keep - 1e-3
        down = t.loss_and_gradients(x, y)[0]
        v[i] = keep
        assert abs((up - down) / 2e-3 - grads[k][i]) < 2e-3


def test_windows_are_full_or_powers_of_two():
    r, bins, windows = random.Random(3), SumOfSquares(64), []
    total = 0
    for i in range(500):
        n = r.randrange(1, 64)
        total += n
        if full := bins.place(Piece(i, 0, b"\0" * 4 * n, n)):
            windows.append(full)
    windows += bins.close()
    sizes = [sum(map(len, w)) for w in windows]
    assert sum(sizes) == total and all(s & (s - 1) == 0 and s <= 64 for s in sizes)


def test_mixing_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d e", None), (None, "f", "y")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 6 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == round(sum({r["source"]: round(r["target"]) for r in got}.values()))
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_quality_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "w " * 40, "en", "s"), (4, " ".join(f"word{i}" for i in range(40)), "en", None)]
    got = {r["doc_id"]: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i]["base_failed"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert got[3]["n_repeat_words"] == 40 and got[4]["kept"]
