"""Personal data: the patterns against plain ones, and what the tagger adds on written spans it has not seen."""

import hashlib
import random
import re

import pytest

from quern.llm.pii import KINDS, _written, all_spans, base_spans, find, learn, luhn, redact

PLAIN = ["the words of this text stand for prose of any kind, and hold nothing else " * 3, "der die das und ein satz mit vielen worten steht hier als text ohne zahlen " * 3]


def plain_spans(text):
    """The contract's patterns as they are written there."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]


@pytest.fixture(scope="module")
def tagger(spark, small):
    return learn(spark.read.parquet(f"{small}/documents.parquet"))


def test_base_spans_are_the_patterns(spark, small):
    r = random.Random(2)
    texts = [t for (t,) in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["".join(r.choice("0123456789.@+-() ab") for _ in range(80)) for _ in range(400)] + [_written(r, r.choice(PLAIN))[0] for _ in range(300)]
    for text in texts:
        assert base_spans(text or "") == plain_spans(text or "")


def test_the_tagger_finds_written_spans_that_the_patterns_miss(tagger):
    r, total, caught, extra = random.Random(4242), 0, 0, 0
    texts, gold = zip(*(_written(r, r.choice(PLAIN)) for _ in range(600)), strict=True)
    for spans, (base, found) in zip(gold, all_spans(tagger, list(texts)), strict=True):
        missed = [s for s in spans if s not in base]
        total += len(missed)
        caught += sum(s in found for s in missed)
        extra += sum(s not in base and not any(s[1] < g[2] and g[1] < s[2] for g in spans) for s in found)
    assert total > 200 and caught / total >= 0.8 and extra <= 20


def test_the_tagger_adds_secrets_and_leaves_clean_texts_alone(spark, small, tagger):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["spans"]) for r in find(docs, tagger).join(docs.select("doc_id", "text"), "doc_id").collect()}
    added = {i for i, (t, s) in rows.items() if "secret" in s}
    assert added == {i for i, (t, _) in rows.items() if re.search(r'token = "[0-9a-f]{40}"', t or "", re.I)} and len(added) > 3
    for text, spans in rows.values():
        if not re.search("[0-9@]", text or ""):
            assert spans == ""


def test_rows_of_all_kinds(spark, tagger):
    text = 'write to a.b@c.de or 1.2.3.4 and token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" here'
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, None, "x"), (3, "", "x"), (4, "plain words " * 20_000 + "end at x@y.org", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = find(df, tagger).collect()
    base = "email:9:17,ip:21:28"
    assert [(r["n_email"], r["n_ip"], r["base_sha256"]) for r in got if r["doc_id"] == 1] == [(1, 1, hashlib.sha256(base.encode()).hexdigest())] * 2
    assert all(r["spans"].startswith(base) and "secret:" in r["spans"] for r in got if r["doc_id"] in (1, None))
    assert [(r["doc_id"], r["spans"]) for r in got if r["doc_id"] in (2, 3)] == [(2, ""), (3, "")]
    assert [r["n_email"] for r in got if r["doc_id"] == 4] == [1]
    clean = {(r["doc_id"], r["text"]) for r in redact(df, tagger).where("doc_id < 4").collect()}
    assert {t for i, t in clean if i == 1} == {'write to [EMAIL] or [IP] and token = "[SECRET]" here'} and (2, None) in clean and (3, "") in clean
    assert find(spark.createDataFrame([], "doc_id long, text string"), tagger).collect() == [] and len(KINDS) == 5
