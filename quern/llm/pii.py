"""Personal data: exact patterns, and a character BiLSTM-CRF that adds what they miss.

Windows of a text overlap by half; each is decoded whole, and each position takes its tag
from the window in whose middle it lies, so that spans join across windows.  Windows without a digit, an @
or a written-out "(at)" or "dot" hold none of the kinds and are not decoded.  A span counts if the CRF
gives its tags a mean chance of CHANCE and its value is possible (digits of a card or phone, parts of an
address below 256); its form is the tagger's to judge.  Spans that meet one of the patterns' give way to it.

The model learns from spans that the patterns label in a bounded sample of rows, and from forms written into
the sample's windows: those of the patterns, and others that they miss (addresses with (at) or [.], phones without
a plus, cards in other groups, quoted keys and tokens).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.bilstm_crf import Tagger
from quern.llm.shared import bounded_sample, chunks, table

#: The patterns know the first four; "secret" (a quoted key or token) is the tagger's alone.
KINDS = ("email", "ip", "card", "phone", "secret")
WINDOW, STRIDE = 64, 32
SAMPLE, AROUND = 300, 256  # rows to learn from at most, and the characters of each, around its first digit or @
LEARNED, WRITTEN = 600, 2400  # windows of those rows, and windows with written forms
CHANCE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]|[(\[{]at[)\]}]|\bdot\b", re.I)
_SECRET = re.compile(r"""\b(?:token|key|secret|password|auth)\w*["']?\s*[=:]\s*["']?([A-Za-z0-9+/_-]{16,})""", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _parts_fit(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in s.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str, strict: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start; without `strict`, cards need no valid check digit."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _parts_fit(m.group())]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and (not strict or luhn(d))]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# --- the model ---------------------------------------------------------------------------

#: Symbols of their own; other characters fall into classes.
_SIGNS = "@.-+()%_ \n\"=:/,;#!?*&$<>|[]'"
_CLASSES = ("pad", "digit", "lower", "upper", "letter", "other")
_CODES = np.full(0x3000, _CLASSES.index("other"), np.uint8)
for _c in range(0x3000):
    _s = chr(_c)
    _CODES[_c] = _CLASSES.index("digit" if "0" <= _s <= "9" else "lower" if "a" <= _s <= "z" else "upper" if "A" <= _s <= "Z" else "letter" if _s.isalpha() else "other")
for _i, _s in enumerate(_SIGNS):
    _CODES[ord(_s)] = len(_CLASSES) + _i
SYMBOLS = len(_CLASSES) + len(_SIGNS)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CODES[np.minimum(points, len(_CODES) - 1)]


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside; 1 + 2k begins kind k and 2 + 2k goes on with it."""
    y = np.zeros(n, np.int64)
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not y[a:b].any():
            y[a:b] = 2 + 2 * k
            y[a] = 1 + 2 * k
    return y


def _checked(digits: str) -> str:
    """The digits with the last one such that luhn() holds."""
    return next(x for d in "0123456789" if luhn(x := digits[:-1] + d))


def _variant(r: random.Random) -> tuple[int, str]:
    """A kind, and a text of that kind in one of its forms."""
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    k = r.choice((0, 0, 1, 2, 3, 3, 4))
    if k == 0:
        local = r.choice((word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{num(2)}", f"{word()}_{word()}", f"{word()}+{word()}", word().capitalize()))
        domain, end = f"{word()}{r.choice(('', num(1)))}", r.choice(("com", "org", "net", "example.com", "co.uk", "de", "fr"))
        plain = f"{local}@{domain}.{end}"
        at, dot = r.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" @ ", "."), (" @ ", " . "), (" AT ", " DOT "), ("{at}", "{dot}")))
        return k, r.choice((plain, f"{local}{at}{domain}{dot}{end.replace('.', dot)}"))
    if k == 1:
        return k, r.choice((".", ".", "[.]", "(.)", " . ", "[dot]")).join(str(r.randrange(256)) for _ in range(4))
    if k == 2:
        d = _checked(num(r.choice((16, 16, 16, 15, 17, 19))))
        cut = lambda sign, *at: sign.join(d[a:b] for a, b in zip((0, *at), (*at, len(d)), strict=True))
        sign = r.choice((" ", "-", ".", "/", "  ", " - "))
        return k, r.choice((d, d, cut(sign, 4, 8, 12), cut(sign, 4, 8, 12), cut(sign, 4, 10), cut(sign, 8)))
    if k == 3:
        forms = (f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(11)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)}-{num(3)}-{num(7)}")
        return k, r.choice((*forms, f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(2)} {num(7)}", f"0{num(2)}/{num(7)}", f"({num(3)}) {num(7)}", f"0{num(3)} {num(3)} {num(4)}"))
    letters = r.choice(("0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF"))
    return k, "".join(r.choice(letters) for _ in range(r.choice((16, 20, 24, 32, 40, 40, 44))))


def _led(r: random.Random, k: int) -> tuple[str, str]:
    """What stands before and after a span."""
    if k == 4:
        name, sign, quote = r.choice(("token", "key", "api_key", "secret", "password", "auth", "access_token")), r.choice((" = ", "=", ": ", ":")), r.choice(('"', '"', "'", ""))
        return f" {r.choice((name, name.upper()))}{sign}{quote}", f"{quote}{r.choice((' ', '.', '!!', chr(10), '###'))}"
    return r.choice((" ", " ", "\n", "(", ": ", " | ")), r.choice((" ", " ", ".", ",", "\n", ")", "###", "!!", "$$$", " | "))


def _decoy(r: random.Random) -> str:
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    return r.choice((
        num(r.randint(1, 7)), f"{num(1)}.{num(1)}", f"version {num(1)}.{num(1)}.", f"CC BY-NC {num(1)}.0", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(2)}:{num(2)}", f"{num(1)},{num(3)}.{num(2)}",
        f"@{r.choice(('home', 'x', 'all'))}", f"v{num(1)}.{num(2)}", num(24), f"{num(3)}%", f"{num(2)}-{num(2)}", f"{num(1)} {num(3)} {num(3)}", f"{num(3)} + {num(2)} = {num(3)}", f'{word()} = "{word()}"', f'key = "{word()} {word()}"', f"{num(4)}/{num(4)}", f"look at {word()} dot {num(1)}",
        f"{word()} at {word()}", f"the dot {word()}", f"{num(2)} x {num(2)} x {num(2)}", f"{word()}-{num(3)}", f"#{num(5)}", f"p. {num(3)}-{num(3)}", f"$ {num(3)}.{num(2)}", f"{word().upper()}{num(2)}",
    ))


def _written(r: random.Random, text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """text with a form or two, and what looks like one, written into it."""
    spans: list[tuple[int, int, int]] = []
    for _ in range(r.choice((1, 1, 2))):
        at = r.randrange(len(text) + 1)
        if spans and at < spans[-1][2] + 6:
            continue
        if r.random() < 0.7:
            k, s = _variant(r)
            left, right = _led(r, k)
            spans.append((k, at + len(left), at + len(left) + len(s)))
        else:
            s = _decoy(r)
            left, right = _led(r, 0)
        text = text[:at] + left + s + right + text[at:]
        if r.random() < 0.5:
            break
    return text, spans


def learn(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, windows: int = LEARNED, seed: int = 5) -> Tagger:
    """A tagger from at most `windows` windows of about `sample` rows that hold a digit or an @, and WRITTEN written ones.

    Of each of those rows AROUND characters come to the driver; null texts are left out, and without any row the
    written forms stand in plain words.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = rows.where(F.col("text").rlike("[0-9@]")).withColumn("all", F.lit(1))
    texts = [r["text"] for r in bounded_sample(held, ["all"], "id", sample).select(F.expr(f"substring(text, greatest(1, regexp_instr(text, '[0-9@]') - {WINDOW // 2}), {AROUND})").alias("text")).orderBy("text").limit(sample).collect()]
    r = random.Random(seed)
    xs, ys = [], []

    def add(text: str, spans: list[tuple[int, int, int]], low: int = 0) -> None:
        a = r.randrange(max(1, len(text) - WINDOW + 1)) if r.random() < 0.3 else min(max(0, low - r.randrange(WINDOW // 2)), max(0, len(text) - WINDOW // 2))
        x, y = symbols(text)[a : a + WINDOW], _tags(len(text), spans)[a : a + WINDOW]
        xs.append(np.pad(x, (0, WINDOW - len(x))))
        ys.append(np.pad(y, (0, WINDOW - len(y))))

    for text in texts:
        spans = base_spans(text, strict=False) + [(4, m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
        for _ in range(2):
            if len(xs) < windows:
                add(text, spans, r.choice(spans)[1] if spans else 0)
    plain = [re.sub(r"\S*[0-9@]\S*", "", t) for t in texts] or ["plain words of no language stand here " * 4]
    for _ in range(WRITTEN):
        text, spans = _written(r, r.choice(plain)[: 2 * WINDOW])
        add(text, spans, r.choice(spans)[1] if spans else 0)
    tagger = Tagger(SYMBOLS, 1 + 2 * len(KINDS), hidden=24)
    tagger.train(np.array(xs), np.array(ys))
    return tagger


def _possible(k: int, s: str) -> bool:
    """Whether the value of a span can be what the tagger takes it for, whatever its form."""
    d, numbers = _digits(s), re.findall("[0-9]+", s)
    if k == 0:
        return len(s) >= 6 and ("@" in s or "at" in s.lower()) and ("." in s or "dot" in s.lower()) and s[0].isalnum() and s[-1].isalpha()
    if k == 1:
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and s[0] in "0123456789" and s[-1] in "0123456789"
    if k == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    if k == 3:
        return 8 <= len(d) <= 15 and len(numbers) > 1
    return len(s) >= 16 and len(d) >= 2 and any(c.isalpha() for c in s) and not any(c.isspace() for c in s)


def model_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of each text, windows decoded in batches and reconciled over the whole text."""
    places, rows = [], []
    for n, text in enumerate(texts):
        cues = {m.start() // STRIDE for m in _CUE.finditer(text)}
        coded = symbols(text) if cues else None
        for g in sorted({x for c in cues for x in (c - 1, c, c + 1) if x >= 0}):  # the middle of window g begins at g * STRIDE
            a = g * STRIDE - STRIDE // 2
            x = coded[max(0, a) : a + WINDOW]
            if len(x):
                rows.append(np.pad(x, (max(0, -a), WINDOW - len(x) - max(0, -a))))
                places.append((n, g))
    middles: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    middle = slice(STRIDE // 2, STRIDE // 2 + STRIDE)
    for at in range(0, len(rows), 1024):
        tags, chances = tagger.decode(np.array(rows[at : at + 1024]))
        for (n, g), y, p in zip(places[at : at + 1024], tags[:, middle], chances[:, middle], strict=True):
            middles.setdefault(n, []).append((g, y, p))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for n, parts in middles.items():
        size = (parts[-1][0] + 1) * STRIDE
        tags, chances = np.zeros(size, np.int8), np.zeros(size)
        for g, y, p in parts:
            tags[g * STRIDE : (g + 1) * STRIDE], chances[g * STRIDE : (g + 1) * STRIDE] = y, p
        tags = tags[: len(texts[n])]
        kind = (tags + 1) // 2  # 0 outside
        opens = (kind > 0) & ((tags % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind))
        for a in np.flatnonzero(opens).tolist():
            z = a + 1
            while z < len(kind) and kind[z] == kind[a] and not opens[z]:
                z += 1
            k = int(kind[a]) - 1
            if chances[a:z].mean() >= CHANCE and _possible(k, texts[n][a:z]):
                found[n].append((k, a, z))
    return found


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, base and model spans) of each text; a model's span that meets a base span is left out."""
    out = []
    for text, extra in zip(texts, model_spans(tagger, texts), strict=True):
        base = base_spans(text)
        free = [s for s in extra if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        out.append((base, sorted(base + free)))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _find(tagger: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            rows = []
            for base, spans in all_spans(tagger, [x or "" for x in batch.column(1).to_pylist()]):
                rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(df: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of df.

    Counts and the digest are of the base spans, `spans` lists all; null and empty texts have none.  Long texts are
    windows like any other, repeated rows get equal answers, null ids stay, an empty table gives no rows, and
    other columns are not looked at.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return docs.mapInArrow(_find(tagger), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """df with the spans in its texts masked; null texts stay null, all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, 1 << 20):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            clean = [None if x is None else masked(x, spans) for x, (_, spans) in zip(texts, all_spans(tagger, [x or "" for x in texts]), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`: the patterns' counts and digest, and all spans; null texts have none."""
    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))
