"""Cutting papers: sections that stay, paragraphs, and chunks of four scales."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scales with their size and overlap, least paragraphs, and the bounds of the natural scale (fixed values).
SCALES = (("fine", 500, 50), ("std", 1000, 100), ("large", 1500, 200))
PARAGRAPH, NATURAL, MOST = 80, 150, 2000
#: Separators from the coarsest to none (fixed values).
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")
_BLANKS = " \t\n\r\f"
_SIZES = {scale: (size, overlap) for scale, size, overlap in SCALES}
_SENTENCES = re.compile(rf"(?<=[.!?])[{_BLANKS}]+")


def kept_sections(lines: Column, skip: str) -> Column:
    """Lines without those from a heading in `skip` on, up to the next heading after a blank line.

    Each line becomes one sign (skipped heading, other heading, neither); in the string of signs a chain from a skipped
    heading up to the next other one is struck out, so lines are looked at once, however many there are.
    """
    before = F.concat(F.array(F.lit(None).cast("string")), lines)
    heading = lambda x, y: x.rlike("^[ \t]*[A-Z一-鿿]") & (F.length(F.trim(x)) <= 61) & F.coalesce(F.trim(y) == "", F.lit(False))
    sign = lambda x, y: F.when(x.isNull(), "").when(x.rlike(f"(?i)^[ \t]*({skip})[ \t]*$"), "s").when(heading(x, y), "h").otherwise(".")
    signs = F.array_join(F.zip_with(lines, before, sign), "")
    struck = F.split(F.regexp_replace(signs, r"s|(?!^)\G\.", "x"), "")
    kept = F.filter(F.zip_with(lines, struck, lambda x, s: F.struct(x.alias("x"), s.alias("s"))), lambda z: z["x"].isNotNull() & (z["s"] != "x"))
    return F.transform(kept, lambda z: z["x"])


def paragraphs(text: Column, least: int = PARAGRAPH) -> Column:
    """Between blank lines, stripped, of `least` characters or more."""
    parts = F.transform(F.split(text, r"\n[ \t\n\r\f]*\n", -1), lambda p: F.regexp_replace(p, f"^[{_BLANKS}]+|[{_BLANKS}]+$", ""))
    return F.filter(parts, lambda p: F.length(p) >= least)


def merged(parts: Column, least: Column | int) -> Column:
    """Paragraphs put together until a chunk has `least` characters; what is left at the end joins the chunk before."""
    least = F.lit(least) if isinstance(least, int) else least
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, p: Column) -> Column:
        held = F.concat_ws("\n\n", a["open"], p)
        full = F.length(held) >= least
        return F.struct(F.when(full, F.array_append(a["done"], held)).otherwise(a["done"]).alias("done"), F.when(full, F.lit(None)).otherwise(held).alias("open"))

    def close(a: Column) -> Column:
        joined = F.array_append(F.slice(a["done"], 1, F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.concat_ws("\n\n", F.try_element_at(a["done"], F.lit(-1)), a["open"]))
        return F.when(a["open"].isNull(), a["done"]).otherwise(joined)

    return F.aggregate(parts, start, step, close)


def by_sentence(part: Column, most: int = MOST) -> Column:
    """Sentences put together by a space while `most` characters hold them; a longer sentence stays whole."""
    sentences = F.split(part, rf"(?<=[.!?])[{_BLANKS}]+", -1)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, s: Column) -> Column:
        fits = F.length(a["open"]) + F.length(s) + 1 <= most
        full = ~fits & (a["open"] != "")
        held = F.when(fits & (a["open"] != ""), F.concat(a["open"], F.lit(" "), s)).otherwise(s)
        return F.struct(F.when(full, F.array_append(a["done"], a["open"])).otherwise(a["done"]).alias("done"), held.alias("open"))

    return F.aggregate(sentences, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def natural(text: Column) -> Column:
    """Paragraphs as chunks: short ones merged, long ones cut at sentences."""
    whole = merged(paragraphs(text), NATURAL)
    return F.flatten(F.transform(whole, lambda p: F.when(F.length(p) <= MOST, F.array(p)).otherwise(by_sentence(p))))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters: pieces that begin with the coarsest separator there is, put together with an overlap of whole
    pieces; pieces of `size` or more are cut by finer separators on their own."""
    nth = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    cut, finer = separators[nth], separators[nth + 1 :]
    first, *rest = text.split(cut) if cut else list(text)
    chunks: list[str] = []
    held: list[str] = []
    filled = 0

    def close() -> None:
        if whole := "".join(held).strip(_BLANKS):
            chunks.append(whole)

    for piece in filter(None, [first, *(cut + p for p in rest)]):
        if len(piece) >= size and finer:
            close()
            held, filled = [], 0
            chunks += split_recursively(piece, size, overlap, finer)
            continue
        if filled + len(piece) > size:
            close()
            gone = 0
            while gone < len(held) and (filled > overlap or filled + len(piece) > size):
                filled -= len(held[gone])
                gone += 1
            held = held[gone:]
        held.append(piece)
        filled += len(piece)
    close()
    return chunks


def merge(parts: list[str], least: int) -> list[str]:
    """merged() of a list."""
    done: list[str] = []
    held = ""
    for p in parts:
        held = f"{held}\n\n{p}" if held else p
        if len(held) >= least:
            done.append(held)
            held = ""
    if held:
        done[-1:] = ["\n\n".join([*done[-1:], held])]
    return done


def pack_sentences(part: str, most: int = MOST) -> list[str]:
    """by_sentence() of a string."""
    done: list[str] = []
    held = ""
    for s in _SENTENCES.split(part):
        if len(held) + len(s) + 1 <= most:
            held = f"{held} {s}" if held else s
        else:
            done += [held] if held else []
            held = s
    return [*done, held] if held else done


def cut(parts: list[str], scale: str) -> list[str]:
    """A document's chunks of a scale, from its paragraphs: merged to a third of the size and cut where they are longer, or natural ones."""
    if scale not in _SIZES:
        return [c for p in merge(parts, NATURAL) for c in ([p] if len(p) <= MOST else pack_sentences(p))]
    size, overlap = _SIZES[scale]
    return [c for p in merge(parts, size // 3) for c in ([p] if len(p) <= size else split_recursively(p, size, overlap))]


def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[int], list[str]]]:
    """(scale, ids, numbers, texts) of the chunks of a batch of documents (doc_id, parts), for each scale."""
    for batch in batches:
        ids, flat = batch.column("doc_id").to_numpy(), batch.column("parts").flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *batch.column("parts").value_lengths().to_numpy()]).tolist()
        parts = [flat[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)]
        for scale in (*_SIZES, "para"):
            each = [cut(p, scale) for p in parts]
            yield scale, np.repeat(ids, [len(cs) for cs in each]), [n for cs in each for n in range(len(cs))], [c for cs in each for c in cs]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for scale, ids, numbers, texts in cuts(batches):
        yield pa.record_batch([pa.array(ids), pa.array([scale] * len(ids), pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "scale", "chunk", "text"])


def divided(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, parts): the paragraphs of documents that have some."""
    return docs.select("doc_id", paragraphs(text).alias("parts")).where(F.size("parts") > 0)


def chunked(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, scale, chunk, text) of four scales: paragraphs merged to a third of the size and cut where they are longer, and natural ones.

    Each document is cut where it is read; nothing is shuffled.  Null texts and texts without a paragraph of 80 characters have no chunks.
    """
    return divided(docs, text).mapInArrow(_cut, "doc_id long, scale string, chunk long, text string")
