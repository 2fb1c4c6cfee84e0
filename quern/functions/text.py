"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOPWORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "as", "at", "by", "an", "or", "be", "was", "are", "this", "that", "with", "from")
TOKEN = r"[a-z0-9](?:[a-z0-9_.\-]*[a-z0-9])"


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters or more, repeats kept, stopwords left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def normal(text: Column) -> Column:
    """Null and "nan" to empty; wide and hard spaces to a space; runs of white space to one."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[　 ]", " "), r"[ \t\n\r\f]+", " "))
    return F.when(F.lower(t) == "nan", "").otherwise(t)


def title(text: Column) -> Column:
    """The first line."""
    return F.substring_index(text, "\n", 1)


def noisy(chunk: Column) -> Column:
    """Too short, few letters, or many short lines."""
    lines = F.split(chunk, "\n", -1)
    letters = F.length(F.regexp_replace(chunk, "[^A-Za-z]", ""))
    return (F.length(chunk) < 80) | (letters * 4 < F.length(chunk)) | ((F.size(lines) > 5) & (F.length(chunk) < 20 * F.size(lines)))


def stripped(text: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def layout(text: Column) -> Column:
    """NUL to a space, runs of blanks to one, three line ends or more to two, stripped."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", " ")
    return stripped(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def plain_title(text: Column) -> Column:
    """Lower case, white space runs to one space, letters a-z, digits and Chinese characters only."""
    t = F.regexp_replace(stripped(F.lower(text)), r"[ \t\n\r\f]+", " ")
    return F.regexp_replace(t, "[^a-z0-9一-鿿 ]", "")


def base_name(path: Column) -> Column:
    """The last part of a path in lower case, without .pdf."""
    return F.regexp_replace(F.lower(F.regexp_extract(normal(path), r"([^/]*)$", 1)), r"\.pdf$", "")


def chinese_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]")) / F.greatest(F.length(text), F.lit(1))
