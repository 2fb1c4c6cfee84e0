"""Tables of phrases, all looked for in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 500_000  # a table of rules goes to every task, so it is bounded: some 50 MB


@dataclass(frozen=True)
class Rule:
    """`phrase` stands for `label`; as a whole word it may have no ASCII letter or digit beside it; folded, case is not looked at."""

    phrase: str
    label: str
    word: bool = False
    fold: bool = True


def from_table(rules: DataFrame, word: bool = False, fold: bool = True) -> list[Rule]:
    """Rules from (phrase, label), in the order of phrases."""
    rows = rules.select("phrase", "label").orderBy("phrase", "label").limit(MOST_RULES + 1).collect()
    return [Rule(r["phrase"], r["label"], word, fold) for r in rows]


class Matcher:
    """An automaton over all phrases; its time goes by the text and what is found there, not by the number of rules."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        self.folded, self.exact = self._automaton(True), self._automaton(False)

    def _automaton(self, fold: bool):
        by_phrase: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            if r.phrase and r.fold == fold:
                by_phrase.setdefault(r.phrase.lower() if fold else r.phrase, []).append(i)
        machine = ahocorasick.Automaton()
        for phrase, numbers in by_phrase.items():
            machine.add_word(phrase, (len(phrase), numbers))
        machine.make_automaton()
        return machine if by_phrase else None

    def places(self, text: str | None) -> dict[int, int]:
        """{number of a rule: where it is found first}."""
        found: dict[int, int] = {}
        for machine, t in ((self.folded, (text or "").lower()), (self.exact, text or "")):
            for end, (length, numbers) in machine.iter(t) if machine else ():
                at = end - length + 1
                alone = not (at and _inner(t[at - 1])) and not (end + 1 < len(t) and _inner(t[end + 1]))
                for i in numbers:
                    if i not in found and (alone or not self.rules[i].word):
                        found[i] = at
        return found

    def longest(self, text: str | None) -> list[tuple[int, int]]:
        """(number of a rule, where) of phrases that do not overlap: the leftmost first, of those the longest, of those the first rule."""
        spans = []
        for machine, t in ((self.folded, (text or "").lower()), (self.exact, text or "")):
            for end, (length, numbers) in machine.iter(t) if machine else ():
                at = end - length + 1
                alone = not (at and _inner(t[at - 1])) and not (end + 1 < len(t) and _inner(t[end + 1]))
                spans += [(at, -length, i) for i in numbers if alone or not self.rules[i].word]
        out, upto = [], 0
        for at, length, i in sorted(spans):
            if at >= upto:
                out.append((i, at))
                upto = at - length
        return out


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def rule_hits(df: DataFrame, text: Column, rules: list[Rule], longest: bool = False) -> DataFrame:
    """df with `hits`: (rule, label, phrase, at) of the rules that `text` holds, in the rules' order, each at its first place.

    With `longest`, phrases that do not overlap, in the order of the text.  Rules are sent with the task; texts pass in Arrow batches.  Null texts
    have no hits.  df must have no columns named hits or text_.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kept = df.columns
    hit = "array<struct<rule int, label string, phrase string, at int>>"
    kind = pa.list_(pa.struct([("rule", pa.int32()), ("label", pa.string()), ("phrase", pa.string()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules)
        for batch in batches:
            hits = []
            for t in batch.column("text_").to_pylist():
                found = matcher.longest(t) if longest else sorted(matcher.places(t).items())
                hits.append([{"rule": i, "label": rules[i].label, "phrase": rules[i].phrase, "at": at} for i, at in found])
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(hits, kind)], [*kept, "hits"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"hits {hit}"])
    return df.withColumn("text_", text).mapInArrow(run, schema)


def labels(hits: str = "hits") -> Column:
    """The labels found, each once, in the rules' order."""
    return F.array_distinct(F.transform(hits, lambda h: h["label"]))
