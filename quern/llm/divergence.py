"""How far the sources of a language are from each other, term by term.

Each language keeps the terms that enough of its documents hold.  They are found by refining byte prefixes, an iceberg query level by level: a
prefix is held by at least as many documents as any term that begins with it, so a prefix below the
threshold rules out all of its terms, and only terms with a surviving prefix are cut to the next, longer prefixes.  A term ends
in a zero byte, which no term holds, so a prefix with one is a complete term and its count is the term's own.

Survivors reach the tasks as a bitmap of their hashes, of a fixed size however many there are: two that share a bit
cost a count in vain, as the threshold is asked of exact counts at every level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import chunks, discard, table, written
from quern.operators.ranking import sent_whole, top_k

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
FIRST_LEVEL = 8  # bytes; each level has twice those of the one before
BITS = 1 << 26  # of the bitmap: 8 MB
_ROWS = 32768  # bits in a row of the bitmap
SOURCES, TERMS = 512, 256  # sources of a tile, terms of a block

#: Separators become spaces and A-Z a-z; letters and the bytes of all other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", 1 << 21):
        bags = [Counter(t.translate(_FOLD).split()) for t in batch.column("text").to_pylist()]
        packed = [[np.fromiter(x, np.int32, len(b)).tobytes() for x in (map(len, b), b.values())] for b in bags]
        columns = [pa.array([b"".join(b) for b in bags], pa.binary()), *(pa.array(c, pa.binary()) for c in (list(zip(*packed)) or [(), ()]))]
        yield pa.record_batch([batch.column("lang"), batch.column("source"), *columns], ["lang", "source", "terms", "lengths", "counts"])


def bags(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, terms, lengths, counts) for each row of df: its distinct terms one after another, the bytes of each, and how often it
    holds each; both are packed numbers of 32 bits, as a row is one text."""
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    docs = df.select(*plain).withColumn("text", F.col("text").cast("binary"))
    return docs.mapInArrow(_bags, "lang string, source string, terms binary, lengths binary, counts binary")


def _numbers(packed: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(all packed numbers, how many of each row)."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2] or b"", np.int32)[ends[0] // 4 : ends[-1] // 4], np.diff(ends) // 4


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, pa.DictionaryArray, np.ndarray, np.ndarray]]:
    """(language, its rows, their terms one after another, the bytes of each distinct one, the row of each)."""
    langs = batch.column("lang").dictionary_encode()
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        rows = batch.filter(pa.compute.equal(langs.indices, k))
        lengths, each = _numbers(rows.column("lengths"))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        terms = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), rows.column("terms").buffers()[2]]).dictionary_encode()
        yield lang, rows, terms, pa.compute.binary_length(terms.dictionary).to_numpy(), np.repeat(np.arange(rows.num_rows), each)


class Survivors:
    """A bitmap of (language, bytes) that answers yes for all of its members, and seldom for others."""

    def __init__(self, members: DataFrame, column: str, bits: int = BITS):
        place = F.pmod(F.xxhash64("lang", column), F.lit(bits))
        rows = members.groupBy(F.floor(place / _ROWS).alias("k")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(_ROWS))).alias("b")).collect()  # bits / 32768 rows at most
        size = max(1, bits // _ROWS)
        held = bytearray(size * _ROWS // 8)
        for r in rows:
            held[r["k"] * _ROWS // 8 : (r["k"] + 1) * _ROWS // 8] = bytes(r["b"])
        self.bits, self.sent = bits, members.sparkSession.sparkContext.broadcast(bytes(held))

    def of(self, lang: str):
        """A function of bytes, for one language."""
        held, seed, bits = self.sent.value, xxhash.xxh64_intdigest(lang.encode(), 42), self.bits

        def has(raw: bytes) -> bool:
            at = xxhash.xxh64_intdigest(raw, seed) % bits
            return held[at >> 3] >> (at & 7) & 1 == 1

        return has


def _signed_safe(bits: int) -> int:
    """Hashes are signed in Spark and unsigned in tasks; their remainders agree for powers of two."""
    if bits & bits - 1 or bits < _ROWS:
        raise ValueError("bits must be a power of two, 32768 at least")
    return bits


def _prefix_documents(level: int, before: int, survivors: Survivors | None):
    """(lang, prefix, n): in how many documents terms with a surviving prefix have which prefix of `level` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, terms, size, doc in _by_lang(batch):
                at = np.flatnonzero(size >= before)
                if survivors:
                    begin = pa.compute.binary_slice(terms.dictionary.take(pa.array(at)), 0, before).to_pylist()
                    at = at[np.fromiter(map(survivors.of(lang), begin), bool, len(at))]
                ended = pa.compute.binary_join_element_wise(terms.dictionary.take(pa.array(at)), b"\0", b"")
                prefixes = pa.compute.binary_slice(ended, 0, level).dictionary_encode()
                number = np.full(len(size), -1, np.int64)
                number[at] = prefixes.indices.to_numpy()
                index = terms.indices.to_numpy()
                of, wide = number[index], len(prefixes.dictionary)
                whole = (of >= 0) & (size < level)[index]  # complete terms are distinct in a document; longer ones may share a prefix
                n = np.bincount(of[whole], minlength=wide)
                cut = (of >= 0) & ~whole
                n += np.bincount(np.unique(doc[cut] * max(1, wide) + of[cut]) % max(1, wide), minlength=wide)
                yield pa.record_batch([pa.array([lang] * wide, pa.string()), prefixes.dictionary, pa.array(n)], ["lang", "prefix", "n"])

    return run


def kept_terms(held: DataFrame, least: int = LEAST_DOCUMENTS, first: int = FIRST_LEVEL, bits: int = BITS) -> DataFrame:
    """(lang, term): the terms of bags() in at least `least` documents of a language, by levels of prefixes until all are complete."""
    level, before, survivors, done = first, 0, None, []
    while True:
        counted = held.select("lang", "terms", "lengths").mapInArrow(_prefix_documents(level, before, survivors), "lang string, prefix binary, n long")
        frequent = written(counted.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        complete = F.substring("prefix", -1, 1) == F.lit(b"\0")
        done.append(frequent.where(complete).select("lang", F.substring(F.col("prefix"), F.lit(1), F.octet_length("prefix") - 1).alias("term")))
        longer = frequent.where(~complete)
        if not longer.limit(1).count():
            break
        survivors, before, level = Survivors(longer, "prefix", _signed_safe(bits)), level, 2 * level
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _occurrences(survivors: Survivors):
    """(lang, term, sources, counts): how often the texts of which sources hold a term that may be kept, one row for a term and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows, terms, size, doc in _by_lang(batch):
                may = np.fromiter(map(survivors.of(lang), terms.dictionary.to_pylist()), bool, len(size))
                sources = rows.column("source").dictionary_encode()
                index = terms.indices.to_numpy()
                key = sources.indices.to_numpy()[doc].astype(np.int64) * max(1, len(size)) + index
                counts, held = _numbers(rows.column("counts"))[0][may[index]], key[may[index]]
                if len(sources.dictionary) * len(size) <= 8 * len(key):
                    sums = np.bincount(held, counts, len(sources.dictionary) * len(size))
                    each = np.flatnonzero(sums)
                    sums = sums[each]
                else:
                    each, at = np.unique(held, return_inverse=True)
                    sums = np.bincount(at, counts, len(each))
                order = np.lexsort((each // max(1, len(size)), each % max(1, len(size))))
                word, source = each[order] % max(1, len(size)), each[order] // max(1, len(size))
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
                ends = pa.array(np.append(first, len(word)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, x) for x in (sources.dictionary.take(pa.array(source)), pa.array(sums[order].astype(np.int64))))
                yield pa.record_batch([pa.array([lang] * len(first), pa.string()), terms.dictionary.take(pa.array(word[first])), *lists], ["lang", "term", "sources", "counts"])

    return run


def _p(n: str, total: str) -> Column:
    """1 + floor(10**9 (n + 2) / total); decimals, as the product may pass 64 bits."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + 2 as decimal(19,0)) div cast({total} as decimal(20,0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def _shared_sums(wide: int, high: int):
    """(lang, a, b, value) of pairs of sources, summed over the terms that both hold, from rows ordered by (lang, i, j, term).

    value is f(p, q) less what the sums over a's and over b's terms say of such a term.  A block of `high` terms is a matrix of terms by
    sources; sums stay in a matrix of the tile (of `wide` sources, or of two times as many), so pairs are sent once for a tile and not for a term.
    """

    value = lambda x, y: (x - y) ** 2 // np.maximum(x + y, 1)

    class Tile:
        def __init__(self, lang: str, i: int, j: int):
            self.of, self.width = (lang, i, j), wide if i == j else 2 * wide
            self.sums, self.base = np.zeros((self.width, self.width), np.int64), np.zeros(self.width, np.int64)
            self.last, self.held = None, np.zeros((3, 0), np.int64)  # the last term; rows of (number of the term, place of the source, p)

        def take(self, rows: pa.RecordBatch) -> None:
            s, p, zero = (rows.column(c).to_numpy() for c in (4, 5, 6))
            terms = rows.column(3).dictionary_encode()
            code = terms.indices.to_numpy()
            new = np.concatenate([[terms.dictionary[int(code[0])].as_py() != self.last], code[1:] != code[:-1]])
            first = self.held[0, -1] if self.held.shape[1] else -1
            _, i, j = self.of
            at = s % wide + (wide if i != j else 0) * (s // wide == j)
            self.base[at] = zero
            self.held = np.concatenate([self.held, [first + np.cumsum(new), at, p]], axis=1)
            self.last = terms.dictionary[int(code[-1])].as_py()
            self.add(int(self.held[0, -1]) // high * high)  # the last term may go on in the next batch

        def add(self, upto: int) -> None:
            begin = int(self.held[0, 0]) if self.held.shape[1] else upto
            for start in range(begin, upto, high):
                a, z = np.searchsorted(self.held[0], [start, min(start + high, upto)])
                self.block(self.held[0, a:z] - start, self.held[1, a:z], self.held[2, a:z])
            self.held = self.held[:, np.searchsorted(self.held[0], upto) :]

        def block(self, term: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
            seen, column = np.unique(at, return_inverse=True)
            grid, there = np.zeros((high, len(seen)), np.int64), np.zeros((high, len(seen)), bool)
            grid[term, column], there[term, column] = p, True
            zero = self.base[seen]
            for k, source in enumerate(seen.tolist()):
                rows = there[:, k]
                own, others = grid[rows, k][:, None], grid[rows, k + 1 :]
                both = value(own, others) - value(own, zero[None, k + 1 :]) - value(zero[k], others) + value(zero[k], zero[k + 1 :])[None]
                self.sums[source, seen[k + 1 :]] += (both * there[rows, k + 1 :]).sum(axis=0)

        def rows(self) -> pa.RecordBatch:
            if self.held.shape[1]:
                self.add(int(self.held[0, -1]) + 1)
            lang, i, j = self.of
            a, b = np.nonzero(self.sums)
            if i != j:  # pairs inside one tile are another task's
                across = (a < wide) & (b >= wide)
                a, b = a[across], b[across]
            number = lambda x: np.where(x < wide, i * wide + x, j * wide + x - wide)
            return pa.record_batch([pa.array([lang] * len(a), pa.string()), pa.array(number(a)), pa.array(number(b)), pa.array(self.sums[a, b])], ["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column(0).dictionary_encode()
            keys = np.stack([langs.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                of = (langs.dictionary[int(keys[0, a])].as_py(), int(keys[1, a]), int(keys[2, a]))
                if tile is None or tile.of != of:
                    if tile:
                        yield tile.rows()
                    tile = Tile(*of)
                tile.take(batch.slice(a, z - a))
        if tile:
            yield tile.rows()

    return run


def _pairs(counts: DataFrame, groups: DataFrame, wide: int) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources.

    Most terms of a large language are missing in most sources.  A missing term has the source's p of count 0, so a pair's sum is that of
    a's terms against b's p of count 0, of b's terms likewise, of the terms that neither holds, and a
    correction over those that both hold.
    """
    tile = lambda c: F.floor(F.col(c) / wide).cast("int")
    placed = counts.withColumn("tile", tile("s")).select("lang", "term", "s", "p", "p0", "tile", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / wide).cast("int"))).alias("other"))
    rows = placed.select("lang", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "term", "s", "p", "p0")
    ordered = rows.repartition("lang", "i", "j", "term").sortWithinPartitions("lang", "i", "j", "term", "s")
    both = ordered.mapInArrow(_shared_sums(wide, TERMS), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))
    a = groups.select("lang", "v", "sources", *(F.col(c).alias(f"a_{c}") for c in ("source", "s", "p0", "held")))
    b = groups.select("lang", *(F.col(c).alias(f"b_{c}") for c in ("source", "s", "p0", "held")))
    # a's terms of one count have one p, so they are summed at once against each other source
    spread = counts.groupBy("lang", "s", "p").agg(F.count("*").alias("m")).join(b, "lang").where("s <> b_s")
    one = spread.groupBy("lang", "s", "b_s").agg(F.sum(F.col("m") * _f("p", "b_p0")).alias("one")).select("lang", F.col("s").alias("x"), F.col("b_s").alias("y"), "one")
    pair = a.join(b, "lang").where("a_s <> b_s")
    pair = pair.join(one.select("lang", F.col("x").alias("a_s"), F.col("y").alias("b_s"), F.col("one").alias("ab")), ["lang", "a_s", "b_s"], "left")
    pair = pair.join(one.select("lang", F.col("y").alias("a_s"), F.col("x").alias("b_s"), F.col("one").alias("ba")), ["lang", "a_s", "b_s"], "left")
    pair = pair.withColumns({"a": F.least("a_s", "b_s").cast("long"), "b": F.greatest("a_s", "b_s").cast("long")}).join(both, ["lang", "a", "b"], "left")
    neither = F.when(F.col("v") > 0, (F.col("v") - F.col("a_held") - F.col("b_held")) * _f("a_p0", "b_p0")).otherwise(F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pair.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), (neither + zero("ab") + zero("ba") + zero("both")).cast("long").alias("value"))


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP, first: int = FIRST_LEVEL, bits: int = BITS, wide: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its own terms.

    Null texts, languages and sources count as empty; rows are documents, also repeated ones and those with one id; a
    source without terms takes part with counts of 0; a language with one source has no pairs, one without kept terms pairs of value 0.  Equal
    values rank by item.  Very long terms take more levels, long texts count whole; other columns are not looked at; an empty table gives no rows.
    """
    held = written(bags(df, text, lang, source))
    kept = written(kept_terms(held, least, first, bits))
    likely = held.mapInArrow(_occurrences(Survivors(kept, "term", _signed_safe(bits))), "lang string, term binary, sources array<string>, counts array<long>")
    # dealt by (lang, term) once, which serves the sums, the join and the window
    parts = likely.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    exact = parts.groupBy("lang", F.col("x.sources").alias("source"), "term").agg(F.sum("x.counts").alias("n")).join(kept, ["lang", "term"])
    in_lang = F.sum("n").over(Window.partitionBy("lang", "term"))  # one row for each source
    counted = written(exact.withColumn("lang_n", in_lang))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    named = held.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0)
    of_lang = Window.partitionBy("lang")
    groups = named.withColumns({"s": F.row_number().over(of_lang.orderBy("source")) - 1, "sources": F.count("*").over(of_lang), "lang_total": F.sum("total").over(of_lang)})
    groups = groups.withColumns({"m": F.col("total") + 2 * F.col("v"), "lang_m": F.col("lang_total") + 2 * F.col("v"), "none": F.lit(0).cast("long")})
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _p("none", "m"))))
    discard(held)

    of_group = groups.select("lang", "source", "s", "sources", "m", "lang_m", "p0")
    each = written(counted.join(sent_whole(of_group), ["lang", "source"]).withColumns({"p": _p("n", "m"), "q": _p("lang_n", "lang_m")}))
    own = each.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _f("p", "q").cast("long").alias("value"))
    order = [F.desc("value"), F.col("item")]
    own = top_k(own, ["lang", "source"], order, top).withColumn("part", F.lit("term"))
    others = _pairs(each, groups, wide).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return others.select(*columns).union(own.select(*columns))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all whole texts of `documents`; null texts, languages and sources are empty (see divergence)."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, count(*) OVER w AS v, sum(coalesce(n, 0)) OVER w AS total
          FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
          WINDOW w AS (PARTITION BY g.lang, g.source)),
whole AS (SELECT lang, term, sum(n) AS n, any_value(v) AS v, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM dense GROUP BY lang, term),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS p FROM dense),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q FROM whole),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
          FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
