"""Packing of token sequences by the sum-of-squares rule.

Each task packs the documents of its own partition, so nothing is shuffled.  Full windows
of a long document stand alone; its rest is placed online: of all fill levels (and a new
window), it goes where the sum over levels of squared counts of partially filled windows
becomes least.  The counts are one array over levels.  When the partition ends, the
windows still open fill each other by cutting, and what the last holds is cut to powers of
two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import chunks, table

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 1 << 20
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids as little-endian 32-bit bytes, word by word.

    The tokenizer drops white space and merges within words only, so a text's ids are its
    words' ids in a row; words seen before come from a cache.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # A-Z may be lowered before, as the tokenizer does, except where its own markers occur
        words = [(x if b"<|" in x else x.lower()).split() for x in texts]
        new = list({w for row in words for w in row}.difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS and self.known:
            self.known = {}
            new = list({w for row in words for w in row})
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()
        known = self.known
        return [b"".join([known[w] for w in row]) for row in words]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)

    def __len__(self) -> int:
        return len(self.ids) // 4


class SumOfSquares:
    """Windows of one task that are partly filled, by level."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # of windows at each level; full ones are not counted
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def place(self, piece: Piece) -> list[Piece] | None:
        """The window that the piece has filled, if it has."""
        n = len(piece)
        levels = np.flatnonzero(self.count[1 : self.size - n + 1]) + 1
        # a move from level h to h+n changes the sum of squares by 2 (count[h+n] - count[h]) + 2
        gain = 2 * (self.count[levels + n] - self.count[levels]) + 2
        fresh = 2 * self.count[n] + 1
        level = 0
        if len(levels):
            best = len(levels) - 1 - int(np.argmin(gain[::-1]))  # the fullest of the best
            if gain[best] <= fresh:
                level = int(levels[best])
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append(piece)
        if level + n == self.size:
            return window
        self.count[level + n] += 1
        self.open[level + n].append(window)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The rest: the emptiest windows are cut to fill the fullest, and the last one to powers of two."""
        windows = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        spare = [p for w in reversed(windows) for p in w]
        total, at = sum(len(p) for p in spare), 0
        room = [[self.size, []] for _ in range(total // self.size)]
        for bit in range(self.size.bit_length() - 1, -1, -1):
            if total % self.size >> bit & 1:
                room.append([1 << bit, []])
        stream = iter(p for w in windows for p in w)
        piece = next(stream, None)
        while piece is not None:
            free, held = room[at]
            if len(piece) <= free:
                held.append(piece)
                room[at][0] -= len(piece)
                piece = next(stream, None)
            else:
                head, piece = piece.cut(free)
                held.append(head)
                room[at][0] = 0
            if room[at][0] == 0:
                yield held
                at += 1
        self.open.clear()


def _pack(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(path), SumOfSquares(size)
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []

        def sent(window: list[Piece]) -> None:
            nonlocal sequence
            at = 0
            for p in window:
                out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, at))
                at += len(p)
            sequence += 1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in chunks(batches, "raw", 1 << 20):
            for i, ids in zip(batch.column(0).to_pylist(), encode([x or b"" for x in batch.column(1).to_pylist()]), strict=True):
                ids += end
                piece = Piece(i, 0, ids, len(ids) // 4)
                while len(piece) >= size:
                    head, piece = piece.cut(size)
                    sent([head])
                if len(piece) and (full := bins.place(piece)):
                    sent(full)
            yield batch_of(out)
            out.clear()
        for window in bins.close():
            sent(window)
        yield batch_of(out)

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); each id lies in one piece.

    `size` must be a power of two.  Null and empty texts are the end id alone; repeated
    rows and null ids are packed each; long texts are cut to full windows first; other columns are not looked at; an
    empty table gives no pieces.  The rows of a partition always give the same pieces.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("raw"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.mapInArrow(_pack(tokenizer_path or vocabulary_path(), size, end_id), schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of `documents` as pieces of sequences of 2048 ids; null texts are the end id alone (see pack)."""
    return pack(table(spark, sf_dir, "documents"))
