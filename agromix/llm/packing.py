"""Packing of documents into sequences, by best fit over the pieces sorted by falling length.

A document's identifiers are followed by id 0 and cut into full windows; each window is a sequence. The remainders of a
few million tokens at a time are sorted by falling length and put into the tightest open window, which a segment tree
over remaining capacities finds. What the fit leaves open is then closed by cutting pieces of the emptiest windows into
the fullest, and the last window is written as sequences whose lengths are powers of two, so nothing needs padding.
Every map task packs what it reads: no shuffle, and memory is bounded by the tokens held at a time.

Null text counts as empty (its only identifier is 0). Rows are packed one by one, so rows that repeat an identifier or
have a null one each get their pieces. Pieces of equal length are packed in the order they are read. Documents of any
length are cut into windows as they come, so only a remainder is held. An empty table gives no pieces. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import mapped, text_of
from agromix.llm.tokens import encode_bytes, rank_file

__all__ = ["CapacityTree", "best_fit", "close_windows", "pack"]

END = bytes(4)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Counts of open windows by remaining capacity 0..size, as a segment tree."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of an open window that is at least ``need``."""
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of indexes into ``lengths`` (each 1..size), by best-fit decreasing."""
    tree, windows, open_at = CapacityTree(size), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (room := tree.tightest(lengths[i])) is None:
            room, where = size, len(windows)
            windows.append([])
        else:
            where = open_at[room].pop()
            tree.add(room, -1)
        windows[where].append(i)
        if left := room - lengths[i]:
            open_at.setdefault(left, []).append(where)
            tree.add(left, 1)
    return windows


def close_windows(windows: list[list[tuple[int, int, int]]], size: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) of windows that need padding are moved or cut until none does."""
    filled = lambda w: sum(x[2] for x in w)
    done, partial = [], []
    for w in windows:
        n = filled(w)
        (done if n == size or n & (n - 1) == 0 else partial).append(w)
    partial.sort(key=filled, reverse=True)
    low, high = 0, len(partial) - 1
    while low < high:
        gap = size - filled(partial[low])
        while gap and partial[high]:
            document, start, length = partial[high].pop()
            if length > gap:
                partial[high].append((document, start, length - gap))
                start, length = start + length - gap, gap
            partial[low].append((document, start, length))
            gap -= length
        if not partial[high]:
            high -= 1
        if not gap:
            done.append(partial[low])
            low += 1
    if low == high and partial[low]:
        rest = partial[low]
        while left := filled(rest):
            gap, one = 1 << (left.bit_length() - 1), []
            while gap:
                document, start, length = rest.pop()
                if length > gap:
                    rest.append((document, start, length - gap))
                    start, length = start + length - gap, gap
                one.append((document, start, length))
                gap -= length
            done.append(one)
    return done


def _packer(path: str, size: int, held_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[tuple] = []
        held: list[tuple] = []  # (identifier, where the remainder starts, its bytes, tokens of the document)
        tokens = 0

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
            rows.clear()
            return out

        def close() -> None:
            nonlocal sequence, tokens
            windows = [[(i, held[i][1], len(held[i][2]) // 4) for i in w] for w in best_fit([len(x[2]) // 4 for x in held], size)]
            for window in close_windows(windows, size):
                at = 0
                for i, start, length in window:
                    one, begin, body, n = held[i]
                    rows.append((one, start, length, zlib.crc32(body[4 * (start - begin) : 4 * (start - begin + length)]), n, sequence, at))
                    at += length
                sequence += 1
            held.clear()
            tokens = 0

        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode_bytes(text.as_py(), path) + END
                n = len(ids) // 4
                for start in range(0, n - size + 1, size):
                    rows.append((one, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, sequence, 0))
                    sequence += 1
                if rest := n % size:
                    held.append((one, n - rest, ids[4 * (n - rest) :], n))
                    tokens += rest
                if tokens >= held_tokens:
                    close()
                if len(rows) >= 20_000:
                    yield flushed()
        close()
        if rows:
            yield flushed()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, held_tokens: int = 4_000_000, path: str | None = None) -> DataFrame:
    """A row for each piece: the document, where in its identifiers the piece starts, its length and CRC-32, and its place in a sequence."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return mapped(rows, _packer(path or rank_file(), size, held_tokens), PIECES)
