"""Exact duplicates of texts, found by owners that keep compressed radix (Patricia) tries of full byte strings.

Every text goes, with its length and SHA-256 as the partition key, to one owner task. The owner inserts the whole byte
string into a radix trie; a terminal node holds the identifier that stays, the number of rows that ended there and the
SHA-256 that came with them. Before the shuffle each map task merges equal texts, so a text held by a third of all rows
reaches its owner once a batch (once a task if it repeats within batches). The number of owners follows from the bytes
of all texts, so that most tries stay within ``budget``. One that outgrows it evicts the heaviest subtree: the strings
in it and those that arrive for it later are returned as rows tagged with the subtree, and the next round gives every
such subtree to a task of its own. Spilled strings live in Spark's shuffle and the shared folder alone. A task holds its
trie, one Arrow batch (bounded in bytes) and, on the map side, at most HELD bytes of repeated texts.

Null texts count as empty and equal each other. Among equal texts a null identifier stays only if all are null. Rows
that repeat both identifier and text count in group_size, and all of those with the identifier that stays are kept.
Long texts are compared whole; one longer than the budget is a trie of its own. Other columns pass through, those named like a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import apart, hidden, mapped, materialise, release, skew_safe_lookup, text_of

__all__ = ["RadixTrie", "classes", "exact_dedup"]

#: What a node takes beside its label: the object, its table of children or its end.
NODE = 400
#: Bytes of repeated texts that a map task holds back; bytes of an owner's rows in one Arrow batch.
HELD, SENT = 16 << 20, 2 << 20
#: Owners at most; beyond that tries outgrow their budget and spill.
OWNERS = 1 << 15
OWNED = "spilled boolean, subtree long, len long, sha binary, body binary, best long, n long"


class _Node:
    __slots__ = ("away", "below", "end", "label")

    def __init__(self, label: bytes):
        self.label, self.below, self.end, self.away = label, None, None, False


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of a and b[at:], by bisection over memory comparisons."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """Byte strings with an (identifier, count, tag) each; insert() gives the prefix of the evicted subtree it belongs to, or None."""

    def __init__(self, better: Callable = min):
        self.root, self.better, self.held, self.strings = _Node(b""), better, 0, 0

    def _merge(self, a: tuple | None, best: int | None, n: int, tag: bytes | None) -> tuple:
        if a is None:
            self.strings += 1
            return best, n, tag
        return (best if a[0] is None else a[0] if best is None else self.better(a[0], best)), a[1] + n, a[2]

    def insert(self, text: bytes, best: int | None, n: int = 1, tag: bytes | None = None) -> bytes | None:
        node, at = self.root, 0
        while not node.away:
            if at == len(text):
                node.end = self._merge(node.end, best, n, tag)
                return None
            if node.below is None:
                node.below = {}
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = _Node(text[at:])
                child.end = self._merge(None, best, n, tag)
                self.held += len(child.label) + NODE
                return None
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            split = _common(child.label, text, at)
            fork = _Node(child.label[:split])
            child.label = child.label[split:]
            fork.below = {child.label[0]: child}
            node.below[text[at]] = fork
            self.held += NODE
            node, at = fork, at + split
        return text[:at]

    def ends(self) -> Iterator[tuple[int, int | None, int, bytes | None]]:
        """(length, identifier, count, tag) of every string that is left, without building the strings."""
        stack = [(self.root, 0)]
        while stack:
            node, length = stack.pop()
            if node.end is not None:
                yield length, *node.end
            stack += [(x, length + len(x.label)) for x in (node.below or {}).values()]

    def items(self, top: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        """(string, identifier, count) of every string below ``top``."""
        stack = [(top or self.root, prefix + (top or self.root).label)]
        while stack:
            node, path = stack.pop()
            if node.end is not None:
                yield path, *node.end[:2]
            stack += [(x, path + x.label) for x in (node.below or {}).values()]

    def evict(self) -> tuple[bytes, Iterator[tuple[bytes, int, int]]]:
        """Takes the heaviest subtree out that is no more than half of what is held (or a single string): (prefix, its strings)."""
        weight: dict[int, int] = {}
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += (node.below or {}).values()
        for node in reversed(order):
            weight[id(node)] = len(node.label) + NODE + sum(weight[id(x)] for x in (node.below or {}).values())
        node, path = self.root, b""
        while True:
            node = max((x for x in node.below.values() if not x.away), key=lambda x: weight[id(x)])
            path += node.label
            live = [x for x in (node.below or {}).values() if not x.away]
            if weight[id(node)] <= weight[id(self.root)] / 2 or not live:
                break
        top = _Node(node.label)
        top.below, top.end = node.below, node.end
        self.held -= weight[id(node)]
        self.strings -= sum(x.end is not None for x in _below(top))
        node.below, node.end, node.away = None, None, True
        return path, self.items(top, path[: len(path) - len(top.label)])


def _below(top: _Node) -> Iterator[_Node]:
    stack = [top]
    while stack:
        node = stack.pop()
        yield node
        stack += (node.below or {}).values()


def _rows(found: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes; the body is the fifth column."""
    held: list[tuple] = []
    size = 0
    for row in found:
        held.append(row)
        size += 100 + len(row[4] or b"")
        if size >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _schema() -> pa.Schema:
    return pa.schema([("spilled", pa.bool_()), ("subtree", pa.int64()), ("len", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("best", pa.int64()), ("n", pa.int64())])


def _merged(keep: str) -> Callable:
    """Map side: equal texts of a batch become one row; texts that repeat in a batch are held back to the task's end, HELD bytes at most."""
    better = max if keep == "max" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        room, schema = HELD, _schema()

        def rows(some: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
            return _rows(((False, 0, len(x), hashlib.sha256(x).digest(), x, best, n) for x, (best, n) in some.items()), schema)

        for batch in batches:
            seen: dict[bytes, list] = {}
            for one, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                body = body.as_py()
                if (x := held.get(body) or seen.get(body)) is None:
                    seen[body] = [one, 1]
                else:
                    x[0] = one if x[0] is None else x[0] if one is None else better(x[0], one)
                    x[1] += 1
            for body in [b for b, x in seen.items() if x[1] > 1]:
                if len(body) + NODE <= room:
                    held[body] = seen.pop(body)
                    room -= len(body) + NODE
            yield from rows(seen)
        yield from rows(held)

    return run


def _own(keep: str, budget: int) -> Callable:
    """Owner side: the trie, and what is evicted from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = RadixTrie(max if keep == "max" else min), _schema()

        def away(found: Iterable[tuple[bytes, int, int]], subtree: bytes) -> Iterator[pa.RecordBatch]:
            tag = zlib.crc32(subtree)
            return _rows(((True, tag, len(x), hashlib.sha256(x).digest(), x, best, n) for x, best, n in found), schema)

        for batch in batches:
            late: dict[bytes, list] = {}
            for sha, body, best, n in zip(batch.column("sha"), batch.column("body"), batch.column("best").to_pylist(), batch.column("n").to_pylist(), strict=True):
                body = body.as_py()
                if (prefix := trie.insert(body, best, n, sha.as_py())) is not None:
                    late.setdefault(prefix, []).append((body, best, n))
            for prefix, found in late.items():
                yield from away(found, prefix)
            while trie.held > budget and trie.strings > 1:
                prefix, strings = trie.evict()
                yield from away(strings, prefix)
        yield from _rows(((False, 0, length, sha, None, best, n) for length, best, n, sha in trie.ends()), schema)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", budget: int = 96 << 20) -> DataFrame:
    """A row for each distinct text: sha (32 bytes), len, best (the identifier that stays: ``keep`` is min or max), n rows. It is a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + NODE)).first()[0] or 0
    # twice as many owners as would fill their budgets; a number of its own also keeps Spark from merging partitions
    owners = int(min(max(2 * total // budget + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), OWNERS))
    todo, parts, tables = mapped(rows, _merged(keep), OWNED).repartition(owners, "len", "sha"), [], []
    while True:
        out = materialise(mapped(todo, _own(keep, budget), OWNED))
        tables.append(out)
        parts.append(out.filter(~F.col("spilled")).select("sha", "len", "best", "n"))
        spilled = out.filter("spilled")
        if spilled.isEmpty():
            break
        todo = spilled.repartition("subtree")
    if len(parts) == 1:
        return parts[0]
    # a subtree may have gone away in two steps, with a text on either side
    whole = materialise(reduce(DataFrame.unionAll, parts).groupBy("sha", "len").agg((F.max if keep == "max" else F.min)("best").alias("best"), F.sum("n").alias("n")))
    release(*tables)
    return whole


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", budget: int = 96 << 20) -> DataFrame:
    """``docs`` with text_sha256, keep_id, group_size and kept (names in use are overwritten)."""
    found = classes(docs, id_col, text_col, keep, budget).select(F.hex("sha").alias("_sha"), F.col("best").alias("_best"), F.col("n").alias("_n"))
    sha: Column = F.sha2(text_of(text_col).cast("binary"), 256)
    own = docs.select(*hidden(docs), F.col(id_col).cast("long").alias("_id"), F.upper(sha).alias("_sha"))
    out = skew_safe_lookup(own, found, "_sha", "_n", "_id")
    made = [F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_id").eqNullSafe(F.col("_best")).alias("kept"), F.lower("_sha").alias("text_sha256")]
    return out.select(*apart(docs, "keep_id", "group_size", "kept", "text_sha256"), *made)
