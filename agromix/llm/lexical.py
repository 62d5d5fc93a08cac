"""Ranked lexical search over inverted treaps.

The index is a row for each shard of at most SHARD documents: the documents, their lengths, and for each term the
documents that hold it with the number of occurrences. Building it is one pass without a shuffle; a document's terms are
read from its whole text. What a score needs of all documents (their number, their length, how many hold a term) are
sums over the index.

In each shard a term's postings become a treap: a search tree by document that is a heap by impact, so the root of any
part of it bounds the impacts of that part. A query walks the treaps of all its terms at once, over intervals of documents:
the roots' weighted impacts sum to a bound for the interval; an interval whose bound can't enter the query's best k is
dropped with all that hangs below it. Otherwise the document of the heaviest root is scored and parts the interval, and
each treap with it. The intervals with the largest bounds go first. A task goes through its shards in turn and keeps its
best k of each query, so that later shards are pruned by what earlier ones gave; the best of all tasks are merged in two
steps. Pruning is exact: equal scores are told apart by identifier, also in bounds.

Queries are taken in blocks of bounded size, each against the whole index. Null texts have no term, neither have texts of
separators; documents without a term count in no statistic and are never found. Rows that repeat are ranked each; rows
with a null identifier come last among equals. Queries that repeat (same identifier and text) are answered once. Texts
of any length are read whole. Other columns are not read. Without documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agromix.llm.common import mapped, materialise, text_of

__all__ = ["Treaps", "best_of_shard", "build_index", "rank", "search", "statistics", "terms_of", "weight"]

#: Bounds of a shard: documents (a power of two) and postings.
SHARD = 1 << 14
POSTINGS = 1 << 20
#: Bounds of a block of queries: rows and characters.
QUERIES = 1024
CHARACTERS = 4 << 20
#: Terms up to this many narrow the index to those that the queries hold.
VOCABULARY = 1 << 20
#: Intervals of a query that part together.
TOGETHER = 24
NONE = np.iinfo(np.int64).max

#: Everything in ASCII but digits and letters parts terms; A-Z are lower-cased; other characters are parts of terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def build_index(docs: DataFrame, vocabulary: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder; only of the terms in ``vocabulary``, if given.

    Columns: ids, lengths (arrays by document, ascending by identifier, null ones last), n_null (how many those are),
    terms, counts (how many documents hold each), places (of these documents), occurrences.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        lengths: list[int] = []
        known: dict[bytes, int] = dict(zip(vocabulary, range(len(vocabulary)), strict=True)) if vocabulary is not None else {}
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def closed() -> pa.RecordBatch:
            """The shard as one row: postings by term and place."""
            nonlocal held
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            doc, term, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
            by = np.lexsort((place[doc], term))
            term, doc, count = term[by], place[doc][by], count[by]
            found, n = np.unique(term, return_counts=True)
            names = list(known)
            nulls = sum(i is None for i in ids)
            row = {"ids": [[ids[i] or 0 for i in order]], "lengths": [[lengths[i] for i in order]], "n_null": [nulls], "terms": [[names[t] for t in found.tolist()]], "counts": [n], "places": [doc], "occurrences": [count]}
            ids.clear(), lengths.clear(), parts.clear()
            if vocabulary is None:
                known.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in shape], schema=shape)

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = terms_of(text)
                if not terms:
                    continue
                if vocabulary is None:
                    for t in terms:
                        known.setdefault(t, len(known))
                there = np.fromiter(map(known.get, terms, repeat(-1)), np.int64, len(terms))
                found, n = np.unique(there[there >= 0], return_counts=True)
                parts.append((np.full(len(found), len(ids), np.int64), found, n))
                held += len(found)
                ids.append(doc)
                lengths.append(len(terms))
                if len(ids) == SHARD or held >= POSTINGS:
                    yield closed()
        if ids:
            yield closed()

    shape = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_null", pa.int32()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("occurrences", pa.list_(pa.int32()))])
    schema = "ids array<bigint>, lengths array<bigint>, n_null int, terms array<binary>, counts array<int>, places array<int>, occurrences array<int>"
    return materialise(mapped(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), run, schema))


def statistics(index: DataFrame, wanted: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """(documents, their length, how many hold each of the ``wanted`` terms)."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    n, length = index.select(F.size("ids").alias("n"), total(F.col("lengths")).alias("length")).agg(F.sum("n"), F.sum("length")).first()
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.*")
    asked = index.sparkSession.createDataFrame([(bytearray(t),) for t in wanted], "terms binary")
    holding = each.join(F.broadcast(asked), "terms", "left_semi").groupBy("terms").agg(F.sum("counts").alias("n"))
    return n or 0, length or 0, {bytes(r["terms"]): r["n"] for r in holding.collect()}


class Treaps:
    """Search trees by place that are heaps by impact, one for each of several runs of postings, in arrays."""

    def __init__(self, starts: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        """Run i is [starts[i], starts[i + 1]), ascending by place."""
        n = len(places)
        self.place, self.impact = places, impacts
        self.left, self.right, self.root = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(len(starts) - 1, -1, np.int64)
        # equal impacts are ordered by a mixed place, so that no long runs of them make long paths
        mixed = places.astype(np.int64) * 0x9E37 + 0x79B9 & (1 << 20) - 1
        priority = np.append(impacts.astype(np.int64) << 20 | mixed, -1)
        lo, hi = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
        tree, parent, side = np.arange(len(lo)), np.full(len(lo), -1, np.int64), np.zeros(len(lo), bool)
        while len(lo):
            some = hi > lo
            lo, hi, tree, parent, side = (x[some] for x in (lo, hi, tree, parent, side))
            if not len(lo):
                break
            sizes = hi - lo
            most = np.maximum.reduceat(priority, np.stack([lo, hi], 1).ravel())[::2]
            ends = np.cumsum(sizes)
            each = np.arange(ends[-1]) + np.repeat(lo - ends + sizes, sizes)
            top = each[priority[each] == np.repeat(most, sizes)]
            first = parent < 0
            self.root[tree[first]] = top[first]
            self.left[parent[~first & ~side]] = top[~first & ~side]
            self.right[parent[~first & side]] = top[~first & side]
            both = np.stack([lo, top + 1], 1).ravel(), np.stack([top, hi], 1).ravel()
            lo, hi = both
            tree, parent, side = np.repeat(tree, 2), np.repeat(top, 2), np.tile([False, True], len(top))

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The roots of what lies under each node at places between lo and hi, both left out; -1 where nothing does."""
        node = node.copy()
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            at = node[open_]
            place = self.place[at]
            below, above = place <= lo[open_], place >= hi[open_]
            go = below | above
            open_, at, below = open_[go], at[go], below[go]
            node[open_] = at = np.where(below, self.right[at], self.left[at])
            open_ = open_[at >= 0]
        return node

    def find(self, node: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The nodes at each place, at or under those given; -1 where there is none."""
        node = node.copy()
        open_ = np.flatnonzero(node >= 0)
        while len(open_):
            at = node[open_]
            here, wanted = self.place[at], place[open_]
            go = here != wanted
            open_, at, right = open_[go], at[go], (here < wanted)[go]
            node[open_] = at = np.where(right, self.right[at], self.left[at])
            open_ = open_[at >= 0]
        return node


class Best:
    """The k best of a query so far, by falling score and rising identifier."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]

    def may_enter(self, bound: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
        """Whether a document that scores at most ``bound``, none before ``first_doc``, could be among the best."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | (bound == self.score[-1]) & (first_doc < self.doc[-1])


def best_of_shard(treaps: Treaps, roots: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Adds to ``best`` what the shard has for one query; returns how many documents were scored.

    ``roots`` and ``weights`` by term; ``ids`` by place, ascending. Intervals are rows; what they hold of each term lies
    in one array of nodes beside the numbers of their interval.
    """
    lo, hi = np.array([-1]), np.array([len(ids)])
    of, node, w = np.zeros(len(roots), np.int64), roots, weights
    bound, scored = np.array([(weights * treaps.impact[roots]).sum()]), 0
    while len(lo):
        keep = best.may_enter(bound, ids[lo + 1])
        pick = np.flatnonzero(keep)
        if not len(pick):
            break
        if len(pick) > TOGETHER:
            pick = pick[np.argpartition(-bound[pick], TOGETHER)[:TOGETHER]]
        chosen = np.zeros(len(lo), bool)
        chosen[pick] = True
        number = np.cumsum(chosen) - 1
        mine = chosen[of]
        here, at, wt = number[of[mine]], node[mine], w[mine]
        value = wt * treaps.impact[at]
        # the heaviest root of each interval; nodes of an interval lie together
        starts = np.flatnonzero(np.diff(here, prepend=-1))
        most = np.maximum.reduceat(value, starts)
        heavy = np.flatnonzero(value == most[here])
        place = np.empty(len(starts), np.int64)
        place[here[heavy]] = treaps.place[at[heavy]]
        a, b, d = lo[chosen][here], hi[chosen][here], place[here]
        met = treaps.find(at, d)
        score = np.add.reduceat(np.where(met >= 0, wt * treaps.impact[met], 0), starts)
        best.add(score[score > 0], ids[place][score > 0])
        scored += len(starts)
        sides = []
        for under, over in ((a, d), (d, b)):
            part = treaps.within(at, under, over)
            there = part >= 0
            sides.append((here[there], part[there], wt[there]))
        m = len(starts)
        of_new = np.concatenate([sides[0][0], sides[1][0] + m])
        node_new, w_new = np.concatenate([sides[0][1], sides[1][1]]), np.concatenate([sides[0][2], sides[1][2]])
        sums = np.zeros(2 * m, np.int64)
        np.add.at(sums, of_new, w_new * treaps.impact[node_new])
        lo_new, hi_new = np.concatenate([lo[chosen], place]), np.concatenate([place, hi[chosen]])
        # what is left of the frontier, and the new intervals
        rest = keep & ~chosen
        stay = rest[of]
        of = np.concatenate([(np.cumsum(rest) - 1)[of[stay]], of_new + rest.sum()])
        node, w = np.concatenate([node[stay], node_new]), np.concatenate([w[stay], w_new])
        lo, hi, bound = np.concatenate([lo[rest], lo_new]), np.concatenate([hi[rest], hi_new]), np.concatenate([bound[rest], sums])
        full = bound > 0
        if not full.all():
            stay = full[of]
            of, node, w = (np.cumsum(full) - 1)[of[stay]], node[stay], w[stay]
            lo, hi, bound = lo[full], hi[full], bound[full]
    return scored


def search(index: DataFrame, items: list[tuple], k: int = 50, stats: tuple[int, int, dict[bytes, int]] | None = None) -> DataFrame:
    """(item, doc_id, score) with the k best documents of each task for ``items``, pairs of a number and its terms."""
    terms = sorted({t for _, x in items for t in x})
    n_docs, length, holding = stats or statistics(index, terms)
    weights = {t: w for t in terms if t in holding and (w := weight(n_docs, holding[t])) > 0}
    asked = [(item, [(t, weights[t]) for t in sorted(set(x)) if t in weights]) for item, x in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {item: Best(k) for item, _ in asked}
        for batch in batches:
            for i in range(batch.num_rows):
                col = lambda name, i=i, batch=batch: batch.column(name)[i].values
                ids = col("ids").to_numpy().copy()
                ids[len(ids) - batch.column("n_null")[i].as_py() :] = NONE
                m = 100 - 50 + (50 * col("lengths").to_numpy() * n_docs) // length
                names, counts = col("terms").to_pylist(), col("counts").to_numpy()
                used = np.fromiter((t in weights for t in names), bool, len(names))
                mine = np.repeat(used, counts)
                places, tf = col("places").to_numpy()[mine], col("occurrences").to_numpy()[mine].astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(counts[used])])
                treaps = Treaps(starts, places.astype(np.int64), (1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))
                root = dict(zip((t for t, u in zip(names, used, strict=True) if u), treaps.root.tolist(), strict=True))
                for item, x in asked:
                    if here := [(root[t], w) for t, w in x if t in root]:
                        best_of_shard(treaps, np.array([r for r, _ in here]), np.array([w for _, w in here]), ids, found[item])
        rows = [(item, b.doc, b.score) for item, b in found.items() if len(b.doc)]
        if rows:
            doc, score = np.concatenate([x[1] for x in rows]), np.concatenate([x[2] for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in rows], [len(x[1]) for x in rows]), pa.int64()), pa.array(doc, pa.int64(), mask=doc == NONE), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return mapped(index, run, "item long, doc_id long, score long")


def _cut(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` that score highest for each row of ``items``."""
    asked = materialise(items.select(F.col(item_col).alias("item_id"), text_of(text_col).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()))
    size = asked.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(-(-size[0] // QUERIES), -(-(size[1] or 0) // CHARACTERS), 1)
    at = lambda b: [(r["item"], terms_of(r["text"])) for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
    first = at(0) if blocks == 1 else None
    terms = frozenset(t for _, x in first for t in x) if first is not None else None
    index = build_index(docs, terms if terms is not None and len(terms) <= VOCABULARY else None)
    out = None
    for b in range(blocks):
        found = search(index, at(b) if first is None else first, k).withColumn("salt", F.spark_partition_id() % 64)
        out = found if out is None else out.unionByName(found)
    best = _cut(_cut(out, ["item", "salt"], k).drop("rank"), ["item"], k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
