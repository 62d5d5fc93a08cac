"""Near duplicates by Order MinHash and banded alignment.

A text is a sequence of shingles of five words (lower-cased bytes; a text of one to four words is one shingle), each
labelled with its occurrence so that no two are equal. A sketch takes, under each of ``bands`` hash orders, the three
smallest labelled shingles and keeps them in text order; its hash is the band's key. Texts that share a key are
candidates. Two texts are near duplicates if a banded alignment of their shingles matches m with m / (a + b - m) of at
least 0.8: the similarity of Jaccard's kind, for shingles in order. With shingles unique, the best alignment is the
longest increasing run of matched places, and the threshold bounds how far apart matched places can lie: the band.

A pair of threshold similarity shares a band's key with probability of about 0.5, so twelve bands miss one in 5000.
Equal texts are one class from the start (by SHA-256). Buckets are worked off by pivots: each text in a bucket is
verified against one member, then two others drawn by hash, classes are joined, and buckets within one class are done.
In the buckets that are left all texts of different classes are compared, block by block: no candidate pair stays open
unless its texts already share a class. Hot buckets and hot pivots are dealt out by salts, and hot classes by a bounded broadcast.

Null text counts as empty. Texts without words are near duplicates of equal texts only. Rows with a null identifier are
returned with a null class and take no part. Rows that repeat an identifier are one document and share the text. Other
columns aren't read, whatever their names. Long texts are hashed and aligned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agromix.llm.common import mapped, materialise, release, skew_safe_lookup, text_of

__all__ = ["alignment", "components", "near_classes", "order_minhash", "shingles"]

WORDS, BANDS, TAKEN, SIMILARITY = 5, 12, 3, 0.8
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D | 1
LOWER = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], dtype=np.uint8)
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(SEGMENT + 1, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def _word_hashes(body: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of at most SEGMENT bytes."""
    up, down = _power_tables()
    edge = np.diff(np.concatenate(([1], BLANK[body], [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((LOWER[body].astype(np.uint64) + np.uint64(1)) * up[: len(body)], dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: bytes, k: int = WORDS, labelled: bool = True) -> np.ndarray:
    """Hashes of the text's shingles in order; labelled: each but the first of its kind mixed with its occurrence, so that no two are equal."""
    body = np.frombuffer(text, dtype=np.uint8)
    if len(body) <= SEGMENT:
        words = _word_hashes(body)
    else:  # cut at blanks; a word longer than a segment is cut at the segment's end
        parts, at = [], 0
        while at < len(body):
            end = min(at + SEGMENT, len(body))
            if end < len(body):
                blanks = np.flatnonzero(BLANK[body[at:end]])
                end = at + int(blanks[-1]) + 1 if len(blanks) else end
            parts.append(_word_hashes(body[at:end]))
            at = end
        words = np.concatenate(parts)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = _mix(out + words[j : j + n] + np.uint64(j + 1))
    if not labelled:
        return out
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if not new.all():
        place = np.arange(n)
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        out = np.where(occurrence > 0, _mix(out + occurrence * ODD), out)
    return out


def order_minhash(labelled: np.ndarray, bands: int = BANDS, taken: int = TAKEN) -> np.ndarray:
    """A key for each hash order: the ``taken`` smallest labelled shingles, in text order."""
    n = len(labelled)
    seeds = _mix(np.arange(1, bands + 1, dtype=np.uint64) * ODD)[:, None]
    if n > taken:
        ranked = (labelled[None, :] ^ seeds) * ODD
        ranked ^= ranked >> np.uint64(31)
        ranked *= np.uint64(0xD6E8FEB86659FD93)
        places = np.sort(np.argpartition(ranked, taken - 1, axis=1)[:, :taken], axis=1)
    else:
        places = np.tile(np.arange(n), (bands, 1))
    keys = np.zeros((bands, 1), dtype=np.uint64) + seeds
    for j in range(places.shape[1]):
        keys = _mix(keys + labelled[places[:, j : j + 1]])
    return keys[:, 0]


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Matches m of the best alignment as m / (a + b - m), or 0 where that is under ``similarity``."""
    n = len(a) + len(b)
    need = int(np.ceil(similarity / (1 + similarity) * n - 1e-9))
    if not n or min(len(a), len(b)) < need:
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    places = order[at]
    matched = b[places] == a
    if matched.sum() < need:
        return 0.0
    i = np.flatnonzero(matched)
    j = places[i]
    j = j[np.abs(i - j) <= n - 2 * need]  # the band: no better alignment leaves it
    if len(j) >= need and (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            if not tails or x > tails[-1]:
                tails.append(x)
            else:
                tails[bisect_left(tails, x)] = x
        m = len(tails)
    return m / (n - m) if m >= need else 0.0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha, size, keys = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            body = text.as_py()
            s = shingles(body)
            sha.append(hashlib.sha256(body).digest())
            size.append(len(s))
            keys.append(order_minhash(s).view(np.int64) if len(s) else np.empty(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary()), pa.array(size, pa.int32()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "sha", "size", "keys"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, salt), the pivot's own first: gives the texts that align with their pivot."""
    pivot, own = None, np.empty(0, np.uint64)
    for batch in batches:
        found = []
        for p, x, text in zip(batch.column("p").to_pylist(), batch.column("x").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            if x is None:
                pivot, own = p, shingles(text.as_py())
            elif p == pivot and alignment(own, shingles(text.as_py())):
                found.append((x, p))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def _aligned(edges: DataFrame, texts: DataFrame, held: int = 256) -> DataFrame:
    """Of ``edges`` (x, p, m: the bucket's size) those that align, as (a, b). A pivot's edges go to salts of about ``held``."""
    salts = F.ceil(F.col("m") / held).cast("int")
    edges = materialise(edges.groupBy("x", "p").agg(F.max("m").alias("m")))
    others = edges.select("x", "p", F.pmod(F.xxhash64("x"), salts).cast("int").alias("salt")).join(texts, F.col("x") == F.col("id")).select("p", "salt", "x", "text")
    pivots = edges.groupBy("p").agg(F.max(salts).alias("salts")).join(texts, F.col("p") == F.col("id")).select("p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("x"), "text")
    dealt = others.unionByName(pivots).repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("x").asc_nulls_first())
    found = materialise(mapped(dealt, _verify, "a long, b long"))
    release(edges)
    return found


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, n: int | None = None, few: int = 1 << 14) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b), root being the component's smallest node.

    Up to ``few`` edges (``n`` or counted) one task does, by union-find; more are worked off by alternating stars. Nodes
    with a large share of the edges are joined by broadcast.
    """
    if (edges.count() if n is None else n) <= few:
        return materialise(mapped(edges.filter("a <> b").select("a", "b").coalesce(1), _union_find, "node long, root long"))
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was, is_ = None, state(now)
    while was != is_:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = skew_safe_lookup(both.filter("v > u"), least, "u", "n", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        release(least)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = skew_safe_lookup(large, least, "u", "n", "v").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, now = now, materialise(small.filter("u <> v").distinct())
        release(last, large, least)
        was, is_ = is_, state(now)
    return materialise(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select("v", "v").distinct()))


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (rep, cls), of those that are not their class's smallest, after ``found`` (a, b) linked classes."""
    n, ends = found.count(), found
    for side in ("a", "b") if labels is not None else ():
        ends = ends.join(labels.select(F.col("rep").alias(side), F.col("cls").alias(f"c{side}")), side, "left").withColumn(side, F.coalesce(f"c{side}", side)).drop(f"c{side}")
    roots = components(ends, n)
    moved = roots.filter("node <> root").select(F.col("node").alias("rep"), F.col("root").alias("cls"))
    if labels is None:
        return materialise(moved)
    held = labels.groupBy("cls").agg(F.count("*").alias("n"))
    changed = materialise(roots.withColumnRenamed("node", "cls").join(held, "cls").select("cls", "root", "n"))
    onward = skew_safe_lookup(labels, changed, "cls", "n", "rep").select("rep", F.coalesce("root", "cls").alias("cls"))
    out = materialise(onward.unionAll(moved))
    release(changed, roots)
    return out


def _block_edges(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Edges that join classes among texts (block, id, class, body) of two blocks, or of one.

    Shingles of all texts in common are counted exactly for all pairs by products of 0/1 matrices; that bounds any
    alignment from above, so only pairs over the threshold are aligned, and only while their classes differ.
    """
    blocks, ids, classes = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
    found = [shingles(r[3]) for r in rows]
    sizes = np.array([len(x) for x in found], dtype=np.float64)
    keys = np.array([order_minhash(x) if len(x) else np.full(BANDS, i, np.uint64) for i, x in enumerate(found)])
    values, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    owner = np.repeat(np.arange(len(rows)), sizes.astype(int))
    where = place[inverse]
    owner, where = owner[where >= 0], where[where >= 0]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    common = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for low in range(0, len(shared), 8192):
        part = slice(*np.searchsorted(where, (low, low + 8192)))
        m = np.zeros((len(rows), min(8192, len(shared) - low)), dtype=np.float32)
        m[owner[part], where[part] - low] = 1
        common += m @ m.T
    one, out, parent = blocks.min() == blocks.max(), [], {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        both = sizes + sizes[i]
        good = (common[i] >= SIMILARITY * (both - common[i]) - 1e-6) & (classes != classes[i]) & (keys == keys[i]).any(axis=1)
        for j in np.flatnonzero(good):
            if (j > i if one else blocks[i] < blocks[j]) and root(classes[i]) != root(classes[j]) and alignment(found[i], found[j]):
                out.append((int(ids[i]), int(ids[j])))
                parent[root(classes[i])] = root(classes[j])
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (root, i, j): gives the edges of each pair of blocks."""
    at, held = None, []

    def edges() -> Iterator[pa.RecordBatch]:
        if len(held) > 1 and (found := _block_edges(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        held.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "block", "id", "cls")]
        for r, i, j, block, one, cls, text in zip(*columns, batch.column("text").cast(pa.binary()), strict=True):
            if (r, i, j) != at:
                yield from edges()
                at = (r, i, j)
            held.append((block, one, cls, text.as_py()))
    yield from edges()


def _rest(members: DataFrame, texts: DataFrame, held: int = 256) -> DataFrame:
    """Edges (a, b) among all texts of different classes in the same open bucket, as far as they join classes.

    Open buckets that touch form a pool. In a pool, texts outside its largest class meet each other and those of that
    class; they are dealt to blocks of about ``held`` and a task compares two blocks, so a text travels once for each
    block it meets, pools of one block being the rule. Pools of more than four blocks are worked bucket by bucket, as
    most of their pairs share none.
    """
    pools = components(materialise(members.select(F.col("rep").alias("a"), F.col("low.rep").alias("b")).distinct())).select(F.col("node").alias("id"), "root")
    own = members.select(F.col("rep").alias("id"), "cls").distinct().join(pools, "id")
    sizes = materialise(own.groupBy("root").agg(F.count("*").alias("n_pool")))
    placed = materialise(skew_safe_lookup(own, sizes, "root", "n_pool", "id"))
    wide = placed.filter(F.col("n_pool") > 4 * held).select("id", "cls")
    by_bucket = members.select("key", F.col("rep").alias("id")).join(wide, "id").select("id", "cls", F.xxhash64("key").alias("root"))
    placed = materialise(placed.filter(F.col("n_pool") <= 4 * held).select("id", "cls", "root").unionByName(by_bucket))
    per = placed.groupBy("root", "cls").agg(F.count("*").alias("n")).groupBy("root").agg(F.sum("n").alias("n"), F.max("n").alias("n_major"), F.max_by("cls", F.struct("n", "cls")).alias("major"))
    minor_blocks = F.ceil((F.col("n") - F.col("n_major")) / held)
    per = materialise(per.filter("n > n_major").select("root", "n", "major", minor_blocks.cast("int").alias("minors"), F.ceil(F.col("n_major") / held).cast("int").alias("majors")))
    dealt = skew_safe_lookup(placed, per, "root", "n", "id").filter("n is not null")
    draw = F.xxhash64("id", F.lit(7))
    is_major = F.col("cls") == F.col("major")
    block = F.when(is_major, F.col("minors") + F.pmod(draw, F.col("majors"))).otherwise(F.pmod(draw, F.col("minors"))).cast("int")
    dealt = dealt.withColumn("block", block)
    meets = F.when(is_major, F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1))
    dealt = dealt.join(texts, "id").select("root", "block", "id", "cls", "text", F.explode(meets).alias("other"))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "cls", "text")
    return materialise(mapped(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), _blocks, "a long, b long"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, held: int = 256) -> DataFrame:
    """A row (id, class_id, group_size, kept) for each document; class_id is the smallest identifier of its class.

    ``rounds`` pivots are tried before all pairs of open buckets are; ``held`` texts make a block of those.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    sketched = materialise(mapped(rows.filter("id is not null"), _sketch, "id long, sha binary, size int, keys array<long>"))
    texts_of = materialise(sketched.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    exploded = texts_of.select("rep", "size", F.explode("keys").alias("key"))
    sizes = exploded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("rep", "size")).alias("low")).filter("m > 1")
    sizes = materialise(sizes)
    members = materialise(skew_safe_lookup(exploded, sizes, "key", "m", "rep").filter("m is not null"))
    release(sizes)
    texts = materialise(rows.join(members.select(F.col("rep").alias("id")).distinct().hint("shuffle_hash"), "id"))
    near = lambda a, b: F.least(a, b) >= SIMILARITY * F.greatest(a, b)
    pivoted = lambda df, end: df.filter(F.col("rep") != F.col(f"{end}.rep")).filter(near(F.col("size"), F.col(f"{end}.size"))).select(F.col("rep").alias("x"), F.col(f"{end}.rep").alias("p"), "m")
    edges, labels = pivoted(members, "low"), None
    for round_ in range(rounds + 1):
        found, last, before = _aligned(edges, texts), members, labels
        labels = _joined(before, found)
        # only buckets that still hold two classes go on; each round draws two pivots of theirs by hash
        labelled = materialise(members.select("key", "rep", "size").join(labels, "rep", "left").select("key", "rep", "size", F.coalesce("cls", "rep").alias("cls")))
        release(found, last, before)
        members = labelled
        drawn = F.struct(F.xxhash64("rep", F.lit(round_)).alias("h"), "cls", "rep", "size")
        open_ = members.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("c0"), F.max("cls").alias("c1"), F.min(drawn).alias("low"), F.max(drawn).alias("high")).filter("c0 <> c1").drop("c0", "c1")
        open_ = materialise(open_)
        members = materialise(skew_safe_lookup(members, open_, "key", "m", "rep").filter("m is not null"))
        release(labelled, open_)
        if members.isEmpty():
            break
        if round_ == rounds:
            labels = _joined(labels, _rest(members, texts, held))
        else:
            edges = reduce(DataFrame.unionAll, [pivoted(members.filter(F.col("cls") != F.col(f"{end}.cls")), end) for end in ("low", "high")])
    classed = texts_of.select("sha", "rep", "n").join(labels, "rep", "left").select("sha", "n", F.coalesce("cls", "rep").alias("cls"))
    totals = materialise(classed.groupBy("cls").agg(F.sum("n").alias("group_size"), F.count("*").alias("m")))
    classed = materialise(skew_safe_lookup(classed, totals, "cls", "m", "sha").select("sha", "n", "cls", "group_size"))
    release(totals)
    release(texts_of, texts, members, labels)
    out = skew_safe_lookup(sketched.select("id", "sha"), classed, "sha", "n", "id")
    out = out.select("id", F.col("cls").alias("class_id"), "group_size", (F.col("id") == F.col("cls")).alias("kept"))
    none = rows.filter("id is null").select("id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return out.unionAll(none)
