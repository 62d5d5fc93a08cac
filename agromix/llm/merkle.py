"""A Merkle manifest of a dataset: a digest for every row, a root for every source and for all, and a proof for each row.

Leaves are digests of the columns, by Spark's own functions. Leaves of a source ascend by identifier; each run of
ARITY nodes becomes one until a single node, the source's root, is left. The roots of the sources, by name, are joined to
one in the same way.

Positions come from one range partition of (source, identifier): a partition's rows count from what earlier ones hold of
its first source. Rows go to aligned blocks of ARITY ** LEVELS (4096) neighbours, so that a source with a large share of the rows
is many blocks. One task reduces a block to a node; nodes of blocks are leaves of the next tier, until each source has one
and then all sources have one. Proofs go back down: a tier's blocks get the upper part of their proof as a row before their
nodes, and a fractal traversal gives the lower part, one node after another. For each level of a block it keeps the
subtree that the current node lies in and, but for the top, the desired next one, which grows by a leaf a step and
takes over when the current one is left; so beside its leaves a block holds 2 * LEVELS runs of ARITY digests, and no inner
node is made twice but the first ones. A proof is not stored: digests are taken from it where it is made.

Nulls are values of their own ('-'). A null source comes first; null identifiers come first in their source. Rows that
share an identifier are leaves each, in the order of their digests. Texts of any length are hashed whole. Other columns
are not read. An empty table gives an empty result; a single row is its own root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from agromix.llm.common import mapped, materialise

__all__ = ["FIELDS", "block_root", "leaf_digest", "manifest", "tampered_text", "traverse"]

ARITY = 16
#: Levels of a block, unless told otherwise.
LEVELS = 3
#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs of a source within a partition up to this many are broadcast; there is one for each partition and each source.
FEW = 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """SHA-256 over the values one after another: '-' for null, else the number of UTF-8 bytes, a colon and the value."""
    strings = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in strings)).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def _join_up(nodes: list[str]) -> list[str]:
    return [digest(*nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]


def block_root(nodes: list[str], alone: bool, levels: int = LEVELS) -> str:
    """The node above a block: of all levels or, if the block is all there is, as soon as one node is left."""
    for _ in range(levels):
        if alone and len(nodes) == 1:
            break
        nodes = _join_up(nodes)
    return nodes[0]


def _height(n: int, alone: bool, levels: int) -> int:
    """Levels above the leaves of a block of n."""
    height = 0
    while height < levels and not (alone and n == 1):
        n, height = -(-n // ARITY), height + 1
    return height


class _Subtree:
    """One run of a level: built from leaves one at a time, by joining complete runs as they end."""

    def __init__(self, level: int):
        self.level, self.nodes, self.open = level, [], [[] for _ in range(level)]

    def feed(self, leaf: str) -> None:
        """The next leaf; a node goes up when its run is full."""
        for run in self.open:
            run.append(leaf)
            if len(run) < ARITY:
                return
            leaf = digest(*run)
            run.clear()
        self.nodes.append(leaf)

    def finish(self) -> None:
        """No more leaves: what is open goes up as it is."""
        for at, run in enumerate(self.open):
            if run:
                node = digest(*run)
                run.clear()
                (self.open[at + 1] if at + 1 < self.level else self.nodes).append(node)


def traverse(leaves: list[str], alone: bool, levels: int = LEVELS) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block, its siblings by level: what stands left and right of its ancestor in the run.

    Level k's subtree spans ARITY ** (k + 1) leaves. While it is in use, each step feeds one leaf, a whole span ahead, to
    the next; at the end of the span that one is complete and takes its place.
    """
    height = _height(len(leaves), alone, levels)
    spans = [ARITY ** (k + 1) for k in range(height)]
    existing, desired = [_Subtree(k) for k in range(height)], [_Subtree(k) for k in range(height)]
    for tree, span in zip(existing, spans, strict=True):
        for leaf in leaves[:span]:
            tree.feed(leaf)
        if len(leaves) <= span:
            tree.finish()
    for at in range(len(leaves)):
        if at:
            for k, span in enumerate(spans):
                if at % span == 0:
                    existing[k], desired[k] = desired[k], _Subtree(k)
        path = []
        for k, (tree, span) in enumerate(zip(existing, spans, strict=True)):
            own = at % span // (span // ARITY)
            path.append(("".join(tree.nodes[:own]), "".join(tree.nodes[own + 1 :])))
            if at + span < len(leaves):
                desired[k].feed(leaves[at + span])
                if at + span == len(leaves) - 1:
                    desired[k].finish()
        yield path


def _fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _numbered(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """``leaves`` with pos (from 0 within each source) and n (leaves of the source), without a task for a whole source."""
    ranged = leaves.repartitionByRange(F.col("source").asc_nulls_first(), *order).sortWithinPartitions(F.col("source").asc_nulls_first(), *order)
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.call_function("shiftright", F.col("at"), F.lit(33)).cast("int")
    runs = ranged.groupBy("source", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("from"))
    whole = Window.partitionBy("source")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = materialise(runs.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "from", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")))
    small = runs.count() <= FEW
    out = ranged.withColumn("part", part).join(F.broadcast(runs) if small else runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    out = out.withColumn("pos", F.col("at") - F.col("from") + F.col("before")).drop("_source", "_part", "part", "at", "from", "before")
    return out if small else materialise(out)


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """The next tier: a node for each block, at its own place among the blocks of its tree."""

    size = ARITY**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def closed() -> tuple:
            tree, block, n = key
            return tree, block // size, block, -(-n // size), block_root(held, n <= size, levels)

        out: list[tuple] = []
        for batch in batches:
            for tree, block, n, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "node")), strict=True):
                if (tree, block, n) != key:
                    if key:
                        out.append(closed())
                    key, held = (tree, block, n), []
                held.append(node)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=shape)
                out = []
        if key:
            out.append(closed())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=shape)

    names = ["tree", "block", "pos", "n", "node"]
    shape = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
    return mapped(_in_blocks(nodes.select("tree", "block", "pos", "n", "node")), run, "tree string, block long, pos long, n long, node string")


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """All tiers of nodes from ``nodes`` to those that hold one block for each tree, each written to the shared folder."""
    tiers = [nodes]
    while tiers[-1].filter(F.col("n") > ARITY**levels).limit(1).count():
        tiers.append(materialise(_reduced(tiers[-1].filter(F.col("n") > ARITY**levels), levels)))
    return tiers


#: The upper part of a block's proof: what stands left and right at each level, from its root to the top.
PATH = "array<struct<l:string,r:string>>"
PATH_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _descended(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, path) of each node, where ``above`` has (tree, block, path, node) for each block."""
    rows = nodes.select("tree", "block", "pos", "n", "node", F.lit(None).cast(PATH).alias("path")).unionByName(above.select("tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit("").alias("node"), "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, held in _blocks(batches, ("pos", "n", "node")):
            upper, tree = head["path"], head["tree"]
            paths = [[{"l": a, "r": b} for a, b in own] + upper for own in traverse([x[2] for x in held], held[0][1] <= ARITY**levels, levels)]
            for i in range(0, len(held), 256):
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(paths[i : i + 256]), pa.string()), pa.array([x[0] for x in held[i : i + 256]], pa.int64()), pa.array(paths[i : i + 256], PATH_TYPE)], ["tree", "pos", "path"])

    return mapped(_in_blocks(rows), run, f"tree string, pos long, path {PATH}")


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[dict, list[tuple]]]:
    """Each block's first row, which holds its upper path, and the values of the rows after it."""
    head, held = None, []
    for batch in batches:
        tree, block, pos = (batch.column(c).to_pylist() for c in ("tree", "block", "pos"))
        values = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for i, p in enumerate(pos):
            if p < 0:
                if head and held:
                    yield head, held
                path = batch.column("path")[i].as_py() or []
                head, held = {"tree": tree[i], "block": block[i], "path": path} | {c: batch.column(c)[i].as_py() for c in batch.schema.names if c == "top_subroot"}, []
            else:
                held.append(values[i])
    if head and held:
        yield head, held


def _paths(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """(tree, block, path) for each block of the lowest tier. ``above`` has (tree, path): the part over each tree's root."""
    last = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for upper in reversed(tiers[1:]):
        # trees of one block in the tier below take no part in the upper tiers
        there = last.join(upper.select("tree", "block").distinct(), ["tree", "block"], "left_semi")
        lower = materialise(_descended(upper, there, levels).select("tree", F.col("pos").alias("block"), "path"))
        last = last.join(upper.select("tree").distinct(), "tree", "left_anti").unionByName(lower)
    return last


def _tree_roots(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(tree, root) of each tree."""
    out = None
    for nodes in tiers:
        one = _reduced(nodes.filter(F.col("n") <= ARITY**levels), levels).select("tree", F.col("node").alias("root"))
        out = one if out is None else out.unionByName(one)
    return out


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, proof_levels, folded_root, verified) for each row of ``docs``.

    ``tampered``: which rows to fold with the leaf of the lower-cased text instead of their own.
    """
    values = [F.col(c) for c in FIELDS]
    swapped = leaf_digest(*(tampered_text(F.col(c)) if c == "text" else F.col(c) for c in FIELDS))
    leaves = docs.select("doc_id", "source", leaf_digest(*values).alias("node"), (F.when(tampered, swapped) if tampered is not None else F.lit(None).cast("string")).alias("swapped"))
    # rows that are equal in all of this are told apart by where they were read, so that no partition gathers them
    numbered = _numbered(leaves.withColumn("row", F.monotonically_increasing_id()), [F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("row")]).drop("row")
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    numbered = numbered.withColumn("tree", tree).withColumn("block", F.expr(f"pos div {ARITY**levels}"))
    tiers = _tiers(numbered.select("tree", "block", "pos", "n", "node"), levels)
    roots = materialise(_tree_roots(tiers, levels))
    # the trees' roots are the leaves of the top one, null first ('-' precedes '=')
    tops = _numbered(roots.select(F.lit(None).cast("string").alias("source"), "tree", F.col("root").alias("node")), [F.col("tree")])
    top = tops.select(F.lit("").alias("tree"), F.expr(f"pos div {ARITY**levels}").alias("block"), "pos", "n", "node")
    top_tiers = _tiers(top, levels)
    found = _tree_roots(top_tiers, levels).first()
    spark = docs.sparkSession
    start = spark.createDataFrame([("", [])], f"tree string, path {PATH}")
    over_top = _paths(top_tiers, start, levels)
    of_trees = materialise(_descended(top, over_top, levels).withColumnRenamed("tree", "all").join(tops.select(F.col("tree"), F.col("pos"), F.col("node").alias("top_subroot")), "pos").select("tree", "path", "top_subroot"))
    heads = _paths(tiers, of_trees.select("tree", "path"), levels).join(of_trees.select("tree", "top_subroot"), "tree")

    rows = numbered.select("tree", "block", "pos", "n", "doc_id", "source", "node", "swapped", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("top_subroot"))
    rows = rows.unionByName(heads.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "path", "top_subroot"), allowMissingColumns=True)
    kind = docs.schema["doc_id"].dataType
    types = [to_arrow_type(kind), *[pa.string()] * 5, pa.int32(), pa.string(), pa.bool_()]
    of_all = found["root"] if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, held in _blocks(batches, ("doc_id", "source", "node", "swapped", "n")):
            upper = [(x["l"], x["r"]) for x in head["path"]]
            above = "".join(a + b for a, b in upper)
            out = []
            for own, (doc, source, node, other, _) in zip(traverse([x[2] for x in held], held[0][4] <= ARITY**levels, levels), held, strict=True):
                folded = _fold(_fold(other or node, own), upper)
                out.append((doc, source, node, head["top_subroot"], of_all, digest(*(a + b for a, b in own), above), len(own) + len(upper), folded, folded == of_all))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "proof_levels", "folded_root", "verified"]
    schema = f"doc_id {kind.simpleString()}, source string, leaf string, subroot string, root string, proof_sha256 string, proof_levels int, folded_root string, verified boolean"
    return mapped(_in_blocks(rows), run, schema)
