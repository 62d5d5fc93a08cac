"""Tokens per document of flat token files that have no index, by scanning for the end-of-document identifier.

A token file is nothing but little-endian unsigned integers. Files are cut into blocks; each task reads a block's bytes
and finds its separators with one vectorised comparison. Blocks then only say how many separators they hold and where
the last one is: a prefix scan over these summaries of a file gives every block the number of the document it starts in
and where that document began, and so joins documents that span blocks.

A file that does not end in a separator ends in an unfinished document (complete = false). Empty files hold none. Two
separators in a row make a document of no tokens. For the writer: null text counts as empty; rows that repeat get a
document each; other columns are not read; an empty table gives no files. Documents of any length are counted whole: a
task holds one block of tokens and the separators in it. Blocks are dealt by their number, so that tasks follow the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agromix.llm.common import mapped, materialise, open_input, open_output, scratch, tasks_for, text_of
from agromix.llm.tokens import END_OF_TEXT, encode_bytes, rank_file

__all__ = ["count_tokens", "dealt_blocks", "token_files", "write_token_files"]


def _writer(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_output(folder, "tokens", ".bin") as (uri, out):
            n = 0
            for batch in batches:
                for text in batch.column(1):
                    ids = np.frombuffer(encode_bytes(text.as_py(), path, end != END_OF_TEXT), dtype="<u4")
                    out.write(ids.astype("<u2").tobytes() + end.to_bytes(2, "little"))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * batch.num_rows), pa.array(range(n, n + batch.num_rows), pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
                n += batch.num_rows

    return run


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END_OF_TEXT, folder: str | None = None) -> DataFrame:
    """Writes 16-bit token files, one a task, each document followed by ``end``; returns (file, ordinal, doc_id).

    Where ``end`` is END_OF_TEXT, the literal of that token in a text is spelled in pieces, as it would end the document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return materialise(mapped(rows, _writer(folder or scratch(docs.sparkSession), path or rank_file(), end), "file string, ordinal long, doc_id long"))


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name in batch.column(0).to_pylist():
                with open_input(name) as source:
                    sizes.append(source.size() // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "n_tokens"])

    return run


def token_files(named: DataFrame, width: int = 2) -> DataFrame:
    """(file, n_tokens) of the distinct files in column file, by their sizes."""
    names = materialise(named.select("file").distinct())
    return materialise(mapped(names.repartition(tasks_for(names.count(), 256), "file"), _sizes(width), "file string, n_tokens long"))


def _scanner(end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for file, block, begin, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "begin", "n")), strict=True):
                with open_input(file) as source:
                    source.seek(begin * width)
                    ids = np.frombuffer(source.read(n * width), dtype=f"<u{width}")
                if len(ids) != n:
                    raise OSError(f"{file}: {len(ids)} tokens read at {begin}, not {n}")
                ends = np.flatnonzero(ids == end) + begin
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], kind)], names=["file", "block", "n_ends", "last_end", "ends"])

    return run


def dealt_blocks(files: DataFrame, block_tokens: int, a_task: int = 8) -> DataFrame:
    """(file, block, begin, n) of ``files`` (file, n_tokens), dealt to tasks of about ``a_task`` blocks."""
    files = files.select("file", F.col("n_tokens").alias("total")).filter("total > 0")
    begin = F.col("block") * block_tokens
    n_blocks = files.agg(F.sum(F.ceil(F.col("total") / block_tokens))).first()[0]
    blocks = files.select("file", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens))).alias("block"))
    return blocks.select("file", "block", begin.alias("begin"), F.least(F.lit(block_tokens), F.col("total") - begin).alias("n")).repartition(tasks_for(n_blocks, a_task), "file", "block")


def count_tokens(files: DataFrame, end: int = END_OF_TEXT, width: int = 2, block_tokens: int = 2 << 20, a_task: int = 8) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete) for each document of ``files`` (file, n_tokens: the file's length)."""
    blocks = dealt_blocks(files, block_tokens, a_task)
    files = files.select("file", F.col("n_tokens").alias("total")).filter("total > 0")
    scanned = materialise(mapped(blocks, _scanner(end, width), "file string, block long, n_ends long, last_end long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.select("file", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first"), F.coalesce(F.last("last_end", ignorenulls=True).over(before), F.lit(-1)).alias("since"))
    joined = scanned.select("file", "block", "ends").join(stitched, ["file", "block"])
    starts = F.concat(F.array(F.col("since") + 1), F.transform("ends", lambda x: x + 1))
    rows = joined.select("file", "first", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("i", "x")).filter("x.end is not null")
    whole = rows.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start")).alias("n_tokens"), F.lit(True).alias("complete"))
    ended = scanned.groupBy("file").agg(F.sum("n_ends").alias("ordinal"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("last"))
    rest = files.join(ended, "file").filter(F.col("last") < F.col("total") - 1).select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("total") - 1 - F.col("last")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionAll(rest)
