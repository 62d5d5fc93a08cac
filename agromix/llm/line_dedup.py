"""Lines that repeat across documents, by native DataFrame operations.

Every line's key is hashed to 128 bits. The hashes are range-partitioned and sorted by document and position; a window
streams over each run and passes on the first document, so a line is dropped when its own document comes later. Keys
with a large share of all lines never enter the sort: a histogram of hash prefixes bounds them (no key can be hot in a
cool prefix), their first documents come from a map-side combined aggregate, and at most 1024 of them are broadcast.
What comes back is a bitmap for each document in 64-bit words, of which only those with a dropped line are stored.

Null text is one empty line. Rows with a null identifier are never dropped from and never make a line repeat. Rows that
share an identifier are one document and are expected to share the text. Texts of any number of lines are split and put
together in one row each; their lines travel as hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agromix.llm.common import HOT_SHARE, apart, hidden, materialise, text_of

__all__ = ["drop_bitmaps", "line_dedup", "line_key"]

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased, as a string of the UTF-8 bytes read as Latin-1.

    lower() alone would change other letters too. Over bytes read as Latin-1 it maps A-Z and turns lead bytes C0-DE
    into E0-FE; how many continuation bytes follow still tells these apart, so keys are equal just when they should be.
    """
    return F.lower(F.decode(F.btrim(line, F.lit(BLANK)).cast("binary"), "ISO-8859-1"))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """A row (id, bitmap array<struct<word, keep>>) for each document that loses lines; absent words keep all 64 lines."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.length(F.btrim("line", F.lit(BLANK))) >= min_chars).withColumn("key", line_key(F.col("line")))
    lines = materialise(lines.select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2")))
    total = lines.count()
    least = max(2, -(-total // int(1 / HOT_SHARE)))
    prefix = F.pmod("h1", F.lit(1 << 16)).alias("prefix")
    full = lines.groupBy(prefix).count().filter(F.col("count") >= least).select("prefix")
    hot = lines.join(F.broadcast(full), F.pmod("h1", F.lit(1 << 16)) == F.col("prefix"), "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first_hot")).filter(F.col("n") >= least).drop("n")
    hot = materialise(hot)
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    known = marked.filter(F.col("first_hot") < F.col("id")).select("id", "pos")
    run = Window.partitionBy("h1", "h2").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ranged = marked.filter(F.col("first_hot").isNull()).drop("first_hot").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    streamed = ranged.withColumn("first", F.first("id").over(run)).filter(F.col("first") < F.col("id")).select("id", "pos")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = known.unionAll(streamed).groupBy("id", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(one)).alias("keep"))
    return words.groupBy("id").agg(F.collect_list(F.struct("word", "keep")).alias("bitmap"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``docs`` with n_lines, n_dropped, keep_bitmap (null: all stay) and kept_text (columns so named are replaced)."""
    bitmaps = drop_bitmaps(docs, id_col, text_col, min_chars).withColumnRenamed("id", "_id").withColumnRenamed("bitmap", "keep_bitmap")
    rows = docs.select(*hidden(docs), F.col(id_col).alias("_doc"), F.col(text_col).alias("_body"))
    out = rows.join(bitmaps.hint("shuffle_hash"), F.col("_doc") == F.col("_id"), "left").withColumn("_lines", F.split(text_of("_body"), "\n", -1))
    # lines are zipped with the bits of all words in order; array_join leaves out what became null
    word = lambda w: F.coalesce(F.element_at(F.map_from_entries("keep_bitmap"), w), F.lit(-1).cast("long"))
    bits = lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftright", x, b).bitwiseAND(F.lit(1)) == 1)
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / 64).cast("int")), word)
    stays = F.array_join(F.zip_with("_lines", F.flatten(F.transform(dense, bits)), lambda line, keep: F.when(keep, line)), "\n")
    kept = F.when(F.col("keep_bitmap").isNull(), text_of("_body")).otherwise(stays)
    dropped = F.coalesce(F.aggregate("keep_bitmap", F.lit(0).cast("long"), lambda a, x: a + 64 - F.bit_count(x["keep"])), F.lit(0).cast("long"))
    made = [F.size("_lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.col("keep_bitmap"), kept.alias("kept_text")]
    return out.select(*apart(docs, "n_lines", "n_dropped", "keep_bitmap", "kept_text"), *made)
