"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agromix.llm.bpe import decode_ids, encode_ids
from agromix.llm.exact_dedup import exact_dedup
from agromix.llm.lexical import rank
from agromix.llm.licenses import scan_licenses
from agromix.llm.line_dedup import line_dedup
from agromix.llm.merkle import manifest
from agromix.llm.near_dedup import near_classes
from agromix.llm.packing import pack
from agromix.llm.pieces import decode, encode_nbest
from agromix.llm.rules import BASE, quality_rules
from agromix.llm.token_counts import count_tokens, token_files, write_token_files
from agromix.llm.tokens import SEPARATOR
from agromix.llm.toxicity import fit_toxicity, held_out, score_toxicity
from agromix.llm.warc import read_warc, write_warc
from agromix.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its group of equal texts; null counts as empty, the largest identifier stays."""
    found = exact_dedup(table(spark, folder, "documents").select("doc_id", "text"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat files written from all of them; empty documents have none."""
    written = write_token_files(table(spark, folder, "documents"), end=SEPARATOR)
    counted = count_tokens(token_files(written), end=SEPARATOR)
    return counted.join(written, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "ordinal")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of every document; documents without one give no row."""
    return scan_licenses(table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A score for every document, empty ones too; held-out rows never train."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the lines that a smaller identifier holds; an empty text is one empty line."""
    found = line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document; an empty one has a single identifier."""
    return pack(table(spark, folder, "documents"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """The five best segmentations of every document, and the best one decoded; an empty text has one without pieces."""
    docs = table(spark, folder, "documents")
    best, second = F.col("nbest")[0], F.get("nbest", F.lit(1))
    digest = lambda ids: F.xxhash64(ids)
    rows = encode_nbest(docs, 5).select("doc_id", F.size("nbest").alias("n_best"), F.size(best["ids"]).cast("long").alias("n_pieces"), best["score"].alias("score"), second["score"].alias("second_score"), F.element_at("nbest", -1)["score"].alias("last_score"), digest(best["ids"]).alias("ids_hash"), digest(second["ids"]).alias("second_hash"), digest(F.col("nbest")["ids"]).alias("all_hash"), best["ids"].alias("ids"))
    return decode(rows).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near duplicates of every document; empty texts are one class."""
    return near_classes(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict for every document; an empty text has no words and fails the base rules."""
    found = quality_rules(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A record for every page, written and read back; a null page is an empty response."""
    index = write_warc(table(spark, folder, "pages"))
    found = read_warc(spark, index)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's identifiers and what they decode to; an empty text has none."""
    found = decode_ids(encode_ids(table(spark, folder, "documents").select("doc_id", "text")))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty documents that score highest for each benchmark item, out of all."""
    return rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the manifest; leaves of identifiers whose CRC-32 is divisible by five are folded tampered."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, folder, "documents"), tampered).drop("proof_levels", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_bpe": op11_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle": op13_merkle,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op5_line_dedup": """
WITH arrays AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line FROM arrays),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
judged AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""",
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
n AS (SELECT doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM n) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
    # runs of nodes are joined level by level until each tree has one; crc32 is written out, as there is no such function
    "op13_merkle": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, *, translate(text, '{UPPER}', '{LOWER}') AS lowered FROM documents),
h AS (SELECT row, doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head, text, lowered FROM d),
l AS (SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) AS other,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda a, b:
        list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(a, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 5 = 0 AS swapped FROM h),
up(tree, level, pos, node) AS (
  SELECT coalesce('=' || source, '-'), 0, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1, leaf FROM l
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, pos // 16),
subroots AS (SELECT tree, arg_max(node, level) AS node, max(level) AS height FROM up GROUP BY tree),
over(level, pos, node) AS (
  SELECT 0, row_number() OVER (ORDER BY tree) - 1, node FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM over) WHERE n > 1 GROUP BY pos // 16),
sides AS (SELECT tree, level, pos, node, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM (SELECT tree, level, pos, node FROM up UNION ALL SELECT '', level, pos, node FROM over) WINDOW r AS (PARTITION BY tree, level, pos // 16 ORDER BY pos)),
top AS (SELECT max(level) AS height, arg_max(node, level) AS root FROM over),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS at, coalesce('=' || source, '-') AS tree FROM l),
placed AS (SELECT n.*, s.node AS subroot, s.height, row_number_of.pos AS place FROM numbered n JOIN subroots s USING (tree) JOIN (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM subroots) row_number_of USING (tree)),
fold(row, step, node, proof) AS (
  SELECT row, 0, CASE WHEN swapped THEN other ELSE leaf END, '' FROM placed
  UNION ALL
  SELECT f.row, f.step + 1, sha256(x.l || f.node || x.r), f.proof || x.l || x.r
  FROM fold f JOIN placed p USING (row), top t, sides x
  WHERE f.step < p.height + t.height
    AND x.tree = CASE WHEN f.step < p.height THEN p.tree ELSE '' END AND x.level = CASE WHEN f.step < p.height THEN f.step ELSE f.step - p.height END
    AND x.pos = CASE WHEN f.step < p.height THEN p.at // (16 ** f.step)::BIGINT ELSE p.place // (16 ** (f.step - p.height))::BIGINT END)
SELECT p.doc_id, p.leaf, p.subroot, t.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.root AS verified
FROM placed p JOIN fold f USING (row), top t WHERE f.step = p.height + t.height""",
}
