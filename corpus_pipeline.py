"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

All stages take any table with doc_id and text. Null texts count as empty; texts of any length are read whole; rows that
repeat are judged each, but for the duplicate stages, which see one document in rows that share an identifier. Other
columns pass through whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agromix.llm.common import materialise, release
from agromix.llm.exact_dedup import exact_dedup
from agromix.llm.near_dedup import near_classes
from agromix.llm.packing import pack
from agromix.llm.rules import quality_rules
from agromix.llm.toxicity import fit_toxicity, score_toxicity
from agromix.sources.tables import table

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Learned and sketched stages can't be written in SQL; tests compare them with brute force.
ORACLE_SQL = None


def _own(docs: DataFrame) -> DataFrame:
    """Identifier and text beside all columns in one, so that no extra column meets what an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Empty texts score as texts without any known word."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(_own(docs), model).filter("predicted = 0").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the decision list rejects go; empty texts fail them."""
    return quality_rules(_own(docs), table(spark, sf_dir, "labels")).filter("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest identifier stays; a null identifier only if all are null."""
    return exact_dedup(_own(docs)).filter("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest identifier stays; those without an identifier stay all."""
    gone = materialise(near_classes(docs).filter(~F.col("kept")).select(F.col("id").alias("doc_id")))
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of 1024 tokens; an empty text has one identifier."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn: a row for each piece of the documents that are left (none for an empty table)."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        last, docs = docs, materialise(stage(spark, docs, sf_dir))
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
