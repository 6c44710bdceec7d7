"""Corpus pipeline: quality rules, toxicity, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents.  Each result is written as Parquet and read again, so a lost executor costs one stage at most.

Defined results, in every stage: an empty table gives an empty result; columns other than those of documents are ignored;
null languages, sources and counts are kept as they are; null ids sort first where ids are compared, and have no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import DOC_COLUMNS, table, written
from tessera.llm.packing import pack
from tessera.llm.quality import quality_filter
from tessera.llm.queries import vocabulary
from tessera.llm.simhash import near_duplicate_filter
from tessera.llm.suffix_dedup import without_repeats
from tessera.llm.toxicity import toxicity_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and very short texts among them; repeated rows go or stay together."""
    return quality_filter(docs, table(spark, sf_dir, "labels")).select(DOC_COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts, which no word speaks against, stay; repeated rows go or stay together."""
    return toxicity_filter(docs, table(spark, sf_dir, "labels")).select(DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays, once; texts without words are one group; rows that repeat an id with other
    texts are told apart."""
    return near_duplicate_filter(docs).select(DOC_COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that start earlier too are cut out, whole characters only, and ``n_chars`` is counted anew; a null text
    becomes empty, one that is repeated as a whole too; no row goes."""
    return without_repeats(docs).select(DOC_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, as ``pack`` gives them; a null or empty text is one piece of the end id."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("simhash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("best-fit packing", packing)]

#: No stage's method can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
