"""The registered queries of the training-data operators, one for each operator and contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table
from .byte_bpe import roundtrip_digests
from .html_text import extract_text
from .nearest import nearest
from .packing import pack
from .quality import quality_rules
from .sharding import shard_by_bytes
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import toxicity


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return roundtrip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def law_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query of op1: how many it found, whether ranks follow scores and ids, and whether scores are those of the vectors."""
    found, vectors = op1_nearest(spark, sf_dir), table(spark, sf_dir, "embeddings")
    v = lambda name: vectors.select(F.col("vec_id").alias(f"{name}_id"), F.col("embedding").cast("array<double>").alias(name))
    both = found.withColumnRenamed("vec_id", "v_id").join(v("query"), "query_id").join(v("v"), "v_id")
    exact = F.aggregate(F.zip_with("query", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    both = both.withColumn("exact", F.abs(exact - F.col("score")) < 1e-9)
    ranks = F.array_sort(F.collect_list(F.struct("rank", (-F.col("score")).alias("less"), "v_id")))
    ordered = F.transform(ranks, lambda r: F.struct(r["less"], r["v_id"]))
    per = both.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_and("exact").alias("exact"), (ordered == F.array_sort(ordered)).alias("ordered"))
    return per.select("query_id", "n", "exact", "ordered")


def law_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3: whether all sequences are gapless and fit, and whether all documents are whole, with their number."""
    pieces = op3_packing(spark, sf_dir)

    def gapless(key: str, order: str, most: int) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct(order, "length"))).alias("own")
        end = F.aggregate("own", F.lit(0).cast("long"), lambda at, x: F.when(x[order] == at, at + x["length"]).otherwise(F.lit(-(2**40))))
        return pieces.groupBy(key).agg(own).agg(F.bool_and(end.between(1, most)).alias("sound"), F.count("*").alias("n"))

    sequences = gapless("sequence_id", "offset", 2048).select(F.lit("sequences").alias("of"), "sound", F.lit(None).cast("long").alias("n"))
    return sequences.unionByName(gapless("doc_id", "start", 2**40).select(F.lit("documents").alias("of"), "sound", "n"))


def law_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("over_limit") == (F.col("n_tokens") > 4096)).alias("limit_holds"))


def law_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding op10's ids gives the texts back."""
    return op10_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def law_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of op6, and whether its predictions follow its scores."""
    out = op6_toxicity(spark, sf_dir)
    return out.select("doc_id", "held_out", (F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.5).cast("int"))).alias("sound"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_token_counts": op2_token_counts,
        "op3_packing": op3_packing,
        "op4_sharding": op4_sharding,
        "op5_html_text": op5_html_text,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_byte_bpe": op10_byte_bpe,
        "law_nearest": law_nearest,
        "law_packing": law_packing,
        "law_token_counts": law_token_counts,
        "law_byte_bpe": law_byte_bpe,
        "law_toxicity": law_toxicity,
    }


oracle_sql = oracles.oracle_sql
