"""The registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import topk
from .common import sha256_hex
from .decontaminate import find_contamination
from .infill import fill_in_middle, restored
from .interaction import audit
from .jaccard import near_duplicates
from .language import identify
from .line_dedup import drop_repeated_lines
from .neighbours import search, usable
from .oracles import ORACLES
from .packing import pack
from .phrases import repeated_words
from .quality import grade, learn, ratings_of
from .secrets import scan
from .sharding import shard_documents


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(_read(spark, sf_dir, "documents"), min_lines=2, long_words=50)
    return out.select("doc_id", "n_lines", "n_removed", sha256_hex(F.col("text")).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_read(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = grade(docs, learn(docs, ratings_of(_read(spark, sf_dir, "labels")), sample=12_000))
    tail = F.coalesce(F.try_element_at("tails", F.lit(1)), F.lit(1.0))  # P(grade >= 1): not toxic
    return out.select("doc_id", "expected_grade", tail.alias("p_not_toxic"), F.coalesce(F.try_element_at("tails", F.lit(2)), F.lit(1.0)).alias("p_good"), (tail >= 0.6).alias("keep"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(_read(spark, sf_dir, "documents"), window=50).drop("removed")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, _read(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_hex(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), n=5, percent=75)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_read(spark, sf_dir, "documents")).withColumn("candidate", F.sha2("candidate", 256)).withColumnRenamed("candidate", "candidate_sha256")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), per_language=120)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(_read(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search(vectors, queries, k=20)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_read(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(_read(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return topk.search(vectors, queries, k=10, scale=1024)


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_quality_classifier, op4_substring_dedup, op5_best_fit_packing, op6_decontamination, op7_ngram_jaccard, op8_secret_scan, op9_language_id, op10_nearest_neighbours, op11_fill_in_middle, op12_filter_audit, op13_exact_topk)}
