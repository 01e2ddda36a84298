"""Raw documents to packed training sequences, in five stages that each decide on all that its predecessor kept.

language        documents whose language can't be told (no letter, or no language with half of the words) go
lines           lines of repeated runs, and repeated lines of 50 words or that are whole documents, go from later copies; documents that had nothing else go
near_duplicates one row of each group of near duplicates stays, the one with the smallest doc_id
benchmark       documents with a passage of the benchmark go
pack            what is left becomes sequences of 2048 tokens

Stages but the last return the columns of documents. The near-duplicate stage decides by row: of rows with one doc_id the one
with the smallest hash of the text stays, then the first; rows without doc_id come after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlink.llm.common import stash
from scholarlink.llm.decontaminate import find_contamination
from scholarlink.llm.jaccard import near_duplicates
from scholarlink.llm.language import identify
from scholarlink.llm.line_dedup import drop_repeated_lines
from scholarlink.llm.packing import pack
from scholarlink.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identify(docs).where("lang_pred != 'und' and score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(docs, min_lines=2, long_words=50).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = stash(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("fp"), "row")
    found = near_duplicates(rows.select(key.alias("key"), "text"), n=5, percent=75, key="key")
    return rows.join(found.where("key != component_id").select("key.row"), "row", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10).where("n_hit = 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(), capacity=2048)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicate), ("benchmark", benchmark), ("pack", packing)]

#: Language models, automata and tokenizers are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
