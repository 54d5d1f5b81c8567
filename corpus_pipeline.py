"""The corpus pipeline: raw documents to packed training sequences.

quality -> near duplicates -> repeated strings -> benchmark passages -> packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  The first four return the columns of docs, whatever further ones there
are; n_chars follows the text.  Ids should be unique, as in the table.

Null and empty texts pass the first four stages unchanged (their quality is the
usual one) and are packed as an end mark.  A row repeated as a whole stays as
often as it is there: its copies share one id, and stages decide by id.  Rows
without an id pass near duplicates and decontamination, which name documents by
id, and keep their text uncut.  A text that the removal leaves empty stays as an
empty text.  Of near duplicates with equal ids none is dropped.  Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import decontam, neardup, packing, quality, storage, suffix
from storelens.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Least quality score of a document that stays.
LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects; learned from labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.fit(docs, labels), docs.columns, name="_quality_score")
    return scored.where(F.col("_quality_score") >= LEAST_SCORE).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id."""
    dropped = neardup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte inside a 200-byte string that occurs more than once; halves of characters go with it."""
    cut = suffix.repeated_strings(docs, with_text=True).where("n_removed > 0")
    new = cut.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.first("kept").alias("_cut_text"))  # repeated rows have equal results
    joined = docs.join(new, docs["doc_id"] == new["_cut_id"], "left")
    kept = F.when(F.col("_cut_id").isNotNull(), F.col("_cut_text")).otherwise(F.col("text"))
    return joined.withColumn("text", kept).withColumn("n_chars", F.when(F.col("_cut_id").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is found."""
    found = storage.written(decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents left into sequences of at most 2048 tokens."""
    return packing.tokenize_and_pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_strings", remove_repeated_strings),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Classifier, suffix arrays, latent space and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to documents; each result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
