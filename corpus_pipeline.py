"""Documents to tokens in five stages, each an operator of ``millrace.llm`` on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import byte_bpe
from millrace.llm.chunks import checkpointed, own_columns
from millrace.llm.decontamination import decontaminate
from millrace.llm.langid import identify_language
from millrace.llm.ngram_join import ngram_jaccard
from millrace.llm.suffix_dedup import suffix_dedup

#: Bytes that must repeat before the third stage removes them: about twenty words, so that stock phrases stay.
REPEATED_BYTES = 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language that the labelled ones teach; text that is null or has no letter goes. Each row is judged by
    its text alone: null ids and repeated rows stay as they are. Without any label all go."""
    return identify_language(docs, docs.select("doc_id", "text", "lang")).where("lang_pred <> 'und'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, of each group linked by 0.8 of their shingles of five words.

    Rows are told apart by their place, not by doc_id: of equal rows one stays, rows of one doc_id with different texts are
    documents of their own, and a null doc_id is the largest (ties: the row that is read first). Text without a word links
    with nothing and stays.
    """
    placed = docs.select(own_columns(docs), F.monotonically_increasing_id().alias("place"))
    found = ngram_jaccard(placed.select(F.col("place").alias("doc_id"), F.col("own.text").alias("text")), 5, 80).withColumnRenamed("doc_id", "place")
    ids = placed.select("place", F.col("own.doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "place")
    stay = found.join(ids, "place").groupBy("component_id").agg(F.min(order)["place"].alias("stays"))
    gone = checkpointed(found.join(stay, "component_id").where("place <> stays").select("place"))
    return placed.join(gone, "place", "left_anti").select("own.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id has too; documents of which nothing is left go. Bytes of a
    character that a cut went through go with it. Rows of one doc_id don't cut each other, a null doc_id is above all others,
    null and empty texts stay."""
    found = suffix_dedup(docs, REPEATED_BYTES, as_text=True)
    cut = F.col("n_removed") > 0
    found = found.where(~cut | (F.trim("kept") != "")).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item. Null and empty texts have no words and stay; repeated
    rows share their verdict; an empty benchmark lets all stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark, 10).where(~F.col("contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to. Null text counts as empty and has no
    tokens; each row has its own, whatever its doc_id."""
    found = byte_bpe(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return found.drop("text")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
