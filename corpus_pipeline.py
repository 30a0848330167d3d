"""The corpus pipeline over `documents`.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs is what the stage before it
returned, and returns a DataFrame. All stages but the last return the columns of documents.

1. quality: documents that the pairwise classifier rejects go.
2. lines: lines similar to an earlier line of the corpus (sets of words, Jaccard 0.8) go from the texts (n_chars follows).
3. near_duplicates: of each group of near copies (SimHash candidates and an exact join of five-word shingles, Jaccard 0.8)
   the least doc_id stays.
4. decontaminate: documents with a window similar to a benchmark item go.
5. pack: what is left becomes pieces in sequences of 2048 tokens.

Null texts count as empty; null doc_ids, repeated rows, empty tables and further columns are treated as the
operators' own docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, lines, packing, quality, simhash
from plumbline.llm.common import read_table, scratch_path

#: No SQL: a fitted classifier and a tokenizer's merges are beyond it. Tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("decontaminate", decontaminate_stage), ("pack", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
