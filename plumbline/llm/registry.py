"""The queries of the corpus operators over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import ann, decontam, lines, oracles, packing, pii, quality, simhash, substrings, token_files, urls
from plumbline.llm.common import read_table, scratch_path


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(read_table(spark, sf_dir, "documents"), window=35)


def op3_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), words=3, radius=3)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    documents = read_table(spark, sf_dir, "documents")
    model = quality.fit(documents, read_table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    scored = quality.score(documents, model, 0.7)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


#: The rules of the contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def op7_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.digests(spark, path)


def queries() -> dict:
    return {f.__name__: f for f in (op1_cross_polytope, op2_substring_dedup, op3_covering_simhash, op4_personal_data, op5_pairwise_quality, op6_url_rules, op7_benchmark_windows, op8_line_dedup, op9_best_fit_packing, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": oracles.OP2, "op6_url_rules": oracles.OP6, "op8_line_dedup": oracles.OP8}
