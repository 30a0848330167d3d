"""Token ids in ORC files (operator 10).

The files hold one row per document in ascending doc_id order: doc_id and its ids, the end id included. ORC
run-length encodes the integers of each stripe, keeps an index of every `stride` rows and a Bloom filter on
doc_id, so readers take stripes in parallel and skip those whose statistics or filter rule a document out.

Null text is the empty document (the end id alone); null doc_ids come first; rows of the same doc_id are
documents of their own, one after another in an order of their texts' hashes; an empty table gives files without rows; other columns
are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts
from plumbline.llm.tokens import encoder, row_slices

ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}


def encoded(documents: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id and ids of every row, in the partitions and order of documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer_path)
        for batch in batches:
            for first, n in row_slices(batch.column(1)):
                part = batch.slice(first, n)
                ends, flat = enc.ragged(part.column(1), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))], ["doc_id", "ids"])
                pa.default_memory_pool().release_unused()

    return texts(documents).mapInArrow(run, "doc_id long, ids array<int>")


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Range partitions of doc_id, sorted, then encoded: texts are shuffled once, and only doc_ids are sampled."""
    docs = texts(documents).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded(docs, tokenizer_path, end_id).write.mode("errorifexists").options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids; a filter on doc_id reaches the files' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the files under path.

    start follows the order of the files and of the rows in them. It adds the totals of all earlier files to a sum within the
    own file, so no task sees more than a file.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids = b.column(1)
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "block", "row", "n_tokens", "ids_crc32"])

    # A file may be read in several blocks; within one of them rows are numbered as they come.
    read = read_token_files(spark, path).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = cut(read.mapInArrow(run, "doc_id long, file string, block long, row long, n_tokens long, ids_crc32 long"))  # read twice below, from the files once
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("own"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"))
    before = W.orderBy(F.col("nulls").desc(), "least").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"))  # one row per file
    within = W.partitionBy("file").orderBy("block", "row").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
        .select("doc_id", (F.col("earlier") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )
