"""What the corpus operators share: reading tables, cutting lineage, scratch tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this subpackage.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: Spark's setting for shuffle files to go with the execution that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The same as a Java regular expression for one run of it.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-checkpoints-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of what is run here when it ends: its result is written, and nothing reads them again."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there; a lost executor costs nothing that was cut."""
    shared_dir(df.sparkSession)
    with _own_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that no extra column can clash with an internal name."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(df: DataFrame, what: str, dictionary: int = 1 << 20) -> DataFrame:
    """df as a compressed table in the shared folder, for results that are large or read with few of their columns. dictionary: the most bytes of a column's dictionary."""
    path = scratch_path(df.sparkSession, what)
    with _own_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.dictionary.page.size", dictionary).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a stored() table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: what a lambda refers to from outside is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
