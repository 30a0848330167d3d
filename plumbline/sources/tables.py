"""Reading: tables by schema and columns, partitions, JSON result sets, databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | str | None = None, recursive: bool = False) -> DataFrame:
    """A Parquet table; with columns, only those are read from the files."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_partition(spark: SparkSession, path: str, **keys) -> DataFrame:
    """The partition of a partitioned table that the keys name; other directories are not listed for data."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options) -> DataFrame:
    """A database table; with a numeric key and its bounds, read by several tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A SQLite table through the driver, for small reference databases only; rows are checked against the schema's width."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        known = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
        if table not in known:
            raise ValueError(f"no table {table}")
        rows = [tuple(r) for r in db.execute(f'SELECT * FROM "{table}"')]
    return spark.createDataFrame(rows, schema)


RESULT_SETS = "struct<resultSets:array<struct<name:string,headers:array<string>,rowSet:array<array<string>>>>>"


def result_rows(payloads: DataFrame, payload: str, columns: list[str], name: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Rows of a JSON result set (the first, or the named one) as columns; rows of another width than the headers get `bad_width`."""
    parsed = payloads.select(*keep, F.from_json(payload, RESULT_SETS).alias("p"))
    sets = F.col("p.resultSets")
    one = F.get(F.filter(sets, lambda r: r["name"] == name), F.lit(0)) if name else F.get(sets, F.lit(0))
    rows = parsed.select(*keep, one.alias("s")).where("s IS NOT NULL").select(*keep, F.col("s.headers").alias("h"), F.explode("s.rowSet").alias("r"))
    ok = F.size("h") == F.size("r")
    value = F.when(ok, F.map_from_arrays("h", "r"))
    return rows.select(*keep, *[F.try_element_at(value, F.lit(c)).alias(c) for c in columns], (~ok).alias("bad_width"))


def roster_rows(payloads: DataFrame, payload: str, keep: list[str] = ()) -> DataFrame:
    """Players of both sides of a nested box score; rows without a name are placeholders and left out."""
    side = "struct<teamId:string,players:array<struct<personId:string,name:string,minutes:string>>>"
    p = payloads.select(*keep, F.from_json(payload, f"struct<home:{side},away:{side}>").alias("p"))
    sides = p.select(*keep, F.explode(F.array("p.home", "p.away")).alias("s")).select(*keep, F.col("s.teamId").alias("team_id"), F.explode("s.players").alias("x"))
    return sides.select(*keep, "team_id", "x.personId", "x.name", "x.minutes").where(F.trim("name") != "")


def acquisition_plan(spark: SparkSession, first: int, last: int, types: list[str], measures: dict[str, int]) -> DataFrame:
    """The work list: periods x types x measures, a measure only from the period it exists."""
    periods = spark.range(first, last + 1).select(F.col("id").cast("int").alias("period"))
    kinds = spark.createDataFrame([(t,) for t in types], "type string")
    known = spark.createDataFrame(list(measures.items()), "measure string, since int")
    return periods.crossJoin(kinds).crossJoin(known).where("period >= since").drop("since")  # a small plan by design


def request_key(*parts: Column) -> Column:
    """SHA-256 of a canonical request."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def classify_response(status: Column, body: Column) -> Column:
    """The outcome of a request: an error is not an empty result."""
    rows = F.size(F.get(F.from_json(body, RESULT_SETS)["resultSets"], F.lit(0))["rowSet"])
    return (
        F.when(status.isNull(), "NETWORK_ERROR").when(status == 429, "RATE_LIMITED").when(status >= 500, "SERVER_ERROR").when(status >= 400, "CLIENT_ERROR")
        .when(rows.isNull(), "MALFORMED").when(rows <= 0, "EMPTY").otherwise("OK")
    )
