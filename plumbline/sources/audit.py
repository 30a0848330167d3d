"""Audits of source databases: what is there, whether keys repeat, and when metrics were first observed."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "name string, row_count long, columns array<struct<name:string,declared_type:string,nullable:boolean,key_ordinal:int>>"
#: Metrics of the anchor table whose first season is reported where the table has them.
METRICS = ("pts_home", "fgm_home", "fga_home", "fg3m_home", "fg3a_home", "ftm_home", "fta_home", "oreb_home", "dreb_home", "reb_home", "ast_home", "stl_home", "blk_home", "tov_home", "pf_home", "plus_minus_home")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_tables(spark: SparkSession, path: str) -> DataFrame:
    """name, row_count and columns of every table; the file is opened read-only. Counting happens inside SQLite, rows stay there."""
    import sqlite3

    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    db = sqlite3.connect(f"file:{os.path.abspath(path)}?mode=ro", uri=True)
    try:
        db.execute("PRAGMA query_only = ON")
        out = []
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
            (n,) = db.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()
            columns = [(c[1], c[2], not c[3], c[5]) for c in db.execute(f"PRAGMA table_info({_quoted(name)})")]
            out.append((name, n, columns))
    finally:
        db.close()
    return spark.createDataFrame(out, TABLES)


def duplicate_groups(df: DataFrame, keys: list[str]) -> int:
    """How many keys stand in more than one row."""
    return df.groupBy(*keys).count().where("count > 1").count()


def metric_observations(games: DataFrame, season: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, first and last start year with a value, null_count, row_count; season ids end in the year."""
    have = [m for m in metrics if m in games.columns]
    year = F.right(F.col(season).cast("string"), F.lit(4)).try_cast("int")
    if not have:
        return games.sparkSession.createDataFrame([], "metric string, first_year int, last_year int, null_count long, row_count long")
    aggs = [F.struct(F.lit(m).alias("metric"), F.min(F.when(F.col(m).isNotNull(), year)).alias("first_year"), F.max(F.when(F.col(m).isNotNull(), year)).alias("last_year"), (F.count("*") - F.count(m)).alias("null_count"), F.count("*").alias("row_count")).alias(f"m{i}") for i, m in enumerate(have)]
    return games.agg(*aggs).select(F.explode(F.array(*[f"m{i}" for i in range(len(have))])).alias("x")).select("x.*")


def file_digest(path: str) -> tuple[int, str]:
    """Size and SHA-256, read in pieces."""
    h, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
            n += len(piece)
    return n, h.hexdigest()


def bundle_claims(metadata_path: str, objects: int, csv_dir: str) -> dict:
    """What a bundle's metadata claims (tables, CSV exports) beside what is there; objects: those counted in its database."""
    with open(metadata_path, encoding="utf-8") as f:
        said = json.load(f)
    tables = re.search(r"(\d+)-table", str(said.get("subtitle", "")))
    exports = re.search(r"CSV exports available\**:\s*(\d+)/(\d+)", str(said.get("description", "")))
    files = sorted(os.path.join(csv_dir, x) for x in os.listdir(csv_dir) if x.endswith(".csv"))
    licenses = said.get("licenses") or []
    return {
        "dataset_id": said.get("id"), "title": said.get("title"), "license": licenses[0].get("name") if licenses else None, "declared_tables": int(tables[1]) if tables else None,
        "declared_exports": int(exports[1]) if exports else None, "declared_catalog": int(exports[2]) if exports else None, "physical_objects": objects, "physical_csv_files": len(files), "physical_csv_bytes": sum(map(os.path.getsize, files)),
    }
