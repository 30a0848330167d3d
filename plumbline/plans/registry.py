"""All queries of the engine by name, with the SQL that each is checked against."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("era", "aggregates", "joins", "careers", "scores", "calibration", "simulation", "models", "platform", "audits", "policies", "records", "measurement", "serving")


def _modules():
    return [importlib.import_module(f"plumbline.plans.{m}") for m in MODULES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.plans.era import era_flagship

    return era_flagship(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
