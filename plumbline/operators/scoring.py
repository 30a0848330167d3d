"""Weighted scores, their sensitivity, and rankings compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_score(weights: dict[str, float]) -> Column:
    """Complete-case weighted sum: NULL if any part is."""
    return reduce(lambda a, b: a + b, [F.col(k) * F.lit(w) for k, w in weights.items()])


def perturbed(weights: dict[str, float], name: str, factor: float) -> dict[str, float]:
    """One weight scaled by a factor, the others rescaled so that all still add up to 1."""
    moved = weights[name] * factor
    rest = sum(w for k, w in weights.items() if k != name)
    return {k: moved if k == name else w * (1 - moved) / rest for k, w in weights.items()}


def without(weights: dict[str, float], name: str) -> dict[str, float]:
    rest = {k: w for k, w in weights.items() if k != name}
    total = sum(rest.values())
    return {k: w / total for k, w in rest.items()}


def scenarios(df: DataFrame, keys: list[str], sets: dict[str, dict[str, float]], digits: int = 9) -> DataFrame:
    """Long form: the score of every row under each named set of weights, from one pass."""
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.round(linear_score(w), digits).alias("score")) for n, w in sets.items()])
    return df.select(*keys, F.explode(arr).alias("x")).select(*keys, "x.scenario", "x.score")


def variance_shares(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per part: w * Cov(part, score) / Var(score); the shares add up to 1."""
    y = linear_score(weights)
    rows = df.dropna(subset=list(weights)).withColumn("__y", y)
    one = rows.agg(F.var_pop("__y").alias("v"), *[(F.lit(w) * F.covar_pop(k, "__y")).alias(k) for k, w in weights.items()])
    stack = ", ".join(f"'{k}', {k}" for k in weights)
    return one.select("v", F.expr(f"stack({len(weights)}, {stack}) AS (part, share)")).select("part", F.when(F.col("v") > 0, F.col("share") / F.col("v")).alias("share"))


def overlap_at(a: DataFrame, b: DataFrame, key: str, rank: str, n: int) -> DataFrame:
    """The share of the first n that two rankings have in common, as one row."""
    x, y = a.where(F.col(rank) <= n).select(key), b.where(F.col(rank) <= n).select(key)
    return x.join(y, key, "left_semi").agg((F.count("*") / F.lit(float(n))).alias("overlap"))
