"""Joins, reconciliation and reshaping with explicit treatment of missing sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import strict_sum


def scoped_totals(df: DataFrame, entity: str, team: str, by: list[str], counts: dict[str, str], sums: list[str]) -> DataFrame:
    """Rows per (entity, team) and per entity in one pass: row_scope TEAM or TOTAL. counts: name -> column counted distinctly."""
    sets = [[F.col(x) for x in (*by, entity, team)], [F.col(x) for x in (*by, entity)]]
    aggs = [F.countDistinct(v).alias(k) for k, v in counts.items()] + [strict_sum(s).alias(s) for s in sums]
    scope = F.when(F.grouping(team) == 0, "TEAM").otherwise("TOTAL").alias("row_scope")
    return df.groupingSets(sets, *by, entity, team).agg(scope, *aggs).select(*by, entity, team, "row_scope", *counts, *sums)


def strict_totals(df: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[strict_sum(s).alias(s) for s in sums])


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], tolerance: float = 0.0) -> DataFrame:
    """Full outer comparison, one row per key and field: EXACT, TOLERANCE, MISMATCH, LEFT_ONLY, RIGHT_ONLY or BOTH_NULL."""
    a = left.select(*keys, *[F.col(f).cast("double").alias(f"l_{f}") for f in fields], F.lit(True).alias("__l"))
    b = right.select(*keys, *[F.col(f).cast("double").alias(f"r_{f}") for f in fields], F.lit(True).alias("__r"))
    both = a.join(b, keys, "full_outer")
    stack = ", ".join(f"'{f}', l_{f}, r_{f}" for f in fields)
    rows = both.select(*keys, "__l", "__r", F.expr(f"stack({len(fields)}, {stack}) AS (field, left_value, right_value)"))
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    status = (
        F.when(F.col("__r").isNull(), "LEFT_ONLY").when(F.col("__l").isNull(), "RIGHT_ONLY")
        .when(F.col("left_value").isNull() & F.col("right_value").isNull(), "BOTH_NULL").when(gap == 0, "EXACT").when(gap <= tolerance, "TOLERANCE").otherwise("MISMATCH")
    )
    return rows.withColumn("status", status).drop("__l", "__r")


def valid_at(facts: DataFrame, windows: DataFrame, key: str, period: str, start: str = "start", end: str = "end") -> DataFrame:
    """Left join of facts to the windows [start, end or open] that cover their period; `matches` counts them."""
    w = windows.withColumnRenamed(key, "__key")
    cond = (F.col(key) == F.col("__key")) & (F.col(period) >= F.col(start)) & (F.col(end).isNull() | (F.col(period) <= F.col(end)))
    return facts.join(w, cond, "left").drop("__key")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(child_key) == F.col("__k"), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def precedence(sources: list[tuple[str, DataFrame]], keys: list[str], fields: list[str]) -> DataFrame:
    """Merge of sources in order of precedence, per field, with the source each value came from. Absence is not zero."""
    out = None
    for i, (_, df) in enumerate(sources):
        s = df.select(*keys, *[F.col(f).alias(f"__{i}_{f}") for f in fields])
        out = s if out is None else out.join(s, keys, "full_outer")
    cols = []
    for f in fields:
        cols.append(F.coalesce(*[F.col(f"__{i}_{f}") for i in range(len(sources))]).alias(f))
        origin = F.lit(None).cast("string")
        for i in reversed(range(len(sources))):
            origin = F.when(F.col(f"__{i}_{f}").isNotNull(), sources[i][0]).otherwise(origin)
        cols.append(origin.alias(f"{f}_source"))
    return out.select(*keys, *cols)


def two_sides(games: DataFrame, home: str, away: str, home_score: str, away_score: str, keep: list[str]) -> DataFrame:
    """Each game as two rows: team, opponent, own and other score."""
    return games.select(*keep, F.expr(f"stack(2, {home}, {away}, {home_score}, {away_score}, {away}, {home}, {away_score}, {home_score}) AS (team, opponent, own, other)"))


def rectangular_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def prefer(df: DataFrame, keys: list[str], priority: Column, *ties) -> DataFrame:
    """One row per key: the least priority, then ties."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(priority, *ties))).where("__n = 1").drop("__n")


def latest_wins(df: DataFrame, keys: list[str], version: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(canonical, quarantined): one row per key, and the keys whose copies of the same version differ."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in payload]), 256)
    tagged = df.withColumn("__h", h)
    clash = tagged.groupBy(*keys, version).agg(F.countDistinct("__h").alias("variants")).where("variants > 1")
    order = W.partitionBy(*keys).orderBy(F.desc(version), "__h")
    return tagged.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__h"), clash


def wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value))


def long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.unpivot(keys, names, "metric", "value")
