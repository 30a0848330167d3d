"""Entity-by-period sequences: gaps, contiguous windows, runs, best periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_gaps(df: DataFrame, entity: str, period: str) -> DataFrame:
    """One row for every period between an entity's first and last: `appeared`, `career_index` and `appearance_index`."""
    span = df.groupBy(entity).agg(F.min(period).alias("__a"), F.max(period).alias("__b"))
    every = span.select(entity, F.explode(F.sequence("__a", "__b")).alias(period))
    out = every.join(df.withColumn("__here", F.lit(True)), [entity, period], "left").withColumn("appeared", F.coalesce("__here", F.lit(False))).drop("__here")
    order = W.partitionBy(entity).orderBy(period)
    return out.withColumn("career_index", F.row_number().over(order).cast("bigint")).withColumn("appearance_index", F.sum(F.col("appeared").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def contiguous_windows(df: DataFrame, entity: str, period: str, value: str, length: int) -> DataFrame:
    """Complete windows of `length` consecutive periods: start, end and the mean value."""
    order = W.partitionBy(entity).orderBy(period)
    ahead = order.rowsBetween(0, length - 1)
    rows = df.where(F.col(value).isNotNull())
    out = rows.withColumn("__end", F.lead(period, length - 1).over(order) if length > 1 else F.col(period)).withColumn("mean", F.avg(value).over(ahead))
    return out.where(F.col("__end") == F.col(period) + length - 1).select(entity, F.col(period).alias("start"), F.col("__end").alias("end"), "mean")


def best_window(df: DataFrame, entity: str, period: str, value: str, length: int, digits: int = 9) -> DataFrame:
    """The best complete window of each entity, the earliest of equals."""
    windows = contiguous_windows(df, entity, period, value, length).withColumn("mean", F.round("mean", digits))
    order = W.partitionBy(entity).orderBy(F.desc("mean"), "start")
    return windows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def best_periods(df: DataFrame, entity: str, period: str, value: str, n: int) -> DataFrame:
    """Mean of the n best periods (not necessarily consecutive) and their list; NULL mean with fewer than n."""
    order = W.partitionBy(entity).orderBy(F.desc(value), period)
    top = df.where(F.col(value).isNotNull()).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    return top.groupBy(entity).agg(F.when(F.count("*") == n, F.avg(value)).alias("mean"), F.array_sort(F.collect_list(period)).alias("periods"))


def runs(df: DataFrame, entity: str, period: str, holds: Column) -> DataFrame:
    """Islands of consecutive periods in which the condition holds: start, end, length. A gap ends a run."""
    rows = df.where(holds).select(entity, period).distinct()
    key = F.col(period) - F.row_number().over(W.partitionBy(entity).orderBy(period))
    return rows.withColumn("__k", key).groupBy(entity, "__k").agg(F.min(period).alias("start"), F.max(period).alias("end"), F.count("*").alias("length")).drop("__k")


def longest_run(df: DataFrame, entity: str, period: str, holds: Column) -> DataFrame:
    """The longest run of each entity, the earliest of equals."""
    order = W.partitionBy(entity).orderBy(F.desc("length"), "start")
    return runs(df, entity, period, holds).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def area_above(value, baseline: float, weight=None) -> Column:
    """Aggregate: the sum of what exceeds the baseline, weighted."""
    excess = F.greatest(F.col(value) - F.lit(baseline), F.lit(0.0))
    return F.sum(excess * weight if weight is not None else excess)


def adjacent(df: DataFrame, entity: str, period: str, values: list[str]) -> DataFrame:
    """Each row with the values of the entity's next period, where that follows directly (`next_<value>`)."""
    order = W.partitionBy(entity).orderBy(period)
    out = df.withColumn("__p", F.lead(period).over(order))
    for v in values:
        out = out.withColumn(f"next_{v}", F.lead(v).over(order))
    return out.where(F.col("__p") == F.col(period) + 1).drop("__p")


def latest(df: DataFrame, entity: str, period: str, n: int) -> DataFrame:
    """The last n appearances of each entity."""
    order = W.partitionBy(entity).orderBy(F.desc(period))
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
