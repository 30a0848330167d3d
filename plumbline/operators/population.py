"""Statistics of an explicit population, applied to all rows.

The population (qualified rows) and the rows scored are different sets: every function takes the condition that
picks the population. Ranks against it come from one sorted window per partition, without a theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distribution(df: DataFrame, by: list[str], value: str, where: Column | None = None) -> DataFrame:
    """count, mean, median, population sd, MAD, quartiles and bounds of the finite values of each group."""
    v = F.col(value)
    rows = df.where(v.isNotNull() & ~F.isnan(v.cast("double")) & (where if where is not None else F.lit(True)))
    stats = rows.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("sd"), F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.75).alias("q3"), F.min(v).alias("least"), F.max(v).alias("most")
    )
    # The deviations need the median first; both aggregates run over the same groups.
    mad = rows.join(stats.select(*by, "median"), by).groupBy(*by).agg(F.median(F.abs(v - F.col("median"))).alias("mad"))
    return stats.join(mad, by)


def with_midranks(df: DataFrame, by: list[str], value: str, member: Column) -> DataFrame:
    """df with __below, __equal, __n: population values below and equal to the row's value, and the population's size."""
    is_ref = F.when(member & F.col(value).isNotNull(), 1).otherwise(0)
    order = W.partitionBy(*by).orderBy(F.col(value))
    upto = F.sum(is_ref).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    equal = F.sum(is_ref).over(W.partitionBy(*by, value))
    known = F.col(value).isNotNull()
    out = df.withColumn("__equal", F.when(known, equal)).withColumn("__below", F.when(known, upto - F.col("__equal")))
    return out.withColumn("__n", F.sum(is_ref).over(W.partitionBy(*by)))


def midrank_share() -> Column:
    """(below + equal / 2) / N, of with_midranks' columns."""
    return F.when(F.col("__n") > 0, (F.col("__below") + 0.5 * F.col("__equal")) / F.col("__n"))


def midrank_score() -> Column:
    """0 to 100: (below + (equal - 1) / 2) / max(N - 1, 1), clipped."""
    x = 100.0 * (F.col("__below") + (F.col("__equal") - 1) / F.lit(2.0)) / F.greatest(F.col("__n") - 1, F.lit(1))
    return F.when(F.col("__below").isNotNull() & (F.col("__n") > 0), F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)))


def ecdf_share() -> Column:
    return F.when(F.col("__n") > 0, (F.col("__below") + F.col("__equal")) / F.col("__n"))


def competition_rank(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """1 + the number of greater values; NULL values have no rank."""
    order = W.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(order)).cast("bigint"))


def deterministic_rank(df: DataFrame, by: list[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """Row number by value descending, then the tie column; and the size of the tie group."""
    order = W.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    return df.withColumn(name, F.row_number().over(order).cast("bigint")).withColumn("tie_size", F.count("*").over(W.partitionBy(*by, value)))


def leaders(df: DataFrame, by: list[str], value: str, entity: str, where: Column | None = None) -> DataFrame:
    """All entities that share the greatest value of each group, sorted."""
    rows = df.where(F.col(value).isNotNull() & (where if where is not None else F.lit(True)))
    best = rows.groupBy(*by).agg(F.max(value).alias("top"))
    return rows.join(best, by).where(F.col(value) == F.col("top")).groupBy(*by, "top").agg(F.array_sort(F.collect_set(entity)).alias("leaders"))


def global_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Row numbers over all rows without gathering them in one task.

    Rows are dealt to ranges of the order and sorted; each range counts its own, and the ranges' totals are added
    up. The order must be total (end with a key). The ranges are written once, since another run may draw them elsewhere.
    """
    from plumbline.sources.lineage import cut

    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    base = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(base, "__part").withColumn(name, (F.col("__base") + F.col("__own")).cast("bigint")).drop("__part", "__own", "__base")
