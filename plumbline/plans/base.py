"""The binding of the domain to the test tables: entities are suppliers, periods are order years, games are orders.

Money is counted in integer cents, so sums are the same in any order of adding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr as E

#: Fixed values of the binding: share of the opportunity that qualifies, and the least games.
SHARE, LEAST = 0.8, 5

FACTS_SQL = """
facts AS (
  SELECT l.l_suppkey AS entity, CAST(year(o.o_orderdate) AS INTEGER) AS period, l.l_orderkey AS game, o.o_custkey AS customer, l.l_returnflag AS kind,
         CAST(l.l_quantity AS BIGINT) AS qty, CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l.l_discount * 100) AS BIGINT) AS disc, CAST(round(l.l_tax * 100) AS BIGINT) AS tax
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

SEASON_SQL = (
    FACTS_SQL
    + """,
season AS (
  SELECT entity, period, count(DISTINCT game) AS games, CAST(sum(qty) AS BIGINT) AS points, CAST(sum(cents) AS BIGINT) AS cents,
         CAST(sum(cents * (100 - disc)) AS BIGINT) AS net, CAST(sum(CASE WHEN period >= 1997 THEN tax END) AS BIGINT) AS tax
  FROM facts GROUP BY entity, period),
opp AS (SELECT period, max(games) AS opportunity FROM season GROUP BY period),
q AS (
  SELECT s.*, o.opportunity, s.games >= greatest(5, CAST(ceil(0.8 * o.opportunity) AS BIGINT)) AS qualified,
         CAST(s.points AS DOUBLE) / s.games AS ppg, CAST(s.net AS DOUBLE) / (100 * s.cents) AS net_share
  FROM season s JOIN opp o USING (period))"""
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its entity, period and game; integer measures."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("entity"), F.year("o_orderdate").alias("period"), F.col("l_orderkey").alias("game"), F.col("o_custkey").alias("customer"), F.col("l_returnflag").alias("kind"),
        F.col("l_quantity").cast("bigint").alias("qty"), cents("l_extendedprice").alias("cents"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"),
    )


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-period totals; tax is introduced in 1997 and NULL before."""
    f = facts(spark, sf_dir)
    return f.groupBy("entity", "period").agg(
        F.countDistinct("game").alias("games"), F.sum("qty").alias("points"), F.sum("cents").alias("cents"), F.sum(F.col("cents") * (100 - F.col("disc"))).alias("net"), F.sum(E.introduced("tax", F.col("period"), 1997)).alias("tax")
    )


def qualified_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """season with its opportunity (the period's most games), `qualified`, and two rates."""
    s = season(spark, sf_dir)
    from pyspark.sql import Window as W

    s = s.withColumn("opportunity", F.max("games").over(W.partitionBy("period")))
    return s.withColumn("qualified", E.qualifies("games", "opportunity", LEAST, SHARE)).withColumn("ppg", E.per_game("points", "games")).withColumn("net_share", E.safe_ratio("net", 100 * F.col("cents")))
