"""Serving queries over a ranking of customers: filtered pages, counts, comparisons over draws, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.operators import population as P
from plumbline.operators import serving as V
from plumbline.operators import simulation as M
from plumbline.plans.base import read


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ranked by balance; every ninth is not rankable."""
    c = read(spark, sf_dir, "customer").withColumn("search_name", E.search_name(F.concat("c_name", F.lit(" "), "c_mktsegment")))
    c = c.withColumn("career_state", F.when(F.col("c_custkey") % 3 == 0, V.ACTIVE).otherwise(V.RETIRED)).withColumn("ranking_status", F.when(F.col("c_custkey") % 9 == 0, "NOT_RANKABLE").when(F.col("c_custkey") % 4 == 0, "POINT").otherwise("INTERVAL_NATIVE"))
    ranked = P.global_position(c.where("ranking_status <> 'NOT_RANKABLE'").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], "display_position").select("c_custkey", "display_position")
    return c.join(ranked, "c_custkey", "left").select("c_custkey", "c_name", "c_acctbal", "search_name", "career_state", "ranking_status", "display_position")


def leaderboard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifteen of retired customers in building."""
    return V.leaderboard(_entries(spark, sf_dir), 15, 15, search=" BUILD-", active=False).select("display_position", "c_custkey", "c_name", "ranking_status")


def leaderboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    asked = [{}, {"active": True}, {"status": "POINT"}, {"search": "machinery", "active": False}, {"search": "nobody"}]
    out = None
    for i, a in enumerate(asked):
        row = V.count_entries(e, **a).withColumn("request", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out


def first_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.first_hundred(_entries(spark, sf_dir)).select("display_position", "c_custkey", "c_acctbal", "career_state")


def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier against the next one, over 200 draws."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.round(F.col("s_acctbal") / 100, 2).alias("centre"), F.lit(20.0).alias("spread"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("balance"), (F.col("s_nationkey") * 1.0).cast("double").alias("nation"))
    d = M.draws(s.select("entity", "centre", "spread"), "entity", "centre", "spread", 200).select("entity", "draw", "score")
    scores = s.withColumn("lower_90", F.col("centre") - 15).withColumn("upper_90", F.col("centre") + 15)
    pairs = s.select(F.col("entity").alias("a"), (F.col("entity") + 1).alias("b"))
    out = V.comparisons(pairs, scores, d, "entity", "draw", "score", ["balance", "nation"])
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("a", "b", r("probability_a_above_b"), r("probability_b_above_a"), r("tie_probability"), "ordering_label", "ranges_overlap", F.round("balance_difference", 2).alias("balance_difference"), "nation_difference")


def release_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded tables against the counts that a release names: equal, missing, different and unexpected ones."""
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer")}
    return V.reconcile_release({"region": 5, "nation": 24, "players": 7}, t)


_E = """e0 AS (SELECT *, lower(c_name || ' ' || c_mktsegment) AS sn, CASE WHEN c_custkey % 3 = 0 THEN 'ACTIVE' ELSE 'RETIRED' END AS career_state, CASE WHEN c_custkey % 9 = 0 THEN 'NOT_RANKABLE' WHEN c_custkey % 4 = 0 THEN 'POINT' ELSE 'INTERVAL_NATIVE' END AS ranking_status FROM customer),
  e AS (SELECT e0.*, p.display_position FROM e0 LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS display_position FROM e0 WHERE ranking_status <> 'NOT_RANKABLE') p ON e0.c_custkey = p.c_custkey)"""
_U = " + ".join(f"CAST(CAST('0x' || substr(sha256(entity || ':' || draw || ':{t}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE" for t in "abc")
_COUNT = "SELECT count(display_position) AS ranked, count(*) - count(display_position) AS unranked, CAST({i} AS INTEGER) AS request FROM e WHERE {w}"
SQL = {
    "leaderboard_search": "WITH " + _E + " SELECT display_position, c_custkey, c_name, ranking_status FROM e WHERE display_position IS NOT NULL AND contains(sn, 'build') AND career_state = 'RETIRED' ORDER BY display_position LIMIT 15 OFFSET 15",
    "leaderboard_counts": "WITH " + _E + " " + " UNION ALL ".join(_COUNT.format(i=i, w=w) for i, w in enumerate(("TRUE", "career_state = 'ACTIVE'", "ranking_status = 'POINT'", "contains(sn, 'machinery') AND career_state = 'RETIRED'", "contains(sn, 'nobody')"))),
    "first_hundred": "WITH " + _E + " SELECT display_position, c_custkey, c_acctbal, career_state FROM e WHERE display_position <= 100",
    "compare_pairs": "WITH s AS (SELECT s_suppkey AS entity, round(s_acctbal / 100, 2) AS centre, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS balance, s_nationkey::DOUBLE AS nation FROM supplier), d0 AS (SELECT entity, centre, CAST(unnest(range(1, 201)) AS INTEGER) AS draw FROM s), d AS (SELECT entity, draw, round(centre + 20.0::DOUBLE * (" + _U + """ - 1.5::DOUBLE), 9) AS score FROM d0),
      p AS (SELECT x.entity AS a, y.entity AS b, avg(CASE WHEN x.score > y.score THEN 1.0::DOUBLE ELSE 0.0 END) AS pa, avg(CASE WHEN x.score < y.score THEN 1.0::DOUBLE ELSE 0.0 END) AS pb, avg(CASE WHEN x.score = y.score THEN 1.0::DOUBLE ELSE 0.0 END) AS pt FROM d x JOIN d y ON x.draw = y.draw AND y.entity = x.entity + 1 GROUP BY 1, 2),
      q AS (SELECT *, pa + pt / 2 AS v FROM p)
      SELECT a, b, round(pa, 6) AS probability_a_above_b, round(pb, 6) AS probability_b_above_a, round(pt, 6) AS tie_probability, CASE WHEN v >= 0.9 THEN 'STRONG_A_OVER_B' WHEN v >= 0.65 THEN 'LEAN_A_OVER_B' WHEN v >= 0.35 THEN 'INDETERMINATE' WHEN 1.0::DOUBLE - v >= 0.9::DOUBLE THEN 'STRONG_B_OVER_A' ELSE 'LEAN_B_OVER_A' END AS ordering_label,
      x.centre - 15 <= y.centre + 15 AND y.centre - 15 <= x.centre + 15 AS ranges_overlap, round(x.balance - y.balance, 2) AS balance_difference, x.nation - y.nation AS nation_difference FROM q JOIN s x ON a = x.entity JOIN s y ON b = y.entity""",
    "release_reconciliation": "SELECT 'customer' AS table, CAST(NULL AS BIGINT) AS expected, count(*) AS found, 'UNEXPECTED' AS status FROM customer UNION ALL SELECT 'nation', 24, count(*), CASE WHEN count(*) = 24 THEN 'EQUAL' ELSE 'DIFFERENT' END FROM nation UNION ALL SELECT 'players', 7, NULL, 'MISSING' UNION ALL SELECT 'region', 5, count(*), CASE WHEN count(*) = 5 THEN 'EQUAL' ELSE 'DIFFERENT' END FROM region",
}
QUERIES = {f.__name__: f for f in (leaderboard_search, leaderboard_counts, first_hundred, compare_pairs, release_reconciliation)}
