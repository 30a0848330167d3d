"""Aggregates whose missing evidence stays missing, coverage, gates and leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.operators import population as P
from plumbline.operators import relational as R
from plumbline.plans.base import FACTS_SQL, SEASON_SQL, facts, qualified_season, read, season


def _masked(spark, sf_dir):
    """facts with their customer's nation as team, and tax unknown for games divisible by 7."""
    cust = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("team"))
    return facts(spark, sf_dir).join(cust, "customer").withColumn("tax", F.when(F.col("game") % 7 != 0, F.col("tax")))


_MASKED = FACTS_SQL + ", mf AS (SELECT f.*, c.c_nationkey AS team, CASE WHEN game % 7 <> 0 THEN tax END AS mtax FROM facts f JOIN customer c ON f.customer = c.c_custkey)"


def team_total_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEAM and TOTAL rows in one pass, distinct games, sums only where complete."""
    out = R.scoped_totals(_masked(spark, sf_dir), "entity", "team", ["period"], {"games": "game"}, ["qty", "tax"])
    return out.select("period", "entity", F.coalesce(F.col("team"), F.lit(-1)).cast("int").alias("team"), "row_scope", "games", "qty", "tax")


def strict_sum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and tolerant sums of a partly unknown metric, its coverage and weighted mean."""
    m = _masked(spark, sf_dir)
    return m.groupBy("entity").agg(
        E.strict_sum("tax").alias("strict"), E.nullable_sum("tax").alias("tolerant"), F.count("tax").alias("known"), F.count("*").alias("n_rows"),
        E.coverage_class(F.count("tax"), F.count("*")).alias("coverage"), F.round(E.weighted_mean("tax", "qty"), 6).alias("weighted"),
    )


def coverage_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per period and metric: rows, known, zeros, distinct entities with a value, class."""
    long = _masked(spark, sf_dir).withColumn("late", F.when(F.col("period") >= 1997, F.col("disc"))).withColumn("most", F.when(F.col("game") % 500 != 0, F.col("qty")))
    long = long.select("period", "entity", F.expr("stack(4, 'qty', qty, 'tax', tax, 'late', late, 'most', most) AS (metric, value)"))
    return long.groupBy("period", "metric").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("known"), F.count_if(F.col("value") == 0).alias("zeros"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("entity"))).alias("entities"), E.coverage_class(F.count("value"), F.count("*")).alias("class")
    )


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of violation counters."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    own = li.agg(
        F.count_if(F.col("l_quantity") < 0).alias("negative"), F.count_if(F.col("l_discount") > 1).alias("discount_over_one"), F.count_if(F.col("l_quantity") != F.floor("l_quantity")).alias("not_whole"),
        F.count_if(F.year("l_shipdate") < 1990).alias("too_early"), F.count_if(F.col("l_extendedprice").isNull()).alias("unknown_price"), F.count_if(F.col("l_extendedprice") < F.col("l_quantity")).alias("price_under_quantity"),
    )
    dup = R.duplicates(li, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("duplicate_keys"), F.sum("copies").alias("rows_in_duplicates"))
    lost = R.orphans(li, o, "l_orderkey", "o_orderkey").agg(F.count("*").alias("orphan_lines"))
    empty = R.orphans(o, li, "o_orderkey", "l_orderkey").agg(F.count("*").alias("orders_without_lines"))
    return own.crossJoin(dup).crossJoin(lost).crossJoin(empty)  # single rows


def season_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts, distinct keys and the date range by year and status."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("customers"), F.min(F.to_date("o_orderdate")).cast("string").alias("first_day"), F.max(F.to_date("o_orderdate")).cast("string").alias("last_day")
    )


def conditional_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last period in which each metric is known, and its NULL rows."""
    s = season(spark, sf_dir)
    long = s.select("period", F.expr("stack(2, 'tax', tax, 'points', points) AS (metric, value)"))
    p = F.when(F.col("value").isNotNull(), F.col("period"))
    return long.groupBy("metric").agg(F.min(p).alias("first_period"), F.max(p).alias("last_period"), F.count_if(F.col("value").isNull()).alias("unknown"))


def leaders_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders of each period, raw and among the qualified, with the class of their agreement."""
    q = qualified_season(spark, sf_dir)
    raw = P.leaders(q, ["period"], "games", "entity").select("period", F.col("top").alias("raw_top"), F.col("leaders").alias("raw"))
    own = P.leaders(q, ["period"], "ppg", "entity", F.col("qualified")).select("period", F.round("top", 6).alias("rate_top"), F.col("leaders").alias("rate"))
    both = raw.join(own, "period")
    kind = F.when(F.col("raw") == F.col("rate"), "EXACT").when(F.size(F.array_intersect("raw", "rate")) > 0, "OVERLAP").otherwise("DIFFERENT")
    return both.select("period", "raw_top", F.array_join(F.col("raw").cast("array<string>"), ",").alias("raw_leaders"), "rate_top", F.array_join(F.col("rate").cast("array<string>"), ",").alias("rate_leaders"), kind.alias("agreement"))


def award_counts_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts per customer; NULL, not zero, for customers that were never queried (key divisible by 10)."""
    o = read(spark, sf_dir, "orders")
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 10 != 0).alias("queried"))
    counts = o.groupBy("o_custkey").agg(*[F.count_if(F.col("o_orderpriority") == k).alias(f"n{k[0]}") for k in kinds])
    cols = [F.when(F.col("queried"), F.coalesce(F.col(f"n{k[0]}"), F.lit(0))).cast("bigint").alias(f"n{k[0]}") for k in kinds]
    return c.join(counts, c.c_custkey == counts.o_custkey, "left").select("c_custkey", *cols)


def taxonomy_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    known = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 1)
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("customers"), F.min(F.year("o_orderdate")).alias("first_period"), F.max(F.year("o_orderdate")).alias("last_period"), F.max(known).alias("level"))


def primary_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation with the most games of each entity and period, the least key of equals."""
    g = _masked(spark, sf_dir).groupBy("entity", "period", "team").agg(F.countDistinct("game").alias("games"))
    order = W.partitionBy("entity", "period").orderBy(F.desc("games"), "team")
    return g.withColumn("n", F.row_number().over(order)).where("n = 1").select("entity", "period", "team", "games")


def recognition_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per season the strongest recognition plus a quarter of the rest, capped; summed over the career."""
    o = read(spark, sf_dir, "orders")
    points = F.when(F.col("o_orderpriority") == "1-URGENT", 3.0).when(F.col("o_orderpriority") == "2-HIGH", 2.0).when(F.col("o_orderpriority") == "3-MEDIUM", 1.0).otherwise(0.0)
    s = o.groupBy("o_custkey", F.year("o_orderdate").alias("period")).agg(F.max(points).alias("best"), F.sum(points).alias("all"))
    s = s.withColumn("value", F.least(F.col("best") + 0.25 * (F.col("all") - F.col("best")), F.lit(4.0)))
    return s.groupBy("o_custkey").agg(F.sum("value").alias("recognition"), F.max("value").alias("best_season"), F.count("*").alias("seasons"))


def winning_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best outcome tier of each season and what a career adds up to."""
    o = read(spark, sf_dir, "orders")
    tier = F.when(F.col("o_totalprice") >= 400000, 4).when(F.col("o_totalprice") >= 300000, 3).when(F.col("o_totalprice") >= 200000, 2).when(F.col("o_totalprice") >= 100000, 1).otherwise(0)
    s = o.groupBy("o_custkey", F.year("o_orderdate").alias("period")).agg(F.max(tier).cast("bigint").alias("tier"))
    return s.groupBy("o_custkey").agg(F.sum("tier").alias("total"), F.max("tier").alias("best"), F.count_if(F.col("tier") >= 3).alias("high_seasons"))


def distribution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile profile of order values by priority."""
    o = read(spark, sf_dir, "orders")
    ps = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("sd"), *[F.round(F.percentile("o_totalprice", p), 4).alias(f"p{int(p * 100)}") for p in ps])


def modal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent ship status of each supplier; of equals the first in order."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    order = W.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_returnflag")
    return li.withColumn("k", F.row_number().over(order)).where("k = 1").select("l_suppkey", F.col("l_returnflag").alias("label"), "n")


def reference_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population flags of entities: three or five qualified periods, or any elite one."""
    q = P.with_midranks(qualified_season(spark, sf_dir), ["period"], "ppg", F.col("qualified")).withColumn("pct", P.midrank_share())
    n = F.count_if("qualified")
    return q.groupBy("entity").agg(n.alias("qualified_periods"), (n >= 3).alias("three"), (n >= 5).alias("five"), F.coalesce(F.max(F.col("qualified") & (F.col("pct") >= 0.95)), F.lit(False)).alias("elite"))


SQL = {
    "team_total_grouping_sets": "WITH " + _MASKED + " SELECT period, entity, coalesce(team, -1) AS team, CASE WHEN grouping(team) = 0 THEN 'TEAM' ELSE 'TOTAL' END AS row_scope, count(DISTINCT game) AS games, CAST(CASE WHEN count(qty) = count(*) THEN sum(qty) END AS BIGINT) AS qty, CAST(CASE WHEN count(mtax) = count(*) THEN sum(mtax) END AS BIGINT) AS tax FROM mf GROUP BY GROUPING SETS ((period, entity, team), (period, entity))",
    "strict_sum_coverage": "WITH " + _MASKED + """ SELECT entity, CAST(CASE WHEN count(mtax) = count(*) THEN sum(mtax) END AS BIGINT) AS strict, CAST(sum(mtax) AS BIGINT) AS tolerant, count(mtax) AS known, count(*) AS n_rows,
      CASE WHEN count(mtax) = 0 THEN 'UNKNOWN' WHEN count(mtax)::DOUBLE / count(*) >= 0.99 THEN 'RELIABLE' WHEN count(mtax)::DOUBLE / count(*) >= 0.8 THEN 'PARTIAL' ELSE 'SPARSE' END AS coverage,
      round(CAST(sum(mtax * qty) AS DOUBLE) / CAST(sum(CASE WHEN mtax IS NOT NULL THEN qty END) AS DOUBLE), 6) AS weighted FROM mf GROUP BY entity""",
    "coverage_classification": "WITH " + _MASKED + """, lg AS (SELECT period, entity, unnest(['qty', 'tax', 'late', 'most']) AS metric, unnest([qty, mtax, CASE WHEN period >= 1997 THEN disc END, CASE WHEN game % 500 <> 0 THEN qty END]) AS value FROM mf)
      SELECT period, metric, count(*) AS n_rows, count(value) AS known, count(*) FILTER (WHERE value = 0) AS zeros, count(DISTINCT CASE WHEN value IS NOT NULL THEN entity END) AS entities,
      CASE WHEN count(value) = 0 THEN 'UNKNOWN' WHEN count(value)::DOUBLE / count(*) >= 0.99 THEN 'RELIABLE' WHEN count(value)::DOUBLE / count(*) >= 0.8 THEN 'PARTIAL' ELSE 'SPARSE' END AS class FROM lg GROUP BY 1, 2""",
    "quality_gates": """SELECT count(*) FILTER (WHERE l_quantity < 0) AS negative, count(*) FILTER (WHERE l_discount > 1) AS discount_over_one, count(*) FILTER (WHERE l_quantity <> floor(l_quantity)) AS not_whole,
      count(*) FILTER (WHERE year(l_shipdate) < 1990) AS too_early, count(*) FILTER (WHERE l_extendedprice IS NULL) AS unknown_price, count(*) FILTER (WHERE l_extendedprice < l_quantity) AS price_under_quantity,
      (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_keys,
      (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS rows_in_duplicates,
      (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) AS orphan_lines, (SELECT count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey) AS orders_without_lines FROM lineitem""",
    "season_coverage": "SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus AS status, count(*) AS n_rows, count(DISTINCT o_custkey) AS customers, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day FROM orders GROUP BY 1, 2",
    "conditional_extent": "WITH " + SEASON_SQL + ", lg AS (SELECT period, 'tax' AS metric, tax AS value FROM season UNION ALL SELECT period, 'points', points FROM season) SELECT metric, min(CASE WHEN value IS NOT NULL THEN period END) AS first_period, max(CASE WHEN value IS NOT NULL THEN period END) AS last_period, count(*) FILTER (WHERE value IS NULL) AS unknown FROM lg GROUP BY 1",
    "leaders_with_ties": "WITH " + SEASON_SQL + """, a AS (SELECT period, games AS raw_top, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) AS raw_leaders, list_sort(list(entity)) AS l1 FROM q s WHERE games = (SELECT max(games) FROM q t WHERE t.period = s.period) GROUP BY 1, 2),
      b AS (SELECT period, round(ppg, 6) AS rate_top, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY entity) AS rate_leaders, list_sort(list(entity)) AS l2 FROM q s WHERE qualified AND ppg = (SELECT max(ppg) FROM q t WHERE t.period = s.period AND t.qualified) GROUP BY 1, 2)
      SELECT a.period, raw_top, raw_leaders, rate_top, rate_leaders, CASE WHEN l1 = l2 THEN 'EXACT' WHEN len(list_intersect(l1, l2)) > 0 THEN 'OVERLAP' ELSE 'DIFFERENT' END AS agreement FROM a JOIN b ON a.period = b.period""",
    "award_counts_nullable": "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_custkey % 10 <> 0 THEN count(*) FILTER (WHERE starts_with(o_orderpriority, '{i}')) END AS n{i}" for i in range(1, 6)) + " FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "taxonomy_inventory": "SELECT o_orderpriority, o_orderstatus, count(*) AS n_rows, count(DISTINCT o_custkey) AS customers, CAST(min(year(o_orderdate)) AS INTEGER) AS first_period, CAST(max(year(o_orderdate)) AS INTEGER) AS last_period, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END) AS level FROM orders GROUP BY 1, 2",
    "primary_teams": "WITH " + _MASKED + ", g AS (SELECT entity, period, team, count(DISTINCT game) AS games FROM mf GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY games DESC, team) AS n FROM g) SELECT entity, period, team, games FROM k WHERE n = 1",
    "recognition_bundle": "WITH p AS (SELECT o_custkey, year(o_orderdate) AS period, CASE o_orderpriority WHEN '1-URGENT' THEN 3.0::DOUBLE WHEN '2-HIGH' THEN 2.0 WHEN '3-MEDIUM' THEN 1.0 ELSE 0.0 END AS pts FROM orders), s AS (SELECT o_custkey, period, least(max(pts) + 0.25::DOUBLE * (sum(pts) - max(pts)), 4.0::DOUBLE) AS value FROM p GROUP BY 1, 2) SELECT o_custkey, sum(value) AS recognition, max(value) AS best_season, count(*) AS seasons FROM s GROUP BY 1",
    "winning_tiers": "WITH s AS (SELECT o_custkey, year(o_orderdate) AS period, max(CASE WHEN o_totalprice >= 400000 THEN 4 WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 200000 THEN 2 WHEN o_totalprice >= 100000 THEN 1 ELSE 0 END)::BIGINT AS tier FROM orders GROUP BY 1, 2) SELECT o_custkey, CAST(sum(tier) AS BIGINT) AS total, max(tier) AS best, count(*) FILTER (WHERE tier >= 3) AS high_seasons FROM s GROUP BY 1",
    "distribution_profile": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS p{int(p * 100)}" for p in [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) + " FROM orders GROUP BY 1",
    "modal_label": "WITH g AS (SELECT l_suppkey, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, label) AS r FROM g) SELECT l_suppkey, label, n FROM k WHERE r = 1",
}


def _midrank_sql():
    from plumbline.plans.era import MIDRANK_SQL

    return MIDRANK_SQL


SQL["reference_flags"] = "WITH " + _midrank_sql() + " SELECT q.entity, count(*) FILTER (WHERE qualified) AS qualified_periods, count(*) FILTER (WHERE qualified) >= 3 AS three, count(*) FILTER (WHERE qualified) >= 5 AS five, bool_or(qualified AND (below + 0.5 * eq) / n >= 0.95) AS elite FROM q JOIN k ON q.entity = k.entity AND q.period = k.period GROUP BY q.entity"
QUERIES = {
    f.__name__: f
    for f in (
        team_total_grouping_sets, strict_sum_coverage, coverage_classification, quality_gates, season_coverage, conditional_extent, leaders_with_ties, award_counts_nullable, taxonomy_inventory, primary_teams,
        recognition_bundle, winning_tiers, distribution_profile, modal_label, reference_flags,
    )
}
