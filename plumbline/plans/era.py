"""Era normalisation: every row against the qualified population of its own period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.operators import population as P
from plumbline.operators import sequences as S
from plumbline.plans.base import SEASON_SQL, qualified_season


def _context(q: DataFrame) -> DataFrame:
    return P.distribution(q, ["period"], "ppg", F.col("qualified"))


def league_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qualified_season(spark, sf_dir)
    pooled = q.where("qualified").groupBy("period").agg((F.sum("points") / F.sum("games")).alias("pooled"), F.max("opportunity").alias("opportunity"))
    r = lambda c: F.round(c, 6).alias(c)
    return _context(q).join(pooled, "period").select("period", "n", r("mean"), r("median"), r("sd"), r("mad"), r("q1"), r("q3"), r("least"), r("most"), r("pooled"), "opportunity")


CONTEXT_SQL = (
    SEASON_SQL
    + """,
m AS (SELECT period, median(ppg) AS med FROM q WHERE qualified GROUP BY period),
ctx AS (
  SELECT q.period, count(*) AS n, avg(ppg) AS mean, max(med) AS median, stddev_pop(ppg) AS sd, median(abs(ppg - med)) AS mad,
         quantile_cont(ppg, 0.25) AS q1, quantile_cont(ppg, 0.75) AS q3, min(ppg) AS least, max(ppg) AS most,
         CAST(sum(points) AS DOUBLE) / CAST(sum(games) AS DOUBLE) AS pooled, max(opportunity) AS opportunity
  FROM q JOIN m ON q.period = m.period WHERE qualified GROUP BY q.period)"""
)


def _with_context(spark, sf_dir):
    q = qualified_season(spark, sf_dir)
    return q.join(_context(q), "period")


def era_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_context(spark, sf_dir).select("entity", "period", "qualified", F.round(E.z_score("ppg", "mean", "sd"), 6).alias("z"))


def era_robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_context(spark, sf_dir).select("entity", "period", F.round(E.robust_z("ppg", "median", "mad"), 6).alias("robust_z"), F.round(E.robust_z("ppg", "median", "mad", 1 / E.ROBUST_Z_CANDIDATE), 6).alias("robust_z_candidate"))


def era_relative_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = qualified_season(spark, sf_dir)
    ref = q.where("qualified").groupBy("period").agg((F.sum("points") / F.sum("games")).alias("pooled"))
    index = E.relative_index("ppg", "pooled")
    ratio = E.safe_ratio("games", "opportunity")
    return q.join(ref, "period").select("entity", "period", F.round(index, 6).alias("relative_index"), F.round(E.opportunity_adjusted(index, ratio, 100.0), 6).alias("adjusted_index"))


def era_midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = P.with_midranks(qualified_season(spark, sf_dir), ["period"], "ppg", F.col("qualified"))
    return q.select("entity", "period", F.round(P.midrank_share(), 9).alias("percentile"), F.round(P.midrank_score(), 6).alias("score"), F.round(P.ecdf_share(), 9).alias("ecdf"))


MIDRANK_SQL = (
    SEASON_SQL
    + """,
k AS (
  SELECT a.entity, a.period, CAST(count(b.entity) FILTER (WHERE b.ppg < a.ppg) AS DOUBLE) AS below, CAST(count(b.entity) FILTER (WHERE b.ppg = a.ppg) AS DOUBLE) AS eq, CAST(count(b.entity) AS DOUBLE) AS n
  FROM q a LEFT JOIN q b ON a.period = b.period AND b.qualified GROUP BY a.entity, a.period)"""
)


def qualification_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each rule would qualify: shares of the opportunity with their floors."""
    q = qualified_season(spark, sf_dir)
    rules = [(2, 0.1), (5, 0.2), (5, 0.5), (5, 0.8), (5, 0.9)]
    counts = [F.count_if(E.qualifies("games", "opportunity", a, s)).alias(f"rule_{a}_{int(s * 100)}") for a, s in rules]
    return q.groupBy("period").agg(F.count("*").alias("n_rows"), *counts)


def scaling_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric in four scalings against the qualified reference, and the raw rank."""
    q = qualified_season(spark, sf_dir)
    ctx = _context(q)
    m = P.with_midranks(q, ["period"], "ppg", F.col("qualified")).join(ctx, "period")
    return P.competition_rank(m, ["period"], "ppg", "raw_rank").select(
        "entity", "period", F.round(P.midrank_score(), 6).alias("midrank"), F.round(100 * P.ecdf_share(), 6).alias("ecdf"), F.round(E.z_score("ppg", "mean", "sd"), 6).alias("z"),
        F.round(E.robust_z("ppg", "median", "mad", 1 / E.ROBUST_Z_CANDIDATE), 6).alias("robust"), "raw_rank",
    )


def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived per-game, per-36, per-75 and share features of every entity-period, masked before their introduction."""
    from plumbline.plans.base import season

    s = season(spark, sf_dir)
    r = lambda x, n: F.round(x, 6).alias(n)
    return s.select(
        "entity", "period", r(E.per_game("points", "games"), "points_per_game"), r(E.per_36("points", "games"), "points_per_36"), r(E.per_75("points", F.col("cents") / 100), "points_per_75"), r(E.per_game("tax", "games"), "tax_per_game"),
        r(E.safe_ratio("net", 100 * F.col("cents")), "net_share"), r(E.true_shooting("points", F.col("games"), F.col("tax")), "true_share"), r(E.effective_share("points", "tax", "games"), "effective_share"),
        F.when(F.col("tax").isNull(), "NOT_INTRODUCED").otherwise("AVAILABLE").alias("tax_status"),
    )


def long_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per entity, period and metric with z and percentile against the qualified population."""
    q = qualified_season(spark, sf_dir)
    long = q.select("entity", "period", "qualified", F.col("ppg").alias("ppg"), F.col("net_share").alias("net_share")).unpivot(["entity", "period", "qualified"], ["ppg", "net_share"], "metric", "value")
    ctx = P.distribution(long, ["period", "metric"], "value", F.col("qualified")).select("period", "metric", "mean", "sd")
    m = P.with_midranks(long, ["period", "metric"], "value", F.col("qualified")).join(ctx, ["period", "metric"])
    return m.select("entity", "period", "metric", F.round("value", 6).alias("value"), F.round(E.z_score("value", "mean", "sd"), 4).alias("z"), F.round(P.midrank_share(), 9).alias("percentile"))


def wide_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide form of the percentiles: one column per metric."""
    long = long_feature_table(spark, sf_dir)
    return long.groupBy("entity", "period").pivot("metric", ["net_share", "ppg"]).agg(F.first("percentile")).withColumnsRenamed({"ppg": "ppg_percentile", "net_share": "net_share_percentile"})


def era_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity totals per period, normalised against the qualified, with the best three-period window and a rank."""
    q = qualified_season(spark, sf_dir)
    m = P.with_midranks(q, ["period"], "ppg", F.col("qualified")).join(_context(q), "period")
    scored = m.select("entity", "period", F.round(E.z_score("ppg", "mean", "sd"), 6).alias("z"), F.round(P.midrank_share(), 9).alias("percentile"))
    best = S.best_window(scored, "entity", "period", "percentile", 3).select("entity", "start", F.round("mean", 6).alias("peak"))
    mean = scored.groupBy("entity").agg(F.count("*").alias("periods"), F.round(F.avg("z"), 4).alias("mean_z"))
    return P.global_position(mean.join(best, "entity", "left"), [F.col("peak").desc_nulls_last(), F.col("entity")])


SQL = {
    "league_context": "WITH " + CONTEXT_SQL + " SELECT period, n, round(mean,6) AS mean, round(median,6) AS median, round(sd,6) AS sd, round(mad,6) AS mad, round(q1,6) AS q1, round(q3,6) AS q3, round(least,6) AS least, round(most,6) AS most, round(pooled,6) AS pooled, opportunity FROM ctx",
    "era_zscore": "WITH " + CONTEXT_SQL + " SELECT entity, q.period, qualified, CASE WHEN sd > 0 THEN round((ppg - mean) / sd, 6) END AS z FROM q JOIN ctx ON q.period = ctx.period",
    "era_robust_z": "WITH " + CONTEXT_SQL + " SELECT entity, q.period, CASE WHEN mad > 0 THEN round(0.6744897501960817 * (ppg - median) / mad, 6) END AS robust_z, CASE WHEN mad > 0 THEN round((1 / 1.4826) * (ppg - median) / mad, 6) END AS robust_z_candidate FROM q JOIN ctx ON q.period = ctx.period",
    "era_relative_index": "WITH " + CONTEXT_SQL + " SELECT entity, q.period, round(100.0 * ppg / pooled, 6) AS relative_index, round(100.0 + (100.0 * ppg / pooled - 100.0) * least(greatest(CAST(games AS DOUBLE) / q.opportunity, 0.0), 1.0), 6) AS adjusted_index FROM q JOIN ctx ON q.period = ctx.period",
    "era_midrank_percentile": "WITH " + MIDRANK_SQL + " SELECT entity, period, round((below + 0.5 * eq) / n, 9) AS percentile, round(least(greatest(100.0 * (below + (eq - 1) / 2.0) / greatest(n - 1, 1), 0.0), 100.0), 6) AS score, round((below + eq) / n, 9) AS ecdf FROM k",
    "qualification_sensitivity": "WITH " + SEASON_SQL + " SELECT period, count(*) AS n_rows, "
    + ", ".join(f"count(*) FILTER (WHERE games >= greatest({a}, CAST(ceil({s} * opportunity) AS BIGINT))) AS rule_{a}_{int(s * 100)}" for a, s in [(2, 0.1), (5, 0.2), (5, 0.5), (5, 0.8), (5, 0.9)])
    + " FROM q GROUP BY period",
    "scaling_methods": "WITH " + CONTEXT_SQL + ", " + MIDRANK_SQL.split(SEASON_SQL + ",\n")[1]
    + " SELECT q.entity, q.period, round(least(greatest(100.0 * (below + (eq - 1) / 2.0) / greatest(k.n - 1, 1), 0.0), 100.0), 6) AS midrank, round(100 * ((below + eq) / k.n), 6) AS ecdf, round((ppg - mean) / sd, 6) AS z, round((1 / 1.4826) * (ppg - median) / mad, 6) AS robust, rank() OVER (PARTITION BY q.period ORDER BY ppg DESC) AS raw_rank FROM q JOIN ctx ON q.period = ctx.period JOIN k ON k.entity = q.entity AND k.period = q.period",
    "feature_registry": "WITH " + SEASON_SQL + """ SELECT entity, period, round(CAST(points AS DOUBLE) / games, 6) AS points_per_game, round(points * 36.0::DOUBLE / games, 6) AS points_per_36,
      round(points * 75.0::DOUBLE / (CAST(cents AS DOUBLE) / 100), 6) AS points_per_75, round(CAST(tax AS DOUBLE) / games, 6) AS tax_per_game, round(CAST(net AS DOUBLE) / (100 * cents), 6) AS net_share,
      round(CAST(points AS DOUBLE) / (2 * (games + 0.44::DOUBLE * tax)), 6) AS true_share, round((points + 0.5::DOUBLE * tax) / games, 6) AS effective_share,
      CASE WHEN tax IS NULL THEN 'NOT_INTRODUCED' ELSE 'AVAILABLE' END AS tax_status FROM season""",
    "era_flagship": "WITH " + CONTEXT_SQL + ", " + MIDRANK_SQL.split(SEASON_SQL + ",\n")[1]
    + """, sc AS (SELECT q.entity, q.period, round((ppg - mean) / sd, 6) AS z, round((below + 0.5 * eq) / k.n, 9) AS pct FROM q JOIN ctx ON q.period = ctx.period JOIN k ON k.entity = q.entity AND k.period = q.period),
      w AS (SELECT entity, period AS start, round(avg(pct) OVER o3, 9) AS m, lead(period, 2) OVER o AS e FROM sc WINDOW o AS (PARTITION BY entity ORDER BY period), o3 AS (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
      b AS (SELECT entity, start, round(m, 6) AS peak, row_number() OVER (PARTITION BY entity ORDER BY m DESC, start) AS n FROM w WHERE e = start + 2),
      a AS (SELECT entity, count(*) AS periods, round(avg(z), 4) AS mean_z FROM sc GROUP BY entity)
      SELECT a.entity, a.periods, a.mean_z, b.start, b.peak, row_number() OVER (ORDER BY b.peak DESC NULLS LAST, a.entity) AS position FROM a LEFT JOIN b ON a.entity = b.entity AND b.n = 1""",
}
_LONG = "WITH " + SEASON_SQL + """, lg AS (SELECT entity, period, qualified, 'ppg' AS metric, ppg AS value FROM q UNION ALL SELECT entity, period, qualified, 'net_share', net_share FROM q),
  c2 AS (SELECT period, metric, avg(value) AS mean, stddev_pop(value) AS sd FROM lg WHERE qualified GROUP BY 1, 2),
  k2 AS (SELECT a.entity, a.period, a.metric, a.value, CAST(count(b.entity) FILTER (WHERE b.value < a.value) AS DOUBLE) AS below, CAST(count(b.entity) FILTER (WHERE b.value = a.value) AS DOUBLE) AS eq, CAST(count(b.entity) AS DOUBLE) AS n
         FROM lg a LEFT JOIN lg b ON a.period = b.period AND a.metric = b.metric AND b.qualified GROUP BY 1, 2, 3, 4),
  lt AS (SELECT k2.entity, k2.period, k2.metric, round(value, 6) AS value, round((value - mean) / sd, 4) AS z, round((below + 0.5 * eq) / n, 9) AS percentile FROM k2 JOIN c2 ON k2.period = c2.period AND k2.metric = c2.metric)"""
SQL["long_feature_table"] = _LONG + " SELECT * FROM lt"
SQL["wide_feature_table"] = _LONG + " SELECT entity, period, max(percentile) FILTER (WHERE metric = 'net_share') AS net_share_percentile, max(percentile) FILTER (WHERE metric = 'ppg') AS ppg_percentile FROM lt GROUP BY 1, 2"
QUERIES = {f.__name__: f for f in (league_context, era_zscore, era_robust_z, era_relative_index, era_midrank_percentile, qualification_sensitivity, scaling_methods, feature_registry, long_feature_table, wide_feature_table, era_flagship)}
