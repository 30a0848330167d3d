"""Measures between score tables: partial correlation, explained variance, block-wise ridge, ranking metrics, and careers per draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evidence as V
from plumbline.operators import population as P
from plumbline.operators import simulation as M
from plumbline.plans.base import SEASON_SQL, qualified_season

COLUMNS = ["ppg", "net_share", "games"]
#: Draws of every entity and period.
DRAWS = 250


def _season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualified_season(spark, sf_dir).select("entity", "period", "ppg", "net_share", F.col("games").cast("double").alias("games"), F.col("points").cast("double").alias("points"))


def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of three columns, with the third held."""
    q = _season(spark, sf_dir)
    rows = [(a, b, V.partial_correlation(q, a, b, [c])) for a, b, c in (("ppg", "net_share", "games"), ("ppg", "games", "net_share"), ("games", "net_share", "ppg"))]
    out = spark.createDataFrame(rows, "a string, b string, r double")
    return out.select("a", "b", F.round("r", 6).alias("r"))


def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other two columns explain of each, and the greatest correlation with them."""
    rows = [tuple(x[k] for k in ("candidate", "n", "max_cross_correlation", "r_squared")) for x in V.uniqueness(_season(spark, sf_dir), dict(zip(COLUMNS, COLUMNS, strict=True)))]
    return spark.createDataFrame(rows, "candidate string, n long, c double, r2 double").select("candidate", "n", F.round("c", 6).alias("max_cross_correlation"), F.round("r2", 6).alias("r_squared"))


def latent_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One factor of three columns, scored where one of them is missing too."""
    q = _season(spark, sf_dir)
    model = V.fit_latent(q, COLUMNS)
    holes = q.withColumn("net_share", F.when(F.col("entity") % 7 != 0, F.col("net_share")))
    return holes.select("entity", "period", F.round(V.latent_score(model), 6).alias("factor"))


def era_block_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points predicted from games, each year by a ridge fitted on all other years."""
    out = V.block_ridge(_season(spark, sf_dir), ["games"], "points", "period")
    return out.select("entity", "period", F.round("predicted", 4).alias("predicted"))


def ranking_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of entities by points against that by mean rate."""
    g = _season(spark, sf_dir).groupBy("entity").agg(F.sum("points").alias("total"), F.round(F.avg("ppg"), 9).alias("rate"))
    r = P.global_position(P.global_position(g, [F.desc("total"), F.col("entity")], "a"), [F.desc("rate"), F.col("entity")], "b")
    m = V.ranking_metrics(r, "entity", "a", "b")
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws around every season's percentile score, as 0 to 100."""
    q = P.with_midranks(qualified_season(spark, sf_dir), ["period"], "ppg", F.lit(True)).select("entity", "period", F.round(100 * P.midrank_share(), 6).alias("centre"))
    keyed = q.withColumn("key", F.concat_ws("-", "entity", "period")).withColumn("spread", F.lit(10.0))
    return M.draws(keyed, "key", "centre", "spread", DRAWS).select("entity", "period", "draw", "score")


_DRAWN = SEASON_SQL + f""", b AS (SELECT entity, period, round(100 * (rank() OVER (PARTITION BY period ORDER BY ppg) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY period, ppg)) / count(*) OVER (PARTITION BY period), 6) AS centre, concat_ws('-', entity, period) AS key FROM q),
  d AS (SELECT b.*, CAST(unnest(range(1, {DRAWS + 1})) AS INTEGER) AS draw FROM b),
  u AS (SELECT *, """ + ", ".join(f"CAST(CAST('0x' || substr(sha256(key || ':' || draw || ':{t}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u{t}" for t in "abc") + """ FROM d),
  x AS (SELECT entity, period, draw, round(centre + 10.0::DOUBLE * (ua + ub + uc - 1.5::DOUBLE), 9) AS v FROM u)"""


def peak_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with window and apex chosen anew in every draw, as intervals."""
    p = V.peak_by_draw(_draws(spark, sf_dir), "entity", "draw", "period", "score").where("peak IS NOT NULL").withColumn("peak", F.round("peak", 6))
    b = V.quantile_band(p, ["entity"], "peak", (0.5, 0.8))
    windows = p.groupBy("entity").agg(F.countDistinct("window_start").alias("windows"), F.countDistinct("apex_period").alias("apexes"))
    return b.join(windows, "entity").select("entity", "n", "windows", "apexes", *[F.round(c, 4).alias(c) for c in ("mean", "low_50", "high_50", "low_80", "high_80")])


def longevity_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth, capped area and longest run per draw, on average and at the ends."""
    g = V.longevity_by_draw(_draws(spark, sf_dir), "entity", "draw", "period", "score").groupBy("entity")
    return g.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("breadth", "area", "run")], F.max("run").alias("longest"), F.min("breadth").alias("least"))


_PC = lambda a, b, c: f"SELECT '{a}' AS a, '{b}' AS b, round((corr({a}, {b}) - corr({a}, {c}) * corr({b}, {c})) / sqrt((1 - corr({a}, {c}) ^ 2) * (1 - corr({b}, {c}) ^ 2)), 6) AS r FROM s"
_R2 = lambda y, a, b: f"SELECT '{y}' AS candidate, count(*) AS n, round(greatest(abs(corr({y}, {a})), abs(corr({y}, {b}))), 6) AS max_cross_correlation, round((corr({y}, {a}) ^ 2 + corr({y}, {b}) ^ 2 - 2 * corr({y}, {a}) * corr({y}, {b}) * corr({a}, {b})) / (1 - corr({a}, {b}) ^ 2), 6) AS r_squared FROM s"
_S = "WITH " + SEASON_SQL + ", s AS (SELECT entity, period, ppg, net_share, games::DOUBLE AS games, points::DOUBLE AS points FROM q)"
SQL = {
    "partial_correlation": _S + " " + " UNION ALL ".join([_PC("ppg", "net_share", "games"), _PC("ppg", "games", "net_share"), _PC("games", "net_share", "ppg")]),
    "explained_variance": _S + " " + " UNION ALL ".join([_R2("ppg", "net_share", "games"), _R2("net_share", "ppg", "games"), _R2("games", "ppg", "net_share")]),
    "era_block_ridge": _S + """, f AS (SELECT p.period, count(*) AS n, avg(games) AS mx, avg(points) AS my, covar_pop(games, points) AS c, var_pop(games) AS v FROM s JOIN (SELECT DISTINCT period FROM s) p ON s.period <> p.period GROUP BY 1)
      SELECT entity, s.period, round(my + n * c / (v * (n + 1)) * (games - mx), 4) AS predicted FROM s JOIN f ON s.period = f.period""",
    "ranking_comparison": _S + """, g AS (SELECT entity, sum(points) AS total, round(avg(ppg), 9) AS rate FROM s GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY total DESC, entity) AS a, row_number() OVER (ORDER BY rate DESC, entity) AS b FROM g)
      SELECT count(*) AS n, round(1 - 6 * sum((b - a) * (b - a))::DOUBLE / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS spearman, round(avg(b - a), 6) AS rank_bias, round(avg(abs(b - a)), 6) AS rank_mae, round(median(abs(b - a)), 6) AS median_absolute_rank_error, """
    + ", ".join(f"round(count(*) FILTER (WHERE a <= {t} AND b <= {t}) / {t}::DOUBLE, 6) AS top_{t}_overlap" for t in (10, 25, 50, 100)) + " FROM r",
    "peak_uncertainty": "WITH " + _DRAWN + """, w AS (SELECT entity, draw, period, round(avg(v) OVER o3, 12) AS m, lead(period, 2) OVER o AS e FROM x WINDOW o AS (PARTITION BY entity, draw ORDER BY period), o3 AS (PARTITION BY entity, draw ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
      b3 AS (SELECT entity, draw, period AS ws, m, row_number() OVER (PARTITION BY entity, draw ORDER BY m DESC, period) AS i FROM w WHERE e = period + 2), ap AS (SELECT entity, draw, period AS ap, v, row_number() OVER (PARTITION BY entity, draw ORDER BY v DESC, period) AS i FROM x),
      pk AS (SELECT entity, draw, ws, ap, round(0.7::DOUBLE * m + (1 - 0.7::DOUBLE) * v, 6) AS peak FROM b3 JOIN ap USING (entity, draw) WHERE b3.i = 1 AND ap.i = 1)
      SELECT entity, count(*) AS n, count(DISTINCT ws) AS windows, count(DISTINCT ap) AS apexes, round(avg(peak), 4) AS mean, round(quantile_cont(peak, (1 - 0.5::DOUBLE) / 2), 4) AS low_50, round(quantile_cont(peak, (1 + 0.5::DOUBLE) / 2), 4) AS high_50, round(quantile_cont(peak, (1 - 0.8::DOUBLE) / 2), 4) AS low_80, round(quantile_cont(peak, (1 + 0.8::DOUBLE) / 2), 4) AS high_80 FROM pk GROUP BY 1""",
    "longevity_uncertainty": "WITH " + _DRAWN + """, i AS (SELECT entity, draw, period - row_number() OVER (PARTITION BY entity, draw ORDER BY period) AS k FROM x WHERE v >= 80), r AS (SELECT entity, draw, max(n)::DOUBLE AS run FROM (SELECT entity, draw, k, count(*) AS n FROM i GROUP BY 1, 2, 3) GROUP BY 1, 2),
      g AS (SELECT entity, draw, count(*) FILTER (WHERE v >= 80)::DOUBLE AS breadth, sum(least(greatest((v - 80) / 10.0::DOUBLE, 0.0), 1.0)) AS area FROM x GROUP BY 1, 2)
      SELECT g.entity, count(*) AS n, round(avg(breadth), 4) AS breadth, round(avg(area), 4) AS area, round(avg(coalesce(run, 0.0)), 4) AS run, max(coalesce(run, 0.0)) AS longest, min(breadth) AS least FROM g LEFT JOIN r ON g.entity = r.entity AND g.draw = r.draw GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (partial_correlation, explained_variance, latent_factor, era_block_ridge, ranking_comparison, peak_uncertainty, longevity_uncertainty)}
