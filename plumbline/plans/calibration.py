"""Error metrics, reliability, conformal radii and links over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.operators import calibration as C
from plumbline.plans.base import SEASON_SQL, qualified_season, read


def _estimates(spark, sf_dir):
    """Each rate with the mean of its entity as estimate."""
    q = qualified_season(spark, sf_dir)
    return q.withColumn("estimate", F.round(F.avg("ppg").over(W.partitionBy("entity")), 9)).withColumn("truth", F.round("ppg", 9)).withColumn("fold", E.hash_fold("entity", 5))


_EST = SEASON_SQL + ", est AS (SELECT *, round(avg(ppg) OVER (PARTITION BY entity), 9) AS estimate, round(ppg, 9) AS truth, CAST(CAST('0x' || substr(sha256(CAST(entity AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM q)"


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _estimates(spark, sf_dir).groupBy("period").agg(*C.error_metrics("truth", "estimate"))
    return m.select("period", "n", *[F.round(c, 4).alias(c) for c in ("bias", "mae", "rmse", "pearson", "slope", "intercept", "p90")])


def _labelled(spark, sf_dir):
    d, y = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels")
    return y.join(d, "doc_id").withColumn("p", F.least(F.lit(1.0), F.col("n_chars") / 5000)).withColumn("y", F.col("quality"))


_LAB = "lab AS (SELECT l.doc_id, n_chars, least(1.0::DOUBLE, n_chars / 5000) AS p, quality AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.reliability(_labelled(spark, sf_dir), "p", "y")
    return r.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_p", "observed", "gap")])


def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.expected_calibration_error(_labelled(spark, sf_dir), "p", "y").select(F.round("ece", 6).alias("ece"))


THRESHOLDS = [250.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0]


def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the greatest J, the lower of equals, with all thresholds' figures."""
    d = _labelled(spark, sf_dir).withColumn("good", F.col("y") == 1)
    y = C.youden(d, "n_chars", "good", THRESHOLDS)
    y = y.select("threshold", *[F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "j")])
    return y.withColumn("chosen", F.row_number().over(W.orderBy(F.desc("j"), "threshold")) == 1)  # as many rows as thresholds


def conformal_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius of each fold at 50, 80 and 90 %."""
    e = _estimates(spark, sf_dir).withColumn("e", F.round(F.col("truth") - F.col("estimate"), 6))
    out = None
    for level in (0.5, 0.8, 0.9):
        one = C.conformal_radius(e, ["fold"], "e", level).select("fold", F.lit(level).alias("level"), "n", "radius")
        out = one if out is None else out.unionByName(one)
    return out


def crossfit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the radius of the other folds' errors covers a fold: nominal against observed."""
    e = _estimates(spark, sf_dir).select("fold", F.abs(F.round(F.col("truth") - F.col("estimate"), 6)).alias("e"))
    folds = e.select("fold").distinct().withColumnRenamed("fold", "f")
    pairs = e.join(F.broadcast(folds), F.col("fold") != F.col("f"))
    r = C.conformal_radius(pairs.select("f", "e"), ["f"], "e", 0.8).select(F.col("f").alias("fold"), "radius")
    return e.join(r, "fold").groupBy("fold", "radius").agg(F.count("*").alias("n"), F.round(F.avg((F.col("e") <= F.col("radius")).cast("double")), 6).alias("covered"))


def linear_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.linear_link(qualified_season(spark, sf_dir), ["period"], "games", "points")
    return r.select("period", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def quantile_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games linked to points by 21 quantile knots, applied to every entity and period."""
    q = qualified_season(spark, sf_dir)
    knots = C.quantile_knots(q, "games", "points", 21)
    return C.interpolate(q, "games", knots).select("entity", "period", F.round("linked", 4).alias("linked"))


def isotonic_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic knots of points on games by period."""
    return C.isotonic_link(qualified_season(spark, sf_dir).withColumn("g", F.col("games").cast("double")).withColumn("p", F.col("points").cast("double")), ["period"], "g", "p", "period int")


def ridge_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold ridge predictions of points from games and cents, folds by a hash of the entity."""
    q = qualified_season(spark, sf_dir).withColumn("fold", E.hash_fold("entity", 5)).withColumn("x1", F.col("games").cast("double")).withColumn("x2", F.col("cents") / 1e6).withColumn("y", F.col("points").cast("double"))
    return C.grouped_oof_ridge(q, "fold", ["x1", "x2"], "y").select("entity", "period", "fold", F.round("oof", 4).alias("oof"))


def grouped_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by nation, for nations with 14 rows or more."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))
    e = _estimates(spark, sf_dir).join(s, "entity").withColumn("e", F.col("estimate") - F.col("truth"))
    return e.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.avg("e"), 4).alias("bias"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.percentile(F.abs("e"), 0.9), 6).alias("p90")).where("n >= 14")


SQL = {
    "regression_metrics": "WITH " + _EST + " SELECT period, count(*) AS n, round(avg(estimate - truth), 4) AS bias, round(avg(abs(estimate - truth)), 4) AS mae, round(sqrt(avg((estimate - truth) * (estimate - truth))), 4) AS rmse, round(corr(truth, estimate), 4) AS pearson, round(regr_slope(estimate, truth), 4) AS slope, round(regr_intercept(estimate, truth), 4) AS intercept, round(quantile_cont(abs(estimate - truth), 0.9), 4) AS p90 FROM est GROUP BY 1",
    "reliability_bins": "WITH " + _LAB + ", b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS ob FROM lab GROUP BY 1) SELECT bin, n, round(mp, 6) AS mean_p, round(ob, 6) AS observed, round(abs(mp - ob), 6) AS gap FROM b",
    "expected_calibration_error": "WITH " + _LAB + ", b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS ob FROM lab GROUP BY 1) SELECT round(sum(n * abs(mp - ob)) / sum(n), 6) AS ece FROM b",
    "youden_threshold": "WITH " + _LAB + f", t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold), f AS (SELECT threshold, round(count(*) FILTER (WHERE y = 1 AND n_chars >= threshold)::DOUBLE / count(*) FILTER (WHERE y = 1), 9) AS sensitivity, round(count(*) FILTER (WHERE y <> 1 AND n_chars < threshold)::DOUBLE / count(*) FILTER (WHERE y <> 1), 9) AS specificity, round(count(*) FILTER (WHERE y = 1 AND n_chars >= threshold)::DOUBLE / count(*) FILTER (WHERE y = 1) + count(*) FILTER (WHERE y <> 1 AND n_chars < threshold)::DOUBLE / count(*) FILTER (WHERE y <> 1) - 1, 9) AS j FROM lab, t GROUP BY 1) SELECT *, row_number() OVER (ORDER BY j DESC, threshold) = 1 AS chosen FROM f",
    "conformal_radius": "WITH " + _EST + ", e AS (SELECT fold, abs(round(truth - estimate, 6)) AS e, count(*) OVER (PARTITION BY fold) AS n, row_number() OVER (PARTITION BY fold ORDER BY abs(round(truth - estimate, 6))) AS k FROM est), l AS (SELECT unnest([0.5, 0.8, 0.9]::DOUBLE[]) AS level) SELECT fold, level, n, e AS radius FROM e, l WHERE k = least(n, CAST(ceil((n + 1) * level) AS BIGINT))",
    "crossfit_coverage": "WITH " + _EST + ", e AS (SELECT fold, abs(round(truth - estimate, 6)) AS e FROM est), f AS (SELECT DISTINCT fold AS f FROM e), p AS (SELECT f, e, count(*) OVER (PARTITION BY f) AS n, row_number() OVER (PARTITION BY f ORDER BY e) AS k FROM e JOIN f ON fold <> f), r AS (SELECT f, e AS radius FROM p WHERE k = least(n, CAST(ceil((n + 1) * 0.8::DOUBLE) AS BIGINT))) SELECT fold, radius, count(*) AS n, round(avg(CASE WHEN e <= radius THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS covered FROM e JOIN r ON fold = f GROUP BY 1, 2",
    "linear_link": "WITH " + SEASON_SQL + " SELECT period, count(*) AS n, round(regr_slope(points, games), 6) AS slope, round(regr_intercept(points, games), 4) AS intercept FROM q GROUP BY 1",
    "quantile_link": "WITH " + SEASON_SQL + ", ks AS (SELECT unnest(range(21)) AS i), kn AS (SELECT i, (SELECT quantile_cont(CAST(games AS DOUBLE), [" + ", ".join(repr(i / 20) for i in range(21)) + "]) FROM q)[i + 1] AS x, (SELECT quantile_cont(CAST(points AS DOUBLE), [" + ", ".join(repr(i / 20) for i in range(21)) + "]) FROM q)[i + 1] AS y FROM ks), a AS (SELECT q.entity, q.period, q.games, max(kn.i) AS lo FROM q JOIN kn ON kn.x <= q.games GROUP BY 1, 2, 3) SELECT a.entity, a.period, round(CASE WHEN b.i IS NULL THEN k.y WHEN b.x > k.x THEN k.y + (b.y - k.y) / (b.x - k.x) * (a.games - k.x) ELSE k.y END, 4) AS linked FROM a JOIN kn k ON k.i = a.lo LEFT JOIN kn b ON b.i = a.lo + 1",
    "grouped_error_report": "WITH " + _EST + ", e AS (SELECT s_nationkey AS nation, estimate - truth AS e FROM est JOIN supplier ON entity = s_suppkey) SELECT nation, count(*) AS n, round(avg(e), 4) AS bias, round(avg(abs(e)), 6) AS mae, round(quantile_cont(abs(e), 0.9), 6) AS p90 FROM e GROUP BY 1 HAVING count(*) >= 14",
}
QUERIES = {f.__name__: f for f in (regression_metrics, reliability_bins, expected_calibration_error, youden_threshold, conformal_radius, crossfit_coverage, linear_link, quantile_link, isotonic_link, ridge_oof, grouped_error_report)}
