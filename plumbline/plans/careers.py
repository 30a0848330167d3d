"""Career-shaped features: gaps, windows, runs, breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.operators import population as P
from plumbline.operators import sequences as S
from plumbline.plans.base import qualified_season, read
from plumbline.plans.era import MIDRANK_SQL


def _customer_seasons(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("period")).agg(F.count("*").alias("games"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


_CS = "cs AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS games, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2)"


def _percentiles(spark, sf_dir):
    q = P.with_midranks(qualified_season(spark, sf_dir), ["period"], "ppg", F.col("qualified"))
    return q.select("entity", "period", "games", "opportunity", "qualified", F.round(P.midrank_share(), 9).alias("pct"))


_PCT = MIDRANK_SQL + ", p AS (SELECT q.entity, q.period, games, opportunity, qualified, round((below + 0.5 * eq) / n, 9) AS pct FROM q JOIN k ON q.entity = k.entity AND q.period = k.period)"


def career_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year between a customer's first and last, gap rows included."""
    return S.with_gaps(_customer_seasons(spark, sf_dir), "entity", "period").select("entity", "period", "appeared", "games", "career_index", "appearance_index")


def _windows(length):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.best_window(_percentiles(spark, sf_dir), "entity", "period", "pct", length).select("entity", "start", "end", F.round("mean", 6).alias("mean"))

    run.__doc__ = f"The best complete window of {length} consecutive periods."
    run.__name__ = f"peak_window_{length}"
    return run


def _window_sql(n):
    return f"WITH {_PCT}, w AS (SELECT entity, period AS start, CAST(period + {n - 1} AS INTEGER) AS e, round(avg(pct) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING), 9) AS m, lead(period, {n - 1}) OVER (PARTITION BY entity ORDER BY period) AS l FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY m DESC, start) AS k FROM w WHERE l = e) SELECT entity, start, e AS \"end\", round(m, 6) AS mean FROM r WHERE k = 1"


def best_non_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the three best years of a customer; NULL with fewer."""
    b = S.best_periods(_customer_seasons(spark, sf_dir), "entity", "period", "cents", 3)
    return b.select("entity", F.round("mean", 2).alias("mean"), F.array_join(F.col("periods").cast("array<string>"), ",").alias("periods"))


def prime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of consecutive years with three orders or more."""
    return S.longest_run(_customer_seasons(spark, sf_dir), "entity", "period", F.col("games") >= 3).select("entity", "start", "end", "length")


def longevity_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth, area above a baseline (plain and weighted by opportunity), longest run, first and last elite period."""
    p = _percentiles(spark, sf_dir)
    elite = F.col("pct") >= 0.8
    ratio = E.clamp(E.safe_ratio("games", "opportunity"), 0.0, 1.0)
    g = p.groupBy("entity").agg(
        F.count_if(elite).alias("elite"), F.round(S.area_above("pct", 0.5), 6).alias("area"), F.round(S.area_above("pct", 0.5, ratio), 6).alias("weighted_area"), F.min(F.when(elite, F.col("period"))).alias("first_elite"), F.max(F.when(elite, F.col("period"))).alias("last_elite")
    )
    run = S.longest_run(p, "entity", "period", elite).select("entity", F.col("length").alias("longest"))
    return g.join(run, "entity", "left").withColumn("longest", F.coalesce("longest", F.lit(0)).cast("bigint"))


def late_career(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the last three appearances are above the median."""
    return S.latest(_percentiles(spark, sf_dir), "entity", "period", 3).groupBy("entity").agg(F.count("*").alias("seen"), F.count_if(F.col("pct") >= 0.5).alias("strong"), F.min("period").alias("since"))


def career_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, moments and extremes of a career, with the best period and the participation."""
    p = _percentiles(spark, sf_dir)
    best = F.max_by("period", F.struct("pct", (-F.col("period")).alias("e")))
    return p.groupBy("entity").agg(
        F.count("*").alias("periods"), F.count_if("qualified").alias("qualified_periods"), (F.max("period") - F.min("period") + 1).alias("span"), F.sum("games").alias("games"), F.round(F.avg("pct"), 6).alias("mean"), F.round(F.median("pct"), 6).alias("median"),
        F.round(F.stddev_pop("pct"), 6).alias("sd"), F.round(F.min("pct"), 6).alias("least"), F.round(F.max("pct"), 6).alias("most"), best.alias("best_period"),
    )


def run_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of one year between two runs of a customer, with the lengths of the runs they would join."""
    r = S.runs(_customer_seasons(spark, sf_dir), "entity", "period", F.col("games") >= 2)
    from pyspark.sql import Window as W

    o = W.partitionBy("entity").orderBy("start")
    n = r.withColumn("next_start", F.lead("start").over(o)).withColumn("next_length", F.lead("length").over(o))
    return n.where(F.col("next_start") == F.col("end") + 2).select("entity", (F.col("end") + 1).alias("gap"), F.col("length").alias("before"), F.col("next_length").alias("after"))


_RUNS = "WITH " + _CS + ", i AS (SELECT entity, period, period - row_number() OVER (PARTITION BY entity ORDER BY period) AS g FROM cs WHERE games >= {n}), r AS (SELECT entity, min(period) AS start, max(period) AS \"end\", count(*) AS length FROM i GROUP BY entity, g)"
SQL = {
    "career_sequence_gaps": "WITH " + _CS + ", s AS (SELECT entity, min(period) AS a, max(period) AS b FROM cs GROUP BY 1), e AS (SELECT entity, CAST(unnest(range(a, b + 1)) AS INTEGER) AS period FROM s) SELECT e.entity, e.period, cs.games IS NOT NULL AS appeared, games, row_number() OVER (PARTITION BY e.entity ORDER BY e.period) AS career_index, CAST(sum(CASE WHEN games IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e.entity ORDER BY e.period) AS BIGINT) AS appearance_index FROM e LEFT JOIN cs ON e.entity = cs.entity AND e.period = cs.period",
    **{f"peak_window_{n}": _window_sql(n) for n in (1, 3, 5)},
    "best_non_contiguous": "WITH " + _CS + ", r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY cents DESC, period) AS k FROM cs) SELECT entity, CASE WHEN count(*) = 3 THEN round(avg(cents), 2) END AS mean, string_agg(CAST(period AS VARCHAR), ',' ORDER BY period) AS periods FROM r WHERE k <= 3 GROUP BY 1",
    "prime_runs": _RUNS.format(n=3) + ", k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY length DESC, start) AS n FROM r) SELECT entity, start, \"end\", length FROM k WHERE n = 1",
    "longevity_evidence": "WITH " + _PCT + """, g AS (SELECT entity, count(*) FILTER (WHERE pct >= 0.8) AS elite, round(sum(greatest(pct - 0.5, 0.0)), 6) AS area, round(sum(greatest(pct - 0.5, 0.0) * least(greatest(CAST(games AS DOUBLE) / opportunity, 0.0), 1.0)), 6) AS weighted_area, min(CASE WHEN pct >= 0.8 THEN period END) AS first_elite, max(CASE WHEN pct >= 0.8 THEN period END) AS last_elite FROM p GROUP BY 1),
      i AS (SELECT entity, period - row_number() OVER (PARTITION BY entity ORDER BY period) AS d FROM p WHERE pct >= 0.8), l AS (SELECT entity, max(c) AS longest FROM (SELECT entity, d, count(*) AS c FROM i GROUP BY 1, 2) GROUP BY 1) SELECT g.*, coalesce(longest, 0) AS longest FROM g LEFT JOIN l ON g.entity = l.entity""",
    "late_career": "WITH " + _PCT + ", r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS b FROM p) SELECT entity, count(*) AS seen, count(*) FILTER (WHERE pct >= 0.5) AS strong, min(period) AS since FROM r WHERE b <= 3 GROUP BY 1",
    "career_summary": "WITH " + _PCT + " SELECT entity, count(*) AS periods, count(*) FILTER (WHERE qualified) AS qualified_periods, max(period) - min(period) + 1 AS span, CAST(sum(games) AS BIGINT) AS games, round(avg(pct), 6) AS mean, round(median(pct), 6) AS median, round(stddev_pop(pct), 6) AS sd, round(min(pct), 6) AS least, round(max(pct), 6) AS most, list(period ORDER BY pct DESC, period)[1] AS best_period FROM p GROUP BY 1",
    "run_bridges": _RUNS.format(n=2) + ", n AS (SELECT *, lead(start) OVER (PARTITION BY entity ORDER BY start) AS ns, lead(length) OVER (PARTITION BY entity ORDER BY start) AS nl FROM r) SELECT entity, \"end\" + 1 AS gap, length AS before, nl AS after FROM n WHERE ns = \"end\" + 2",
}
QUERIES = {f.__name__: f for f in (career_sequence_gaps, _windows(1), _windows(3), _windows(5), best_non_contiguous, prime_runs, longevity_evidence, late_career, career_summary, run_bridges)}
