"""Dimension scores, the overall score and its sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.operators import population as P
from plumbline.operators import scoring as K
from plumbline.plans.careers import _PCT, _percentiles

#: The weights of the seven dimensions.
WEIGHTS = {"peak": 0.17, "longevity": 0.14, "offense": 0.16, "defense": 0.14, "playoffs": 0.18, "accolades": 0.10, "winning": 0.11}


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven 0-100 dimension scores per entity from its percentiles; `accolades` is unknown for entities divisible by 9."""
    p = _percentiles(spark, sf_dir)
    g = p.groupBy("entity").agg(
        F.max("pct").alias("peak"), F.sum(F.greatest(F.col("pct") - 0.5, F.lit(0.0))).alias("longevity"), F.avg("pct").alias("offense"), F.min("pct").alias("defense"), F.median("pct").alias("playoffs"),
        F.count_if(F.col("pct") >= 0.8).cast("double").alias("accolades"), F.sum("games").cast("double").alias("winning"),
    )
    out = g.withColumn("accolades", F.when(F.col("entity") % 9 != 0, F.col("accolades")))
    for k in WEIGHTS:
        out = out.withColumn(k, F.round(k, 9))
    long = out.unpivot(["entity"], list(WEIGHTS), "dimension", "value")
    m = P.with_midranks(long, ["dimension"], "value", F.lit(True)).select("entity", "dimension", F.round(P.midrank_score(), 6).alias("score"))
    return m.groupBy("entity").pivot("dimension", list(WEIGHTS)).agg(F.first("score"))


_COMP = (
    _PCT
    + """, g0 AS (SELECT entity, max(pct) AS peak, sum(greatest(pct - 0.5, 0.0)) AS longevity, avg(pct) AS offense, min(pct) AS defense, median(pct) AS playoffs, CASE WHEN entity % 9 <> 0 THEN CAST(count(*) FILTER (WHERE pct >= 0.8) AS DOUBLE) END AS accolades, CAST(sum(games) AS DOUBLE) AS winning FROM p GROUP BY 1),
  g AS (SELECT entity, """
    + ", ".join(f"round({k}, 9) AS {k}" for k in WEIGHTS)
    + " FROM g0), c AS (SELECT entity, "
    + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN round(100.0 * (rank() OVER (ORDER BY {k} ASC NULLS LAST) - 1 + (count({k}) OVER (PARTITION BY {k}) - 1) / 2.0::DOUBLE) / greatest(count({k}) OVER () - 1, 1), 6) END AS {k}" for k in WEIGHTS)
    + " FROM g)"
)


def _lin(weights):
    return " + ".join(f"{k} * {w!r}::DOUBLE" for k, w in weights.items())


def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven scores in long form with their rank."""
    long = components(spark, sf_dir).unpivot(["entity"], list(WEIGHTS), "dimension", "score")
    r = P.competition_rank(long, ["dimension"], "score")
    return r.select("entity", "dimension", "score", "rank")


def overall_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-case weighted score; incomplete entities are listed without a rank."""
    s = components(spark, sf_dir).withColumn("overall", F.round(K.linear_score(WEIGHTS), 6))
    r = P.global_position(s, [F.col("overall").desc_nulls_last(), F.col("entity")]).withColumn("rank", F.when(F.col("overall").isNotNull(), F.col("position")))
    return r.select("entity", "overall", "rank", F.when(F.col("overall").isNull(), "INCOMPLETE").otherwise("RANKED").alias("status"))


def missingness_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score under four policies for absent parts, with the share of weight observed."""
    c = components(spark, sf_dir)
    r = lambda p: F.round(E.combine(WEIGHTS, p, 50.0), 6).alias(p)
    return c.select("entity", r("complete"), r("renormalise"), r("zero"), r("neutral"), F.round(E.observed_weight(WEIGHTS), 6).alias("coverage"), F.round(E.stronger_secondary("offense", "defense"), 6).alias("two_way"))


def _sets():
    base = {"base": WEIGHTS}
    base |= {f"{k}_up": K.perturbed(WEIGHTS, k, 1.2) for k in WEIGHTS}
    base |= {f"{k}_down": K.perturbed(WEIGHTS, k, 0.8) for k in WEIGHTS}
    return base


def weight_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst rank, and mean score, of each complete entity when each weight moves by a fifth."""
    s = K.scenarios(components(spark, sf_dir).dropna(), ["entity"], _sets(), 6)
    r = s.withColumn("rank", F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("score"), "entity")).cast("bigint"))
    return r.groupBy("entity").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), F.round(F.avg("score"), 4).alias("mean_score"))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every complete entity without each dimension, against its rank with all."""
    sets = {"all": WEIGHTS} | {k: K.without(WEIGHTS, k) for k in WEIGHTS}
    s = K.scenarios(components(spark, sf_dir).dropna(), ["entity"], sets, 6)
    r = s.withColumn("rank", F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("score"), "entity")).cast("bigint"))
    base = r.where("scenario = 'all'").select("entity", F.col("rank").alias("base_rank"))
    return r.where("scenario <> 'all'").join(base, "entity").select("entity", F.col("scenario").alias("left_out"), "rank", (F.col("rank") - F.col("base_rank")).alias("change"))


def shapley_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dimension's share of the variance of the overall score."""
    return K.variance_shares(components(spark, sf_dir), WEIGHTS).select("part", F.round("share", 6).alias("share"))


def top_n_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of the first ten and fifty of two rankings of customers."""
    from plumbline.plans.base import read

    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c"))
    # Only the first fifty of each order are kept: a top-k sort, not a ranking of all.
    top = lambda col, n: o.orderBy(F.desc(col), "o_custkey").limit(n).select("o_custkey")
    out = None
    for n in (10, 50):
        one = top("n", n).join(top("c", n), "o_custkey", "left_semi").agg(F.lit(n).cast("bigint").alias("size"), (F.count("*") / F.lit(float(n))).alias("overlap"))
        out = one if out is None else out.unionByName(one)
    return out


def masking_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score recomputed with parts masked: error against the full score by scenario."""
    c = components(spark, sf_dir).dropna()
    scen = {"no_peak": ["peak"], "no_awards": ["accolades", "winning"], "box_only": ["defense", "playoffs", "accolades"]}
    full = E.weighted_observed(WEIGHTS)
    out = None
    for name, hide in scen.items():
        kept = {k: w for k, w in WEIGHTS.items() if k not in hide}
        one = c.select(F.lit(name).alias("scenario"), (E.weighted_observed(kept) - full).alias("e"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("bias"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.max(F.abs("e")), 6).alias("worst"))


def close_order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the overall order and how many are closer than each gap."""
    s = components(spark, sf_dir).dropna().select("entity", F.round(K.linear_score(WEIGHTS), 6).alias("overall"))
    g = s.withColumn("gap", F.col("overall") - F.lead("overall").over(W.orderBy(F.desc("overall"), "entity")))
    return g.agg(F.count("gap").alias("pairs"), *[F.count_if(F.col("gap") < t).alias(f"under_{i}") for i, t in enumerate((0.1, 0.5, 1.0))], F.round(F.min("gap"), 6).alias("least"), F.round(F.max("gap"), 6).alias("most"))


def _scen_sql(sets):
    return " UNION ALL ".join(f"SELECT entity, '{n}' AS scenario, round({_lin(w)}, 6) AS score FROM f" for n, w in sets.items())


_FULL = "WITH " + _COMP + ", f AS (SELECT * FROM c WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in WEIGHTS) + ")"


def _wo(kept):
    return "(" + _lin(kept) + ") / (" + " + ".join(f"{w!r}::DOUBLE" for w in kept.values()) + ")"


_MASK = {"no_peak": ["peak"], "no_awards": ["accolades", "winning"], "box_only": ["defense", "playoffs", "accolades"]}
SQL = {
    "dimension_scores": "WITH " + _COMP + ", l AS (" + " UNION ALL ".join(f"SELECT entity, '{k}' AS dimension, {k} AS score FROM c" for k in WEIGHTS) + ") SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY dimension ORDER BY score DESC NULLS LAST) END AS rank FROM l",
    "overall_score_rank": "WITH " + _COMP + f", s AS (SELECT entity, round({_lin(WEIGHTS)}, 6) AS overall FROM c) SELECT entity, overall, CASE WHEN overall IS NOT NULL THEN row_number() OVER (ORDER BY overall DESC NULLS LAST, entity) END AS rank, CASE WHEN overall IS NULL THEN 'INCOMPLETE' ELSE 'RANKED' END AS status FROM s",
    "missingness_policies": "WITH " + _COMP + f", k0 AS (SELECT *, CASE WHEN accolades IS NULL THEN 0.9 ELSE 1.0 END AS cov FROM c) SELECT entity, round({_lin(WEIGHTS)}, 6) AS complete, round((" + " + ".join(f"coalesce({k} * {w}::DOUBLE, 0.0)" for k, w in WEIGHTS.items()) + ") / (" + " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w}::DOUBLE ELSE 0.0 END" for k, w in WEIGHTS.items()) + "), 6) AS renormalise, round(" + " + ".join(f"coalesce({k}, 0.0) * {w}::DOUBLE" for k, w in WEIGHTS.items()) + ", 6) AS zero, round(" + " + ".join(f"coalesce({k}, 50.0) * {w}::DOUBLE" for k, w in WEIGHTS.items()) + ", 6) AS neutral, CAST(round(cov, 6) AS DOUBLE) AS coverage, round(greatest(offense, defense) * 0.65::DOUBLE + least(offense, defense) * 0.35::DOUBLE, 6) AS two_way FROM k0",
    "weight_perturbation": _FULL + ", s AS (" + _scen_sql(_sets()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, entity) AS rank FROM s) SELECT entity, min(rank) AS best, max(rank) AS worst, round(avg(score), 4) AS mean_score FROM r GROUP BY 1",
    "leave_one_out": _FULL + ", s AS (" + _scen_sql({"all": WEIGHTS} | {k: K.without(WEIGHTS, k) for k in WEIGHTS}) + "), r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, entity) AS rank FROM s) SELECT r.entity, r.scenario AS left_out, r.rank, r.rank - b.rank AS change FROM r JOIN r b ON r.entity = b.entity AND b.scenario = 'all' WHERE r.scenario <> 'all'",
    "shapley_variance": _FULL + f", y AS (SELECT *, {_lin(WEIGHTS)} AS y FROM f) " + " UNION ALL ".join(f"SELECT '{k}' AS part, round({w}::DOUBLE * covar_pop({k}, y) / var_pop(y), 6) AS share FROM y" for k, w in WEIGHTS.items()),
    "top_n_overlap": "WITH o AS (SELECT o_custkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY 1), r AS (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) AS a, row_number() OVER (ORDER BY c DESC, o_custkey) AS b FROM o) SELECT CAST(10 AS BIGINT) AS size, count(*) FILTER (WHERE a <= 10 AND b <= 10) / 10.0::DOUBLE AS overlap FROM r UNION ALL SELECT CAST(50 AS BIGINT), count(*) FILTER (WHERE a <= 50 AND b <= 50) / 50.0::DOUBLE FROM r",
    "masking_audit": _FULL + ", e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS scenario, {_wo({k: w for k, w in WEIGHTS.items() if k not in h})} - {_wo(WEIGHTS)} AS e FROM f" for n, h in _MASK.items()) + ") SELECT scenario, count(*) AS n, round(avg(e), 6) AS bias, round(avg(abs(e)), 6) AS mae, round(max(abs(e)), 6) AS worst FROM e GROUP BY 1",
    "close_order_audit": _FULL + f", s AS (SELECT entity, round({_lin(WEIGHTS)}, 6) AS overall FROM f), gp AS (SELECT overall - lead(overall) OVER (ORDER BY overall DESC, entity) AS gap FROM s) SELECT count(gap) AS pairs, count(*) FILTER (WHERE gap < 0.1) AS under_0, count(*) FILTER (WHERE gap < 0.5) AS under_1, count(*) FILTER (WHERE gap < 1.0) AS under_2, round(min(gap), 6) AS least, round(max(gap), 6) AS most FROM gp",
}
QUERIES = {f.__name__: f for f in (dimension_scores, overall_score_rank, missingness_policies, weight_perturbation, leave_one_out, shapley_variance, top_n_overlap, masking_audit, close_order_audit)}
