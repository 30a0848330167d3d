"""Missingness policies, labels, features, candidates and their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.functions import policy as L
from plumbline.operators import catalog as C
from plumbline.operators import population as P
from plumbline.plans.base import FACTS_SQL, facts, read

#: The binding of parts: a customer's balance, size of name and key in four parts, of which some are absent; core or not.
PARTS = {"a": True, "b": True, "c": True, "d": False, "e": False}


def evidence_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's parts combined under each policy for absent ones."""
    k = F.col("c_custkey")
    parts = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 != 0, k % 97 / F.lit(97.0)).alias("a"), F.when(k % 5 != 0, k % 89 / F.lit(89.0)).alias("b"), F.when(k % 7 < 5, k % 83 / F.lit(83.0)).alias("c"), F.when(k % 2 == 0, k % 79 / F.lit(79.0)).alias("d"), F.when(k % 11 < 4, k % 73 / F.lit(73.0)).alias("e"),
    )
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), L.combine_components(PARTS, p, {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.1, "e": 0.1}).alias("x")) for p in L.POLICIES])
    r = lambda c: F.round(F.col(f"z.x.{c}"), 6).alias(c)
    return parts.select("c_custkey", F.explode(rows).alias("z")).select("c_custkey", "z.policy", r("value"), r("coverage"), r("core_coverage"), r("optional_coverage"), "z.x.confidence", F.col("z.x.used").cast("bigint").alias("used"))


def rank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers counted by the labels that a probability and an interval's width give them."""
    p, width = (F.col("c_custkey") % 101) / F.lit(100.0), F.col("c_custkey") % 120
    c = read(spark, sf_dir, "customer").select(L.top100_membership(p).alias("membership"), L.pairwise_order(p).alias("order_evidence"), L.robust_order(p).alias("robust_order"), L.rank_stability(p, width).alias("stability"))
    return c.groupBy("membership", "order_evidence", "robust_order", "stability").agg(F.count("*").alias("n"))


def era_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("c_custkey") % 83 != 82, 1946 + F.col("c_custkey") % 80)
    return read(spark, sf_dir, "customer").groupBy(L.era_group(y).alias("era")).agg(F.count("*").alias("n"), F.min(y).alias("first"), F.max(y).alias("last"))


#: The binding of first seasons: the test tables begin in 1995.
STARTS = {"minutes_total": 1996, "points_per_36": 1996, "rebounds_per_36": 1996, "assists_per_36": 1996, "points_per_75": 1997, "rpg": None, "spg": 1998, "bpg": 1998, "fg3_pct": 1999, "efg_pct": 1999}
_N = lambda c: F.count_if(c).cast("bigint")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy("entity", "period").agg(
        F.countDistinct("game").alias("games_played"), F.sum("qty").alias("points_total"), (F.sum("cents") / 100000.0).alias("minutes_total"), F.count("*").alias("possessions"), _N(F.col("kind") == "R").alias("rebounds_total"), _N(F.col("kind") == "A").alias("assists_total"),
        _N(F.col("kind") == "N").alias("steals_total"), _N(F.col("qty") > 40).alias("blocks_total"), _N(F.col("qty") > 25).alias("fgm_total"), F.count("*").alias("fga_total"), _N(F.col("disc") >= 5).alias("ftm_total"), _N(F.col("disc") >= 2).alias("fta_total"),
        _N(F.col("tax") >= 7).alias("fg3m_total"), _N(F.col("tax") >= 6).alias("fg3a_total"),
    )


_TOTALS = FACTS_SQL + """, totals AS (SELECT entity, period, count(DISTINCT game) AS games_played, CAST(sum(qty) AS DOUBLE) AS points_total, CAST(sum(cents) AS DOUBLE) / 100000.0::DOUBLE AS minutes_total, count(*) AS possessions,
  count(*) FILTER (WHERE kind = 'R') AS rebounds_total, count(*) FILTER (WHERE kind = 'A') AS assists_total, count(*) FILTER (WHERE kind = 'N') AS steals_total, count(*) FILTER (WHERE qty > 40) AS blocks_total, count(*) FILTER (WHERE qty > 25) AS fgm_total,
  count(*) AS fga_total, count(*) FILTER (WHERE disc >= 5) AS ftm_total, count(*) FILTER (WHERE disc >= 2) AS fta_total, count(*) FILTER (WHERE tax >= 7) AS fg3m_total, count(*) FILTER (WHERE tax >= 6) AS fg3a_total FROM facts GROUP BY 1, 2)"""


def feature_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen features of every entity and period, with their availability."""
    out = C.feature_values(_totals(spark, sf_dir), ["entity", "period"], "period", STARTS)
    return out.select("entity", "period", "feature", "basis", F.round("value", 6).alias("value"), "availability")


def _feature_sql() -> str:
    rows = []
    for name, basis, num, den, start in C.FEATURES:
        start = STARTS.get(name, start)
        num = num.replace("0.5", "0.5::DOUBLE")
        x = f"CAST({num} AS DOUBLE)" if den is None else f"CASE WHEN {den.replace('0.44', '0.44::DOUBLE')} > 0 THEN CAST({num} AS DOUBLE) * {float({'PER_36': 36, 'PER_75': 75}.get(basis, 1))}::DOUBLE / ({den.replace('0.44', '0.44::DOUBLE')}) END"
        early = "FALSE" if start is None else f"period < {start}"
        rows.append(f"SELECT entity, period, '{name}' AS feature, '{basis}' AS basis, CASE WHEN NOT ({early}) THEN round({x}, 6) END AS value, CASE WHEN {early} THEN 'NOT_INTRODUCED' WHEN ({x}) IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS availability FROM totals")
    return " UNION ALL ".join(rows)


def candidate_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitives that candidates of one dimension share."""
    return C.shared_lineage(C.catalog(spark))


METRICS = ("ppg", "rpg", "apg", "ts_pct")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z and percentile of the metrics of every entity and period; odd games are the regular ones, even games the post-season."""
    f = facts(spark, sf_dir).withColumn("part", F.when(F.col("game") % 2 == 1, "reg").otherwise("po"))
    g = f.groupBy("entity", "period", "part").agg(F.countDistinct("game").alias("games"), F.sum("qty").alias("points"), _N(F.col("kind") == "R").alias("r"), _N(F.col("kind") == "A").alias("a"), F.count("*").alias("n"), _N(F.col("disc") >= 2).alias("ft"))
    w = W.partitionBy("period", "part")
    g = g.withColumn("ratio", F.round(F.col("games") / F.max("games").over(w), 9))
    g = g.select("entity", "period", "part", "ratio", (F.col("points") / F.col("games")).alias("ppg"), (F.col("r") / F.col("games")).alias("rpg"), (F.col("a") / F.col("games")).alias("apg"), E.true_shooting("points", "n", "ft").alias("ts_pct"))
    long = g.unpivot(["entity", "period", "part", "ratio"], list(METRICS), "metric", "value").withColumn("value", F.round("value", 9))
    by = ["period", "part", "metric"]
    stats = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    m = P.with_midranks(long, by, "value", F.lit(True)).join(stats, by)
    return m.select("entity", "period", "part", "metric", "ratio", F.round(E.z_score("value", "mean", "sd"), 6).alias("z"), F.round(P.midrank_share(), 6).alias("pct"))


_LONG = FACTS_SQL + """, g AS (SELECT entity, period, CASE WHEN game % 2 = 1 THEN 'reg' ELSE 'po' END AS part, count(DISTINCT game) AS games, sum(qty)::DOUBLE AS points, count(*) FILTER (WHERE kind = 'R')::DOUBLE AS r, count(*) FILTER (WHERE kind = 'A')::DOUBLE AS a, count(*)::DOUBLE AS n, count(*) FILTER (WHERE disc >= 2)::DOUBLE AS ft FROM facts GROUP BY 1, 2, 3),
  gr AS (SELECT *, round(games::DOUBLE / max(games) OVER (PARTITION BY period, part), 9) AS ratio FROM g),
  lg AS (SELECT entity, period, part, ratio, 'ppg' AS metric, round(points / games, 9) AS value FROM gr UNION ALL SELECT entity, period, part, ratio, 'rpg', round(r / games, 9) FROM gr UNION ALL SELECT entity, period, part, ratio, 'apg', round(a / games, 9) FROM gr
         UNION ALL SELECT entity, period, part, ratio, 'ts_pct', round(points / (2 * (n + 0.44::DOUBLE * ft)), 9) FROM gr),
  st AS (SELECT period, part, metric, avg(value) AS mean, stddev_pop(value) AS sd, count(*)::DOUBLE AS n FROM lg GROUP BY 1, 2, 3),
  lz AS (SELECT entity, l.period, l.part, l.metric, ratio, CASE WHEN sd > 0 THEN round((value - mean) / sd, 6) END AS z,
         round((rank() OVER (PARTITION BY l.period, l.part, l.metric ORDER BY value) - 1 + 0.5::DOUBLE * count(*) OVER (PARTITION BY l.period, l.part, l.metric, value)) / n, 6) AS pct FROM lg l JOIN st ON l.period = st.period AND l.part = st.part AND l.metric = st.metric),
  k AS (SELECT entity, period, part, metric, ratio, z, pct, 0.5::DOUBLE + (pct - 0.5::DOUBLE) * least(greatest(ratio, 0.0), 1.0) AS adj FROM lz WHERE z IS NOT NULL),
  wn AS (SELECT entity, part, metric, period, avg(pct) OVER w3 AS m3, lead(period, 2) OVER o AS e3, avg(pct) OVER w5 AS m5, lead(period, 4) OVER o AS e5, avg(adj) OVER w3 AS a3 FROM k
         WINDOW o AS (PARTITION BY entity, part, metric ORDER BY period), w3 AS (PARTITION BY entity, part, metric ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), w5 AS (PARTITION BY entity, part, metric ORDER BY period ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
  wb AS (SELECT entity, part, metric, max(round(m3, 6)) FILTER (WHERE e3 = period + 2) AS peak3_quality, max(round(m5, 6)) FILTER (WHERE e5 = period + 4) AS peak5_quality, max(round(a3, 6)) FILTER (WHERE e3 = period + 2) AS peak3_adjusted FROM wn GROUP BY 1, 2, 3),
  ag AS (SELECT entity, part, metric, max(pct) AS peak1_quality, max(z) AS max_z, avg(z) AS mean_z, sum(greatest(z, 0.0)) AS cum_positive_z, sum(greatest(z, 0.0) * ratio) AS weighted_positive_z, sum(greatest(pct - 0.8, 0.0)) AS area_p80, sum(greatest(pct - 0.9, 0.0)) AS area_p90,
         count(*) FILTER (WHERE pct >= 0.80)::DOUBLE AS elite_p80, count(*) FILTER (WHERE pct >= 0.90)::DOUBLE AS elite_p90, count(*) FILTER (WHERE pct >= 0.95)::DOUBLE AS elite_p95,
         CASE WHEN count(*) >= 3 THEN list_sum(list_slice(list_reverse_sort(list(z)), 1, 3)) / 3 END AS top3_z FROM k GROUP BY 1, 2, 3),
  ri AS (SELECT entity, part, metric, th, period - row_number() OVER (PARTITION BY entity, part, metric, th ORDER BY period) AS i FROM k, (VALUES ('p80', 0.80::DOUBLE), ('p90', 0.90), ('p95', 0.95)) t(th, low) WHERE pct >= low),
  rn AS (SELECT entity, part, metric, th, max(n)::DOUBLE AS n FROM (SELECT entity, part, metric, th, i, count(*) AS n FROM ri GROUP BY ALL) GROUP BY 1, 2, 3, 4),
  al AS (SELECT ag.*, wb.peak3_quality, wb.peak5_quality, wb.peak3_adjusted, coalesce(r8.n, 0.0) AS run_p80, coalesce(r9.n, 0.0) AS run_p90, coalesce(r5.n, 0.0) AS run_p95 FROM ag LEFT JOIN wb USING (entity, part, metric)
         LEFT JOIN rn r8 ON ag.entity = r8.entity AND ag.part = r8.part AND ag.metric = r8.metric AND r8.th = 'p80' LEFT JOIN rn r9 ON ag.entity = r9.entity AND ag.part = r9.part AND ag.metric = r9.metric AND r9.th = 'p90' LEFT JOIN rn r5 ON ag.entity = r5.entity AND ag.part = r5.part AND ag.metric = r5.metric AND r5.th = 'p95'),
  up AS (UNPIVOT al ON COLUMNS(* EXCLUDE (entity, part, metric)) INTO NAME kind VALUE value),
  pr0 AS (SELECT entity, part || '_' || metric || '_' || kind AS primitive, value FROM up WHERE value IS NOT NULL),
  pr AS (SELECT * FROM pr0 UNION ALL SELECT a.entity, a.metric || '_playoff_lift', b.mean_z - a.mean_z FROM al a JOIN al b ON a.entity = b.entity AND a.metric = b.metric AND a.part = 'reg' AND b.part = 'po')"""


def _primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    reg, po = (C.career_primitives(long.where(F.col("part") == p), "entity", "period", p) for p in ("reg", "po"))
    return reg.unionByName(po).unionByName(C.lift(reg, po, "entity"))


def career_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primitive matrix in long form: entity, primitive, value."""
    return _primitives(spark, sf_dir).select("entity", "primitive", F.round("value", 9).alias("value"))


def candidate_catalog_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of the catalogue for which an entity has a part, under the coverage threshold."""
    v = C.candidate_values(_primitives(spark, sf_dir), C.catalog(spark), "entity", L.POLICIES[2])
    return v.select("entity", "dimension", "candidate", F.round("value", 9).alias("value"), F.round("coverage", 6).alias("coverage"), F.round("core_coverage", 6).alias("core_coverage"), "confidence", F.col("used").cast("bigint").alias("used"))


_CATALOG = "ct AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{k}', '{p}', {str(c).upper()})" for d, k, p, c in C.catalog_rows()) + ") t(dimension, candidate, primitive, core))"


def _policy_sql() -> str:
    known = {k: f"CASE WHEN {k} IS NOT NULL THEN 1 ELSE 0 END" for k in PARTS}
    w = {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.1, "e": 0.1}
    core = [k for k, x in PARTS.items() if x]
    n, nc = len(PARTS), len(core)
    av, cav = "(" + " + ".join(known.values()) + ")", "(" + " + ".join(known[k] for k in core) + ")"
    conf = f"CASE WHEN {av} = 0 THEN 'UNAVAILABLE' WHEN {av} = {n} THEN 'STRONG' WHEN {av} / {n}::DOUBLE >= 0.75 THEN 'MODERATE' ELSE 'LIMITED' END"
    out = []
    for p, valid in zip(L.POLICIES, (f"{cav} = {nc}", f"{av} > 0", f"{av} / {n}::DOUBLE >= 2 / 3.0::DOUBLE", f"{cav} / {nc}::DOUBLE >= 2 / 3.0::DOUBLE"), strict=True):
        ks = core if p in (L.POLICIES[0], L.POLICIES[3]) else list(PARTS)
        num, den = " + ".join(f"coalesce({k} * {w[k]}::DOUBLE, 0.0)" for k in ks), " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {w[k]}::DOUBLE ELSE 0.0 END" for k in ks)
        used = " + ".join(known[k] for k in ks)
        out.append(f"SELECT c_custkey, '{p}' AS policy, CASE WHEN {valid} AND ({den}) > 0 THEN round(({num}) / ({den}), 6) END AS value, round({av} / {n}::DOUBLE, 6) AS coverage, round({cav} / {nc}::DOUBLE, 6) AS core_coverage, round(({av} - {cav}) / {n - nc}::DOUBLE, 6) AS optional_coverage, {conf} AS confidence, CAST(CASE WHEN {valid} THEN {used} ELSE 0 END AS BIGINT) AS used FROM p")
    parts = "WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 97 / 97.0::DOUBLE END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 89 / 89.0::DOUBLE END AS b, CASE WHEN c_custkey % 7 < 5 THEN c_custkey % 83 / 83.0::DOUBLE END AS c, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 79 / 79.0::DOUBLE END AS d, CASE WHEN c_custkey % 11 < 4 THEN c_custkey % 73 / 73.0::DOUBLE END AS e FROM customer) "
    return parts + " UNION ALL ".join(out)


SQL = {
    "evidence_policies": _policy_sql(),
    "rank_labels": """WITH c AS (SELECT (c_custkey % 101) / 100.0::DOUBLE AS p, c_custkey % 120 AS w FROM customer)
      SELECT CASE WHEN p >= 0.9 THEN 'ROBUST_TOP100' WHEN p >= 0.65 THEN 'LIKELY_TOP100' WHEN p >= 0.35 THEN 'TOP100_BUBBLE' WHEN p >= 0.1 THEN 'LIKELY_OUTSIDE_TOP100' ELSE 'ROBUST_OUTSIDE_TOP100' END AS membership,
      CASE WHEN p >= 0.9 THEN 'STRONG_A_OVER_B' WHEN p >= 0.65 THEN 'LEAN_A_OVER_B' WHEN p >= 0.35 THEN 'INDETERMINATE' WHEN 1.0::DOUBLE - p >= 0.9::DOUBLE THEN 'STRONG_B_OVER_A' ELSE 'LEAN_B_OVER_A' END AS order_evidence,
      CASE WHEN p >= 0.9 THEN 'ROBUST_ORDER' WHEN p >= 0.65 THEN 'LEAN_ORDER' WHEN p <= 0.1 THEN 'ROBUST_REVERSE' WHEN p <= 0.35 THEN 'LEAN_REVERSE' ELSE 'UNCERTAIN_ORDER' END AS robust_order,
      CASE WHEN p >= 0.9 AND w <= 25 THEN 'HIGH' WHEN p >= 0.5 OR w <= 75 THEN 'MODERATE' ELSE 'LOW' END AS stability, count(*) AS n FROM c GROUP BY ALL""",
    "era_groups": "WITH c AS (SELECT CASE WHEN c_custkey % 83 <> 82 THEN 1946 + c_custkey % 80 END AS y FROM customer) SELECT CASE WHEN y IS NULL THEN 'UNKNOWN' WHEN y < 1960 THEN 'PRE_1960' ELSE (y // 10 * 10) || 'S' END AS era, count(*) AS n, min(y) AS first, max(y) AS last FROM c GROUP BY 1",
    "feature_definitions": "WITH " + _TOTALS + " " + _feature_sql(),
    "candidate_lineage": "WITH " + _CATALOG + " SELECT a.dimension, a.candidate AS left, b.candidate AS right, string_agg(DISTINCT a.primitive, ',' ORDER BY a.primitive) AS shared FROM ct a JOIN ct b ON a.dimension = b.dimension AND a.primitive = b.primitive AND a.candidate < b.candidate GROUP BY 1, 2, 3",
    "career_primitives": "WITH " + _LONG + " SELECT entity, primitive, round(value, 9) AS value FROM pr",
    "candidate_catalog_values": "WITH " + _LONG + ", " + _CATALOG + """, sz AS (SELECT dimension, candidate, count(*) AS n, count(*) FILTER (WHERE core) AS nc FROM ct GROUP BY 1, 2),
      hv AS (SELECT entity, ct.dimension, ct.candidate, count(*) AS a, count(*) FILTER (WHERE core) AS ca, avg(value) AS v FROM pr JOIN ct ON pr.primitive = ct.primitive GROUP BY 1, 2, 3)
      SELECT entity, hv.dimension, hv.candidate, CASE WHEN a::DOUBLE / n >= 2 / 3.0::DOUBLE THEN round(v, 9) END AS value, round(a::DOUBLE / n, 6) AS coverage, round(ca::DOUBLE / nc, 6) AS core_coverage, CASE WHEN a = n THEN 'STRONG' WHEN a::DOUBLE / n >= 0.75 THEN 'MODERATE' ELSE 'LIMITED' END AS confidence, CASE WHEN a::DOUBLE / n >= 2 / 3.0::DOUBLE THEN a ELSE 0 END AS used
      FROM hv JOIN sz ON hv.dimension = sz.dimension AND hv.candidate = sz.candidate""",
}
QUERIES = {f.__name__: f for f in (evidence_policies, rank_labels, era_groups, feature_definitions, candidate_lineage, career_primitives, candidate_catalog_values)}
