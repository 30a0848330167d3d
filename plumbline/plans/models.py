"""Correlation, association, clustering and decomposition over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import models as M
from plumbline.plans.base import SEASON_SQL, qualified_season, read
from plumbline.plans.scores import _COMP, WEIGHTS, components


def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pairwise_correlation(components(spark, sf_dir), list(WEIGHTS)).select("a", "b", "n", F.round("r", 6).alias("r"))


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of points, games, cents and net of all entity-periods."""
    q = qualified_season(spark, sf_dir).select("entity", "points", "games", "cents", "net")
    return M.pairwise_correlation(M.midranked(q, ["points", "games", "cents", "net"]), ["points", "games", "cents", "net"]).select("a", "b", "n", F.round("r", 6).alias("r"))


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tau of two dimension scores over the entities."""
    return M.kendall_tau(components(spark, sf_dir).select("entity", "peak", "offense"), "entity", "peak", "offense").select("pairs", "concordant", "discordant", F.round("tau", 9).alias("tau"))


def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("nation"))
    return M.eta_squared(qualified_season(spark, sf_dir).join(s, "entity"), "nation", "ppg").select("n", F.round("eta_squared", 6).alias("eta_squared"))


def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return M.cramers_v(o, "o_orderpriority", "o_orderstatus").select("n", F.round("v", 6).alias("v"))


def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the embeddings' labels with the index of their largest coordinate."""
    e = read(spark, sf_dir, "embeddings")
    big = F.array_position("embedding", F.array_max("embedding"))
    return M.adjusted_rand(e.select("label", (big % 10).alias("big")), "label", "big").select("n", F.round("ari", 9).alias("ari"))


def _dim(spark, sf_dir) -> int:
    return read(spark, sf_dir, "embeddings").select(F.size("embedding").alias("d")).first().d


def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues and loadings of the first five components of the embeddings."""
    values, load = M.pca(read(spark, sf_dir, "embeddings"), "embedding", _dim(spark, sf_dir))
    return spark.createDataFrame([(c + 1, round(float(values[c]), 9), i, round(float(load[i, c]), 6)) for c in range(5) for i in range(load.shape[0])], "component int, eigenvalue double, coordinate int, loading double")


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of k-means from the vectors with the ten smallest ids."""
    e = read(spark, sf_dir, "embeddings")
    start = [r.embedding for r in e.orderBy("vec_id").limit(10).collect()]
    return M.kmeans(e, "vec_id", "embedding", start, 10)[0]


def kmeans_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of k-means clusters with the labels, and cluster sizes' extremes."""
    k = kmeans_clusters(spark, sf_dir).join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    sizes = k.groupBy("cluster").agg(F.count("*").alias("s")).agg(F.min("s").alias("least"), F.max("s").alias("most"))
    return M.adjusted_rand(k, "label", "cluster").crossJoin(sizes)  # single rows


def complete_case_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities a complete-case matrix keeps, and why the others go."""
    c = components(spark, sf_dir)
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in WEIGHTS]))
    return c.groupBy(F.size(missing).cast("bigint").alias("missing"), F.array_join(missing, ",").alias("which")).agg(F.count("*").alias("entities"))


_RK = ", ".join(f"rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("points", "games", "cents", "net"))
SQL = {
    "pearson_matrix": "WITH " + _COMP + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM c" for i, a in enumerate(WEIGHTS) for b in list(WEIGHTS)[i + 1 :]),
    "spearman_matrix": "WITH " + SEASON_SQL + f", rk AS (SELECT {_RK} FROM q) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM rk" for i, a in enumerate(("points", "games", "cents", "net")) for b in ("points", "games", "cents", "net")[i + 1 :]),
    "kendall_tau": "WITH " + _COMP + ", j AS (SELECT sign(x.peak - y.peak) * sign(x.offense - y.offense) AS s FROM c x JOIN c y ON x.entity < y.entity) SELECT count(*) AS pairs, count(*) FILTER (WHERE s > 0) AS concordant, count(*) FILTER (WHERE s < 0) AS discordant, round((count(*) FILTER (WHERE s > 0) - count(*) FILTER (WHERE s < 0))::DOUBLE / count(*), 9) AS tau FROM j",
    "eta_squared": "WITH " + SEASON_SQL + ", v AS (SELECT s_nationkey AS g, ppg, avg(ppg) OVER () AS m, avg(ppg) OVER (PARTITION BY s_nationkey) AS gm FROM q JOIN supplier ON entity = s_suppkey) SELECT count(*) AS n, round(sum((gm - m) * (gm - m)) / sum((ppg - m) * (ppg - m)), 6) AS eta_squared FROM v",
    "cramers_v": "WITH t AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER () AS n, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM t) SELECT CAST(max(n) AS BIGINT) AS n, round(sqrt((sum(o * o / e) - max(n)) / max(n) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS v FROM e",
    "ari": "WITH x AS (SELECT label AS a, list_position(embedding, list_max(embedding)) % 10 AS b FROM embeddings), t AS (SELECT a, b, count(*) AS o FROM x GROUP BY 1, 2), s AS (SELECT (SELECT sum(o * (o - 1) / 2.0::DOUBLE) FROM t) AS cells, (SELECT sum(o)::DOUBLE FROM t) AS n, (SELECT sum(r * (r - 1) / 2.0::DOUBLE) FROM (SELECT sum(o)::DOUBLE AS r FROM t GROUP BY a)) AS ra, (SELECT sum(r * (r - 1) / 2.0::DOUBLE) FROM (SELECT sum(o)::DOUBLE AS r FROM t GROUP BY b)) AS cb) SELECT CAST(n AS BIGINT) AS n, round((cells - ra * cb / (n * (n - 1) / 2)) / ((ra + cb) / 2 - ra * cb / (n * (n - 1) / 2)), 9) AS ari FROM s",
    "complete_case_audit": "WITH " + _COMP + ", m AS (SELECT list_filter([" + ", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in WEIGHTS) + "], lambda x: x IS NOT NULL) AS l FROM c) SELECT CAST(len(l) AS BIGINT) AS missing, coalesce(array_to_string(l, ','), '') AS which, count(*) AS entities FROM m GROUP BY 1, 2",
}
QUERIES = {f.__name__: f for f in (pearson_matrix, spearman_matrix, kendall_tau, eta_squared, cramers_v, ari, pca_loadings, kmeans_clusters, kmeans_quality, complete_case_audit)}
