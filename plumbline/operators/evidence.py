"""Measures between whole score tables: partial correlations, explained variance, latent factors, block-wise ridge, and draws.

What leaves the executors is moments: sums of products of a fixed list of columns, in all or by block or fold. The small
systems they give are solved on the driver; rows never go there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import sequences as S

#: The share of the three-period window in a peak, the component weights of longevity, and its percentiles.
PEAK_WINDOW_WEIGHT = 0.70
LONGEVITY_WEIGHTS = (0.35, 0.40, 0.25)
P80, P90 = 80.0, 90.0
#: Blocks of a block-wise fit: their moments are held on the driver.
MOST_BLOCKS = 10_000


def moments(df: DataFrame, columns: list[str], by: str | None = None) -> dict:
    """n, the sums (d) and the products' sums (d, d) of complete rows, of each value of by (None: of all)."""
    import numpy as np

    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    d = len(columns)
    aggs = [F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]]
    aggs += [F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    grouped = rows.groupBy(F.col(by).alias("__by")).agg(*aggs).limit(MOST_BLOCKS + 1).collect() if by else rows.agg(*aggs).withColumn("__by", F.lit(None)).collect()
    if len(grouped) > MOST_BLOCKS:
        raise ValueError(f"over {MOST_BLOCKS} blocks")
    out = {}
    for r in grouped:
        s = np.array([r[f"s{i}"] or 0.0 for i in range(d)])
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
        out[r["__by"]] = (r.n, s, p)
    return out


def _cov(m):
    import numpy as np

    n, s, p = m
    return p / n - np.outer(s / n, s / n)


def _corr(m):
    import numpy as np

    c = _cov(m)
    sd = np.sqrt(np.clip(np.diag(c), 0, None))
    return np.divide(c, np.outer(sd, sd), out=np.full_like(c, np.nan), where=np.outer(sd, sd) > 0)


def partial_correlation(df: DataFrame, a: str, b: str, given: list[str]) -> float | None:
    """The correlation of a and b with the given columns held, from the inverse of the correlation matrix."""
    import numpy as np

    m = moments(df, [a, b, *given])[None]
    if m[0] < len(given) + 3:
        return None
    r = _corr(m)
    if not np.isfinite(r).all():
        return None
    q = np.linalg.pinv(r)
    scale = q[0, 0] * q[1, 1]
    return float(-q[0, 1] / np.sqrt(scale)) if scale > 0 else None


def multiple_r_squared(df: DataFrame, target: str, predictors: list[str]) -> float | None:
    """The share of the target's variance that a linear fit on the predictors explains; NULL under three rows or without variance."""
    import numpy as np

    m = moments(df, [target, *predictors])[None]
    if m[0] < 3:
        return None
    c = _cov(m)
    if c[0, 0] * m[0] <= 1e-12:
        return None
    beta = np.linalg.lstsq(c[1:, 1:], c[1:, 0], rcond=None)[0] if predictors else np.zeros(0)
    return float(beta @ c[1:, 0] / c[0, 0])


def uniqueness(df: DataFrame, families: dict[str, str]) -> list[dict]:
    """For each column: its greatest absolute correlation with, and its variance explained by, columns of other families."""
    import numpy as np

    names = list(families)
    m = moments(df, names)[None]
    r, c = _corr(m), _cov(m)
    out = []
    for i, name in enumerate(names):
        other = [j for j, o in enumerate(names) if families[o] != families[name]]
        r2 = None
        if other and m[0] >= 3 and c[i, i] * m[0] > 1e-12:
            beta = np.linalg.lstsq(c[np.ix_(other, other)], c[other, i], rcond=None)[0]
            r2 = float(beta @ c[other, i] / c[i, i])
        out.append({"candidate": name, "family": families[name], "n": m[0], "max_cross_correlation": float(np.nanmax(np.abs(r[i, other]))) if other else None, "r_squared": r2, "residual_share": None if r2 is None else 1 - r2})
    return out


def fit_latent(df: DataFrame, channels: list[str]) -> dict:
    """One factor: the first eigenvector of the standardized channels' covariance, its sum made positive."""
    import numpy as np

    m = moments(df, channels)[None]
    if m[0] < 2 or len(channels) < 2:
        raise ValueError("a factor needs two rows and two channels")
    c = _cov(m)
    sd = np.sqrt(np.clip(np.diag(c), 0, None))
    sd = np.where(sd > 1e-12, sd, 1.0)
    values, vectors = np.linalg.eigh(c / np.outer(sd, sd))
    v = vectors[:, -1]
    v = -v if v.sum() < 0 else v
    return {"channels": channels, "mean": (m[1] / m[0]).tolist(), "sd": sd.tolist(), "loading": v.tolist(), "explained": float(values[-1] / values.sum())}


def latent_score(model: dict):
    """A column: the factor score from the channels that are known; NULL without any."""
    num, den = F.lit(0.0), F.lit(0.0)
    for c, mean, sd, load in zip(model["channels"], model["mean"], model["sd"], model["loading"], strict=True):
        num = num + F.coalesce((F.col(c) - F.lit(mean)) / F.lit(sd) * F.lit(load), F.lit(0.0))
        den = den + F.when(F.col(c).isNotNull(), load * load).otherwise(0.0)
    return F.when(den > 1e-12, num / den)


def block_ridge(df: DataFrame, features: list[str], target: str, block: str, alpha: float = 1.0) -> DataFrame:
    """df with `predicted`: by a ridge of standardized features fitted on all rows of other blocks. NULL where too few are left.

    A block's training moments are those of all rows minus its own, so the rows are read once for all fits.
    """
    import numpy as np

    by = moments(df, [*features, target], block)
    d, rows = len(features), []
    total = [sum(m[i] for m in by.values()) for i in range(3)] if by else [0, 0, 0]
    for key, m in by.items():
        n, s, p = (total[i] - m[i] for i in range(3))
        if n < d + 2:
            continue
        c = _cov((n, s, p))
        sd = np.sqrt(np.clip(np.diag(c)[:d], 0, None))
        sd = np.where(sd > 1e-12, sd, 1.0)
        gram = n * c[:d, :d] / np.outer(sd, sd)
        beta = np.linalg.solve(gram + alpha * np.eye(d), n * c[:d, d] / sd) / sd
        rows.append((key, [float(x) for x in beta], float(s[d] / n - beta @ (s[:d] / n))))
    kind = df.schema[block].dataType.simpleString()
    fits = df.sparkSession.createDataFrame(rows, f"__block {kind}, __beta array<double>, __origin double")
    value = F.col("__origin")
    for i, f in enumerate(features):
        value = value + F.get("__beta", F.lit(i)) * F.col(f)
    return df.join(F.broadcast(fits), F.col(block) == F.col("__block"), "left").withColumn("predicted", value).drop("__block", "__beta", "__origin")  # at most MOST_BLOCKS rows


def ranking_metrics(df: DataFrame, key: str, reference: str, candidate: str, tops: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """One row: how a complete ranking differs from a reference: correlation of ranks, bias, absolute errors, shared tops."""
    diff = F.col(candidate) - F.col(reference)
    n = F.count(F.lit(1)).cast("double")
    rho = 1 - 6 * F.sum((diff * diff).cast("double")) / (n * (n * n - 1))
    return df.agg(
        F.count("*").alias("n"), F.when(F.count("*") > 1, rho).alias("spearman"), F.avg(diff).alias("rank_bias"), F.avg(F.abs(diff)).alias("rank_mae"), F.median(F.abs(diff)).alias("median_absolute_rank_error"),
        *[(F.count_if((F.col(reference) <= t) & (F.col(candidate) <= t)) / t).alias(f"top_{t}_overlap") for t in tops],
    )


def peak_by_draw(draws: DataFrame, entity: str, draw: str, period: str, value: str) -> DataFrame:
    """Within every draw the best complete three-period window and the best period are chosen anew: peak, window_start, apex_period. An entity without a window has a NULL peak."""
    key = F.struct(entity, draw)
    keyed = draws.select(key.alias("__key"), F.col(period).alias("__p"), F.col(value).alias("__v"))
    window = S.best_window(keyed, "__key", "__p", "__v", 3, 12).select("__key", F.col("start").alias("window_start"), F.col("mean").alias("__mean"))
    apex = keyed.groupBy("__key").agg(F.max("__v").alias("__apex"), F.max_by("__p", F.struct(F.col("__v"), -F.col("__p"))).alias("apex_period"))
    j = apex.join(window, "__key", "left")
    peak = F.lit(PEAK_WINDOW_WEIGHT) * F.col("__mean") + F.lit(1 - PEAK_WINDOW_WEIGHT) * F.col("__apex")
    return j.select(F.col(f"__key.{entity}").alias(entity), F.col(f"__key.{draw}").alias(draw), peak.alias("peak"), "window_start", "apex_period")


def longevity_by_draw(draws: DataFrame, entity: str, draw: str, period: str, value: str) -> DataFrame:
    """Periods at the 80th percentile or above, capped area from the 80th to the 90th, and the longest run, in every draw."""
    keyed = draws.select(F.struct(entity, draw).alias("__key"), F.col(period).alias("__p"), F.col(value).alias("__v"))
    area = F.least(F.greatest((F.col("__v") - P80) / F.lit(P90 - P80), F.lit(0.0)), F.lit(1.0))
    g = keyed.groupBy("__key").agg(F.count_if(F.col("__v") >= P80).cast("double").alias("breadth"), F.sum(area).alias("area"))
    run = S.longest_run(keyed, "__key", "__p", F.col("__v") >= P80).select("__key", F.col("length").cast("double").alias("run"))
    j = g.join(run, "__key", "left")
    return j.select(F.col(f"__key.{entity}").alias(entity), F.col(f"__key.{draw}").alias(draw), "breadth", "area", F.coalesce("run", F.lit(0.0)).alias("run"))


def quantile_band(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = (0.5, 0.8, 0.95)) -> DataFrame:
    """Central empirical intervals of each group, without an assumption of shape."""
    cols = []
    for level in levels:
        cols += [F.percentile(value, (1 - level) / 2).alias(f"low_{int(level * 100)}"), F.percentile(value, (1 + level) / 2).alias(f"high_{int(level * 100)}")]
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *cols)


def concordance(df: DataFrame, key: str, a: str, b: str, blocks: int | None = None) -> DataFrame:
    """Pairs of rows, concordant and discordant in a and b (ties are neither), and Kendall's tau-a, without a join of all with all.

    Both scores are cut into blocks of about the square root of the rows, equal values in one block. Pairs in different blocks of both
    are counted from the grid of blocks, by sums over cells; pairs that share a block of either are joined within it.
    """
    import numpy as np

    from plumbline.sources.lineage import cut

    rows = cut(df.select(F.col(key).alias("k"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    n = rows.count()
    m = blocks or max(1, min(256, int(n**0.5) // 4))
    at = [i / m for i in range(1, m)]
    edges = rows.agg(F.percentile_approx("a", at, 10_000).alias("a"), F.percentile_approx("b", at, 10_000).alias("b")).first() if n and at else None

    def block(name):
        cuts = sorted(set(edges[name])) if edges else []
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]) if cuts else F.array().cast("array<double>"), lambda x: x < F.col(name)))

    rows = cut(rows.select("k", "a", "b", block("a").alias("x"), block("b").alias("y")))
    grid = np.zeros((m, m), dtype=object)  # whole numbers of any size
    for r in rows.groupBy("x", "y").agg(F.count("*").alias("n")).collect():  # at most blocks x blocks cells
        grid[r.x, r.y] = r.n
    later = np.zeros((m + 1, m + 1), dtype=object)  # later[x, y]: rows in blocks from x and from y on
    for i in range(m - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            later[i, j] = grid[i, j] + later[i + 1, j] + later[i, j + 1] - later[i + 1, j + 1]
    up = sum(int(grid[i, j] * later[i + 1, j + 1]) for i in range(m) for j in range(m))
    down = sum(int(grid[i, j] * (later[i + 1, 0] - later[i + 1, j])) for i in range(m) for j in range(m))
    p, q = rows.alias("p"), rows.alias("q")
    sign = F.signum(F.col("p.a") - F.col("q.a")) * F.signum(F.col("p.b") - F.col("q.b"))
    same_x = p.join(q, (F.col("p.x") == F.col("q.x")) & (F.col("p.k") < F.col("q.k"))).select(sign.alias("s"))
    same_y = p.join(q, (F.col("p.y") == F.col("q.y")) & (F.col("p.x") < F.col("q.x"))).select(sign.alias("s"))
    near = same_x.unionByName(same_y).agg(F.count_if(F.col("s") > 0).alias("c"), F.count_if(F.col("s") < 0).alias("d"))
    pairs = n * (n - 1) // 2
    return near.select(F.lit(pairs).cast("long").alias("pairs"), (F.col("c") + up).alias("concordant"), (F.col("d") + down).alias("discordant")).withColumn("tau", F.when(F.col("pairs") > 0, (F.col("concordant") - F.col("discordant")) / F.col("pairs")))
