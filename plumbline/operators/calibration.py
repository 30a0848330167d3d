"""Error metrics, reliability, conformal radii and linking functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def error_metrics(truth: str, estimate: str) -> list[Column]:
    e = F.col(estimate) - F.col(truth)
    return [
        F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(truth, estimate).alias("pearson"),
        F.regr_slope(estimate, truth).alias("slope"), F.regr_intercept(estimate, truth).alias("intercept"), F.percentile(F.abs(e), 0.9).alias("p90"),
    ]


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of a probability (the last one closed): count, mean probability, observed share, gap."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed")).withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))


def expected_calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    return reliability(df, p, y, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def conformal_radius(df: DataFrame, by: list[str], error: str, level: float) -> DataFrame:
    """The ceil((n+1) level)-th smallest absolute error of each group: a finite-sample quantile, not an interpolated one."""
    w = W.partitionBy(*by)
    rows = df.where(F.col(error).isNotNull()).withColumn("__e", F.abs(F.col(error))).withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy("__e")))
    return rows.where(F.col("__k") == F.least(F.col("__n"), F.ceil((F.col("__n") + 1) * F.lit(level)))).select(*by, F.col("__n").alias("n"), F.col("__e").alias("radius"))


def youden(df: DataFrame, value: str, positive: str, thresholds: list[float]) -> DataFrame:
    """Sensitivity + specificity - 1 at each threshold, in one pass."""
    pos, neg = F.count_if(F.col(positive)), F.count_if(~F.col(positive))
    rows = [F.struct(F.lit(t).alias("threshold"), (F.count_if(F.col(positive) & (F.col(value) >= t)) / pos).alias("sensitivity"), (F.count_if(~F.col(positive) & (F.col(value) < t)) / neg).alias("specificity")) for t in thresholds]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*").withColumn("j", F.col("sensitivity") + F.col("specificity") - 1)


def linear_link(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def quantile_knots(df: DataFrame, x: str, y: str, knots: int = 101) -> DataFrame:
    """Matching quantiles of two marginals: knot, x, y, with y made monotone by a running maximum."""
    ps = F.array(*[F.lit(i / (knots - 1)) for i in range(knots)])
    q = df.agg(F.percentile(x, ps).alias("qx"), F.percentile(y, ps).alias("qy")).select(F.posexplode(F.arrays_zip("qx", "qy")).alias("knot", "z"))
    return q.select("knot", F.col("z.qx").alias("x"), F.max("z.qy").over(W.orderBy("knot").rowsBetween(W.unboundedPreceding, 0)).alias("y"))  # `knots` rows


def interpolate(df: DataFrame, value: str, knots: DataFrame, name: str = "linked") -> DataFrame:
    """Piecewise linear through the knots, constant beyond them. knots: knot, x, y, a fixed number of rows."""
    table = knots.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("__t"))
    at = F.size(F.filter("__t", lambda k: k["x"] <= F.col(value)))
    lo, hi = F.get("__t", at - 1), F.get("__t", at)
    slope = F.when(hi["x"] > lo["x"], (hi["y"] - lo["y"]) / (hi["x"] - lo["x"])).otherwise(0.0)
    out = F.when(at == 0, F.get("__t", F.lit(0))["y"]).when(at == F.size("__t"), lo["y"]).otherwise(lo["y"] + slope * (F.col(value) - lo["x"]))
    return df.crossJoin(F.broadcast(table)).withColumn(name, F.when(F.col(value).isNotNull(), out)).drop("__t")  # one row of knots


def pava(x, y, w=None):
    """Isotonic fit by pooling adjacent violators: arrays of knot x (means of equal x pooled) and fitted y."""
    blocks: list[list[float]] = []
    merged: dict[float, list[float]] = {}
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        m = merged.setdefault(a, [0.0, 0.0])
        weight = 1.0 if w is None else w[i]
        m[0] += b * weight
        m[1] += weight
    for a in sorted(merged):
        s, n = merged[a]
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    fitted = [s / n for s, n, k in blocks for _ in range(k)]
    return sorted(merged), fitted


def isotonic_link(df: DataFrame, by: list[str], x: str, y: str, schema_by: str) -> DataFrame:
    """Knots of an isotonic fit of each group. Values are rounded to knots of 1/1000 first, so a group is a bounded table."""

    def fit(key, pdf):
        import pandas as pd

        xs, ys = pava(pdf["x"].tolist(), pdf["y"].tolist(), pdf["n"].tolist())
        return pd.DataFrame({**{b: [k] * len(xs) for b, k in zip(by, key, strict=True)}, "x": xs, "y": ys})

    binned = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.round(x, 3).alias("x")).agg(F.avg(y).alias("y"), F.count("*").cast("double").alias("n"))
    return binned.groupBy(*by).applyInPandas(fit, f"{schema_by}, x double, y double")


def gram(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Sufficient statistics of least squares by group: n, sums and cross products, in one aggregate."""
    cols = [*xs, y]
    aggs = [F.count("*").alias("n")] + [F.sum(c).alias(f"s_{c}") for c in cols] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return df.groupBy(*by).agg(*aggs)


def ridge_from_gram(row: dict, xs: list[str], y: str, alpha: float):
    """Intercept and coefficients of standardised ridge from summed statistics (driver side: a matrix of len(xs))."""
    import numpy as np

    n = row["n"]
    g = lambda a, b: row.get(f"p_{a}_{b}", row.get(f"p_{b}_{a}"))
    mean = np.array([row[f"s_{a}"] / n for a in xs])
    my = row[f"s_{y}"] / n
    cov = np.array([[g(a, b) / n - row[f"s_{a}"] * row[f"s_{b}"] / n**2 for b in xs] for a in xs])
    cy = np.array([g(a, y) / n - row[f"s_{a}"] * row[f"s_{y}"] / n**2 for a in xs])
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd == 0] = 1.0
    beta = np.linalg.solve(cov / np.outer(sd, sd) + alpha / n * np.eye(len(xs)), cy / sd) / sd
    return float(my - beta @ mean), beta


def grouped_oof_ridge(df: DataFrame, fold: str, xs: list[str], y: str, alpha: float = 1.0, name: str = "oof") -> DataFrame:
    """Out-of-fold ridge predictions: each fold's model is the total of the other folds' statistics (one row per fold on the driver)."""
    stats = [r.asDict() for r in gram(df, [fold], xs, y).collect()]
    total = {k: sum(r[k] for r in stats) for k in stats[0] if k != fold} if stats else {}
    out = F.lit(None).cast("double")
    for r in stats:
        rest = {k: total[k] - r[k] for k in total}
        if rest["n"] <= len(xs):
            continue
        b0, beta = ridge_from_gram(rest, xs, y, alpha)
        pred = F.lit(b0)
        for c, b in zip(xs, beta, strict=True):
            pred = pred + F.lit(float(b)) * F.col(c)
        out = F.when(F.col(fold) == r[fold], pred).otherwise(out)
    return df.withColumn(name, out)
