"""Matrix models from sufficient statistics: the cluster sums products, the driver solves a matrix of the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pairwise_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations of all column pairs over their pairwise complete rows, in one pass: a, b, n, r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.corr(a, b).alias("r")) for a, b in pairs]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def midranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns replaced by their average ranks (from 0), for Spearman's correlation; few rows (one window over all)."""
    out = df
    for c in columns:
        r = F.rank().over(W.orderBy(F.col(c).asc_nulls_last())) - 1 + (F.count(F.lit(1)).over(W.partitionBy(c)) - 1) / F.lit(2.0)
        out = out.withColumn(f"__{c}", F.when(F.col(c).isNotNull(), r))
    return out.select(*[F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def kendall_tau(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Kendall's tau-a of two scores: one row n, concordant, discordant, tau. Pairs are counted by blocks, not joined all with all."""
    from plumbline.operators.evidence import concordance

    return concordance(df, key, a, b)


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the sum of squares, from one aggregate by group."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    t = g.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.col("n"), F.when(total > 0, (F.col("between") - F.col("s") * F.col("s") / F.col("n")) / total).alias("eta_squared"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    t = df.groupBy(a, b).agg(F.count("*").cast("double").alias("o"))
    n, ra, cb = F.sum("o").over(W.partitionBy()), F.sum("o").over(W.partitionBy(a)), F.sum("o").over(W.partitionBy(b))  # of a contingency table
    t = t.withColumn("n", n).withColumn("e", ra * cb / n)
    g = t.agg(F.sum(F.col("o") * F.col("o") / F.col("e")).alias("q"), F.max("n").alias("n"), F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c"))
    return g.select(F.col("n").cast("bigint").alias("n"), F.sqrt((F.col("q") - F.col("n")) / F.col("n") / (F.least("r", "c") - 1)).alias("v"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    t = df.groupBy(a, b).agg(F.count("*").alias("o"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / F.lit(2.0)
    cells = t.agg(F.sum(two("o")).alias("cells"), F.sum("o").alias("n"))
    rows = t.groupBy(a).agg(F.sum("o").alias("s")).agg(F.sum(two("s")).alias("ra"))
    cols = t.groupBy(b).agg(F.sum("o").alias("s")).agg(F.sum(two("s")).alias("cb"))
    j = cells.crossJoin(rows).crossJoin(cols)  # single rows
    expected = F.col("ra") * F.col("cb") / two("n")
    top = (F.col("ra") + F.col("cb")) / 2
    return j.select(F.col("n").cast("bigint").alias("n"), F.when(top != expected, (F.col("cells") - expected) / (top - expected)).otherwise(1.0).alias("ari"))


def vector_moments(df: DataFrame, vector: str, dim: int):
    """n, mean and population covariance of an array column. Each task sums its own products; one row per task goes on."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        n, s, p = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None and len(v) == dim], dtype=float).reshape(-1, dim)
            n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], ["n", "s", "p"])

    parts = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, "n long, s array<double>, p array<double>")
    # Sums by position, so what reaches the driver is one matrix whatever the number of tasks.
    total = parts.agg(F.sum("n")).first()[0] or 0
    sums = {name: [r.v for r in parts.select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()] for name in ("s", "p")}
    if not total:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    mean = np.array(sums["s"]) / total
    return total, mean, np.array(sums["p"]).reshape(dim, dim) / total - np.outer(mean, mean)


def pca(df: DataFrame, vector: str, dim: int):
    """(eigenvalues, loadings as columns scaled by the root of theirs), signs fixed so that each column's largest entry is positive."""
    import numpy as np

    _, _, cov = vector_moments(df, vector, dim)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dim)])
    return values, vectors * np.sqrt(np.maximum(values, 0))


def kmeans(df: DataFrame, key: str, vector: str, start, rounds: int = 10) -> tuple[DataFrame, list]:
    """Lloyd's rounds from given centres: (key, cluster) and the centres. Each round is one aggregate of the cluster sums."""
    import numpy as np

    centres = [list(map(float, c)) for c in start]
    dim = len(centres[0])

    def assigned(cs):
        c = np.array(cs)

        def run(batches):
            import pyarrow as pa

            for b in batches:
                x = np.array(b.column(1).to_pylist(), dtype=float).reshape(-1, dim)
                d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.argmin(1).astype(np.int32)), b.column(1)], [key, "cluster", vector])

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, f"{key} {kind}, cluster int, {vector} array<double>")

    for _ in range(rounds):
        means = assigned(centres).select("cluster", F.posexplode(vector).alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v")).collect()  # clusters x dimensions rows
        moved = [list(c) for c in centres]
        for r in means:
            moved[r.cluster][r.i] = r.v
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return assigned(centres).select(key, "cluster"), centres
