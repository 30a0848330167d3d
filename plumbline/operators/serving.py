"""What a ranking release serves: filtered pages and their counts, profiles, and comparisons of two entities, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.functions import policy as L

ACTIVE, RETIRED = "ACTIVE", "RETIRED"


def page_filter(search: str | None = None, active: bool | None = None, status: str | None = None) -> Column:
    """The condition of a request over search_name (see expr.search_name), career_state and ranking_status; a blank search asks nothing."""
    out = F.lit(True)
    if search and search.strip():
        out = out & F.col("search_name").contains(E.search_name(F.lit(search)))
    if active is not None:
        out = out & (F.col("career_state") == (ACTIVE if active else RETIRED))
    if status is not None:
        out = out & (F.col("ranking_status") == status)
    return out


def leaderboard(entries: DataFrame, limit: int = 100, offset: int = 0, most: int = 10_000, **asked) -> DataFrame:
    """A page in display order. Only ranked entries (with a display_position) are listed."""
    if limit < 0 or offset < 0 or limit > most:
        raise ValueError("invalid pagination")
    rows = entries.where(F.col("display_position").isNotNull() & page_filter(**asked))
    return rows.orderBy("display_position").offset(offset).limit(limit)


def count_entries(entries: DataFrame, **asked) -> DataFrame:
    """One row: how many entries the filters leave, ranked and not."""
    rows = entries.where(page_filter(**asked))
    return rows.agg(F.count("display_position").alias("ranked"), (F.count(F.lit(1)) - F.count("display_position")).alias("unranked"))


def first_hundred(entries: DataFrame, size: int = 100) -> DataFrame:
    """The first entries by display position; the release is incomplete if any place is missing, which is an error."""
    out = entries.where(F.col("display_position").between(1, size))
    if out.agg(F.countDistinct("display_position").alias("n")).first().n != size:
        raise ValueError(f"the view of the first {size} is incomplete")
    return out.orderBy("display_position")


def comparisons(pairs: DataFrame, scores: DataFrame, draws: DataFrame, entity: str, draw: str, score: str, dimensions: list[str]) -> DataFrame:
    """One row per pair (a, b): probabilities over aligned draws, the order's label, differences of dimensions, and whether 90 % ranges overlap.

    scores: entity, the dimensions, lower_90 and upper_90. A pair of which one has no score row is absent; a difference with an unknown side is NULL.
    """
    s = draws.select(F.col(entity).alias("e"), F.col(draw).alias("d"), F.col(score).alias("s"))
    x, y = s.select(F.col("e").alias("a"), "d", F.col("s").alias("sa")), s.select(F.col("e").alias("b"), "d", F.col("s").alias("sb"))
    # Spark takes a table of draws, which are exploded, to be as small as its entities, and would broadcast it.
    p = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), ["b", "d"]).groupBy("a", "b").agg(F.avg((F.col("sa") > F.col("sb")).cast("double")).alias("p_a"), F.avg((F.col("sa") < F.col("sb")).cast("double")).alias("p_b"), F.avg((F.col("sa") == F.col("sb")).cast("double")).alias("p_tie"))
    side = lambda n: scores.select(F.col(entity).alias(n), *[F.col(c).alias(f"{n}_{c}") for c in (*dimensions, "lower_90", "upper_90")])
    j = p.join(side("a"), "a").join(side("b"), "b")
    above = F.col("p_a") + F.col("p_tie") / 2
    return j.select(
        "a", "b", F.col("p_a").alias("probability_a_above_b"), F.col("p_b").alias("probability_b_above_a"), F.col("p_tie").alias("tie_probability"), L.pairwise_order(above).alias("ordering_label"),
        ((F.col("a_lower_90") <= F.col("b_upper_90")) & (F.col("b_lower_90") <= F.col("a_upper_90"))).alias("ranges_overlap"), *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c}_difference") for c in dimensions],
    )


def reconcile_release(expected: dict[str, int], tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of loaded tables against those that a release says it has: table, expected, found, status."""
    out = None
    for name in sorted(expected.keys() | tables.keys()):
        said = expected.get(name)
        spark = next(iter(tables.values())).sparkSession
        found = tables[name].agg(F.count(F.lit(1)).alias("found")) if name in tables else spark.createDataFrame([(None,)], "found long")
        row = found.select(F.lit(name).alias("table"), F.lit(said).cast("long").alias("expected"), "found")
        out = row if out is None else out.unionByName(row)
    status = F.when(F.col("found").isNull(), "MISSING").when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("found") == F.col("expected"), "EQUAL").otherwise("DIFFERENT")
    return out.withColumn("status", status)
