"""Registries: the 16 features of an entity-period and the 38 candidates of the eight dimensions, as data and as operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.functions import policy as P
from plumbline.operators import sequences as S

#: Feature, rate basis, numerator parts, denominator, and the first season it is known in (None: always).
FEATURES = (
    ("games_played", "TOTAL", "games_played", None, None),
    ("minutes_total", "TOTAL", "minutes_total", None, 1951),
    ("ppg", "PER_GAME", "points_total", "games_played", None),
    ("points_per_36", "PER_36", "points_total", "minutes_total", 1951),
    ("points_per_75", "PER_75", "points_total", "possessions", 1996),
    ("rpg", "PER_GAME", "rebounds_total", "games_played", 1950),
    ("rebounds_per_36", "PER_36", "rebounds_total", "minutes_total", 1951),
    ("apg", "PER_GAME", "assists_total", "games_played", None),
    ("assists_per_36", "PER_36", "assists_total", "minutes_total", 1951),
    ("spg", "PER_GAME", "steals_total", "games_played", 1973),
    ("bpg", "PER_GAME", "blocks_total", "games_played", 1973),
    ("fg_pct", "PERCENTAGE", "fgm_total", "fga_total", None),
    ("ft_pct", "PERCENTAGE", "ftm_total", "fta_total", None),
    ("fg3_pct", "PERCENTAGE", "fg3m_total", "fg3a_total", 1979),
    ("efg_pct", "PERCENTAGE", "fgm_total + 0.5 * fg3m_total", "fga_total", 1979),
    ("ts_pct", "PERCENTAGE", "points_total", "2 * (fga_total + 0.44 * fta_total)", None),
)
_SCALE = {"PER_36": 36.0, "PER_75": 75.0}


def feature_values(totals: DataFrame, keys: list[str], season: str, starts: dict[str, int | None] | None = None) -> DataFrame:
    """Long form: keys, feature, value and availability of every feature. starts: other first seasons than the registry's."""
    rows = []
    for name, basis, num, den, start in FEATURES:
        start = (starts or {}).get(name, start)
        x = F.expr(num).cast("double") if den is None else E.safe_ratio(F.expr(num), F.expr(den), _SCALE.get(basis, 1.0))
        early = F.lit(False) if start is None else F.col(season) < start
        state = F.when(early, "NOT_INTRODUCED").when(x.isNull(), "MISSING").otherwise("AVAILABLE")
        rows.append(F.struct(F.lit(name).alias("feature"), F.lit(basis).alias("basis"), F.when(~early, x).alias("value"), state.alias("availability")))
    return totals.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


_PRA, _FOUR = ("ppg", "rpg", "apg"), ("ppg", "rpg", "apg", "ts_pct")
_AWARDS = ("mvp_count", "finals_mvp_count", "dpoy_count")


def _each(form: str, metrics, *others) -> list[tuple[str, bool]]:
    """Core primitives by a naming rule: form with {m} and, in {o}, each of others."""
    return [(form.format(m=m, o=o), True) for m in metrics for o in (others or ("",))]


def candidates() -> list[tuple[str, str, list[tuple[str, bool]]]]:
    """(dimension, candidate, [(primitive, core)]): fixed values, those of like names by a rule."""
    core = lambda *names: [(n, True) for n in names]
    more = lambda *names: [(n, False) for n in names]
    return [
        ("PEAK", "PEAK-A", _each("reg_{m}_peak1_quality", _FOUR)),
        ("PEAK", "PEAK-B", _each("reg_{m}_peak3_quality", _FOUR)),
        ("PEAK", "PEAK-C", _each("reg_{m}_peak5_quality", _FOUR)),
        ("PEAK", "PEAK-D", _each("reg_{m}_peak{o}_quality", _PRA, 1, 3, 5)),
        ("PEAK", "PEAK-E", _each("reg_{m}_peak3_adjusted", _FOUR)),
        ("LONGEVITY", "LONGEVITY-A", _each("reg_{m}_elite_{o}", _PRA, "p80", "p90", "p95")),
        ("LONGEVITY", "LONGEVITY-B", _each("reg_{m}_{o}", _FOUR, "cum_positive_z", "area_p80")),
        ("LONGEVITY", "LONGEVITY-C", _each("reg_{m}_run_{o}", _PRA, "p80", "p90", "p95")),
        ("LONGEVITY", "LONGEVITY-D", core("regular_qualified_seasons", "regular_total_games", "reg_ppg_mean_z", "reg_apg_mean_z", "reg_rpg_mean_z")),
        ("LONGEVITY", "LONGEVITY-E", _each("reg_{m}_elite_{o}", _FOUR, "p90", "p95")),
        ("OFFENSE", "OFFENSE-A", core("reg_ppg_mean_z", "reg_apg_mean_z") + more("reg_ts_pct_mean_z")),
        ("OFFENSE", "OFFENSE-B", core("reg_ppg_mean_z", "reg_apg_mean_z")),
        ("OFFENSE", "OFFENSE-C", core("reg_ppg_mean_z", "reg_ts_pct_mean_z") + more("reg_efg_pct_mean_z")),
        ("OFFENSE", "OFFENSE-D", core("reg_points_per_75_mean_z", "modern_reg_apg_mean_z", "modern_reg_ts_pct_mean_z")),
        ("DEFENSE", "DEFENSE-A", core("reg_rpg_mean_z") + more("reg_spg_mean_z", "reg_bpg_mean_z")),
        ("DEFENSE", "DEFENSE-B", core("reg_rpg_mean_z") + more("reg_spg_mean_z", "reg_bpg_mean_z", "dpoy_count", "all_defense_total_count")),
        ("DEFENSE", "DEFENSE-C", core("modern_def_rating_mean_z", "modern_reg_spg_mean_z", "modern_reg_bpg_mean_z")),
        ("DEFENSE", "DEFENSE-D", core("reg_rpg_mean_z") + more("dpoy_count", "all_defense_total_count")),
        ("PLAYOFFS", "PLAYOFFS-A", _each("po_{m}_mean_z", _FOUR)),
        ("PLAYOFFS", "PLAYOFFS-B", _each("po_{m}_peak{o}_quality", _PRA, 1, 3)),
        ("PLAYOFFS", "PLAYOFFS-C", core("playoff_seasons", "playoff_games") + _each("po_{m}_cum_positive_z", ("ppg", "apg", "rpg"))),
        ("PLAYOFFS", "PLAYOFFS-D", _each("{m}_playoff_lift", _FOUR)),
        ("PLAYOFFS", "PLAYOFFS-E", _each("po_{m}_weighted_positive_z", _PRA) + core("playoff_games")),
        ("ACCOLADES", "ACCOLADES-A", core(*_AWARDS, "all_nba_total_count", "all_defense_total_count")),
        ("ACCOLADES", "ACCOLADES-B", core("award_scarcity_index")),
        ("ACCOLADES", "ACCOLADES-C", core("award_opportunity_index")),
        ("ACCOLADES", "ACCOLADES-D", core("all_nba_total_count", "all_defense_total_count", "all_star_roster_seasons", "stat_title_count")),
        ("ACCOLADES", "ACCOLADES-E", core(*_AWARDS)),
        ("WINNING", "WINNING-A", core("mean_team_win_percentile", "playoff_seasons", "finals_seasons", "champion_regular_seasons")),
        ("WINNING", "WINNING-B", core("playoff_games", "playoff_wins", "champion_playoff_seasons")),
        ("WINNING", "WINNING-C", core("finals_seasons", "finals_games", "champion_finals_seasons")),
        ("WINNING", "WINNING-D", core("mean_regular_game_share") + more("mean_playoff_game_share", "mean_finals_game_share", "champion_finals_seasons")),
        ("WINNING", "WINNING-E", core("elite_team_seasons", "playoff_seasons", "finals_seasons", "champion_playoff_seasons")),
        ("ERA_DOMINANCE", "ERA-A", _each("reg_{m}_max_z", _PRA)),
        ("ERA_DOMINANCE", "ERA-B", _each("reg_{m}_top3_z", _PRA)),
        ("ERA_DOMINANCE", "ERA-C", _each("reg_{m}_elite_p90", _FOUR)),
        ("ERA_DOMINANCE", "ERA-D", _each("reg_{m}_area_p90", _FOUR)),
        ("ERA_DOMINANCE", "ERA-E", _each("reg_{m}_cum_positive_z", _FOUR)),
    ]


def catalog_rows() -> list[tuple[str, str, str, bool]]:
    return [(d, k, p, is_core) for d, k, parts in candidates() for p, is_core in parts]


def catalog(spark: SparkSession) -> DataFrame:
    """dimension, candidate, primitive, core."""
    return spark.createDataFrame(catalog_rows(), "dimension string, candidate string, primitive string, core boolean")


def shared_lineage(catalog_table: DataFrame) -> DataFrame:
    """Pairs of candidates of one dimension with the primitives that both use."""
    a, b = catalog_table.alias("a"), catalog_table.alias("b")
    both = a.join(b, (F.col("a.dimension") == F.col("b.dimension")) & (F.col("a.primitive") == F.col("b.primitive")) & (F.col("a.candidate") < F.col("b.candidate")))
    return both.groupBy(F.col("a.dimension").alias("dimension"), F.col("a.candidate").alias("left"), F.col("b.candidate").alias("right")).agg(F.array_join(F.sort_array(F.collect_set("a.primitive")), ",").alias("shared"))


def career_primitives(long: DataFrame, entity: str, period: str, prefix: str) -> DataFrame:
    """Primitives of careers: entity, primitive, value. long: entity, period, metric, z, pct, ratio of qualified periods."""
    by = [entity, "metric"]
    rows = long.where(F.col("z").isNotNull() & F.col("pct").isNotNull())
    up = F.greatest(F.col("z"), F.lit(0.0))
    shares = {"p80": 0.80, "p90": 0.90, "p95": 0.95}
    best = F.slice(F.sort_array(F.collect_list("z"), asc=False), 1, 3)
    g = rows.groupBy(*by).agg(
        F.max("pct").alias("peak1_quality"), F.max("z").alias("max_z"), F.avg("z").alias("mean_z"), F.sum(up).alias("cum_positive_z"), F.sum(up * F.col("ratio")).alias("weighted_positive_z"), S.area_above("pct", 0.80).alias("area_p80"), S.area_above("pct", 0.90).alias("area_p90"),
        *[F.count_if(F.col("pct") >= t).cast("double").alias(f"elite_{n}") for n, t in shares.items()], F.when(F.count("*") >= 3, F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / 3).alias("top3_z"),
    )
    key = F.concat_ws("\x1f", F.col(entity).cast("string"), "metric")  # one sequence of each entity and metric
    keyed = rows.withColumn("__key", key).withColumn("adjusted", E.opportunity_adjusted("pct", "ratio", 0.5))
    parts = g.withColumn("__key", key)
    for n in (3, 5):
        parts = parts.join(S.best_window(keyed, "__key", period, "pct", n, 6).select("__key", F.col("mean").alias(f"peak{n}_quality")), "__key", "left")
    parts = parts.join(S.best_window(keyed, "__key", period, "adjusted", 3, 6).select("__key", F.col("mean").alias("peak3_adjusted")), "__key", "left")
    for n, t in shares.items():
        run = S.longest_run(keyed, "__key", period, F.col("pct") >= t).select("__key", F.col("length").cast("double").alias(f"run_{n}"))
        parts = parts.join(run, "__key", "left").withColumn(f"run_{n}", F.coalesce(f"run_{n}", F.lit(0.0)))  # a known career without such a period
    names = [x for x in parts.columns if x not in (entity, "metric", "__key")]
    return parts.unpivot([entity, "metric"], names, "kind", "value").where("value IS NOT NULL").select(entity, F.concat(F.lit(f"{prefix}_"), "metric", F.lit("_"), "kind").alias("primitive"), "value")


def candidate_values(primitives: DataFrame, catalog_table: DataFrame, entity: str, policy: str = P.POLICIES[1], threshold: float = P.COVERAGE_THRESHOLD) -> DataFrame:
    """Each entity's candidates under a missingness policy: value, coverage, core_coverage, confidence, used. A candidate of which an entity has no part is absent."""
    sizes = catalog_table.groupBy("dimension", "candidate").agg(F.count("*").alias("n"), F.count_if("core").alias("n_core"))
    have = primitives.join(F.broadcast(catalog_table), "primitive")  # the catalogue is a fixed list
    g = have.groupBy(entity, "dimension", "candidate").agg(
        F.count("*").alias("available"), F.count_if("core").alias("core_available"), F.avg("value").alias("all_mean"), F.avg(F.when(F.col("core"), F.col("value"))).alias("core_mean")
    ).join(F.broadcast(sizes), ["dimension", "candidate"])
    a, ca = F.col("available"), F.col("core_available")
    rule = {
        P.POLICIES[0]: (ca == F.col("n_core"), F.col("core_mean"), ca), P.POLICIES[1]: (a > 0, F.col("all_mean"), a),
        P.POLICIES[2]: (a / F.col("n") >= threshold, F.col("all_mean"), a), P.POLICIES[3]: (ca / F.col("n_core") >= threshold, F.col("core_mean"), ca),
    }
    valid, value, used = rule[policy]
    return g.select(entity, "dimension", "candidate", F.when(valid, value).alias("value"), (a / F.col("n")).alias("coverage"), (ca / F.col("n_core")).alias("core_coverage"), P.coverage_confidence(a, "n").alias("confidence"), F.when(valid, used).otherwise(0).alias("used"))


def lift(regular: DataFrame, post: DataFrame, entity: str) -> DataFrame:
    """Primitives `<metric>_playoff_lift`: the difference of mean z, never a ratio. Both: career_primitives."""
    strip = lambda df, prefix, name: df.where(F.col("primitive").rlike(f"^{prefix}_.*_mean_z$")).select(entity, F.regexp_extract("primitive", f"^{prefix}_(.*)_mean_z$", 1).alias("metric"), F.col("value").alias(name))
    both = strip(regular, "reg", "__r").join(strip(post, "po", "__p"), [entity, "metric"])
    return both.select(entity, F.concat("metric", F.lit("_playoff_lift")).alias("primitive"), (F.col("__p") - F.col("__r")).alias("value"))


