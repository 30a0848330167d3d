"""Team success: participation of players in team seasons, careers in teams, and the environment of games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import expr as E

PHASES = ("regular", "playoff", "finals")


def participation(rows: DataFrame, results: DataFrame, winners: DataFrame, digits: int = 12) -> DataFrame:
    """One row per player, team and season.

    rows: season, player, team, game, phase (regular, playoff), finals (boolean), minutes and eligible (boolean, whether
    the phase's minutes of the season can be used). results: season, team, regular_games, playoff_games, finalist, champion. winners: game,
    winner. A player's minutes are NULL if any of them is missing or the phase isn't eligible; so is their share.
    """
    here = {"regular": F.col("phase") == "regular", "playoff": F.col("phase") == "playoff", "finals": (F.col("phase") == "playoff") & F.col("finals")}
    won = rows.join(winners, "game", "left").withColumn("__won", (F.col("winner") == F.col("team")) & here["playoff"])

    def minutes(cond: Column) -> Column:
        m = F.when(cond & F.col("eligible"), F.col("minutes"))
        return F.when((F.count_if(cond) == F.count(m)) & (F.coalesce(F.min(F.when(cond, F.col("eligible"))), F.lit(True))), F.round(F.coalesce(F.sum(m), F.lit(0.0)), digits))

    own = won.groupBy("season", "player", "team").agg(
        *[F.countDistinct(F.when(c, F.col("game"))).alias(f"{p}_games") for p, c in here.items()], F.count_if("__won").alias("playoff_wins"), *[minutes(c).alias(f"{p}_minutes") for p, c in here.items()],
        *[F.coalesce(F.min(F.when(c, F.col("eligible"))), F.lit(False)).alias(f"{p}_eligible") for p, c in here.items()],
    )
    team = rows.groupBy("season", "team").agg(*[F.sum(F.when(c & F.col("eligible"), F.col("minutes"))).alias(f"team_{p}_minutes") for p, c in here.items()], F.countDistinct(F.when(here["finals"], F.col("game"))).alias("team_finals_games"))
    r = results.select("season", "team", F.col("regular_games").alias("team_regular_games"), F.col("playoff_games").alias("team_playoff_games"), "finalist", "champion")
    j = own.join(team, ["season", "team"]).join(r, ["season", "team"])
    out = j
    for p in PHASES:
        out = out.withColumn(f"{p}_game_share", F.round(E.safe_ratio(f"{p}_games", f"team_{p}_games"), digits))
        known = F.col(f"{p}_eligible") & F.col(f"{p}_minutes").isNotNull()
        out = out.withColumn(f"{p}_minutes", F.when(known, F.col(f"{p}_minutes"))).withColumn(f"{p}_minutes_share", F.round(F.when(known, E.safe_ratio(f"{p}_minutes", f"team_{p}_minutes")), digits))
        out = out.withColumn(f"{p}_minutes_coverage", F.when(F.col(f"{p}_eligible"), "RELIABLE").otherwise("UNAVAILABLE"))
    for name, p in (("regular_member_of_champion", "regular"), ("played_playoffs_for_champion", "playoff"), ("played_finals_for_champion", "finals")):
        out = out.withColumn(name, F.col("champion") & (F.col(f"{p}_games") > 0))
    return out.drop(*[f"{p}_eligible" for p in PHASES], *[f"team_{p}_minutes" for p in PHASES])


def career_context(parts: DataFrame, strength: DataFrame) -> DataFrame:
    """One row per player: seasons and games by phase, outcomes, and the win percentile of the teams (plain and weighted by games).

    parts: participation's rows; strength: season, team, percentile.
    """
    j = parts.join(strength, ["season", "team"], "left")
    seasons = lambda cond: F.countDistinct(F.when(cond, F.col("season")))
    here = {p: F.col(f"{p}_games") > 0 for p in PHASES}
    regular = F.when(here["regular"], F.col("percentile"))
    covered = lambda p: F.count_if(here[p] & (F.col(f"{p}_minutes_coverage") == "RELIABLE")).alias(f"{p}_minutes_covered")
    return j.groupBy("player").agg(
        seasons(here["playoff"]).alias("playoff_seasons"), F.sum("playoff_games").alias("playoff_games"), F.sum("playoff_wins").alias("playoff_wins"), seasons(here["finals"]).alias("finals_seasons"), F.sum("finals_games").alias("finals_games"),
        seasons(here["regular"] & F.col("finalist")).alias("finalist_regular_seasons"), seasons(F.col("regular_member_of_champion")).alias("champion_regular_seasons"), seasons(F.col("played_playoffs_for_champion")).alias("champion_playoff_seasons"),
        seasons(F.col("played_finals_for_champion")).alias("champion_finals_seasons"), F.avg(regular).alias("mean_team_win_percentile"), E.weighted_mean(regular, F.col("regular_games")).alias("weighted_team_win_percentile"),
        F.count_if(here["regular"]).alias("regular_affiliations"), seasons(here["regular"] & (F.col("percentile") >= 0.90)).alias("elite_team_seasons"), *[covered(p) for p in PHASES],
    )


def game_environment(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the most games of a team, team games, games of two known sides, and the points of a side and of both. rows: game, team, points."""
    sides = rows.groupBy(*by, "game", "team").agg(F.sum("points").alias("points"))
    opportunity = sides.groupBy(*by, "team").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("opportunity"))
    known = sides.where("points IS NOT NULL")
    pairs = known.groupBy(*by, "game").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    both = pairs.groupBy(*by).agg(F.count_if(F.col("n") == 2).alias("two_team_game_count"), F.avg(F.when(F.col("n") == 2, F.col("points"))).alias("average_combined_game_points"), F.sum("n").alias("team_game_count"), (F.sum("points") / F.sum("n")).alias("average_team_points_per_game"))
    return opportunity.join(both, by, "left")


def advanced_context(rows: DataFrame, by: list[str]) -> DataFrame:
    """Whether a group's possessions can be used (known, positive, for 99 % of its rows), and their mean."""
    n = F.count(F.lit(1))
    good = F.count_if(F.col("possessions") > 0)
    return rows.groupBy(*by).agg(n.alias("n_rows"), good.alias("n_known"), ((n > 0) & (good / n >= 0.99)).alias("possessions_eligible"), F.avg(F.when(F.col("possessions") > 0, F.col("possessions"))).alias("mean_possessions"))
