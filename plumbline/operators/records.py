"""Canonical records from source rows: players, seasons, games, box scores, awards. Bad rows are told apart, never guessed.

Every mapping gives the canonical columns and `rejected`, the reason why a row can't be used (NULL for good rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expr as E

#: Source labels of season types.
SEASON_TYPES = {
    "regular season": "REGULAR", "regular": "REGULAR", "playoffs": "PLAYOFF", "playoff": "PLAYOFF", "play-in": "PLAY_IN", "play in": "PLAY_IN", "play-in tournament": "PLAY_IN",
    "all star": "ALL_STAR", "all-star": "ALL_STAR", "pre season": "PRESEASON", "preseason": "PRESEASON",
}
#: The first season in which a source field was kept.
INTRODUCED = {"REB": 1950, "MIN": 1951, "GS": 1970, "OREB": 1973, "DREB": 1973, "STL": 1973, "BLK": 1973, "TOV": 1977, "FG3M": 1979, "FG3A": 1979, "FG3_PCT": 1979}
FIRST_SEASON, ADVANCED_FROM = 1946, 1996
#: Source descriptions of awards: type, taxonomy status, scope.
_CORE, _SECOND, _MINOR, _OTHER = "CANONICAL_CORE", "CANONICAL_SECONDARY", "MINOR_RECURRING", "NON_PLAYER_COMPETITIVE"
AWARDS = (
    ("NBA Most Valuable Player", "MVP", _CORE, "LEAGUE"),
    ("NBA Finals Most Valuable Player", "FINALS_MVP", _CORE, "LEAGUE"),
    ("Eastern Conference Finals Most Valuable Player", "CONFERENCE_FINALS_MVP", _CORE, "CONFERENCE"),
    ("Western Conference Finals Most Valuable Player", "CONFERENCE_FINALS_MVP", _CORE, "CONFERENCE"),
    ("NBA Defensive Player of the Year", "DPOY", _CORE, "LEAGUE"),
    ("All-NBA", "ALL_NBA", _CORE, "LEAGUE"),
    ("All-Defensive Team", "ALL_DEFENSE", _CORE, "LEAGUE"),
    ("NBA Rookie of the Year", "ROY", _SECOND, "LEAGUE"),
    ("NBA Most Improved Player", "MIP", _SECOND, "LEAGUE"),
    ("NBA Sixth Man of the Year", "SIXTH_MAN", _SECOND, "LEAGUE"),
    ("NBA Clutch Player of the Year", "CLUTCH_PLAYER", _SECOND, "LEAGUE"),
    ("NBA Comeback Player of the Year", "COMEBACK_PLAYER", _SECOND, "LEAGUE"),
    ("All-Rookie Team", "ALL_ROOKIE", _SECOND, "LEAGUE"),
    ("NBA All-Star", "ALL_STAR", _SECOND, "LEAGUE"),
    ("NBA All-Star Selection", "ALL_STAR", _SECOND, "LEAGUE"),
    ("NBA All-Star Most Valuable Player", "ALL_STAR_MVP", _SECOND, "LEAGUE"),
    ("NBA Cup Most Valuable Player", "NBA_CUP_MVP", _SECOND, "LEAGUE"),
    ("NBA Cup All-Tournament Team", "NBA_CUP_ALL_TOURNAMENT", _SECOND, "LEAGUE"),
    ("NBA Champion", "NBA_CHAMPION", _SECOND, "TEAM"),
    ("NBA Player of the Month", "PLAYER_OF_MONTH", _MINOR, "LEAGUE"),
    ("NBA Player of the Week", "PLAYER_OF_WEEK", _MINOR, "LEAGUE"),
    ("NBA Rookie of the Month", "ROOKIE_OF_MONTH", _MINOR, "LEAGUE"),
    ("NBA Defensive Player of the Month", "DEFENSIVE_PLAYER_OF_MONTH", _MINOR, "LEAGUE"),
    ("Hall of Fame Inductee", "OTHER", _OTHER, "EXTERNAL"),
    ("IBM Award", "OTHER", _OTHER, "LEAGUE"),
    ("J. Walter Kennedy Citizenship", "OTHER", _OTHER, "LEAGUE"),
    ("NBA Sportsmanship", "OTHER", _OTHER, "LEAGUE"),
    ("NBA Sporting News Most Valuable Player of the Year", "OTHER", _OTHER, "EXTERNAL"),
    ("NBA Sporting News Rookie of the Year", "OTHER", _OTHER, "EXTERNAL"),
    ("Olympic Gold Medal", "OTHER", _OTHER, "EXTERNAL"),
    ("Olympic Silver Medal", "OTHER", _OTHER, "EXTERNAL"),
    ("Olympic Bronze Medal", "OTHER", _OTHER, "EXTERNAL"),
    ("Olympic Appearance", "OTHER", _OTHER, "EXTERNAL"),
    ("NBA Scoring Champion", "SCORING_TITLE", _SECOND, "LEAGUE"),
    ("NBA Rebounding Champion", "REBOUND_TITLE", _SECOND, "LEAGUE"),
    ("NBA Assists Leader", "ASSIST_TITLE", _SECOND, "LEAGUE"),
    ("NBA Steals Leader", "STEAL_TITLE", _SECOND, "LEAGUE"),
    ("NBA Blocks Leader", "BLOCK_TITLE", _SECOND, "LEAGUE"),
)
TITLES = ("SCORING_TITLE", "REBOUND_TITLE", "ASSIST_TITLE", "STEAL_TITLE", "BLOCK_TITLE")
#: Awards that come in teams, and their levels.
TEAM_AWARDS, LEVELS = ("ALL_NBA", "ALL_DEFENSE", "ALL_ROOKIE", "NBA_CUP_ALL_TOURNAMENT"), ("FIRST", "SECOND", "THIRD")
#: The season in which an award was first given.
AWARD_SINCE = {
    "MVP": 1955, "FINALS_MVP": 1968, "CONFERENCE_FINALS_MVP": 2021, "DPOY": 1982, "ROY": 1952, "MIP": 1985, "SIXTH_MAN": 1982, "CLUTCH_PLAYER": 2022, "COMEBACK_PLAYER": 1980, "ALL_NBA": 1946,
    "ALL_DEFENSE": 1968, "ALL_ROOKIE": 1962, "ALL_STAR": 1950, "ALL_STAR_MVP": 1950, "NBA_CUP_MVP": 2023, "NBA_CUP_ALL_TOURNAMENT": 2023,
}
#: Counts of a career by award type, or by type and level.
COUNTED_LEVELS = {"ALL_NBA": 3, "ALL_DEFENSE": 2, "ALL_ROOKIE": 2}


def cleaned(x) -> Column:
    """Trimmed text; blank is NULL."""
    t = F.trim(E.c(x).cast("string"))
    return F.when(t != "", t)


def lookup(x: Column, table: dict[str, str]) -> Column:
    return reduce(lambda out, kv: out.when(x == kv[0], kv[1]), table.items(), F.when(F.lit(False), ""))


def season_type(label) -> Column:
    """The canonical season type of a source label, NULL for others."""
    return lookup(F.trim(F.lower(F.regexp_replace(F.trim(E.c(label)), r"\s+", " "))), SEASON_TYPES)


def start_year(raw) -> Column:
    """The start year of a five-digit season id whose first digit is its type; NULL for others and years before 1946."""
    t = F.trim(E.c(raw).cast("string"))
    year = F.when(t.rlike(r"^\d{5}$"), F.right(t, F.lit(4)).cast("int"))
    return F.when(year >= FIRST_SEASON, year)


def optional_date(x) -> Column:
    """The date that a text begins with; NULL where it begins with none."""
    return F.left(F.trim(E.c(x).cast("string")), F.lit(10)).try_cast("date")


def weight_kg(pounds) -> Column:
    return F.round(F.trim(E.c(pounds).cast("string")).try_cast("double") * F.lit(0.45359237), 3)


def observed(field: str, season: Column) -> Column:
    """A source field where its season is not before its introduction, else NULL."""
    return F.when(season >= INTRODUCED.get(field, FIRST_SEASON), F.col(field))


def missing_reason(field: str, season: Column) -> Column:
    return F.when(season < INTRODUCED.get(field, FIRST_SEASON), "NOT_INTRODUCED").when(F.col(field).isNull(), "SOURCE_MISSING")


def players(rows: DataFrame, info: DataFrame, namespace: str) -> DataFrame:
    """Players (id, full_name, first_name, last_name, is_active) with what is known of them (person_id, birthdate, country, height, weight, position, from_year, to_year, draft_*)."""
    joined = rows.join(info, rows["id"].cast("string") == info["person_id"].cast("string"), "left")
    whole = lambda n: E.whole_number(F.col(n).cast("string")).cast("int")
    return joined.select(
        E.canonical_id("player", "nba", F.col("id").cast("string"), namespace).alias("player_id"), F.col("id").cast("string").alias("nba_player_id"), "full_name", cleaned("first_name").alias("first_name"), cleaned("last_name").alias("last_name"),
        optional_date("birthdate").alias("birth_date"), cleaned("country").alias("country"), E.height_cm("height").alias("height_cm"), weight_kg("weight").alias("weight_kg"), cleaned("position").alias("primary_position"),
        whole("draft_year").alias("draft_year"), whole("draft_round").alias("draft_round"), whole("draft_number").alias("draft_pick"), whole("from_year").alias("career_start_year"), whole("to_year").alias("career_end_year"), F.col("is_active").cast("boolean").alias("is_active"),
        F.when(cleaned("full_name").isNull(), "NAME_MISSING").alias("rejected"),
    )


def seasons(rows: DataFrame, raw: str) -> DataFrame:
    """Distinct seasons of raw ids: season_id, label, start and end year."""
    y = start_year(raw)
    return rows.select(F.col(raw).alias("raw_season_id"), y.alias("season_id"), E.season_label(y).alias("season_label"), (y + 1).alias("end_year"), F.when(y.isNull(), "BAD_SEASON_ID").alias("rejected")).distinct()


def games(rows: DataFrame, teams: DataFrame, namespace: str) -> DataFrame:
    """Games (game_id, season_id, game_date, season_type, team_id_home, team_id_away, pts_home, pts_away) with canonical ids; teams: nba_team_id, team_id."""
    t = F.broadcast(teams) if teams.limit(10_001).count() <= 10_000 else teams
    side = lambda s: t.select(F.col("nba_team_id").alias(f"team_id_{s}"), F.col("team_id").alias(f"__{s}"))
    j = rows.join(side("home"), "team_id_home", "left").join(side("away"), "team_id_away", "left")
    home, away = (E.whole_number(F.col(f"pts_{s}").cast("string")) for s in ("home", "away"))
    year, kind, day = start_year("season_id"), season_type("season_type"), optional_date("game_date")
    reason = F.when(F.col("__home").isNull() | F.col("__away").isNull(), "UNRESOLVED_TEAM").when(day.isNull(), "DATE_MISSING").when(year.isNull(), "BAD_SEASON_ID").when(kind.isNull(), "UNSUPPORTED_SEASON_TYPE")
    return j.select(
        E.canonical_id("game", "nba", F.col("game_id").cast("string"), namespace).alias("game_id"), F.col("game_id").cast("string").alias("nba_game_id"), year.alias("season_id"), day.alias("game_date"), kind.alias("season_type"),
        F.col("__home").alias("home_team_id"), F.col("__away").alias("away_team_id"), home.alias("home_score"), away.alias("away_score"),
        F.when(home > away, F.col("__home")).when(away > home, F.col("__away")).alias("winner_team_id"), reason.alias("rejected"),
    )


def _box(total: bool) -> list[tuple[str, str]]:
    """(source field, canonical name) of counts."""
    plain = [("MIN", "minutes"), ("PTS", "points"), ("FGM", "fgm"), ("FGA", "fga"), ("FG3M", "fg3m"), ("FG3A", "fg3a"), ("FTM", "ftm"), ("FTA", "fta"), ("OREB", "oreb"), ("DREB", "dreb"), ("REB", "rebounds"), ("AST", "assists"), ("STL", "steals"), ("BLK", "blocks"), ("TOV", "turnovers"), ("PF", "personal_fouls")]
    return [(f, f"{n}_total" if total else n) for f, n in plain]


def player_games(rows: DataFrame, teams: DataFrame, season: str, kind: str, namespace: str) -> DataFrame:
    """Box scores of games; season and kind are columns with the request's labels. Fields before their introduction are NULL whatever the source says."""
    t = teams.select(F.col("nba_team_id").alias("TEAM_ID"), F.col("team_id").alias("__team"))
    y = E.season_start(season)
    j = rows.join(F.broadcast(t) if t.limit(10_001).count() <= 10_000 else t, "TEAM_ID", "left")
    reason = F.when(F.col("__team").isNull(), "UNRESOLVED_TEAM").when(y.isNull(), "BAD_SEASON").when(season_type(kind).isNull(), "UNSUPPORTED_SEASON_TYPE")
    return j.select(
        E.canonical_id("game", "nba", F.col("GAME_ID").cast("string"), namespace).alias("game_id"), E.canonical_id("player", "nba", F.col("PLAYER_ID").cast("string"), namespace).alias("player_id"), F.col("__team").alias("team_id"), y.alias("season_id"),
        season_type(kind).alias("season_type"), *[observed(f, y).alias(n) for f, n in _box(False)], F.col("PLUS_MINUS").alias("plus_minus"), F.lit(None).cast("boolean").alias("started"), F.when(y >= INTRODUCED["MIN"], True).alias("did_play"), reason.alias("rejected"),
    )


def player_seasons(rows: DataFrame, season: str, kind: str, namespace: str) -> DataFrame:
    """Season totals of scope TOTAL; rates per game are derived later, never taken."""
    y = E.season_start(season)
    return rows.select(
        E.canonical_id("player", "nba", F.col("PLAYER_ID").cast("string"), namespace).alias("player_id"), y.alias("season_id"), season_type(kind).alias("season_type"), F.lit("TOTAL").alias("row_scope"), F.lit(None).cast("string").alias("team_id"),
        F.col("GP").alias("games_played"), observed("GS", y).alias("games_started"), *[observed(f, y).alias(n) for f, n in _box(True)], F.col("FG_PCT").alias("fg_pct"), observed("FG3_PCT", y).alias("fg3_pct"), F.col("FT_PCT").alias("ft_pct"),
        F.when(y.isNull(), "BAD_SEASON").when(season_type(kind).isNull(), "UNSUPPORTED_SEASON_TYPE").alias("rejected"),
    )


def player_advanced(rows: DataFrame, season: str, kind: str, namespace: str) -> DataFrame:
    """Advanced rates, which are kept from 1996 on; earlier rows are rejected."""
    y = E.season_start(season)
    named = {"OFF_RATING": "offensive_rating", "DEF_RATING": "defensive_rating", "NET_RATING": "net_rating", "PACE": "pace", "USG_PCT": "usage_pct", "TS_PCT": "true_shooting_pct", "EFG_PCT": "effective_fg_pct", "AST_PCT": "assist_pct", "OREB_PCT": "oreb_pct", "DREB_PCT": "dreb_pct", "REB_PCT": "rebound_pct", "TM_TOV_PCT": "turnover_pct", "PIE": "pie", "POSS": "possessions"}
    return rows.select(
        E.canonical_id("player", "nba", F.col("PLAYER_ID").cast("string"), namespace).alias("player_id"), y.alias("season_id"), season_type(kind).alias("season_type"), F.lit("TOTAL").alias("row_scope"), F.col("GP").alias("games_played"), F.col("MIN").alias("minutes"),
        *[F.col(f).cast("double").alias(n) for f, n in named.items()], F.when(y.isNull(), "BAD_SEASON").when(y < ADVANCED_FROM, "NOT_INTRODUCED").alias("rejected"),
    )


# --- Awards


def award_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AWARDS), "description string, award_type string, taxonomy_status string, award_scope string")


def award_events(rows: DataFrame, mapping: DataFrame, expected: str = "expected_person_id") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine). rows: PERSON_ID, DESCRIPTION, ALL_NBA_TEAM_NUMBER, SEASON and the expected person.

    Unknown descriptions are OTHER of taxonomy UNKNOWN. A season that is no label, or whose second part doesn't follow the first, is
    kept raw and unmapped. Rows of another person than was asked for are quarantined. Equal rows are one event.
    """
    label = cleaned("SEASON")
    season = E.season_start(label)
    number = F.when(F.col("award_type").isin(*TEAM_AWARDS) & cleaned("ALL_NBA_TEAM_NUMBER").isin("1", "2", "3"), cleaned("ALL_NBA_TEAM_NUMBER").cast("int"))
    clean = cleaned("DESCRIPTION")
    joined = rows.withColumn("description", F.coalesce(clean, F.lit(""))).join(F.broadcast(mapping), "description", "left")  # a fixed list
    joined = joined.withColumn("award_type", F.coalesce("award_type", F.lit("OTHER"))).withColumn("taxonomy_status", F.coalesce("taxonomy_status", F.lit("UNKNOWN"))).withColumn("award_scope", F.coalesce("award_scope", F.lit("UNKNOWN")))
    out = joined.select(
        F.col("PERSON_ID").cast("string").alias("person_id"), F.col(expected).cast("string").alias("expected"), "description", "award_type", "taxonomy_status", "award_scope", number.alias("team_number"), F.get(F.array(*[F.lit(x) for x in LEVELS]), number - 1).alias("award_level"),
        season.alias("season_id"), label.alias("season_label_raw"), F.when(season.isNotNull(), "MAPPED").otherwise("SEASON_MAPPING_UNKNOWN").alias("season_mapping_status"),
        F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != expected)), {"ignoreNullFields": "false"}), 256).alias("fingerprint"),
    )
    same = F.coalesce(F.col("person_id") == F.col("expected"), F.lit(False))
    return out.where(same).drop("expected").dropDuplicates(["fingerprint"]), out.where(~same).withColumn("reason", F.lit("IDENTITY_OR_SCHEMA_CONFLICT"))


def count_fields() -> list[tuple[str, str, str | None]]:
    """(name, type, level) of the counts of a career, by a rule."""
    out = []
    for kind in dict.fromkeys(a[1] for a in AWARDS if a[1] != "OTHER"):
        if kind in COUNTED_LEVELS:
            out += [(f"{kind}_{level}_count".lower(), kind, level) for level in LEVELS[: COUNTED_LEVELS[kind]]]
            out.append((f"{kind}_total_count".lower(), kind, None))
        else:
            out.append((f"{kind}_count".lower(), kind, None))
    return out


def accolade_counts(people: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of a career; people: person_id, status. Who was not queried successfully has NULL counts, which are not zeros."""
    hit = lambda kind, level: F.count_if((F.col("award_type") == kind) & (F.lit(True) if level is None else F.col("award_level") == level))
    g = events.groupBy("person_id").agg(
        F.count("*").alias("source_event_count"), F.count_if(F.col("taxonomy_status") == "UNKNOWN").alias("unknown_event_count"), F.min("season_id").alias("first_event_season"), F.max("season_id").alias("last_event_season"),
        *[hit(k, level).alias(n) for n, k, level in count_fields()],
    )
    queried = F.col("status").isin("SUCCESS_WITH_ROWS", "SUCCESS_EMPTY")
    counts = [c for c in g.columns if c.endswith("_count")]
    j = people.join(g, "person_id", "left")
    return j.select("person_id", "status", "first_event_season", "last_event_season", *[F.when(queried, F.coalesce(c, F.lit(0))).alias(c) for c in counts])


def award_coverage(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every award type: what of it was seen, and how far the source can be relied on."""
    types = mapping.select("award_type").unionByName(mapping.sparkSession.createDataFrame([("OTHER",)], "award_type string")).distinct()
    g = events.groupBy("award_type").agg(F.min("season_id").alias("first_observed_season"), F.max("season_id").alias("last_observed_season"), F.count("*").alias("event_count"), F.countDistinct("person_id").alias("player_count"), F.max((F.col("taxonomy_status") == "UNKNOWN").cast("int")).alias("__unknown"))
    since = reduce(lambda out, kv: out.when(F.col("award_type") == kv[0], kv[1]), AWARD_SINCE.items(), F.when(F.lit(False), 0))
    status = (
        F.when(F.col("event_count").isNull() & F.col("award_type").isin(*TITLES), "REQUIRES_SEPARATE_SOURCE").when(F.col("event_count").isNull() | (F.col("__unknown") == 1), "UNKNOWN")
        .when(F.col("award_type") == "ALL_STAR", "PARTIAL").otherwise("RELIABLE")
    )
    j = types.join(g, "award_type", "left")
    return j.select("award_type", "first_observed_season", "last_observed_season", since.alias("known_introduction_season"), status.alias("source_coverage_status"), F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("player_count", F.lit(0)).alias("player_count"))
