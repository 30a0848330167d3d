"""Canonical records from raw rows: games, box scores, awards, participation and careers in teams, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import records as R
from plumbline.operators import success as T
from plumbline.plans.base import read
from plumbline.plans.platform import NAMESPACE

LABELS = ("Regular Season", " playoffs ", "PLAY-IN  Tournament", "friendly")


def canonical_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw games between the nations of customer and clerk; bad season types, dates and teams are told apart."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw = o.select(
        k.cast("string").alias("game_id"), F.concat(F.lit("2"), F.year("o_orderdate")).alias("season_id"), F.when(k % 19 != 0, F.date_format("o_orderdate", "yyyy-MM-dd 00:00:00")).alias("game_date"), F.element_at(F.array(*[F.lit(x) for x in LABELS]), (k % 4 + 1).cast("int")).alias("season_type"),
        (F.col("o_custkey") % 26).cast("string").alias("team_id_home"), (k % 25).cast("string").alias("team_id_away"), F.concat((F.col("o_custkey") % 120).cast("string"), F.lit(".0")).alias("pts_home"), F.when(k % 13 != 0, (k % 120).cast("string")).alias("pts_away"),
    )
    teams = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("nba_team_id"), F.col("n_name").alias("team_id"))
    return R.games(raw, teams, NAMESPACE).select("nba_game_id", "season_id", F.col("game_date").cast("string").alias("game_date"), "season_type", "home_team_id", "away_team_id", "home_score", "away_score", "winner_team_id", "rejected")


def _award_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw award rows: the description by kind and user, labels of seasons of which some are wrong."""
    names = [a[0] for a in R.AWARDS] + ["Local Hero", " "]
    e = read(spark, sf_dir, "events")
    u, i = F.col("user_id"), F.col("event_id")
    year = 1980 + i % 30
    return e.select(
        F.when(i % 97 == 0, u + 1).otherwise(u).alias("PERSON_ID"), F.concat(F.lit(" "), F.element_at(F.array(*[F.lit(n) for n in names]), ((i * 7 + u) % len(names) + 1).cast("int"))).alias("DESCRIPTION"), (i % 5).cast("string").alias("ALL_NBA_TEAM_NUMBER"),
        F.when(i % 11 == 0, year.cast("string")).otherwise(F.format_string("%d-%02d", year, (year + 1) % 100)).alias("SEASON"), u.alias("expected_person_id"),
    )


_AWARD = """m AS (SELECT * FROM (VALUES """ + ", ".join("(" + ", ".join(f"'{x}'" for x in a) + ")" for a in R.AWARDS) + """) t(description, award_type, taxonomy_status, award_scope)),
  raw AS (SELECT CASE WHEN event_id % 97 = 0 THEN user_id + 1 ELSE user_id END AS person, trim([""" + ", ".join(f"'{n}'" for n in [a[0] for a in R.AWARDS] + ["Local Hero", " "]) + f"""][CAST((event_id * 7 + user_id) % {len(R.AWARDS) + 2} + 1 AS INTEGER)]) AS description,
    CAST(event_id % 5 AS VARCHAR) AS num, CAST(1980 + event_id % 30 AS INTEGER) AS y, event_id % 11 = 0 AS bad, user_id AS expected FROM events),
  ev0 AS (SELECT CAST(person AS VARCHAR) AS person_id, expected, person, raw.description, coalesce(award_type, 'OTHER') AS award_type, coalesce(taxonomy_status, 'UNKNOWN') AS taxonomy_status, coalesce(award_scope, 'UNKNOWN') AS award_scope,
    CASE WHEN award_type IN ('ALL_NBA', 'ALL_DEFENSE', 'ALL_ROOKIE', 'NBA_CUP_ALL_TOURNAMENT') AND num IN ('1', '2', '3') THEN CAST(num AS INTEGER) END AS team_number, num, CASE WHEN NOT bad THEN y END AS season_id, CASE WHEN bad THEN CAST(y AS VARCHAR) ELSE printf('%d-%02d', y, (y + 1) % 100) END AS label FROM raw LEFT JOIN m ON raw.description = m.description),
  ev AS (SELECT DISTINCT person_id, description, award_type, taxonomy_status, award_scope, team_number, num, season_id, label FROM ev0 WHERE person = expected)"""


def _events(spark, sf_dir):
    return R.award_events(_award_rows(spark, sf_dir), R.award_mapping(spark))


def award_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award events by type, level and season mapping, with what was quarantined."""
    good, bad = _events(spark, sf_dir)
    by = ["award_type", "taxonomy_status", "award_scope", "award_level", "season_mapping_status"]
    g = good.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("people")).withColumn("reason", F.lit(None).cast("string"))
    q = bad.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("people"))
    return g.unionByName(q, allowMissingColumns=True)


def award_career_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every user's career; those that were not queried have NULLs."""
    e = read(spark, sf_dir, "events").select(F.col("user_id")).distinct()
    status = F.when(F.col("user_id") % 10 == 0, "NOT_QUERIED").when(F.col("user_id") % 10 == 1, "FAILED_RETRYABLE").otherwise("SUCCESS_WITH_ROWS")
    out = R.accolade_counts(e.select(F.col("user_id").cast("string").alias("person_id"), status.alias("status")), _events(spark, sf_dir)[0])
    return out.select("person_id", "status", "source_event_count", "unknown_event_count", "first_event_season", "last_event_season", "mvp_count", "all_nba_first_count", "all_nba_total_count", "all_defense_second_count", "nba_champion_count", "scoring_title_count")


def award_type_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.award_coverage(_events(spark, sf_dir)[0], R.award_mapping(spark))


# --- Participation: a customer's nation is the team, a clerk's supplier the player; urgent orders are the post-season, those of December its finals.


def _team_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    o = read(spark, sf_dir, "orders").join(c, "o_custkey").select(
        F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"), "team", F.when(F.col("o_orderpriority").startswith("1"), "playoff").otherwise("regular").alias("phase"), (F.month("o_orderdate") == 12).alias("finals"), F.col("o_totalprice").alias("price")
    )
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("player")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    rows = o.join(li, "game").select("season", "player", "team", "game", "phase", "finals", F.when(F.col("q") % 50 != 49, F.col("q").cast("double")).alias("minutes"), (F.col("season") >= 1997).alias("eligible"))
    return rows, o


def _results(o: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Team seasons with their games; the team with the most urgent orders of December is champion, the next the finalist too."""
    g = o.groupBy("season", "team").agg(F.count_if(F.col("phase") == "regular").alias("regular_games"), F.count_if(F.col("phase") == "playoff").alias("playoff_games"), F.count_if((F.col("phase") == "playoff") & F.col("finals")).alias("f"))
    place = F.row_number().over(W.partitionBy("season").orderBy(F.desc("f"), "team"))
    pct = F.round(F.percent_rank().over(W.partitionBy("season").orderBy("regular_games")), 9)
    r = g.withColumn("place", place).withColumn("percentile", pct)
    return r.select("season", "team", "regular_games", "playoff_games", (F.col("place") <= 2).alias("finalist"), (F.col("place") == 1).alias("champion"), "percentile"), o.where("price > 150000").select("game", F.col("team").alias("winner"))


def _participation(spark, sf_dir):
    rows, o = _team_rows(spark, sf_dir)
    results, winners = _results(o)
    return T.participation(rows, results, winners), results


def player_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games, wins and shares of every player in every team season, by phase."""
    p, _ = _participation(spark, sf_dir)
    names = ["season", "player", "team", "regular_games", "playoff_games", "finals_games", "playoff_wins", "team_finals_games", "champion", "regular_member_of_champion", "played_playoffs_for_champion", "played_finals_for_champion", "regular_minutes_coverage"]
    return p.select(*names, *[F.round(f"{x}_{k}", 6).alias(f"{x}_{k}") for x in T.PHASES for k in ("minutes", "game_share", "minutes_share")])


_PART = """o AS (SELECT o_orderkey AS game, CAST(year(o_orderdate) AS INTEGER) AS season, c_nationkey AS team, CASE WHEN starts_with(o_orderpriority, '1') THEN 'playoff' ELSE 'regular' END AS phase, month(o_orderdate) = 12 AS finals, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey),
  li AS (SELECT l_orderkey AS game, l_suppkey AS player, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
  rw AS (SELECT season, player, team, o.game, phase = 'regular' AS reg, phase = 'playoff' AS po, phase = 'playoff' AND finals AS fi, CASE WHEN q % 50 <> 49 THEN q::DOUBLE END AS m, season >= 1997 AS el, price > 150000 AS won FROM o JOIN li ON o.game = li.game),
  g0 AS (SELECT season, team, count(*) FILTER (WHERE phase = 'regular') AS rg, count(*) FILTER (WHERE phase = 'playoff') AS pg, count(*) FILTER (WHERE phase = 'playoff' AND finals) AS f FROM o GROUP BY 1, 2),
  rs AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY f DESC, team) AS place, round(percent_rank() OVER (PARTITION BY season ORDER BY rg), 9) AS percentile FROM g0),
  tm AS (SELECT season, team, sum(m) FILTER (WHERE reg AND el) AS trm, sum(m) FILTER (WHERE po AND el) AS tpm, sum(m) FILTER (WHERE fi AND el) AS tfm, count(DISTINCT game) FILTER (WHERE fi) AS tfg FROM rw GROUP BY 1, 2),
  ow AS (SELECT season, player, team, count(DISTINCT game) FILTER (WHERE reg) AS regular_games, count(DISTINCT game) FILTER (WHERE po) AS playoff_games, count(DISTINCT game) FILTER (WHERE fi) AS finals_games, count(*) FILTER (WHERE po AND won) AS playoff_wins,
         CASE WHEN bool_and(el) AND count(*) FILTER (WHERE reg) > 0 AND count(*) FILTER (WHERE reg) = count(m) FILTER (WHERE reg) THEN sum(m) FILTER (WHERE reg) END AS rm,
         CASE WHEN bool_and(el) AND count(*) FILTER (WHERE po) > 0 AND count(*) FILTER (WHERE po) = count(m) FILTER (WHERE po) THEN sum(m) FILTER (WHERE po) END AS pm,
         CASE WHEN bool_and(el) AND count(*) FILTER (WHERE fi) > 0 AND count(*) FILTER (WHERE fi) = count(m) FILTER (WHERE fi) THEN sum(m) FILTER (WHERE fi) END AS fm, bool_and(el) AND count(*) FILTER (WHERE reg) > 0 AS re FROM rw GROUP BY 1, 2, 3),
  pa AS (SELECT ow.*, rg, pg, tfg AS team_finals_games, place = 1 AS champion, place <= 2 AS finalist, percentile, trm, tpm, tfm FROM ow JOIN tm USING (season, team) JOIN rs USING (season, team))"""


def career_team_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, results = _participation(spark, sf_dir)
    c = T.career_context(p, results.select("season", "team", "percentile"))
    return c.select("player", "playoff_seasons", "playoff_games", "playoff_wins", "finals_seasons", "finals_games", "finalist_regular_seasons", "champion_regular_seasons", "champion_playoff_seasons", "champion_finals_seasons", "regular_affiliations", "elite_team_seasons", "regular_minutes_covered", *[F.round(x, 6).alias(x) for x in ("mean_team_win_percentile", "weighted_team_win_percentile")])


def team_game_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunity, team games and points of sides per year; a side is a supplier nation in an order, points are quantities."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("team"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("period"))
    rows = read(spark, sf_dir, "lineitem").join(s, "l_suppkey").join(o, "l_orderkey").select("period", F.col("l_orderkey").alias("game"), "team", F.when(F.col("l_quantity") < 50, F.col("l_quantity").cast("bigint")).alias("points"))
    e = T.game_environment(rows, ["period"])
    return e.select("period", "opportunity", "team_game_count", "two_team_game_count", F.round("average_team_points_per_game", 6).alias("average_team_points_per_game"), F.round("average_combined_game_points", 6).alias("average_combined_game_points"))


_SHARES = ", ".join(
    f"CASE WHEN {b} > 0 THEN round({p}_games / {b}::DOUBLE, 6) END AS {p}_game_share, round({m}, 6) AS {p}_minutes, CASE WHEN t{m[0]}m > 0 THEN round({m} / t{m[0]}m, 6) END AS {p}_minutes_share" for p, b, m in (("regular", "rg", "rm"), ("playoff", "pg", "pm"), ("finals", "team_finals_games", "fm"))
)
SQL = {
    "canonical_games": f"""WITH r AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_orderkey % 19 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE o_orderkey % 4 WHEN 0 THEN 'REGULAR' WHEN 1 THEN 'PLAYOFF' WHEN 2 THEN 'PLAY_IN' END AS st, o_custkey % 26 AS h, o_orderkey % 25 AS a, CAST(o_custkey % 120 AS BIGINT) AS ph, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 120 AS BIGINT) END AS pa FROM orders),
      j AS (SELECT r.*, n.n_name AS hn, m.n_name AS an FROM r LEFT JOIN nation n ON h = n.n_nationkey LEFT JOIN nation m ON a = m.n_nationkey)
      SELECT CAST(k AS VARCHAR) AS nba_game_id, y AS season_id, d AS game_date, st AS season_type, hn AS home_team_id, an AS away_team_id, ph AS home_score, pa AS away_score, CASE WHEN ph > pa THEN hn WHEN pa > ph THEN an END AS winner_team_id,
      CASE WHEN hn IS NULL OR an IS NULL THEN 'UNRESOLVED_TEAM' WHEN d IS NULL THEN 'DATE_MISSING' WHEN st IS NULL THEN 'UNSUPPORTED_SEASON_TYPE' END AS rejected FROM j""",
    "award_events": "WITH " + _AWARD + """ SELECT award_type, taxonomy_status, award_scope, CASE team_number WHEN 1 THEN 'FIRST' WHEN 2 THEN 'SECOND' WHEN 3 THEN 'THIRD' END AS award_level, CASE WHEN season_id IS NULL THEN 'SEASON_MAPPING_UNKNOWN' ELSE 'MAPPED' END AS season_mapping_status, count(*) AS n, count(DISTINCT person_id) AS people, CAST(NULL AS VARCHAR) AS reason FROM ev GROUP BY 1, 2, 3, 4, 5
      UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*), count(DISTINCT person_id), 'IDENTITY_OR_SCHEMA_CONFLICT' FROM ev0 WHERE person <> expected HAVING count(*) > 0""",
    "award_career_counts": "WITH " + _AWARD + """, p AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS person_id, CASE user_id % 10 WHEN 0 THEN 'NOT_QUERIED' WHEN 1 THEN 'FAILED_RETRYABLE' ELSE 'SUCCESS_WITH_ROWS' END AS status FROM events),
      g AS (SELECT person_id, count(*) AS source_event_count, count(*) FILTER (WHERE taxonomy_status = 'UNKNOWN') AS unknown_event_count, min(season_id) AS first_event_season, max(season_id) AS last_event_season, count(*) FILTER (WHERE award_type = 'MVP') AS mvp_count, count(*) FILTER (WHERE award_type = 'ALL_NBA' AND team_number = 1) AS all_nba_first_count, count(*) FILTER (WHERE award_type = 'ALL_NBA') AS all_nba_total_count, count(*) FILTER (WHERE award_type = 'ALL_DEFENSE' AND team_number = 2) AS all_defense_second_count, count(*) FILTER (WHERE award_type = 'NBA_CHAMPION') AS nba_champion_count, count(*) FILTER (WHERE award_type = 'SCORING_TITLE') AS scoring_title_count FROM ev GROUP BY 1)
      SELECT p.person_id, status, first_event_season, last_event_season, """ + ", ".join(f"CASE WHEN starts_with(status, 'SUCCESS') THEN coalesce({x}, 0) END AS {x}" for x in ("source_event_count", "unknown_event_count", "mvp_count", "all_nba_first_count", "all_nba_total_count", "all_defense_second_count", "nba_champion_count", "scoring_title_count")) + " FROM p LEFT JOIN g ON p.person_id = g.person_id",
    "award_type_coverage": "WITH " + _AWARD + ", since AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in R.AWARD_SINCE.items()) + """) t(award_type, y)), ty AS (SELECT DISTINCT award_type FROM m UNION SELECT 'OTHER'),
      g AS (SELECT award_type, min(season_id) AS a, max(season_id) AS b, count(*) AS n, count(DISTINCT person_id) AS p, max(CASE WHEN taxonomy_status = 'UNKNOWN' THEN 1 ELSE 0 END) AS u FROM ev GROUP BY 1)
      SELECT ty.award_type, a AS first_observed_season, b AS last_observed_season, since.y AS known_introduction_season, CASE WHEN n IS NULL AND ty.award_type LIKE '%\\_TITLE' ESCAPE '\\' THEN 'REQUIRES_SEPARATE_SOURCE' WHEN n IS NULL OR u = 1 THEN 'UNKNOWN' WHEN ty.award_type = 'ALL_STAR' THEN 'PARTIAL' ELSE 'RELIABLE' END AS source_coverage_status, coalesce(n, 0) AS event_count, coalesce(p, 0) AS player_count
      FROM ty LEFT JOIN g ON ty.award_type = g.award_type LEFT JOIN since ON ty.award_type = since.award_type""",
    "player_participation": "WITH " + _PART + " SELECT season, player, team, regular_games, playoff_games, finals_games, playoff_wins, team_finals_games, champion, champion AND regular_games > 0 AS regular_member_of_champion, champion AND playoff_games > 0 AS played_playoffs_for_champion, champion AND finals_games > 0 AS played_finals_for_champion, CASE WHEN re THEN 'RELIABLE' ELSE 'UNAVAILABLE' END AS regular_minutes_coverage, " + _SHARES + " FROM pa",
    "career_team_context": "WITH " + _PART + """ SELECT player, count(DISTINCT season) FILTER (WHERE playoff_games > 0) AS playoff_seasons, CAST(sum(playoff_games) AS BIGINT) AS playoff_games, CAST(sum(playoff_wins) AS BIGINT) AS playoff_wins, count(DISTINCT season) FILTER (WHERE finals_games > 0) AS finals_seasons, CAST(sum(finals_games) AS BIGINT) AS finals_games,
      count(DISTINCT season) FILTER (WHERE regular_games > 0 AND finalist) AS finalist_regular_seasons, count(DISTINCT season) FILTER (WHERE champion AND regular_games > 0) AS champion_regular_seasons, count(DISTINCT season) FILTER (WHERE champion AND playoff_games > 0) AS champion_playoff_seasons, count(DISTINCT season) FILTER (WHERE champion AND finals_games > 0) AS champion_finals_seasons,
      count(*) FILTER (WHERE regular_games > 0) AS regular_affiliations, count(DISTINCT season) FILTER (WHERE regular_games > 0 AND percentile >= 0.9) AS elite_team_seasons, count(*) FILTER (WHERE regular_games > 0 AND re) AS regular_minutes_covered, round(avg(percentile) FILTER (WHERE regular_games > 0), 6) AS mean_team_win_percentile,
      round(sum(percentile * regular_games) FILTER (WHERE regular_games > 0) / sum(regular_games) FILTER (WHERE regular_games > 0), 6) AS weighted_team_win_percentile FROM pa GROUP BY 1""",
    "team_game_environment": """WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS period, l_orderkey AS game, s_nationkey AS team, sum(CASE WHEN l_quantity < 50 THEN CAST(l_quantity AS BIGINT) END)::DOUBLE AS points FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
      op AS (SELECT period, max(n) AS opportunity FROM (SELECT period, team, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1), pg AS (SELECT period, game, count(*) AS n, sum(points) AS p FROM s WHERE points IS NOT NULL GROUP BY 1, 2)
      SELECT pg.period, max(opportunity) AS opportunity, CAST(sum(n) AS BIGINT) AS team_game_count, count(*) FILTER (WHERE n = 2) AS two_team_game_count, round(sum(p) / sum(n), 6) AS average_team_points_per_game, round(avg(p) FILTER (WHERE n = 2), 6) AS average_combined_game_points FROM pg JOIN op ON pg.period = op.period GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (canonical_games, award_events, award_career_counts, award_type_coverage, player_participation, career_team_context, team_game_environment)}
