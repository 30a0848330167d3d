"""Policies, catalogues, records, evidence between scores and audits of sources, against plain Python and NumPy."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.functions import policy as L
from plumbline.operators import catalog as C
from plumbline.operators import evidence as V
from plumbline.operators import records as R
from plumbline.operators import success as T
from plumbline.sources import audit

NS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def test_policies_for_absent_parts(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, 3.0), (1.0, 2.0, None), (None, None, None)], "a double, b double, c double")
    parts = {"a": True, "b": True, "c": False}
    got = {p: [tuple(r.x) for r in df.select(L.combine_components(parts, p).alias("x")).collect()] for p in L.POLICIES}
    assert [g[0] for g in got["CORE_FEATURE_ONLY"]] == [None, None, 1.5, None]
    assert [g[0] for g in got["AVAILABLE_FEATURE_RENORMALIZATION"]] == [2.0, 3.0, 1.5, None]
    assert [g[0] for g in got["COVERAGE_THRESHOLD"]] == [2.0, None, 1.5, None]
    assert [g[0] for g in got["ERA_SPECIFIC_ENRICHMENT"]] == [None, None, 1.5, None]
    assert [(g[1], g[2], g[3], g[4], g[5]) for g in got["COVERAGE_THRESHOLD"]] == [(2 / 3, 0.5, 1.0, "LIMITED", 2), (1 / 3, 0.0, 1.0, "LIMITED", 0), (2 / 3, 1.0, 0.0, "LIMITED", 2), (0.0, 0.0, 0.0, "UNAVAILABLE", 0)]
    with pytest.raises(ValueError):
        L.combine_components(parts, "ZERO")


def test_labels(spark):
    r = spark.range(1).select(L.era_group(F.lit(None)).alias("a"), L.era_group(F.lit(1959)).alias("b"), L.era_group(F.lit(2031)).alias("c"), L.top100_membership(F.lit(0.65)).alias("d"), L.pairwise_order(F.lit(0.1)).alias("e"), L.pairwise_order(F.lit(0.34)).alias("f"), L.broad_role(F.lit(" forward-center ")).alias("g"), L.broad_role(F.lit("x")).alias("h"), L.rank_stability(F.lit(0.95), F.lit(26)).alias("i")).first()
    assert tuple(r) == ("UNKNOWN", "PRE_1960", "2020S", "LIKELY_TOP100", "STRONG_B_OVER_A", "LEAN_B_OVER_A", "BIG", None, "MODERATE")


def test_catalogue():
    rows = C.catalog_rows()
    assert len(C.candidates()) == 38 and len({k for _, k, _ in C.candidates()}) == 38 and len(C.FEATURES) == 16
    assert len(rows) == len({(k, p) for _, k, p, _ in rows}) and {d for d, *_ in rows} == {"PEAK", "LONGEVITY", "OFFENSE", "DEFENSE", "PLAYOFFS", "ACCOLADES", "WINNING", "ERA_DOMINANCE"}


def test_candidates_without_their_core(spark):
    prim = spark.createDataFrame([(1, "reg_rpg_mean_z", 1.0), (1, "reg_spg_mean_z", 3.0), (2, "reg_spg_mean_z", 4.0)], "entity int, primitive string, value double")
    got = {(r.entity, r.candidate): r.value for r in C.candidate_values(prim, C.catalog(spark), "entity", L.POLICIES[0]).collect()}
    assert got[1, "DEFENSE-A"] == 1.0 and got[2, "DEFENSE-A"] is None and (1, "PEAK-A") not in got


def test_source_rows(spark):
    people = spark.createDataFrame([(76, "A B", "A", " ", 1), (77, "", None, None, 0)], "id int, full_name string, first_name string, last_name string, is_active int")
    info = spark.createDataFrame([("76", "1963-02-17T00:00:00", "USA", "7-2", "200", "Center", "1984.0", "x", "1984", "1", "3.5")], "person_id string, birthdate string, country string, height string, weight string, position string, from_year string, to_year string, draft_year string, draft_round string, draft_number string")
    a, b = R.players(people, info, NS).orderBy("nba_player_id").collect()
    assert (str(a.birth_date), a.height_cm, a.weight_kg, a.career_start_year, a.career_end_year, a.draft_pick, a.last_name, a.rejected) == ("1963-02-17", 218.4, 90.718, 1984, None, None, None, None)
    assert b.rejected == "NAME_MISSING" and b.birth_date is None
    s = {r.raw_season_id: (r.season_id, r.season_label, r.rejected) for r in R.seasons(spark.createDataFrame([("21999",), ("21900",), ("x",)], "s string"), "s").collect()}
    assert s == {"21999": (1999, "1999-00", None), "21900": (None, None, "BAD_SEASON_ID"), "x": (None, None, "BAD_SEASON_ID")}
    box = "GAME_ID string, PLAYER_ID string, TEAM_ID string, season string, kind string, PLUS_MINUS double, " + ", ".join(f"{f} double" for f, _ in R._box(False))
    rows = spark.createDataFrame([("g", "p", "1", "1970-71", "Regular Season", 1.0, *[5.0] * 16), ("g", "p", "9", "1999-00", "Playoffs", 1.0, *[5.0] * 16)], box)
    teams = spark.createDataFrame([("1", "T1")], "nba_team_id string, team_id string")
    old, new = R.player_games(rows, teams, "season", "kind", NS).orderBy("season_id").collect()
    assert (old.minutes, old.steals, old.fg3m, old.turnovers, old.did_play, old.rejected) == (5.0, None, None, None, True, None)
    assert (new.steals, new.season_type, new.rejected) == (5.0, "PLAYOFF", "UNRESOLVED_TEAM")


def test_awards(spark):
    schema = "PERSON_ID string, DESCRIPTION string, ALL_NBA_TEAM_NUMBER string, SEASON string, expected_person_id string"
    rows = spark.createDataFrame([("1", " All-NBA ", "2", "1999-00", "1"), ("1", "All-NBA", "7", "2040", "1"), ("1", "Odd", None, None, "1"), ("2", "NBA Champion", "1", "2000-01", "1"), ("1", " All-NBA ", "2", "1999-00", "1")], schema)
    good, bad = R.award_events(rows, R.award_mapping(spark))
    got = sorted((r.award_type, r.award_level, r.season_id, r.taxonomy_status) for r in good.collect() if r.season_id) + sorted((r.award_type, r.season_label_raw) for r in good.collect() if not r.season_id and r.season_label_raw)
    assert got == [("ALL_NBA", "SECOND", 1999, "CANONICAL_CORE"), ("ALL_NBA", "2040")] and good.count() == 3 and bad.count() == 1
    people = spark.createDataFrame([("1", "SUCCESS_WITH_ROWS"), ("2", "SUCCESS_EMPTY"), ("3", "NOT_QUERIED")], "person_id string, status string")
    c = {r.person_id: (r.all_nba_total_count, r.all_nba_second_count, r.unknown_event_count) for r in R.accolade_counts(people, good).collect()}
    assert c == {"1": (2, 1, 1), "2": (0, 0, 0), "3": (None, None, None)}
    cover = {r.award_type: r.source_coverage_status for r in R.award_coverage(good, R.award_mapping(spark)).collect()}
    assert cover["ALL_NBA"] == "RELIABLE" and cover["OTHER"] == "UNKNOWN" and cover["BLOCK_TITLE"] == "REQUIRES_SEPARATE_SOURCE" and cover["MVP"] == "UNKNOWN"


def test_minutes_that_are_missing(spark):
    rows = spark.createDataFrame([(1, "p", "t", "g1", "regular", False, 10.0, True), (1, "p", "t", "g2", "regular", False, None, True), (1, "q", "t", "g1", "regular", False, 30.0, True), (1, "q", "t", "g3", "playoff", True, 5.0, False)], "season int, player string, team string, game string, phase string, finals boolean, minutes double, eligible boolean")
    results = spark.createDataFrame([(1, "t", 2, 1, True, True)], "season int, team string, regular_games int, playoff_games int, finalist boolean, champion boolean")
    winners = spark.createDataFrame([("g3", "t")], "game string, winner string")
    p, q = T.participation(rows, results, winners).orderBy("player").collect()
    assert (p.regular_games, p.regular_minutes, p.regular_minutes_share, p.regular_game_share, p.regular_member_of_champion, p.played_finals_for_champion) == (2, None, None, 1.0, True, False)
    assert (q.regular_minutes, q.regular_minutes_share, q.playoff_minutes, q.playoff_wins, q.playoff_minutes_coverage, q.finals_game_share) == (30.0, 0.75, None, 1, "UNAVAILABLE", 1.0)


def test_evidence_against_numpy(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=300)
    x = np.column_stack([f + rng.normal(size=300), 2 * f + rng.normal(size=300), rng.normal(size=300)])
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300)
    block = np.arange(300) % 5
    df = spark.createDataFrame([(*map(float, r), float(t), int(b)) for r, t, b in zip(x, y, block)], "a double, b double, c double, y double, k int")
    q = np.linalg.inv(np.corrcoef(np.column_stack([x[:, 0], x[:, 1], y]).T))
    assert abs(V.partial_correlation(df, "a", "b", ["y"]) + q[0, 1] / np.sqrt(q[0, 0] * q[1, 1])) < 1e-9
    design = np.column_stack([np.ones(300), x])
    fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert abs(V.multiple_r_squared(df, "y", ["a", "b", "c"]) - (1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert V.multiple_r_squared(df.limit(2), "y", ["a"]) is None
    model = V.fit_latent(df, ["a", "b", "c"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.eigh(z.T @ z / 300)[1][:, -1]
    assert np.allclose(model["loading"], w if w.sum() > 0 else -w)
    one = df.limit(1).withColumn("b", F.lit(None).cast("double")).select(V.latent_score(model).alias("s")).first().s
    ld, z0 = np.array(model["loading"]), (df.first()[:3] - x.mean(axis=0)) / x.std(axis=0)
    assert abs(one - (z0[0] * ld[0] + z0[2] * ld[2]) / (ld[0] ** 2 + ld[2] ** 2)) < 1e-9
    got = np.array([r.predicted for r in V.block_ridge(df, ["a", "b", "c"], "y", "k").orderBy("k", "y").collect()])
    want = []
    for b in range(5):
        t = block != b
        m, s = x[t].mean(axis=0), x[t].std(axis=0)
        zt = (x[t] - m) / s
        beta = np.linalg.solve(zt.T @ zt + np.eye(3), zt.T @ (y[t] - y[t].mean()))
        own = np.nonzero(~t)[0]
        want += list(((x[own] - m) / s @ beta + y[t].mean())[np.argsort(y[own])])
    assert np.allclose(got, want)


def test_pairs_are_counted_whatever_the_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 40)), float(rng.integers(0, 25))) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    s = [np.sign(p[1] - q[1]) * np.sign(p[2] - q[2]) for i, p in enumerate(rows) for q in rows[:i]]
    for blocks in (None, 1, 9):
        r = V.concordance(df, "k", "a", "b", blocks).first()
        assert (r.pairs, r.concordant, r.discordant) == (len(s), sum(x > 0 for x in s), sum(x < 0 for x in s))
    assert V.concordance(df.limit(0), "k", "a", "b").first().tau is None


def test_careers_by_draw(spark):
    rows = [("e", 1, 2000, 90.0), ("e", 1, 2001, 85.0), ("e", 1, 2002, 70.0), ("e", 1, 2004, 99.0), ("e", 2, 2000, 50.0), ("e", 2, 2002, 85.0)]
    d = spark.createDataFrame(rows, "e string, d int, p int, v double")
    a, b = V.peak_by_draw(d, "e", "d", "p", "v").orderBy("d").collect()
    assert abs(a.peak - (0.7 * (90 + 85 + 70) / 3 + 0.3 * 99)) < 1e-9 and (a.window_start, a.apex_period) == (2000, 2004) and b.peak is None
    x, y = V.longevity_by_draw(d, "e", "d", "p", "v").orderBy("d").collect()
    assert (x.breadth, x.area, x.run) == (3.0, 2.5, 2.0) and (y.breadth, y.area, y.run) == (1.0, 0.5, 1.0)


def test_audits(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE game (season_id TEXT, game_id TEXT PRIMARY KEY, fg3m_home REAL NOT NULL)")
        db.execute("INSERT INTO game VALUES ('21979', 'a', 1)")
    (t,) = audit.sqlite_tables(spark, path).collect()
    assert (t.name, t.row_count, [(c.name, c.nullable, c.key_ordinal) for c in t.columns]) == ("game", 1, [("season_id", True, 0), ("game_id", True, 1), ("fg3m_home", False, 0)])
    with pytest.raises(FileNotFoundError):
        audit.sqlite_tables(spark, str(tmp_path / "none.db"))
    games = spark.createDataFrame([("21978", None), ("21979", 1.0), ("21979", 2.0)], "season_id string, fg3m_home double")
    (m,) = audit.metric_observations(games, "season_id").collect()
    assert tuple(m) == ("fg3m_home", 1979, 1979, 1, 3) and audit.duplicate_groups(games, ["season_id"]) == 1
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("x")
    (tmp_path / "m.json").write_text(json.dumps({"id": "i", "subtitle": "a 16-table set", "description": "CSV exports available**: 3/16", "licenses": [{"name": "L"}]}))
    got = audit.bundle_claims(str(tmp_path / "m.json"), 15, str(tmp_path / "csv"))
    assert (got["declared_tables"], got["declared_exports"], got["declared_catalog"], got["physical_objects"], got["physical_csv_files"], got["license"]) == (16, 3, 16, 15, 1, "L")
    assert audit.file_digest(str(tmp_path / "csv" / "a.csv"))[0] == 1


def test_names_of_any_script(spark):
    names = ["  Nikola JOKIĆ", "Luka Dončić", "Šarić, Dario", "Ömer Aşık", None]
    got = [r.n for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, t string").orderBy("i").select(E.search_name("t").alias("n")).collect()]
    assert got == ["nikola jokic", "luka doncic", "saric dario", "omer as k", None]
