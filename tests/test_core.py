"""Functions and operators on small hand-made tables."""

import random
import sqlite3
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.operators import calibration as C
from plumbline.operators import models as M
from plumbline.operators import population as P
from plumbline.operators import relational as R
from plumbline.operators import scoring as K
from plumbline.operators import sequences as S
from plumbline.operators import simulation as X
from plumbline.sources import sinks, tables
from plumbline.streaming import ingest


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


@pytest.mark.parametrize("opportunity,least,share,games", [(82, 5, 0.2, 17), (50, 5, 0.2, 10), (66, 5, 0.2, 14), (23, 2, 0.1, 3), (11, 2, 0.1, 2)])
def test_qualification_thresholds(spark, opportunity, least, share, games):
    r = one(spark, a=E.qualifies(F.lit(games), F.lit(opportunity), least, share), b=E.qualifies(F.lit(games - 1), F.lit(opportunity), least, share))
    assert (r.a, r.b) == (True, False)


def test_ratios_and_z_are_null_without_a_scale(spark):
    r = one(spark, a=E.safe_ratio(F.lit(3), F.lit(0)), b=E.safe_ratio(F.lit(3), F.lit(2)), c=E.z_score(F.lit(1.0), F.lit(0.0), F.lit(0.0)), d=E.robust_z(F.lit(2.0), F.lit(1.0), F.lit(0.5)), e=E.relative_index(F.lit(3.0), F.lit(0.0)), f=E.per_36(F.lit(10), F.lit(20)), g=E.true_shooting(F.lit(20.0), F.lit(10.0), F.lit(5.0)))
    assert r.a is None and r.b == 1.5 and r.c is None and r.e is None and r.f == 18.0
    assert abs(r.d - 2 * E.ROBUST_Z_ERA) < 1e-12 and abs(r.g - 20 / 24.4) < 1e-12


def test_strict_and_tolerant_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3), ("c", None)], "k string, v int")
    got = {r.k: (r.s, r.t, r.c) for r in df.groupBy("k").agg(E.strict_sum("v").alias("s"), E.nullable_sum("v").alias("t"), E.coverage_class(F.count("v"), F.count("*")).alias("c")).collect()}
    assert got == {"a": (None, 1, "SPARSE"), "b": (5, 5, "RELIABLE"), "c": (None, None, "UNKNOWN")}


def test_scores_under_missingness(spark):
    df = spark.createDataFrame([(1.0, 0.5), (None, 0.5), (None, None)], "a double, b double")
    w = {"a": 0.75, "b": 0.25}
    got = df.select(*[E.combine(w, p).alias(p) for p in ("complete", "renormalise", "zero", "neutral")], E.weighted_observed(w, ("a",)).alias("req"), E.stronger_secondary("a", "b").alias("two")).collect()
    assert tuple(got[0]) == (0.875, 0.875, 0.875, 0.875, 0.875, 0.825)
    assert tuple(got[1]) == (None, 0.5, 0.125, 0.5, None, 0.5)
    assert tuple(got[2]) == (None, None, 0.0, 0.5, None, None)


def test_ids_and_hashes(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    r = one(spark, a=E.canonical_id("player", "p", F.lit(76), ns))
    assert r.a == str(uuid.uuid5(uuid.UUID(ns), "player:p:76"))
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    f = lambda d: d.agg(E.fingerprint("a", "b").alias("f")).first().f
    assert f(df) == f(df.orderBy(F.desc("a"))) != f(df.withColumn("b", F.lit("x")))


def test_parsing(spark):
    r = one(
        spark, a=E.season_start(F.lit("1999-00")), b=E.season_start(F.lit("1999-01")), c=E.season_label(F.lit(2009)), d=E.parse_minutes(F.lit("12:30")), e=E.parse_minutes(F.lit("x")), f=E.whole_number(F.lit("12.0")),
        g=E.whole_number(F.lit("12.5")), h=E.height_cm(F.lit("7-2")), i=E.search_name(F.lit("  Nikola JOKIĆ-Éà ")), k=E.age_on(F.lit("2000-02-01").cast("date"), F.lit("2001-02-01").cast("date")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.k) == (1999, None, "2009-10", 12.5, None, 12, None, 218.4, None)
    assert r.i == "nikola jokic ea"


def test_midranks_against_an_external_population(spark):
    random.seed(1)
    rows = [(i, random.choice([None, *range(6)]), random.random() < 0.6) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v int, ref boolean")
    ref = [v for _, v, f in rows if f and v is not None]
    for r in P.with_midranks(df, [], "v", F.col("ref")).withColumn("s", P.midrank_share()).withColumn("t", P.midrank_score()).collect():
        if r.v is None:
            assert r.s is None and r.t is None
            continue
        below, equal = sum(x < r.v for x in ref), sum(x == r.v for x in ref)
        assert abs(r.s - (below + equal / 2) / len(ref)) < 1e-12
        assert abs(r.t - min(100, max(0, 100 * (below + (equal - 1) / 2) / (len(ref) - 1)))) < 1e-9


def test_distribution(spark):
    v = [1.0, 2.0, 4.0, 8.0]
    r = P.distribution(spark.createDataFrame([(1, x) for x in v] + [(1, None), (1, float("nan"))], "k int, v double"), ["k"], "v").first()
    assert (r.n, r.mean, r.median, r.q1, r.q3, r.mad) == (4, 3.75, 3.0, 1.75, 5.0, 1.5)
    assert abs(r.sd - np.std(v)) < 1e-12


SEASONS = [("a", 2000, 0.5), ("a", 2001, 0.9), ("a", 2002, 0.9), ("a", 2004, 1.0), ("a", 2005, 0.2), ("b", 2003, 0.4)]


def seasons(spark):
    return spark.createDataFrame(SEASONS, "e string, p int, v double")


def test_sequences(spark):
    s = seasons(spark)
    gaps = S.with_gaps(s, "e", "p").where("e = 'a'").orderBy("p").collect()
    assert [(r.p, r.appeared, r.appearance_index) for r in gaps] == [(2000, True, 1), (2001, True, 2), (2002, True, 3), (2003, False, 3), (2004, True, 4), (2005, True, 5)]
    assert [(r.e, r.start, r.end) for r in S.best_window(s, "e", "p", "v", 3).collect()] == [("a", 2000, 2002)]
    assert {(r.e, r.start) for r in S.best_window(s, "e", "p", "v", 1).collect()} == {("a", 2004), ("b", 2003)}
    assert [(r.e, r.start, r.length) for r in S.longest_run(s, "e", "p", F.col("v") >= 0.5).collect() if r.e == "a"] == [("a", 2000, 3)]
    best = {r.e: (r["mean"], r.periods) for r in S.best_periods(s, "e", "p", "v", 2).collect()}
    assert best["a"] == (0.95, [2001, 2004]) and best["b"][0] is None
    assert {(r.p, r.v, r.next_v) for r in S.adjacent(s, "e", "p", ["v"]).collect()} == {(2000, 0.5, 0.9), (2001, 0.9, 0.9), (2004, 1.0, 0.2)}
    area = s.groupBy("e").agg(S.area_above("v", 0.8).alias("x"))
    assert abs(area.where("e = 'a'").first().x - 0.4) < 1e-12


def test_ranks_and_leaders(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, None)], "id int, v int")
    assert {r.id: r["rank"] for r in P.competition_rank(df, [], "v").collect()} == {1: 3, 2: 1, 3: 1, 4: None}
    assert {r.id: (r["rank"], r.tie_size) for r in P.deterministic_rank(df, [], "v", "id").collect()}[3] == (2, 2)
    assert P.leaders(df.withColumn("k", F.lit(1)), ["k"], "v", "id").first().leaders == [2, 3]


def test_global_position(spark):
    random.seed(5)
    df = spark.createDataFrame([(i, random.choice([None, 1, 2, 3])) for i in range(200)], "id int, v int").repartition(5)
    got = {r.id: r.position for r in P.global_position(df, [F.col("v").desc_nulls_last(), F.col("id")]).collect()}
    order = sorted(((-(r.v or 0), r.id) for r in df.collect()))
    assert [got[i] for _, i in order] == list(range(1, 201))


def test_reconcile_and_merge(spark):
    a = spark.createDataFrame([(1, 5, None), (2, 5, 1), (3, 1, 1)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 5, None), (2, 7, 2), (4, 1, 1)], "k int, x int, y int")
    got = {(r.k, r.field): r.status for r in R.reconcile(a, b, ["k"], ["x", "y"], 1.0).collect()}
    assert got == {(1, "x"): "EXACT", (1, "y"): "BOTH_NULL", (2, "x"): "MISMATCH", (2, "y"): "TOLERANCE", (3, "x"): "LEFT_ONLY", (3, "y"): "LEFT_ONLY", (4, "x"): "RIGHT_ONLY", (4, "y"): "RIGHT_ONLY"}
    m = {r.k: (r.x, r.x_source, r.y, r.y_source) for r in R.precedence([("a", a), ("b", b)], ["k"], ["x", "y"]).collect()}
    assert m[1] == (5, "a", None, None) and m[4] == (1, "b", 1, "b")


def test_validity_windows(spark):
    f = spark.createDataFrame([(1, 1995), (1, 2005), (2, 2000)], "id int, p int")
    w = spark.createDataFrame([(1, 1990, 1999, "x"), (1, 2000, None, "y")], "id int, start int, end int, label string")
    assert {(r.id, r.p, r.label) for r in R.valid_at(f, w, "id", "p").collect()} == {(1, 1995, "x"), (1, 2005, "y"), (2, 2000, None)}


def test_scoring(spark):
    w = {"a": 0.6, "b": 0.4}
    p = K.perturbed(w, "a", 1.2)
    assert abs(sum(p.values()) - 1) < 1e-12 and abs(p["a"] - 0.72) < 1e-12
    assert K.without(w, "a") == {"b": 1.0}
    df = spark.createDataFrame([(float(i), float((i * 7) % 5)) for i in range(20)], "a double, b double")
    shares = {r.part: r.share for r in K.variance_shares(df, w).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9


def test_calibration(spark):
    assert C.pava([1, 2, 3, 4], [1.0, 3.0, 2.0, 4.0]) == ([1, 2, 3, 4], [1.0, 2.5, 2.5, 4.0])
    assert C.pava([1, 1, 2], [1.0, 3.0, 1.0]) == ([1, 2], [5 / 3, 5 / 3])
    e = spark.createDataFrame([(1, float(x)) for x in range(1, 11)], "k int, e double")
    assert C.conformal_radius(e, ["k"], "e", 0.8).first().radius == 9.0  # ceil(11 * 0.8)
    assert C.conformal_radius(e, ["k"], "e", 0.99).first().radius == 10.0
    knots = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (2.0, 10.0)], "x double, y double")
    got = [r.linked for r in C.interpolate(spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (3.0,), (None,)], "v double"), "v", knots).collect()]
    assert got == [0.0, 5.0, 10.0, 10.0, None]


def test_ridge_out_of_fold(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=200), rng.normal(size=200)
    y = 2 * x - z + 3
    df = spark.createDataFrame([(int(i % 4), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))], "fold int, x double, z double, y double")
    out = C.grouped_oof_ridge(df, "fold", ["x", "z"], "y", 1e-9).collect()
    assert max(abs(r.oof - r.y) for r in out) < 1e-6


def test_models(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 5)) * [3, 1, 1, 1, 0.5]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>").repartition(4)
    n, mean, cov = M.vector_moments(df, "v", 5)
    assert n == 300 and np.allclose(mean, v.mean(0)) and np.allclose(cov, np.cov(v.T, ddof=0))
    values, load = M.pca(df, "v", 5)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(v.T, ddof=0)))[::-1]) and np.allclose(load @ load.T, cov)
    assert M.adjusted_rand(spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "a int, b int"), "a", "b").first().ari == 1.0
    t = M.kendall_tau(spark.createDataFrame([(1, 1, 1), (2, 2, 3), (3, 3, 2)], "k int, a int, b int"), "k", "a", "b").first()
    assert (t.concordant, t.discordant) == (2, 1)


def test_kmeans(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(40, 2)) + c for c in ([0, 0], [20, 0], [0, 20])])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, v array<double>")
    got = {r.id: r.cluster for r in M.kmeans(df, "id", "v", v[[0, 40, 80]])[0].collect()}
    assert [len({got[i] for i in range(a, a + 40)}) for a in (0, 40, 80)] == [1, 1, 1] and len(set(got.values())) == 3


def test_simulation(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 1.0), (2, 2, 3.0)], "draw int, k int, s double")
    r = X.rank_within_draws(d, "draw", "s", "k")
    assert {(x.draw, x.k): x["rank"] for x in r.collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 2, (2, 2): 1}
    assert X.pair_probability(d, "draw", "k", "s", d.select("k").distinct()).first().p == 0.25
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    assert {(x.node, x.component, x.size) for x in X.cycles(edges).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1)}


def test_result_sets(spark):
    good = '{"resultSets":[{"name":"x","headers":["A","B"],"rowSet":[["1","2"],["3"]]},{"name":"y","headers":["A"],"rowSet":[["9"]]}]}'
    df = spark.createDataFrame([(1, good), (2, "broken"), (3, '{"resultSets":[]}')], "id int, p string")
    assert [(r.A, r.B, r.bad_width) for r in tables.result_rows(df, "p", ["A", "B"]).collect()] == [("1", "2", False), (None, None, True)]
    assert [(r.id, r.A) for r in tables.result_rows(df, "p", ["A"], "y", ["id"]).collect()] == [(1, "9")]


def test_rosters(spark):
    p = '{"home":{"teamId":"1","players":[{"personId":"7","name":"A B","minutes":"1:00"},{"personId":"8","name":" "}]},"away":{"teamId":"2","players":[]}}'
    assert [(r.team_id, r.personId) for r in tables.roster_rows(spark.createDataFrame([(p,)], "p string"), "p").collect()] == [("1", "7")]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.execute("INSERT INTO t VALUES (1, 'x'), (2, NULL)")
    assert [tuple(r) for r in tables.read_sqlite(spark, path, "t", "a long, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        tables.read_sqlite(spark, path, "u", "a long")


def test_write_once_and_partitions(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    path = str(tmp_path / "once")
    assert sinks.write_once(df, path) and not sinks.write_once(df.repartition(5), path)
    with pytest.raises(ValueError):
        sinks.write_once(df.withColumn("k", F.lit(1)), path)
    parts = str(tmp_path / "parts")
    sinks.write_partitioned(df, parts, ["k"])
    assert tables.read_partition(spark, parts, k=1).count() == 33
    srt = str(tmp_path / "sorted")
    sinks.write_sorted(df.orderBy(F.desc("id")), srt, ["id"], 3)
    assert spark.read.parquet(srt).count() == 100
    sinks.write_report({"b": 1, "a": [2]}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().index('"a"') < (tmp_path / "r.json").read_text().index('"b"')
    with pytest.raises(ValueError):
        sinks.write_report({"a": float("nan")}, str(tmp_path / "r.json"))


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    df.unionByName(df.limit(5)).repartition(3).write.parquet(src)
    table, check = str(tmp_path / "table"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.event_stream(spark, src, df.schema), table, check, ["id"])
        assert spark.read.parquet(table).count() == 40
    out = str(tmp_path / "out")
    ingest.run_to_table(ingest.windowed(ingest.event_stream(spark, src, df.schema), "t", ["k"], "10 minutes", "5 minutes"), out, str(tmp_path / "check2"))
    got = {(str(r.start), r.k): r.n for r in spark.read.parquet(out).collect()}
    assert got and ("2024-01-01 00:30:00", "a") not in got  # its window isn't final


def test_ties_are_rounded_as_the_sql_rounds_them(spark):
    """Doubles whose shortest form is a tie, but whose product with the power of ten is not, and the other way round."""
    duckdb = pytest.importorskip("duckdb")
    x = [k / 1e9 for k in range(16_000_500, 1_050_000_500, 3_001_000)] + [0.65 * (k / 1e9) + 0.35 * ((k + 70_000) / 1e9) for k in range(10, 1_000_000_000, 2_000_003)] + [-0.0000005, 2.5e-6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    got = [tuple(r) for r in df.select("i", E.round_scaled("x", 6), E.round_scaled("x", 9)).orderBy("i").collect()]
    rows = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(x))
    assert got == duckdb.sql(f"SELECT i, round(x, 6), round(x, 9) FROM (VALUES {rows}) t(i, x) ORDER BY i").fetchall()


def test_sums_in_the_order_of_a_key(spark):
    rows = [(1, k, v) for k, v in ((1, 1e16), (2, 1.0), (3, None), (4, -1e16), (5, 0.25))] + [(2, 1, None)]
    for own in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(own, "g int, k int, v double").coalesce(1)
        assert [tuple(r) for r in df.groupBy("g").agg(E.sum_by("v", "k"), E.avg_by("v", "k")).orderBy("g").collect()] == [(1, 0.25, 0.0625), (2, None, None)]


def test_comparisons_never_broadcast_draws(spark, tmp_path):
    """Entities in a small file, whose draws are many times their size."""
    from plumbline.operators import serving as V

    spark.range(50).selectExpr("id AS e", "id * 1.0D AS c", "1.0D AS w", "-1.0D AS lower_90", "9.0D AS upper_90").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    out = V.comparisons(e.selectExpr("e AS a", "e + 1 AS b"), e, X.draws(e, "e", "c", "w", 20), "e", "draw", "score", ["c"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and all("Inner, BuildLeft" not in x and "draw" not in x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    assert out.count() == 49
