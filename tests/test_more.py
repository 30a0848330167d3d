"""Kernels, constraints, factor models, the HTTP client and release bundles."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels as N
from plumbline.operators import constraints as V
from plumbline.operators import factors as A
from plumbline.sources import http, release, sinks, tables


def test_kernels(spark):
    df = spark.createDataFrame([(0.8, 0.4, 10.0), (0.8, None, 0.0), (None, 0.4, 5.0)], "a double, b double, n double")
    got = df.select(N.joint_scoring("a", "b").alias("s"), N.evidence_form(a=F.col("a").isNotNull(), b=F.col("b").isNotNull()).alias("f"), N.reliability_blend("a", F.lit(0.5), "n").alias("r"), N.strongest_plus(["a", "b"]).alias("t"), N.defense_observed({"a": 0.5, "b": 0.5}).alias("d")).collect()
    assert [round(r.s, 9) if r.s is not None else None for r in got] == [0.66, 0.8, None]
    assert [r.f for r in got] == ["a+b", "a", "b"]
    assert round(got[0].r, 9) == 0.6 and got[1].r == 0.5
    assert [round(r.t, 9) for r in got] == [0.9, 0.8, 0.4] and [round(r.d, 9) for r in got] == [0.6, 0.4, 0.2]


def test_nested_intervals(spark):
    df = spark.createDataFrame([(0.4, 0.6, 0.45, 1.4)], "l1 double, u1 double, l2 double, u2 double")
    r = df.select(*N.nested_intervals([("l1", "u1"), ("l2", "u2")], 0.0, 1.0)).first()
    assert tuple(r) == (0.4, 0.6, 0.4, 1.0)
    assert [c for c in df.select(*N.polynomial(["l1", "u1"])).columns] == ["l1", "u1", "l1_l1", "l1_u1", "u1_u1"]


def test_constraints(spark):
    df = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.6, 0.5), (3, None, 1.5)], "k int, p double, q double")
    rules = {"ordered": F.col("p") <= F.col("q"), "share": F.col("q") <= 1}
    assert {(r.k, r.rule) for r in V.violations(df, rules, ["k"]).collect()} == {(2, "ordered"), (3, "share")}
    assert {(r.rule, r.violations) for r in V.counters(df, rules).collect()} == {("ordered", 1), ("share", 1)}
    with pytest.raises(Exception, match="violated: share"):
        V.require(df.where("k <> 2"), rules).collect()
    assert V.require(df.where("k = 1"), rules).count() == 1
    assert [r.m for r in df.select(V.monotone(["p", "q"]).alias("m")).collect()][:2] == [True, False]
    assert V.schema_drift(df, {"k": "int", "p": "float", "z": "int"}) == ["missing z", "p is double, not float", "unexpected q"]
    p = spark.createDataFrame([(1, 2, 0.7)], "a int, b int, p double")
    assert V.complementary(p, spark.createDataFrame([(2, 1, 0.3)], "a int, b int, p double")).count() == 0
    assert V.complementary(p, spark.createDataFrame([(2, 1, 0.4)], "a int, b int, p double")).count() == 1


def structured(n=180):
    rng = np.random.default_rng(130013)
    f = rng.normal(size=(n, 3))
    return np.repeat(f, 2, axis=1) + 0.3 * rng.normal(size=(n, 6))


def test_factors():
    x = structured()
    own, cut, k = A.parallel_analysis(x, 20)
    assert k == 3 and (own[:3] > cut[:3]).all()
    load, h = A.principal_axis(np.corrcoef(x.T), 3)
    assert load.shape == (6, 3) and np.all((h > 0.7) & (h <= 1))
    turned, r = A.varimax(load)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(turned @ turned.T, load @ load.T)
    assert (np.sort(np.abs(turned), axis=1)[:, -1] > 0.8).all() and (np.sort(np.abs(turned), axis=1)[:, -2] < 0.3).all()
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    good = A.nearest_psd(bad)
    assert np.linalg.eigvalsh(good).min() > -1e-9 and np.allclose(np.diag(good), 1)


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(30, 2)) + c for c in ([0, 0], [15, 0], [0, 15])])
    truth = np.repeat([0, 1, 2], 30)
    assert (A.average_linkage(x, 3) == truth).all()
    m = A.cluster_metrics(x, truth)
    assert m["silhouette"] > 0.7 and m["davies_bouldin"] < 0.8
    g = A.diagonal_gmm(x, 3, seed=1)
    assert abs(g["weights"].sum() - 1) < 1e-9 and g["bic"] > g["aic"]
    same = np.diag([10, 10, 10])
    assert abs(A.adjusted_mutual_information(same) - 1) < 1e-9
    assert abs(A.adjusted_mutual_information(np.full((3, 3), 10))) < 0.05
    with pytest.raises(ValueError):
        A.average_linkage(np.zeros((A.MOST_ROWS + 1, 1)), 2)


def test_draws():
    w = A.simplex_weights(200, 4, 7, 0.05, 0.6)
    assert w.shape == (200, 4) and np.allclose(w.sum(axis=1), 1) and w.min() >= 0.05 and w.max() <= 0.6
    m = np.random.default_rng(1).normal(size=(2, 2500))
    c = A.couple_ranks(m, [[1, 0.8], [0.8, 1]], 3)
    assert np.allclose(np.sort(c, axis=1), np.sort(m, axis=1)) and 0.7 < np.corrcoef(c)[0, 1] < 0.9
    e = A.empirical_marginal(np.random.default_rng(2).normal(size=999), 10.0, 7.0, 15.0, 2001)
    assert abs(np.median(e) - 10) < 0.01 and abs(np.quantile(e, 0.05) - 7) < 0.05 and abs(np.quantile(e, 0.95) - 15) < 0.05


GOOD = '{"resultSets":[{"name":"a","headers":["X"],"rowSet":[["1"]]}]}'


def test_client(tmp_path):
    calls, slept = [], []
    replies = iter([(503, ""), OSError(), (200, GOOD), (404, ""), (200, "no json"), (429, ""), (429, "")])

    def transport(request):
        calls.append(request.endpoint)
        r = next(replies)
        if isinstance(r, OSError):
            raise r
        return r

    limiter = http.RateLimiter(1.0, clock=lambda: 0.0, sleep=slept.append)
    client = http.Client(transport, http.Cache(str(tmp_path)), limiter, tries=3)
    a = client.fetch(http.Request("logs", (("season", "1999"),)))
    assert (a["outcome"], a["tries"], a["from_cache"]) == ("OK", 3, False) and len(slept) >= 4
    assert client.fetch(http.Request("logs", (("season", "1999"),)))["from_cache"]
    assert client.fetch(http.Request("none"))["outcome"] == "CLIENT_ERROR" and client.fetch(http.Request("none"))["from_cache"]
    assert client.fetch(http.Request("bad"))["outcome"] == "MALFORMED"
    limited = http.Client(transport, http.Cache(str(tmp_path)), limiter, tries=2).fetch(http.Request("busy"))
    assert limited["outcome"] == "RATE_LIMITED" and len(calls) == 7
    assert http.Request("x", (("b", "1"), ("a", "2"))).key == http.Request("x", (("a", "2"), ("b", "1"))).key


def test_release_bundles(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("one")
    (src / "sub" / "b.txt").write_text("two")
    first = release.package(str(src), str(tmp_path / "1.tgz"))
    os.utime(src / "a.txt", (1, 1))
    assert release.package(str(src), str(tmp_path / "2.tgz")) == first
    release.unpack(str(tmp_path / "1.tgz"), str(tmp_path / "out"), first)
    assert release.fingerprint(str(tmp_path / "out")) == release.fingerprint(str(src))
    with pytest.raises(ValueError):
        release.unpack(str(tmp_path / "1.tgz"), str(tmp_path / "out"), "0" * 64)
    with pytest.raises(ValueError):
        release.unpack(str(tmp_path / "1.tgz"), str(tmp_path / "out2"), first, most_bytes=2)


def test_read_release(spark, tmp_path):
    folder = str(tmp_path / "rel")
    spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string").coalesce(1).write.parquet(f"{folder}/players.parquet")
    spark.createDataFrame([(1, 1)], "id long, rank long").coalesce(1).write.parquet(f"{folder}/rankings.parquet")
    spec = {"players": {"schema": {"id": "bigint", "name": "string"}, "key": ["id"]}, "rankings": {"schema": {"id": "bigint", "rank": "bigint"}, "key": ["id"], "refers": {"id": ("players", "id")}}}
    assert release.read_release(spark, folder, release.fingerprint(folder), spec)["players"].count() == 2
    with pytest.raises(ValueError):
        release.read_release(spark, folder, "0", spec)
    spec["rankings"]["schema"]["rank"] = "int"
    with pytest.raises(ValueError, match="rank is bigint"):
        release.read_release(spark, folder, release.fingerprint(folder), spec)


def test_migrations():
    ran, done = [], {}
    steps = [("0002", "B"), ("0001", "A")]
    assert release.migrate(steps, done, ran.append) == ["0001", "0002"] and ran == ["A", "B"]
    assert release.migrate([*steps, ("0003", "C")], done, ran.append) == ["0003"]
    with pytest.raises(ValueError):
        release.migrate([("0001", "changed")], done, ran.append)


def test_work_lists_and_json(spark, tmp_path):
    plan = tables.acquisition_plan(spark, 1995, 1997, ["regular"], {"base": 1900, "advanced": 1996})
    assert plan.count() == 5
    done = spark.createDataFrame([(1995, "OK"), (1996, "SERVER_ERROR")], "period int, status string")
    assert {r.period for r in sinks.pending(plan, done, ["period"]).collect()} == {1996, 1997}
    df = spark.createDataFrame([(1, None), (2, "x")], "b int, a string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(rows, key=str) == sorted([{"b": 1}, {"a": "x", "b": 2}], key=str)
    assert "fields" in json.loads(sinks.json_schema(df))
