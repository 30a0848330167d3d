"""Odd rows: nulls, repeated rows, small and empty tables, very long texts, clashing columns."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from plumbline.llm import ann, decontam, packing, quality, simhash, substrings, token_files, urls

DOCS = "doc_id long, text string, fp long, node int, x string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "z") for r in rows], DOCS)


@pytest.mark.parametrize("n", [1, 15, 22])
def test_small_tables_are_searched_whole(spark, n):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 48))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, F.col("id") % 5 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {}
    for q in range(0, n, 5):
        order = sorted((i for i in range(n) if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        if order:
            want[q] = [(k + 1, i) for k, i in enumerate(order)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_an_id_with_two_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") > 0, k=3).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(1, 2, 1.0), (2, 1, 1.0)]


def test_fingerprints_of_rows_without_ids(spark):
    rows = [(None, "a b c d"), (None, "q w e r t y u i o p"), (5, "a b c d"), (5, "a b c d"), (7, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_components(docs(spark, rows)).collect())
    assert len(got) == 5 and (7, 7) in got and got.count((5, 5)) == 2 and (0, 5) in got and (0, 0) in got
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_very_long_texts_are_whole(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[59_900:])), (3, "w1 w2")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.dedup_substrings(docs(spark, rows)).collect()}
    assert got == {1: (60_000, 100), 2: (100, 100), 3: (2, 0)}
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, [(1, " ".join(words)), (2, " ".join(words[:52_000])), (3, " ".join(words[:30_000]))])).collect()}
    assert near == {1: 1, 2: 1, 3: 3}


def test_pairs_are_fitted_to_the_least_loss():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0.6, 1, size=(80, 3)), rng.normal(0, 1, size=(90, 3))
    w = quality.fit_pairs(good, bad)
    pick = np.random.default_rng(5)
    i = np.concatenate([np.repeat(np.arange(80), quality.PARTNERS), pick.integers(0, 80, 90 * quality.PARTNERS)])
    j = np.concatenate([pick.integers(0, 90, 80 * quality.PARTNERS), np.repeat(np.arange(90), quality.PARTNERS)])
    d, v = good[i] - bad[j], np.zeros(3)
    for _ in range(20_000):
        v += 0.5 * (d.T @ (1 / (1 + np.exp(d @ v))) / len(d) - 1e-3 * v)
    assert np.allclose(w, v, atol=1e-4)


def test_scores_against_a_plain_reading(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(["Good", "words", "here.", "and", "there"], 30)) if i % 2 else "!!! ### $$ " * 9) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs(spark, rows), labels)
    again = quality.fit(docs(spark, rows + rows[:7]), labels)  # a repeated row changes nothing
    assert np.allclose(model["w"], again["w"]) and model["at"] == again["at"]
    got = {r.doc_id: r.score for r in quality.score(docs(spark, [*rows, (99, None), (100, "a " * 50_000)]), model).collect()}
    for i, t in [*rows, (99, ""), (100, "a " * 50_000)]:
        z = np.clip((np.array(quality.features(t)) - model["mean"]) / model["scale"], -8, 8) @ model["w"] - model["at"] + np.log(0.7 / 0.3)
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -35, 35)))) < 1e-12


def test_all_labelled_rows_are_learned_from(spark):
    """More than 5,000 of a class, beyond which rows were once left out."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["Good", "words", "here.", "!!"], int(rng.integers(1, 9))))) for i in range(5300)] + [(9000, "Z"), (9001, "## Y")]
    y = [0 if i % 50 == 0 else 1 for i in range(5300)] + [0, 1]
    labels = spark.createDataFrame([(i, k) for (i, _), k in zip(rows, y, strict=True)], "doc_id long, quality int")
    model = quality.fit(docs(spark, rows), labels)
    x = np.array([quality.features(t) for _, t in rows])
    assert np.allclose(model["mean"], x.mean(axis=0), rtol=1e-9) and np.allclose(model["scale"], np.maximum(x.std(axis=0), 1e-6), rtol=1e-9)
    s = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
    cost = lambda at: 2 * np.mean(s[np.array(y) == 1] < at) + np.mean(s[np.array(y) == 0] >= at)
    assert cost(model["at"]) <= min(cost((a + b) / 2) for a, b in zip(np.unique(s), np.unique(s)[1:], strict=False)) + 1e-9


@pytest.mark.parametrize("n_good,n_bad", [(150, 140), (2, 300), (300, 1), (3, 3)])
def test_every_row_has_its_pairs_in_one_block(spark, monkeypatch, n_good, n_bad):
    monkeypatch.setattr(quality, "BLOCK_ROWS", 64)
    monkeypatch.setattr(quality, "BLOCK_LEAST", 16)
    rng = np.random.default_rng(n_good)
    y = [1.0] * n_good + [0.0] * n_bad
    x = rng.normal(size=(len(y), quality.N_FEATURES)) + np.array(y)[:, None] * 0.4
    rows = spark.createDataFrame([(i, [float(v) for v in r], k) for i, (r, k) in enumerate(zip(x, y, strict=True))], "doc_id long, x array<double>, y double")
    dealt = quality.blocks(rows.repartition(3), n_good, n_bad, np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES)).cache()
    got = {1: [], 0: []}
    pairs = []
    for r in dealt.collect():
        good, bad = (np.frombuffer(r[k], np.float64).reshape(-1, quality.N_FEATURES) for k in ("good", "bad"))
        assert len(good) and len(bad)
        got[1] += [tuple(v) for v in good[: r.own_good]]
        got[0] += [tuple(v) for v in bad[: r.own_bad]]
        pairs.append(quality.differences(good, bad, np.random.default_rng([5, r.g]), r.own_good, r.own_bad))
    for k in (1, 0):
        assert sorted(got[k]) == sorted(tuple(v) for v, label in zip(np.clip(x, -8, 8), y, strict=True) if label == k)
    d = np.concatenate(pairs)
    assert len(d) == quality.PARTNERS * len(y)
    w = quality.fit_blocks(dealt)
    p = 1 / (1 + np.exp(d @ w))
    assert np.abs(d.T @ p / len(d) - 1e-3 * w).max() < 1e-6  # the loss is least where its slope is zero


def test_threshold_against_all_cuts(spark):
    rng = np.random.default_rng(3)
    for n in (2, 9, 400):
        s, y = np.round(rng.normal(size=n), 1), (np.arange(n) % 3 == 0).astype(float)
        s = s + y * 0.5
        at = quality.threshold(spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y, strict=True)], "s double, y double").repartition(3))
        cost = lambda c: 2 * np.mean(s[y == 1] < c) + np.mean(s[y == 0] >= c)
        v = np.unique(s)
        assert abs(cost(at) - min(cost(c) for c in [v[0] - 1, *(v[1:] + v[:-1]) / 2])) < 1e-12


def test_rules_that_repeat_and_pages_without_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.com/x", "h"), (1, "http://a.com/x", "h"), (1, None, "h"), (2, "nothing", "h")], "page_id long, url string, host string")
    rules = urls.rules_table(spark, [("block", "a.com/x"), ("allow", "a.com/x"), ("block", "com/")])
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in urls.judge_urls(pages, rules).collect()) == [(0, "a.com/x", "allow"), (1, "", "allow"), (1, "a.com/x", "allow"), (2, "", "allow")]
    assert {r.verdict for r in urls.judge_urls(pages, rules.where("false")).collect()} == {"allow"}
    assert urls.judge_urls(pages.where("false"), rules).count() == 0


def test_leaks_in_rows_without_ids(spark):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (None, "n1 n2 n3 n4 n5 n6 n7 n8"), (3, None)], "item_id long, text string")
    rows = [(None, item), (None, "clean words only"), (4, item), (4, item), (4, "something else"), (5, None), (6, "x n1 n2 n3 n4 n5 n6 n7 n8 y")]
    left = sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(docs(spark, rows), bench).collect())
    assert left == [(0, "clean words only"), (4, "something else"), (5, "")]
    found = sorted((r.doc_id or 0, r.item_id or 0) for r in decontam.contaminated(docs(spark, rows), bench).collect())
    assert found == [(0, 1), (4, 1), (6, 0)]


def test_pieces_of_rows_without_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "a b c"), (None, None), (3, "same text"), (3, "same text"), (3, "another")]
    out = packing.pack_documents(docs(spark, rows), path, capacity=16).collect()
    assert len(out) == 5 and sorted(r.doc_id or 0 for r in out) == [0, 0, 3, 3, 3]
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert all(a[1] == b[0] for s in spans.values() for a, b in zip(sorted(s), sorted(s)[1:], strict=False)) and all(min(s)[0] == 0 for s in spans.values())


def test_starts_follow_the_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7, f"text number {i} " * (i + 1)) for i in range(8)] + [(None, "first of all"), (None, None), (9, "é ü ß 12.5, (a-b) İstanbul"), (2, "")]
    token_files.write_token_files(docs(spark, rows).repartition(3), str(tmp_path / "o"), path)
    stored, at = [], 0
    for f in sorted(spark.read.orc(str(tmp_path / "o")).inputFiles()):
        stored += [(r.doc_id, r.ids) for r in spark.read.schema("doc_id long, ids array<int>").orc(f).coalesce(1).collect()]
    want = []
    for d, ids in stored:
        want.append((d or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((r.start, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, str(tmp_path / "o")).collect())
    assert got == [(s, d, n, c) for d, s, n, c in want] and [d for d, *_ in want] == sorted(d for d, *_ in want)


def test_stages_on_odd_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    prose = lambda n: " ".join(f"{w}." if k % 9 == 8 else w for k, w in enumerate(rng.choice(["river", "stone", "light", "house", "garden", "morning", "quiet", "road"], n)))
    rows = [(i, prose(60) + "\n" + prose(40)) for i in range(20)] + [(None, prose(50)), (None, prose(50)), (3, prose(70)), (8, None), (9, ""), (50, prose(30_000))]
    rows += rows[:4]
    schema = "doc_id long, text string, lang string, source string, n_chars long, place int, tok long, d long"
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, 2, 3) for d, t in rows], schema)
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name == "pack":
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and out.where("doc_id IS NULL").count() >= 2
        else:
            assert out.columns == frame.columns
            assert name == "quality" or out.where("doc_id IS NULL").count() == 2
