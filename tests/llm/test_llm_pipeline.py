"""Operator 5, near-duplicate groups, and the pipeline's stages on small tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import quality, registry, simhash

SMALL = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, place int, fps string"


def prose(rng, n, v=4000):
    return [f"{'abcdefghij'[x % 10]}{x}e" for x in (rng.random(n) ** 2 * v).astype(int)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "k") for i, t in rows], COLUMNS)


def corpus():
    rng = np.random.default_rng(11)
    good = [(i, " ".join(prose(rng, 150)) + ".\n" + " ".join(prose(rng, 60)) + ".") for i in range(120)]
    bad = [(200 + i, (w := prose(rng, 1)[0]) and " ".join([w] * 80)) for i in range(25)] + [(230 + i, " ".join(x.upper() + "!!" for x in prose(rng, 80))) for i in range(25)]
    return rng, good, bad


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark with planted copies, leaks and junk."""
    rng, good, bad = corpus()
    d = str(tmp_path_factory.mktemp("sf"))
    items = [" ".join(prose(rng, 30)) for _ in range(5)]
    base = prose(rng, 200)
    near = list(base)
    near[100] = "changed"
    extra = [(300, " ".join(base)), (301, " ".join(near)), (302, good[5][1]), (303, " ".join(prose(rng, 60) + items[2].split() + prose(rng, 60)) + ".\n" + " ".join(prose(rng, 60)) + "."), (304, None), (305, "")]
    table(spark, good + bad + extra).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_quality_scores(spark, folder):
    got = {r.doc_id: r for r in registry.op5_pairwise_quality(spark, folder).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].predicted == 1 for i in range(120)) and all(got[i].predicted == 0 for i in [*range(200, 225), *range(230, 255)])
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


def test_quality_without_a_class_or_rows(spark):
    docs = table(spark, [(1, "a b"), (2, None)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert {r.predicted for r in quality.score(docs, None).collect()} == {1}
    assert quality.keep_good(docs, None).count() == 2
    assert quality.score(docs.where("false"), None).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_quality_on_held_out_rows(spark):
    y = spark.read.parquet(f"{SMALL}/labels.parquet")
    r = registry.op5_pairwise_quality(spark, SMALL).join(y, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).first()
    assert r.a >= 0.97


def brute_groups(rows, k=5, t=0.8):
    sh, root = {}, {}
    for i, text in rows:
        w = (text or "").lower().split()
        sh[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sh)
    for a in ids:
        for b in ids:
            if a < b and len(sh[a] & sh[b]) >= t * len(sh[a] | sh[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicate_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (1004, "one two three")]
    for g in range(25):
        base = prose(rng, 150)
        for c in range(5):
            own = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 4)):
                own[at] = f"q{rng.integers(0, 99)}"
            rows.append((g * 5 + c, " ".join(own)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    expect = brute_groups(rows)
    assert got == expect
    kept = simhash.keep_first(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] == i}
    assert simhash.keep_first(table(spark, rows).where("false")).count() == 0


def test_near_duplicates_of_block_edits(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    rows = []
    for _ in range(40):
        base = fresh(200)
        cut_short, longer, block = base[: int(rng.integers(162, 182))], base + fresh(int(rng.integers(20, 48))), list(base)
        block[90:107] = fresh(17)
        rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((base, cut_short, longer, block))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_near_duplicates_beside_texts_of_the_same_words(spark):
    base = [f"s{i}" for i in range(1200)]
    swapped = list(base)
    swapped[600], swapped[601] = swapped[601], swapped[600]
    shuffled = [base[i] for i in np.random.default_rng(5).permutation(1200)]
    rows = [(1, " ".join(shuffled)), (2, " ".join(base)), (3, " ".join(swapped))]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()} == {1: 1, 2: 2, 3: 2}


def test_near_duplicates_in_crowds_of_like_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 20)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(80):
        base = [f"v{x}" for x in rng.permutation(300)]  # the same words in another order
        near = list(base)
        for at in rng.integers(0, 300, 5):
            near[at] = f"n{rng.integers(0, 1 << 40)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute_groups(rows) and len(set(got.values())) < 160


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        seen[name] = out
        if name != "pack":
            assert out.columns == columns and {r.doc_id for r in out.select("doc_id").collect()} <= ids
            docs = out
    left = {n: {r.doc_id for r in seen[n].select("doc_id").distinct().collect()} for n in seen}
    assert set(range(120)) <= left["quality"] and not left["quality"] & {*range(200, 225), *range(230, 255)}
    lines = {r.doc_id: r for r in seen["lines"].collect()}
    assert lines[302].text == "" and lines[302].n_chars == 0 and lines[5].text
    assert set(range(120)) <= left["near_duplicates"] and not {302, 304, 305} & left["near_duplicates"]  # 301 is the first of the empty
    assert left["near_duplicates"] - left["decontaminate"] == {303}
    assert left["pack"] == left["decontaminate"]


def test_line_stage_removes_lines_with_one_word_changed(spark, folder):
    line = [f"w{i}" for i in range(20)]
    near = [*line[:10], "changed", *line[11:]]
    out = corpus_pipeline.line_stage(spark, table(spark, [(1, " ".join(line)), (2, " ".join(near) + "\nother")]), folder)
    assert {r.doc_id: r.text for r in out.collect()} == {1: " ".join(line), 2: "other"}


def test_run_gives_what_the_stages_give(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 303 not in {r.doc_id for r in out.select("doc_id").collect()}


def test_stages_on_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


