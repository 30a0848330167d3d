"""Operator 2 against brute force over all windows."""

import collections
import hashlib

import numpy as np
import pytest

from plumbline.llm import substrings


def brute(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(3)
    word = lambda n, v=300: [f"w{x}" for x in rng.integers(0, v, n)]
    passage, long = word(60), word(200)
    texts = [None, "", "one two", "same " * 40, "same " * 37, "a b " * 60, "é😀 " * 36]
    texts += [" ".join(word(20) + passage[: 30 + i] + word(15)) for i in range(0, 30, 3)]
    texts += [" ".join(long)] * 3 + [" ".join(long[:90] + ["x"] + long[90:]), "\n".join(long[50:]), " ".join(long[10:44]), " ".join(long[10:45])]
    texts += [" ".join(word(120, 2)) for _ in range(4)] + [" ".join(word(300, 3))]
    texts += [" ".join(word(10) + passage[5:45] + word(10) + passage[5:45])]
    return texts


@pytest.mark.parametrize("hot", [2000, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = corpus()
    table = spark.createDataFrame([(i, t, "k", 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, d string, h int, piece string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(table.repartition(3)).collect()}
    assert got == dict(enumerate(brute(texts, 35)))


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, "a " + text), (None, None), (2, "short")]
    got = sorted((r.n_words, r.n_removed) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (40, 40), (40, 40), (41, 40)]
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reference_spans(spark):
    ref = [" ".join(f"r{i}" for i in range(50)), "x y z"]
    rows = [(1, "a b " + " ".join(f"r{i}" for i in range(5, 45)) + " c"), (2, " ".join(f"r{i}" for i in range(34))), (3, None)]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substrings.remove_reference_spans(spark.createDataFrame(rows, "doc_id long, text string"), ref).collect()}
    assert got[1] == (40, "a b c") and got[2][0] == 0 and got[3] == (0, "")


def test_automaton_counts_every_substring():
    rng = np.random.default_rng(8)
    for _ in range(60):
        texts = [rng.integers(0, 2, rng.integers(1, 14)).tolist() for _ in range(4)]
        a = substrings.Automaton()
        for t in texts:
            a.add(t)
        for n in range(1, 6):
            seen = collections.Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
            for t in texts:
                covered = {j for s, e in a.spans(t, n, 2) for j in range(s, e)}
                assert covered == {j for i in range(len(t) - n + 1) if seen[tuple(t[i : i + n])] > 1 for j in range(i, i + n)}
