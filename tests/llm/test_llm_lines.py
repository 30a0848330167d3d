"""Operators 7 and 8 against brute force."""

import collections

import numpy as np
import pytest

from plumbline.llm import decontam, lines

SCHEMA = "doc_id long, text string, place int, line string, x int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)


# --- 8


def brute_lines(rows, t=0.8):
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    seen, out = [], {}
    for d, text in order:
        kept = []
        for line in (text or "").split("\n"):
            s = set(line.encode().split())
            gone = bool(s) and any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen)
            if s:
                seen.append(s)
            if not gone:
                kept.append(line)
        out[d] = (len((text or "").split("\n")), None if text is None and len(kept) == 1 else "\n".join(kept))
    return out


def line_rows():
    rng = np.random.default_rng(9)
    word = lambda n, v: [f"w{int(x ** 2 * v)}" for x in rng.random(n)]
    base = [word(int(n), 400) for n in rng.integers(1, 40, 25)]
    rows = [(0, None), (1, ""), (2, "\n \n"), (3, "same line here"), (4, "same line here\n\nsame  line\there"), (5, "here line same"), (6, "é😀 x\r\n" + "y " * 500)]
    for i in range(60):
        own = []
        for b in rng.choice(25, rng.integers(1, 6)):
            line = list(base[b])
            for at in rng.integers(0, len(line), rng.integers(0, 4)):
                line[at] = word(1, 400)[0]
            own.append(" ".join(line) + (" extra" if rng.random() < 0.2 else ""))
        rows.append((i + 10, "\n".join(own)))
    rows.append((-5, rows[20][1]))
    return rows


@pytest.mark.parametrize("bits,near", [(18, 2), (2, 0)])
def test_line_dedup_against_brute_force(spark, monkeypatch, bits, near):
    """Whatever the order of words and the first candidates are."""
    monkeypatch.setattr(lines.rarity, "__defaults__", (bits,))
    monkeypatch.setattr(lines.tokens, "__defaults__", (bits,))
    monkeypatch.setattr(lines.postings, "__defaults__", (near, ()))
    rows = line_rows()
    out = lines.dedup_lines(table(spark, rows).repartition(3))
    assert out.columns == ["doc_id", "text", "place", "line", "x", "__n_lines", "__n_removed"]
    got = {r.doc_id: (r["__n_lines"], r.text) for r in out.collect()}
    assert got == brute_lines(rows)


def test_lines_of_a_dense_group(spark):
    """Near copies of one another, of which many are under the threshold to most."""
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.integers(0, 40, rng.integers(2, 7)):
            own[at] = f"x{rng.integers(0, 1 << 30)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r["__n_lines"], r.text) for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_in_slices_by_size(spark, monkeypatch):
    """Similar lines on both sides of a slice's bound, in either order, with bitmaps of several words."""
    monkeypatch.setattr(lines, "SLICES", ((8, 1), (11, 2), (30, 4), (1 << 31, 8)))
    rng = np.random.default_rng(21)
    rows = line_rows()
    for i in range(40):
        n = int(rng.integers(6, 60))
        base = [f"s{i}_{k}" for k in range(n)]
        cut_short = base[: n - int(rng.integers(0, n // 4 + 1))] + [f"e{i}"] * int(rng.integers(0, 2))
        rows += [(1000 + 2 * i, " ".join(base if i % 2 else cut_short)), (1001 + 2 * i, " ".join(cut_short if i % 2 else base))]
    got = {r.doc_id: (r["__n_lines"], r.text) for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_long_lines_of_common_words_are_no_candidates(spark):
    """Unlike lines of over 56 words share prefix tokens; 64 bits told few of them apart, and pairs grew with the square of the lines."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(22)
    rows = [(i, " ".join(f"v{x}" for x in rng.choice(1500, int(rng.integers(150, 170)), replace=False))) for i in range(150)]
    classes = lines.line_classes(table(spark, rows), lines.Places(table(spark, rows)))
    ranks = lines.rarity(table(spark, rows))
    words = next(w for most, w in lines.SLICES if most >= 170)
    shared = lines.postings(lines.prefixes(lines.tokens(classes, ranks), 0.8, words), 0.8, also=("prev",))
    none = spark.range(0).select(F.col("id").alias("place"))
    assert lines.left_pairs(shared.drop("found"), none, 0.8).count() == 0


def test_the_first_pass_reads_two_marks_a_line(spark):
    """Whatever its length (it read every token of a prefix before), and near copies meet there."""
    base = [f"b{i}" for i in range(200)]
    docs = table(spark, [(i, " ".join([*base[:-1], f"own{i}"])) for i in range(30)])
    sets = lines.prefixed(lines.tokens(lines.line_classes(docs, lines.Places(docs)), lines.rarity(docs)), 0.8, 4).collect()
    assert [len(r.marks) for r in sets] == [2] * 30 and all(len(r.prefix) == 41 for r in sets)
    assert len({m for r in sets for m in r.marks}) < 30


def test_lines_are_parted_into_words_once(spark):
    """What follows reads the hashes of the classes, not their lines (they were parted four times: counted, ordered in slices and verified)."""
    docs = table(spark, [(1, " a\tb  a \n\n \x0b"), (2, "b a\r\nc"), (3, "c  \nd")])
    classes = lines.line_classes(docs, lines.Places(docs)).cache()
    assert classes.columns == ["place", "h"]
    assert sorted(len(r.h) for r in classes.collect()) == [0, 0, 1, 1, 1, 2, 2]
    gone = {r.place for r in lines.repeated_places(classes, lines.rarity(classes)).collect()}
    assert [lines.Places(docs).bits] == [4] and gone == {(2 << 4) + 0, (3 << 4) + 0}


def test_sketches_and_their_folds_against_plain_numbers(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    sets = {i: [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)] for i, n in enumerate([1, 7, 64, 300])}
    rows = lines.sketches(spark.createDataFrame([(i, v) for i, v in sets.items()] + [(9, [])], "place long, h array<long>"))
    got = {r.place: r for r in rows.select("*", *[lines.folded(F.col("bits"), w).alias(f"f{w}") for w in (1, 2, 4)]).collect()}
    assert set(got) == set(sets)
    for i, v in sets.items():
        assert got[i].n == len(v) and len(got[i].marks) == 2
        for words, bits in ((1, [got[i].f1]), (2, got[i].f2), (4, got[i].f4), (8, got[i].bits)):
            want = [0] * words
            for h in v:
                want[(h >> 6) % words] ^= 1 << (h & 63)
            assert [b & (1 << 64) - 1 for b in bits] == want


def test_very_long_lines(spark):
    v = [f"z{i}" for i in range(60_000)]
    rows = [(1, " ".join(v)), (2, " ".join(v[:50_000])), (3, " ".join(v[:40_000])), (4, "q " * 90_000)]
    got = {r.doc_id: (r["__n_lines"], r.text) for r in lines.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_of_odd_tables(spark):
    far = [(1 << 62, "a b c\nd"), (-(1 << 62), "a b c"), (None, "d")]
    assert sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(table(spark, far)).collect()) == [(-(1 << 62), "a b c"), (0, "d"), (1 << 62, "")]
    assert lines.dedup_lines(table(spark, [])).count() == 0
    got = lines.dedup_lines(table(spark, [(None, "a b c"), (7, "a b c"), (7, "a b c"), (9, "a b c")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a b c"), (7, ""), (7, ""), (9, "")]


# --- 7


def brute_leaks(docs, items, t=0.8):
    def sh(w):
        return collections.Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, q in items:
            v = (q or "").lower().split()
            if not v or not w:
                continue
            n = min(len(v), len(w))
            best = max(sum((a & b).values()) / sum((a | b).values()) for b in [sh(v)] for s in range(len(w) - n + 1) for a in [sh(w[s : s + n])])
            if best >= t - 1e-12:
                out[d, i] = round(best, 9)
    return out


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda n, v=500: [f"t{x}" for x in rng.integers(0, v, n)]
    items = [(i, " ".join(word(int(n)))) for i, n in enumerate(rng.integers(12, 60, 12))] + [(20, "tiny one"), (21, None), (22, "the " * 14)]
    docs = [(0, None), (1, ""), (2, "so a Tiny  one"), (3, "tiny one"), (4, " ".join(word(300))), (5, "the " * 30)]
    for k, (_, q) in enumerate(items[:12]):
        v = q.split()
        docs.append((10 + k, " ".join(word(30) + v + word(30))))
        near = list(v)
        near[0] = "changed"
        docs.append((30 + k, "\n".join(word(7) + near)))
        cut_short = v[: int(len(v) * 0.93)]
        docs.append((50 + k, " ".join(cut_short)))
        docs.append((70 + k, " ".join(word(5) + v[len(v) // 2 :] + v[: len(v) // 2] + word(9))))
        drop = list(v)
        del drop[len(v) // 2]
        docs.append((90 + k, " ".join(word(3) + drop + word(40))))
    bench = spark.createDataFrame([(i, q, 1) for i, q in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(table(spark, docs), bench).collect()}
    assert got == brute_leaks(docs, items)
    left = {r.doc_id for r in decontam.clean(table(spark, docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_leak_of_an_item_of_over_4096_shingles(spark):
    v = [f"z{i}" for i in range(4700)]
    bench = spark.createDataFrame([(1, " ".join(v))], "item_id long, text string")
    got = decontam.contaminated(table(spark, [(1, " ".join(v)), (2, " ".join(v[:3000]))]), bench).collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_words, r.similarity) for r in got] == [(1, 1, 0, 4700, 1.0)]


def test_no_leaks_in_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(table(spark, []), bench).count() == 0
    assert decontam.contaminated(table(spark, [(1, "a b")]), bench.where("false")).count() == 0


def test_simhash_in_sql_is_that_of_python(spark):
    from pyspark.sql import functions as F

    from plumbline.llm.simhash import majority

    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, 9)
    got = spark.range(1).select(decontam.simhash(F.array(*[F.lit(int(x)) for x in h])).alias("f")).first().f
    assert got & (1 << 64) - 1 == majority(h.view(np.uint64))
