"""Operators 1, 3, 6, 9 and 10 against brute force, round trips and odd tables."""

import zlib

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")
P = pytest.importorskip("public_tokenizers")

from plumbline.llm import ann, packing, simhash, token_files, urls  # noqa: E402
from plumbline.llm.tokens import encoder  # noqa: E402

DOCS = "doc_id long, text string, rank string, ids string, fp string, component string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "clash", "x", "y", "z") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n", "one", "One two", "a b c d e f", "A b C d e f", "a b c d e g", "word " * 3000, "tie", "tie", "é È <|endoftext|> x  y\t\tz\n\n", "x" * 20000]


# --- 3


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components_against_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = list(ODD)
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 120)]
        for _ in range(6):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 3)):
                own[at] = f"v{rng.integers(0, 50)}"
            texts.append(" ".join(own))
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    expect = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(spark, texts)).collect()}
    assert got == {i: (f"{fps[i]:016x}", expect[i]) for i in fps}


def test_covering_masks_cover_every_triple():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(3)]
    assert len(masks) == 15
    rng = np.random.default_rng(0)
    for _ in range(3000):
        bits = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not m & bits for m in masks)


def test_heavy_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 4)
    rng = np.random.default_rng(3)
    fps = {0}
    for _ in range(60):
        x = 0
        for b in rng.choice(64, 2, replace=False):
            x |= 1 << int(b)
        fps.add(x)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    nodes = spark.createDataFrame([(0, f - (1 << 64) if f >> 63 else f) for f in fps.values()], "g int, fp long")
    links = simhash.covering_links(nodes).collect()
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 3 for r in links)
    assert len({r.u for r in links} | {r.v for r in links}) == len(fps)  # all hang on zero


def test_simhash_of_an_empty_table(spark):
    out = simhash.simhash_components(docs(spark, []))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


# --- 1


def brute_nearest(rows, queries, k):
    out = {}
    for q in queries:
        s = sorted((-sum(float(a) * float(b) for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q)
        out[q] = [(i, -d) for d, i in s[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, id int, cell string")


def test_nearest_of_all_when_every_axis_is_probed(spark):
    rng = np.random.default_rng(5)
    rows = {i: [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 3)] for i in range(60)}
    for i in range(60, 70):
        rows[i] = rows[3]
    from pyspark.sql import functions as F

    odd = [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [1.0] * 5), (104, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (3, rows[3])]
    got = ann.search(vectors(spark, [*rows.items(), *odd]), F.col("id") % 3 == 0, k=5, tables=2, probes=64).collect()
    expect = brute_nearest(rows, [i for i in rows if i % 3 == 0], 5)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in mine.items()} == {q: [i for i, _ in v] for q, v in expect.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in expect for a, b in zip(mine[q], expect[q]))


def test_small_blocks_give_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    table = vectors(spark, [(i, rng.normal(size=16).tolist()) for i in range(300)])
    one = {tuple(r) for r in ann.search(table, F.col("id") % 5 == 0).collect()}
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert {tuple(r) for r in ann.search(table, F.col("id") % 5 == 0).collect()} == one


def test_recall(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    centre = rng.normal(size=(10, 64))
    v = centre[rng.integers(0, 10, 3000)] * 0.6 + rng.normal(size=(3000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = ann.search(vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)]), F.col("id") % 20 == 0).collect()
    v = v.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 3000, 20):
        s = v @ v[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / (150 * 20) >= 0.9


def test_no_vectors(spark):
    from pyspark.sql import functions as F

    assert ann.search(vectors(spark, [(1, None)]), F.col("id") % 20 == 0).count() == 0


# --- 6

URLS = [None, "", "no scheme/en/", "http://a.example.com/en/7x", "https://EXAMPLE.com/en/8?q#f", "http://com/en/", "http://xcom/en/", "http://b.net/de/1", "http://example.net/de/8", "http://example.net", "ftp://org/es/#x", "a://b://c/d", "http://u@x.example.org:80/es/"]
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("allow", "net")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(r), r, v) for v, r in RULES for h, p in [urls.split_rule(r)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("rows", [250_000, 3])
def test_url_rules(spark, monkeypatch, rows):
    monkeypatch.setattr(urls, "RANGE_ROWS", rows)
    many = URLS * 3 + [f"http://s{i % 7}.example.{t}/{l}/{i}" for i in range(60) for t in ("com", "net", "org") for l in ("en", "de", "es")]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(many)], "page_id long, url string, host string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.rules_table(spark, RULES)).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(many)}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(pages, urls.rules_table(spark, RULES)).count() == 0


# --- tokens, 9 and 10

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("file", FILES)
def test_ids_are_those_of_the_library(file):
    import random

    from tokenizers import Tokenizer

    random.seed(0)
    some = " \n\t  abZé'sΣσ9.,\x1c\x07\xa0\x00"
    texts = ["".join(random.choice(some) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += [t or "" for t in ODD] + ["it's  we'll", "<|endoftext|> a", "ΑΣ ΟΔΟΣ Σ", "İx ǅ", "e\u0301 \u0301"]
    library = Tokenizer.from_file(P.path(file))
    expect = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder(P.path(file)).ids(texts) == expect


def library_ids(file, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(P.path(file)).encode(text or "", add_special_tokens=False).ids, end]


def test_packing(spark):
    texts = ODD + [f"some words {i} " * (i % 40) for i in range(120)]
    got = packing.pack_documents(docs(spark, texts), P.path(FILES[0]), capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = library_ids(FILES[0], t, 0)
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            assert r.length == 64 or n == 0
            at += r.length
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(docs(spark, []), P.path(FILES[0])).count() == 0


def test_plan_against_document_by_document_best_fit():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 500).tolist()
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in bins if b >= n), default=None)
        if fit is None:
            bins.append(100 - n)
        else:
            bins.remove(fit)
            bins.append(fit - n)
    histogram = {n: lengths.count(n) for n in lengths}
    slots = packing.plan_best_fit(histogram, 100)
    used = {}
    for n, _, count, first, offset in slots:
        for s in range(first, first + count):
            used.setdefault(s, []).append((offset, n))
    assert sorted(n for v in used.values() for _, n in v) == sorted(lengths)
    assert len(used) == len(bins)
    assert all(sum(n for _, n in v) <= 100 for v in used.values())


def test_token_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "orc")
    texts = ODD + [f"line {i} of text" for i in range(50)]
    table = docs(spark, texts).unionByName(docs(spark, ["again", "again"], start=3))
    token_files.write_token_files(table.repartition(5), path, P.path(FILES[1]))
    rows = token_files.read_token_files(spark, path).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted((r.doc_id, library_ids(FILES[1], r.text, 1)) for r in table.collect())
    start = 0
    out = token_files.digests(spark, path).collect()
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(r.doc_id for r in out)
    assert token_files.read_token_files(spark, path).where("doc_id = 7").count() == 1


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write_token_files(docs(spark, []), path, P.path(FILES[1]))
    assert token_files.digests(spark, path).count() == 0
