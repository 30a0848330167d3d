"""The pattern-instance graph of operator 4 against a plain reading of its rules."""

import re

import numpy as np

from plumbline.llm import pii

WS = r"[\x20\x09-\x0D]"


def base_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def tokens_of(t):
    """(start, end, token, seed, patterns) of each instance."""
    base, out, last = base_spans(t), [], 0
    for m in re.finditer(rf"(?<!{WS.replace('[', '[^')})(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]+", t):
        words = re.split(WS + "+", t[last : m.start()].lower().strip(" \t\n\x0b\x0c\r"))
        patterns = ([" ".join(words[-2:])] if len(words) >= 2 else []) + ([words[-1]] if words[-1] else [])
        seeds = [k for k, s, e in base if s < m.end() and e > m.start()]
        out.append((m.start(), m.end(), m[0], min(seeds, default=None), patterns))
        last = m.end()
    return out


def trusted(rows):
    edges = {}
    for toks in rows:
        for _, _, token, seed, patterns in toks:
            for p in patterns:
                old = edges.get((p, token))
                edges[p, token] = seed if old is None else old if seed is None else min(old, seed)
    own = {k: [1.0 if s == x else 0.0 for x in range(4)] for k, s in edges.items()}
    now, good = dict(own), {}
    for _ in range(pii.ROUNDS):
        means, good = {}, {}
        for p in {p for p, _ in edges}:
            v = [now[k] for k in now if k[0] == p]
            means[p] = [sum(x[i] for x in v) / len(v) for i in range(4)]
            best = max(means[p][i] if sum(x[i] == 1.0 for x in v) >= pii.MIN_SEEDS else 0.0 for i in range(4))
            if best >= pii.MIN_SCORE:
                good[p] = best
        lent = {}
        for (p, token), seed in edges.items():
            if seed is None and p in good:
                lent[token] = [max(a, good[p] * b) for a, b in zip(lent.get(token, [0.0] * 4), means[p], strict=True)]
        now = {k: own[k] if edges[k] is not None or k[1] not in lent else lent[k[1]] for k in edges}
    return good


def test_discoveries_against_a_plain_reading(spark):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(400):
        bits = []
        for _ in range(rng.integers(1, 6)):
            lead = str(rng.choice(["contact me at", "mail", "server", "reach  us under", "room", "code", "x" * 80 + " write to"]))
            what = rng.integers(0, 5)
            value = [f"a{rng.integers(0, 40)}@b.org", f"10.0.{rng.integers(0, 256)}.7", f"+49 30 {rng.integers(1000000, 9999999)}", f"u{rng.integers(0, 30)}@local", f"{rng.integers(0, 999)}"][what if rng.random() < 0.1 else {"contact me at": 0, "mail": 0, "server": 1, "reach  us under": 2}.get(lead, 4)]
            bits.append(f"{lead} {value}")
        texts.append((i, " and ".join(bits)))
    rows = {i: tokens_of(t) for i, t in texts}
    good = trusted(rows.values())
    assert good and len(good) < len({p for toks in rows.values() for *_, ps in toks for p in ps})
    want = {i: sorted((s, e) for s, e, _, seed, ps in toks if seed is None and any(p in good for p in ps)) for i, toks in rows.items()}
    assert sum(map(len, want.values())) > 2
    got = {}
    for r in pii.personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got[r.doc_id] = sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("id:"))
        assert r.n_discovered == len(got[r.doc_id])
    assert got == want


def test_rows_without_ids_and_long_words(spark):
    long = "z" * 5_000
    rows = [(None, "mail a@b.org"), (None, None), (3, f"first {long} a1@b.org"), (3, "")]
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, ""), (0, 1, "email:5:12"), (3, 0, ""), (3, 1, "email:5007:5015")]
