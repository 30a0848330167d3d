"""Operator 4: base spans against Python's re, discoveries on a planted context."""

import hashlib
import re

from plumbline.llm import pii

BASE = [  # the contract's patterns, as they stand there
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if passes(kind, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


TEXTS = [
    None, "", "no data", "a@b.c_d@e.f x.y@z.co.uk.", "@@ a@b a@b. a@-.-", "é😀 joe.x+1%@mail-5.example.com 😀 4111 1111 1111 1111, 4111-1111-1111-1112",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 999999999999999999999.1.1.1 1.2.3", "+1 (476) 555-3733 +12 3 +1 234 567 89012345 +1-.(2)", "12345678901234567890 4111111111111111",
    "0" * 16, "x" * 50000 + "@" + "y" * 100 + ".z", "7" * 30000, "4111 1111 1111 1111 4111 1111 1111 1111", "+4 4111111111111111",
]


def table(spark, texts):
    return spark.createDataFrame([(i // 2 if i < 4 else i, t, 1, "k", 2) for i, t in enumerate(texts)], "doc_id long, text string, row int, kind string, start int")


def test_base_spans(spark):
    import random

    random.seed(4)
    noise = ["".join(random.choice("ab1290.@+-() _%é") for _ in range(random.randint(0, 60))) for _ in range(400)]
    every = TEXTS + noise
    got = pii.personal_data(table(spark, every)).collect()
    mine = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got)
    expect = []
    for r in table(spark, every).collect():
        s = brute(r.text)
        expect.append((r.doc_id, *(sum(x.startswith(k + ":") for x in s) for k, _ in BASE), hashlib.sha256(",".join(s).encode()).hexdigest(), ",".join(s)))
    assert [m[:6] for m in mine] == sorted(e[:6] for e in expect)
    assert all(set(e[6].split(",")) <= set(m[6].split(",")) for m, e in zip(mine, sorted(expect)) if e[6])


def test_trusted_contexts_discover_tokens(spark):
    seeds = [f"please write to u{i}@example.com today" for i in range(8)]
    got = pii.personal_data(table(spark, ["x", "y", "z", "w", *seeds, "please write to u9(at)example today", "see page 9"])).collect()
    by = {r.doc_id: r for r in got}
    assert by[12].spans == "id:16:29" and by[12].n_discovered == 1 and by[12].n_email == 0
    assert by[13].spans == ""


def test_no_documents(spark):
    assert pii.personal_data(table(spark, [])).count() == 0
