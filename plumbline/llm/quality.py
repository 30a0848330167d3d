"""Quality scores by Bradley-Terry pairwise ranking (operator 5).

Training pairs a document labelled 1 with documents labelled 0; the chance that the first is preferred is the
logistic function of the difference of their scores, and scores are linear in text features, so the loss is
the logistic loss on feature differences. Scores carry no origin, so a threshold is set at a quantile of the
training scores, and a document's score is moved and squashed so that the threshold becomes `cut` (0.7).

All labelled rows are learned from, whatever their number. Rows are dealt into blocks by a hash of their ids, and each
is paired with PARTNERS rows of the other class in its block; a class too small for all blocks is in several. A round
of the fit adds up gradient and curvature over all blocks, one small sum a task, and the threshold comes from the
counts of both classes at every score.

Features see the text alone and are counted over the whole of it, by bytes and by words.

A null text is the empty text. Labels that are null or contradict each other are averaged and used only if
that leaves 0 or 1; labels of absent documents and repeated rows change nothing (of several texts of one doc_id the
one with the least features is learned from). Texts of any length are read whole. Where either class has no
training row, every document scores `cut` and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stored, texts

#: Labelled rows of a block, within which rows are paired, and how many of each class it has at least, on average.
BLOCK_ROWS = 4096
BLOCK_LEAST = 64
#: Documents labelled 0 that each one labelled 1 is paired with, and the other way round.
PARTNERS = 4
N_FEATURES = 22


def features(text: str) -> list[float]:
    """Shares of kinds of bytes and words; none depends on the language, source or id."""
    import numpy as np

    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    stops, commas = c[46], c[44]
    marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum() - stops - commas
    words = raw.split()
    k = max(1, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    kinds = len(set(words))
    twice = sum(map(bytes.__eq__, words[1:], words[:-1])) if len(words) > 1 else 0
    ends = sum(1 for w in words if not (w[-1] > 127 or w[-1:].isalnum()))
    odd_ends = sum(1 for w in words if w[-1] in b"!*%&$#@|~^=_<>")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    log = np.log1p
    return [
        float(x)
        for x in (
            log(len(words)), log(len(lines)), upper / n, min(1.0, upper / max(1, lower)), digit / n, marks / n, stops / k, commas / k,
            c[128:].sum() / n, log(lens.mean()), log(lens.max()), kinds / k, kinds / k**0.8, twice / k, ends / k, odd_ends / k,
            c[124] / k, c[33] / k, 1 - len(set(lines)) / m, log(k / m), sum(x.rstrip().endswith(b".") for x in lines) / m, float(not words),
        )
    ]


def with_features(documents: DataFrame) -> DataFrame:
    """doc_id and x, its features."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts(documents).mapInArrow(run, "doc_id long, x array<double>")


def differences(good, bad, rng, n_good: int | None = None, n_bad: int | None = None):
    """good - bad of PARTNERS pairs of each of the first n_good and n_bad rows (by default, of all)."""
    import numpy as np

    a, b = len(good) if n_good is None else n_good, len(bad) if n_bad is None else n_bad
    i = np.concatenate([np.repeat(np.arange(a), PARTNERS), rng.integers(0, len(good), b * PARTNERS)])
    j = np.concatenate([rng.integers(0, len(bad), a * PARTNERS), np.repeat(np.arange(b), PARTNERS)])
    return good[i] - bad[j]


def pair_sums(d, w):
    """Number, loss, gradient (downhill) and curvature of the differences d at w, in one row."""
    import numpy as np

    m = d @ w
    p = 1 / (1 + np.exp(np.clip(m, -30, 30)))  # of the wrong order
    return np.concatenate([[len(d), np.logaddexp(0, -m).sum()], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(sums, width: int, rounds: int = 30, ridge: float = 1e-3):
    """The w of the least mean loss plus ridge; sums(w) is as of pair_sums. A step that doesn't lessen it is halved."""
    import numpy as np

    w, was, step, least = np.zeros(width), None, None, np.inf
    for _ in range(rounds):
        s = sums(w)
        s, loss = s / s[0], s[1] / s[0] + ridge / 2 * w @ w
        if loss > least + 1e-12:
            step = step / 2
        else:
            was, least = w, loss
            step = np.linalg.solve(s[2 + width :].reshape(width, width) + ridge * np.eye(width), s[2 : 2 + width] - ridge * w)
        w = was + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_pairs(good, bad, rounds: int = 30, ridge: float = 1e-3, seed: int = 5):
    """Weights of the logistic loss on the differences good - bad, by Newton steps, of rows in memory."""
    import numpy as np

    d = differences(good, bad, np.random.default_rng(seed))
    return newton(lambda w: pair_sums(d, w), good.shape[1], rounds, ridge)


def training_rows(documents: DataFrame, labels: DataFrame, use=None) -> DataFrame:
    """doc_id, x (features) and y (0 or 1) of every labelled document; `use` is a condition on doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    own = texts(documents).where("doc_id IS NOT NULL")
    if use is not None:
        known, own = known.where(use), own.where(use)
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y")).where("y IN (0, 1)")
    once = with_features(own).groupBy("doc_id").agg(F.min("x").alias("x"))  # a repeated row counts once; features are shuffled, not texts
    return once.join(known, "doc_id")


def _matrix(column, mean, scale):
    """The standardized features of an Arrow column of lists."""
    import numpy as np

    return np.clip((column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES) - mean) / scale, -8, 8)


def blocks(rows: DataFrame, n_good: int, n_bad: int, mean, scale) -> DataFrame:
    """g, own_good, own_bad, good, bad: the standardized features of the rows dealt to each block, those first that have their pairs there."""
    import numpy as np

    n = math.ceil((n_good + n_bad) / BLOCK_ROWS)
    copies = [min(n, max(1, math.ceil(BLOCK_LEAST * n / k))) for k in (n_bad, n_good)]
    times = F.when(F.col("y") == 1, copies[1]).otherwise(copies[0])
    dealt = rows.select("doc_id", "x", "y", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))
    dealt = dealt.withColumn("g", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(n)) + F.col("copy"), F.lit(n)))

    def block(key, table):
        import pyarrow as pa

        table = table.combine_chunks().sort_by([("copy", "ascending"), ("doc_id", "ascending")])
        z, y, own = _matrix(table["x"].combine_chunks(), mean, scale), table["y"].to_numpy(), table["copy"].to_numpy() == 0
        values = [key[0].as_py(), int((own & (y == 1)).sum()), int((own & (y == 0)).sum()), z[y == 1].astype(np.float64).tobytes(), z[y == 0].astype(np.float64).tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["g", "own_good", "own_bad", "good", "bad"])

    return dealt.groupBy("g").applyInArrow(block, "g long, own_good long, own_bad long, good binary, bad binary")


def fit_blocks(dealt: DataFrame, seed: int = 5):
    """fit_pairs over the pairs of all blocks."""
    import numpy as np

    def sums(w):
        def run(batches):
            import pyarrow as pa

            out, first = None, None
            for b in batches:
                for r in b.to_pylist():
                    good, bad = (np.frombuffer(r[k], np.float64).reshape(-1, N_FEATURES) for k in ("good", "bad"))
                    if len(good) and len(bad):
                        own = pair_sums(differences(good, bad, np.random.default_rng([seed, r["g"]]), r["own_good"], r["own_bad"]), w)
                        out, first = (own, r["g"]) if out is None else (out + own, min(first, r["g"]))
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([out], pa.list_(pa.float64()))], ["g", "s"])

        parts = dealt.mapInArrow(run, "g long, s array<double>").collect()  # one row a task
        return np.sum([r.s for r in sorted(parts, key=lambda r: r.g)], axis=0)

    return newton(sums, N_FEATURES)


def threshold(scored: DataFrame) -> float:
    """Where the scores (s, y) are best parted: twice the share of lost 1s and the share of kept 0s are least together. Of equals, in the widest gap.

    The costs of all cuts between different scores, in whole numbers: ranges of scores are summed up first, then each is gone through from what is before it.
    """
    count = lambda y: F.sum(F.when(F.col("y") == y, 1).otherwise(0))
    each = stored(scored.groupBy("s").agg(count(1).alias("good"), count(0).alias("bad")).repartitionByRange("s").withColumn("part", F.spark_partition_id()), "quality-scores")
    parts = sorted(each.groupBy("part").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect(), key=lambda r: r.least)
    before, good, bad, last = [], 0, 0, None
    for r in parts:
        before.append((r.part, good, bad, last))
        good, bad, last = good + r.good, bad + r.bad, r.most
    offsets = scored.sparkSession.createDataFrame(before, "part int, good0 long, bad0 long, last double")  # a row a range
    order = W.partitionBy("part").orderBy("s")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    summed = each.select("part", "s", F.coalesce(F.sum("good").over(past), F.lit(0)).alias("good"), F.coalesce(F.sum("bad").over(past), F.lit(0)).alias("bad"), F.lag("s").over(order).alias("prev"))
    cuts = summed.join(F.broadcast(offsets), "part").select("s", F.coalesce("prev", "last").alias("prev"), (2 * bad * (F.col("good") + F.col("good0")) + good * (bad - F.col("bad") - F.col("bad0"))).alias("cost"))
    best = cuts.agg(F.min(F.struct("cost", F.coalesce(F.col("prev") - F.col("s"), F.lit(0.0)).alias("gap"), "s", "prev")).alias("x")).first().x
    discard(each)
    if best.prev is None:
        return best.s - 1
    at = (best.prev + best.s) / 2
    return at if at > best.prev else best.s


def fit(documents: DataFrame, labels: DataFrame, use=None) -> dict | None:
    """The model, from all labelled documents; `use` is a condition on doc_id."""
    import numpy as np

    rows = stored(training_rows(documents, labels, use), "quality-rows")
    features_of = [F.get("x", F.lit(i)) for i in range(N_FEATURES)]
    found = rows.agg(F.count(F.when(F.col("y") == 1, 1)).alias("good"), F.count(F.when(F.col("y") == 0, 1)).alias("bad"), F.array(*map(F.avg, features_of)).alias("mean"), F.array(*map(F.stddev_pop, features_of)).alias("scale")).first()
    if not found.good or not found.bad:
        discard(rows)
        return None
    whole = lambda v: np.array([float(f"{x:.10g}") for x in v])  # noqa: E731  # the order of sums shows in the last digits alone
    mean, scale = whole(found.mean), np.maximum(whole(found.scale), 1e-6)
    dealt = stored(blocks(rows, found.good, found.bad, mean, scale), "quality-blocks")
    w = fit_blocks(dealt)
    discard(dealt)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_matrix(b.column(0), mean, scale) @ w), b.column(1)], ["s", "y"])

    at = threshold(rows.select("x", "y").mapInArrow(run, "s double, y double"))
    discard(rows)
    return {"mean": mean, "scale": scale, "w": w, "at": at}


def score(documents: DataFrame, model: dict | None, cut: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `cut` on) of every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if model is None:
                s = np.full(b.num_rows, cut)
            else:
                x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
                raw = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] - model["at"] + np.log(cut / (1 - cut))
                s = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= cut - 1e-12).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(documents).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id):
    """Rows whose crc32 of the id as text is 2 modulo 4 are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def keep_good(documents: DataFrame, model: dict | None, cut: float = 0.7) -> DataFrame:
    """The rows of documents, all their columns, whose text scores `cut` or more."""

    schema = documents.schema
    at = documents.columns.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if model is None:
                yield b
                continue
            x = np.array([features(t or "") for t in b.column(at).to_pylist()]).reshape(-1, N_FEATURES)
            raw = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"] - model["at"]
            yield b.filter(pa.array(raw >= 0))

    return documents.mapInArrow(run, schema)
