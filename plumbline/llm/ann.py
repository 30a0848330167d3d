"""Approximate nearest neighbours by cross-polytope hashing (operator 1).

A pseudo-rotation multiplies a unit vector three times by random signs and a Hadamard matrix, in d log d steps; the
nearest signed axis is its bucket. Each table has its own rotations. Queries probe, in every table, the `probes`
axes nearest to them. What a bucket holds is scored exactly, in blocks, and the best of all blocks are kept.

Inner products of vectors of unequal length are searched as angles: with M the largest norm, a stored vector x
becomes (x, sqrt(M^2 - |x|^2)) / M and a query (q, 0) / |q|.

Equal vectors: a query's nearest k can hold at most k+1 copies with the smallest ids (its own among them), so
later copies aren't stored; equal queries are searched once. Buckets are cut into blocks of at most about
BLOCK vectors and BLOCK queries, each block a task of its own, so no bucket is too large for one.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Ties go to the smaller id; of an id with several vectors the least in their order stands for it. A query whose buckets held
fewer than k others is scored against all vectors, in blocks, so that only where there are fewer candidates are there fewer
rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Vectors, and queries, that a block is meant to hold.
BLOCK = 2_000
#: Bucket sizes are known to every task; that many buckets at most.
MOST_BUCKETS = 1 << 22


def hadamard(x):
    """Rows of x times the orthonormal Hadamard matrix."""
    import numpy as np

    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def rotation_signs(tables: int, dim: int, seed: int):
    import numpy as np

    size = 1 << max(0, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, size))


def axes(x, signs):
    """The coordinates of the rows of x along all signed axes: +e0, +e1, ..., -e0, -e1, ..."""
    import numpy as np

    y = np.zeros((len(x), signs.shape[1]))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    return np.concatenate([y, -y], axis=1)


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    good = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def search(table: DataFrame, queries, k: int = 20, tables: int = 10, probes: int = 9, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row of table that the condition `queries` (a column of `id`) picks."""
    import numpy as np

    spark = table.sparkSession
    # One row of each id; the key stands for the vector.
    all_rows = _vectors(table, id_col, vector_col)
    sizes = all_rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes.d
    rows = cut(all_rows.where(F.size("v") == dim).withColumn("key", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    least, most = rows.agg(F.min(norm), F.max(norm)).first()
    lifted = most > least * 1.001
    stored = rows.withColumn("copy", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("copy") <= k + 1).select("id", "v")
    asked = rows.where(queries).groupBy("key").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v")).select("id", "v")
    signs = rotation_signs(tables, dim + lifted, seed)
    buckets = 2 * signs.shape[2]
    if tables * buckets > MOST_BUCKETS:
        raise ValueError("too many buckets to count")

    def unit(v, query):
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        if not lifted:
            return v / n
        if query:
            return np.concatenate([v / n, np.zeros((len(v), 1))], axis=1)
        return np.concatenate([v / most, np.sqrt(np.maximum(0, 1 - (n / most) ** 2))], axis=1)

    def hashed(v, query):
        """(rows, table, bucket) index arrays."""
        u, out = unit(v, query), []
        m = probes if query else 1
        for t in range(tables):
            a = axes(u, signs[t])
            best = np.argpartition(-a, m - 1, axis=1)[:, :m] if m < a.shape[1] else np.tile(np.arange(a.shape[1]), (len(a), 1))
            out.append((np.repeat(np.arange(len(v)), best.shape[1]), np.full(best.size, t * buckets), best.ravel()))
        row, table_at, bucket = (np.concatenate(x) for x in zip(*out, strict=True))
        return row, table_at + bucket

    def counted(query):
        def run(batches):
            import pyarrow as pa

            total = np.zeros(tables * buckets, np.int64)
            for b in batches:
                if b.num_rows:
                    total += np.bincount(hashed(np.array(b.column(1).to_pylist()), query)[1], minlength=len(total))
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

        return run

    def counts(df, query):
        got = np.zeros(tables * buckets, np.int64)
        for r in df.mapInArrow(counted(query), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most tables x buckets rows
            got[r.bucket] = r.n
        return got

    blocks = {q: np.maximum(1, -(-counts(df, q) // BLOCK)) for q, df in ((False, stored), (True, asked))}
    first_cell = np.concatenate([[0], np.cumsum(blocks[False] * blocks[True])])

    def dealt(query):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for s in range(0, batch.num_rows, 500):
                    b = batch.slice(s, 500)
                    ids, v = b.column(0).to_numpy(), np.array(b.column(1).to_pylist())
                    row, bucket = hashed(v, query)
                    own = (ids[row] * 0x9E3779B1 >> 7) % blocks[query][bucket]
                    times = blocks[not query][bucket]
                    rep = np.repeat(np.arange(len(row)), times)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
                    row, bucket, own = row[rep], bucket[rep], own[rep]
                    stored_block, asked_block = (other, own) if query else (own, other)
                    cell = first_cell[bucket] + stored_block * blocks[True][bucket] + asked_block
                    raw = [x.tobytes() for x in v]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(row), query)), pa.array(ids[row]), pa.array([raw[i] for i in row.tolist()], pa.binary())], ["cell", "asked", "id", "v"])

        return run

    def score(pdf):
        import pandas as pd

        asked_rows, stored_rows = pdf[pdf.asked], pdf[~pdf.asked]
        if asked_rows.empty or stored_rows.empty:
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
        q, c = (np.frombuffer(b"".join(x.v), np.float64).reshape(-1, dim) for x in (asked_rows, stored_rows))
        rough, ids, n = q @ c.T, stored_rows.id.to_numpy(), min(k + 1, len(c))
        edge = np.partition(rough, len(c) - n, axis=1)[:, len(c) - n]
        a, b = np.nonzero(rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
        exact = np.zeros(len(a))
        for j in range(dim):  # one order of adding for every pair, so equal vectors score equally wherever they are scored
            exact += q[a, j] * c[b, j]
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        keep = place < k + 1
        return pd.DataFrame({"query": asked_rows.id.to_numpy()[a[keep]], "id": ids[b[keep]], "score": exact[keep]})

    schema = "cell long, asked boolean, id long, v binary"
    cells = stored.mapInArrow(dealt(False), schema).unionByName(asked.mapInArrow(dealt(True), schema))
    found = cells.groupBy("cell").applyInPandas(score, "query long, id long, score double").distinct()
    nearest = W.partitionBy("query").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1).drop("place")
    best = cut(top(found))
    n_stored = stored.count()
    counts = best.groupBy("query").agg(F.count("*").alias("n"))
    short = cut(asked.join(counts, F.col("id") == F.col("query"), "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, n_stored)).select("id", "v"))
    if short.limit(1).count():
        n_blocks = -(-n_stored // BLOCK)

        def plain(query):
            def run(batches):
                import pyarrow as pa

                for b in batches:
                    own = [np.array(x).tobytes() for x in b.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, query)), b.column(1), pa.array(own, pa.binary())], ["cell", "asked", "id", "v"])

            return run

        # A block of all vectors meets a block of these queries.
        part = (F.pmod(F.xxhash64("id"), F.lit(n_blocks))).cast("long")
        groups = -(-short.count() // BLOCK)
        turn = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long")
        every = stored.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), part.alias("p"), "id", "v").select((F.col("g") * n_blocks + F.col("p")).alias("cell"), "id", "v")
        those = short.select(turn.alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("p"), "id", "v").select((F.col("g") * n_blocks + F.col("p")).alias("cell"), "id", "v")
        whole = every.mapInArrow(plain(False), schema).unionByName(those.mapInArrow(plain(True), schema)).groupBy("cell").applyInPandas(score, "query long, id long, score double")
        best = top(whole.unionByName(best).distinct())
    members = rows.where(queries).select("key", F.col("id").alias("query_id"))
    heads = members.groupBy("key").agg(F.min("query_id").alias("query"))
    each = members.join(heads, "key").join(best, "query").where("id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
