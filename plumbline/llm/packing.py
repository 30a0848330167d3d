"""Best-fit packing planned over a length histogram (operator 9).

Documents become token ids; those longer than a sequence are cut into full pieces, the first of which may be
shorter. The plan never sees documents: best-fit decreasing runs over the counts of the at most `capacity`
different lengths, and what it yields is ranges of slots (length, first rank, count, first sequence, offset).
A piece then takes the slot of its rank within its length. Ranks are counted in hash buckets with the
buckets' totals added, so that a length which a third of all pieces share is still counted by many tasks.

Null text is the empty document, which is the end id alone; an empty table gives an empty result; rows of
the same doc_id, and null doc_ids, are packed as documents of their own; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts
from plumbline.llm.tokens import encoder, slices

#: Pieces that one hash bucket is meant to rank.
BUCKET_ROWS = 500_000
#: The plan is sent to every task; a plan of more slot ranges than this is refused (histograms of up to 2048 lengths stay far below).
MOST_RANGES = 4_000_000


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slot ranges (length, first rank, count, first sequence, offset) of best-fit decreasing over counts.

    Rank r of the range is in sequence (first sequence + r - first rank). Sequences with the same free space
    are kept as ranges, so the work depends on the number of lengths and not on the number of documents.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []

    def put(room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in free:
            free[room] = []
            insort(rooms, room)
        free[room].append((first, count))

    fresh = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit {capacity}")
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
                n = min(left, count)
                slots.append((length, rank, n, first, capacity - room))
                put(room, first + n, count - n)
                put(room - length, first, n)
                left, rank = left - n, rank + n
                continue
            each = min(left, capacity // length)
            bins = left // each
            for j in range(each):
                slots.append((length, rank, bins, fresh, j * length))
                rank += bins
            put(capacity - each * length, fresh, bins)
            left -= each * bins
            fresh += bins
    return slots


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    if length <= capacity:
        return [(0, length)]
    head = length % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, length, capacity)]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its ids as an array where keep_ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc, end = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, rows, kept = batch.column(0).to_pylist(), [], []
            for part, names in zip(slices(batch.column(1).to_pylist()), slices(ids), strict=True):
                for doc, data in zip(names, enc.ids(part), strict=True):
                    data += end
                    for piece, (start, n) in enumerate(cut_points(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + n)]
                        rows.append((doc, piece, start, n, zlib.crc32(own)))
                        if keep_ids:
                            kept.append(np.frombuffer(own, "<u4").astype("int32"))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return texts(documents).mapInArrow(run, schema)


def ranked_in_length(pieces: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """pieces with __rank: 0, 1, ... within each length. counts: of each length and bucket."""
    before = W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = W.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        pieces.withColumn("__bucket", _bucket(buckets)).withColumn("__own", F.row_number().over(own) - 1)
        .join(base, ["length", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__own")).drop("__own", "__before", "__bucket")
    )


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32, ...) with their sequence_id and offset.

    pieces is read three times, so pass a table or a cut.
    """
    import numpy as np

    spark = pieces.sparkSession
    buckets = max(64, pieces.count() // BUCKET_ROWS)
    counts = pieces.groupBy("length", _bucket(buckets).alias("__bucket")).agg(F.count("*").alias("__n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    slots = sorted(plan_best_fit(histogram, capacity))
    if len(slots) > MOST_RANGES:
        raise ValueError(f"{len(slots)} slot ranges; at most {MOST_RANGES} are sent to tasks")
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)

    def place(batches):
        import numpy as np
        import pyarrow as pa

        t = sent.value
        key = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            columns = [b.column(i) for i, n in enumerate(b.schema.names) if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])], [*(n for n in b.schema.names if n != "__rank"), "sequence_id", "offset"])

    ranked = ranked_in_length(pieces, counts, buckets).select(*pieces.columns, F.col("__rank").cast("long").alias("__rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(token_pieces(documents, tokenizer_path, capacity, end_id)), capacity)
