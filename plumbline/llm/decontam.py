"""Benchmark decontamination by SimHash of item-sized windows (operator 7). DataFrame functions only.

A window has as many words as a benchmark item (a shorter document is one window) and is compared with the item
by the weighted Jaccard similarity of their five-word shingles, weights being counts. A window that reaches
the threshold shares shingles with the item, and moved so that its first (or, at the document's end, its last)
shingle is a shared one it shares no fewer; so only such windows, and of them those with enough shared shingles
in sight, are fingerprinted. Their SimHashes meet the items' in a multi-index: RADIUS + 1 blocks of bits, of which
at least one is equal for every pair within the radius. What is within it is verified exactly.

Shared shingles are found by their longest word: documents are parted into words, words meet the table of these
words (broadcast if it has at most BROADCAST_ROWS rows; else by a shuffle), and what they point at is compared in the text of
those documents alone. Words travel without their text, so a long text costs no more than its length.

Words are lower-cased and parted by white space. Null texts count as empty and match nothing; an item of
fewer than five words is one shingle. Repeated items and documents give one row per (doc_id, item_id); rows of one doc_id, and
of none, are judged each by its own text, and clean() removes just those that hold an item. Null item_ids are items like others. Empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_RUN, cut, let, stored, texts

#: Hamming radius of the fingerprints. At similarity 0.8 distances are about 10 of 64 bits, with a deviation of 3.
RADIUS = 20
#: Rows of the table of shingles up to which it is broadcast.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), SPACE_RUN)


def shingles(words: Column, k: int) -> Column:
    """Joined runs of k words; of fewer words, one run of all."""
    return F.when(F.size(words) <= k, F.array(F.array_join(words, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))


def simhash(hashes: Column) -> Column:
    """64 bits: bit j is set if it is in over half of the hashes."""
    set_in = lambda hs, j: F.size(F.filter(hs, lambda h: F.getbit(h, j) == 1))
    bit = lambda hs, j: F.when(2 * set_in(hs, j) > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
    return let(hashes, lambda hs: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseOR(bit(hs, j))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of shingles, by counts; by plain set sizes where neither repeats any."""
    count = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    least = F.aggregate(F.array_union(a, b), F.lit(0), lambda t, s: t + F.least(count(a, s), count(b, s)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(least)
    return shared / (F.size(a) + F.size(b) - shared)


def _blocks(fp: Column, radius: int) -> Column:
    """(block, bits) of each of radius + 1 blocks."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << (e - s)) - 1)).alias("bits")) for i, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def _keyed(documents: DataFrame) -> DataFrame:
    """d and h, which stand for a row, its doc_id and text."""
    return texts(documents).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), "doc_id", "text")


def _bound(df: DataFrame) -> DataFrame:
    """df to be broadcast, if its own rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _matches(documents: DataFrame, items: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """d, h, doc_id, item_id, start, n, hamming, similarity of every window found."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("w")).where("w[0] <> ''")
    own = own.withColumn("item_sh", shingles(F.col("w"), shingle)).withColumn("n", F.size("w")).withColumn("m", F.size("item_sh"))
    own = cut(own.withColumn("item_fp", simhash(F.transform("item_sh", lambda s: F.xxhash64(s)))).withColumn("k", F.least("n", F.lit(shingle))))
    # The longest word of each shingle, where it stands in it, and the shingle.
    parts = own.select("k", "n", "m", "item_id", F.explode(F.array_distinct("item_sh")).alias("shingle")).withColumn("sw", F.split("shingle", " "))
    parts = parts.withColumn("longest", F.array_max(F.transform("sw", lambda x, i: F.struct(F.length(x).alias("l"), (-i).alias("o"), x.alias("x")))))
    anchors = cut(parts.select(F.col("longest.x").alias("word"), (-F.col("longest.o")).alias("o"), "k", "n", "m", "item_id", "shingle").distinct())
    docs = _keyed(documents)
    # Equal shingles of many items are compared once and find their items afterwards.
    words = docs.select("d", "h", F.posexplode_outer(words_of(F.col("text"))).alias("at", "word"))  # outer: no filter is inferred that would part the text twice
    points = words.join(_bound(anchors.select("word", "o", "k", "shingle").distinct()), "word").where("at >= o")
    pointed = points.groupBy("d", "h").agg(F.collect_set(F.struct((F.col("at") - F.col("o")).alias("at"), "k", "shingle")).alias("points"))  # of one document
    same = lambda ws: F.transform(F.filter("points", lambda p: F.array_join(F.slice(ws, p["at"] + 1, p["k"]), " ") == p["shingle"]), lambda p: F.struct(F.size(ws).alias("len"), p["at"].alias("at"), p["shingle"].alias("shingle")))
    found = docs.join(pointed.hint("shuffle_hash"), ["d", "h"]).select("d", "h", F.explode_outer(let(words_of(F.col("text")), same)).alias("p"))  # texts needn't be sorted
    shared = stored(found.where("p IS NOT NULL").select("d", "h", "p.*").distinct(), "shared-shingles")
    hits = shared.join(_bound(anchors.select("shingle", "item_id", "n", "m").distinct()), "shingle").drop("shingle").distinct()
    # Shared shingles in sight of a window; enough of them are a condition for the similarity.
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("m") + F.least("m", F.greatest(F.lit(1), F.col("len") - F.lit(shingle) + 1))) - F.lit(1e-9))
    near = W.partitionBy("d", "h", "item_id").orderBy(F.col("at") / F.col("m"))  # an item's length is 1
    ahead, behind = F.count("*").over(near.rangeBetween(0, 1)), F.count("*").over(near.rangeBetween(-1, 0))
    hits = hits.withColumn("ahead", ahead).withColumn("behind", behind).withColumn("need", need)
    size, last = F.least("n", "len"), F.greatest(F.lit(0), F.col("at") - F.col("m") + 1)
    starts = hits.select("d", "h", "n", F.explode(F.array(
        F.struct(((F.col("ahead") >= F.col("need")) & (F.col("at") + F.col("n") <= F.col("len"))).alias("enough"), F.col("at").alias("start"), size.alias("size")),
        F.struct((F.col("behind") >= F.col("need")).alias("enough"), last.alias("start"), size.alias("size")),
    )).alias("x")).where("x.enough").select("d", "h", "n", "x.start", "x.size").distinct()
    wanted = starts.groupBy("d", "h").agg(F.collect_list(F.struct("n", "start", "size")).alias("at"))  # of one document
    cuts = lambda ws: F.transform("at", lambda x: F.struct(x["n"].alias("n"), x["start"].alias("start"), F.slice(ws, x["start"] + 1, x["size"]).alias("win")))
    wanted = stored(wanted, "window-starts")
    wanted = F.broadcast(wanted) if (wanted.agg(F.sum(F.size("at"))).first()[0] or 0) <= BROADCAST_ROWS else wanted  # by windows, not rows
    windows = docs.join(wanted, ["d", "h"]).select("d", "h", "doc_id", F.explode_outer(let(words_of(F.col("text")), cuts)).alias("x")).select("d", "h", "doc_id", "x.*").distinct()
    windows = windows.withColumn("sh", shingles(F.col("win"), shingle)).drop("win").withColumn("fp", simhash(F.transform("sh", lambda s: F.xxhash64(s))))
    keyed = windows.select("d", "h", "doc_id", "n", "start", "sh", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("b")).select("d", "h", "doc_id", "n", "start", "sh", "fp", "b.block", "b.bits")
    index = own.select("item_id", "n", "item_sh", "item_fp", F.explode(_blocks(F.col("item_fp"), radius)).alias("b")).select("item_id", "n", "item_sh", "item_fp", "b.block", "b.bits").distinct()
    pairs = keyed.join(_bound(index), ["n", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= radius)
    # A pair may meet in several blocks: it is verified in the first of them.
    first = F.array_min(F.transform(F.filter(F.arrays_zip(_blocks(F.col("fp"), radius).alias("a"), _blocks(F.col("item_fp"), radius).alias("c")), lambda z: z["a"] == z["c"]), lambda z: z["a"]["block"]))
    pairs = pairs.where(F.col("block") == first).withColumn("similarity", weighted_jaccard(F.col("sh"), F.col("item_sh"))).where(F.col("similarity") >= similarity)
    return pairs.select("d", "h", "doc_id", "item_id", "start", "n", "hamming", "similarity")


def contaminated(documents: DataFrame, items: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start, n_words, hamming, similarity: the best window of each document and item that reach the similarity."""
    pairs = _matches(documents, items, shingle, similarity, radius)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("minus"), "n", (-F.col("hamming")).alias("h"))).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.minus")).cast("long").alias("start"), F.col("x.n").cast("long").alias("n_words"), (-F.col("x.h")).cast("int").alias("hamming"), F.col("x.similarity").alias("similarity"))


def clean(documents: DataFrame, items: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of documents, all their columns, that hold no benchmark item."""
    bad = stored(_matches(documents, items, shingle, similarity, radius).select(F.col("d").alias("__d"), F.col("h").alias("__h")).distinct(), "leaks")
    d, h = F.coalesce(documents["doc_id"].cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(documents["text"], F.lit("")))
    return documents.join(bad, (d == F.col("__d")) & (h == F.col("__h")), "left_anti")
