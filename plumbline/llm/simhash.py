"""SimHash near-duplicates by covering locality-sensitive hashing (operator 3).

Masks: bit i of a fingerprint gets a nonzero vector phi(i) of r+1 bits, and for each nonzero v of r+1 bits there
is a table keyed by the bits with <phi(i), v> = 1. For any r differing bits some v is orthogonal to all their
phi, and that table keeps none of them: every pair within radius r collides in one of the 2^(r+1)-1 tables.

Equal fingerprints are one node. Buckets hold nodes, not documents, and inside a bucket only the links of its
spanning forest within the radius leave the task, so neither copies nor dense groups make pairs by the square.
Buckets of over HEAVY nodes are dealt again by a second set of masks over the same bits, which again covers
every pair within the radius.

Null texts count as empty. A text of fewer words than a shingle is one shingle; a text without words has
fingerprint zero and links like any other. Repeated rows, rows of one doc_id and equal texts are rows of their own that
share a fingerprint or don't. Rows without doc_id link like others; a component of only such rows has no
component_id. An empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import lines
from plumbline.llm.common import cut, discard, stored, texts
from plumbline.llm.components import connected_components
from plumbline.llm.substrings import run_hashes

#: Nodes in a bucket beyond which it is dealt again by further masks.
HEAVY = 20_000
#: Up to so many nodes all links within a bucket are looked at as pairs; beyond, its spanning tree is grown.
SMALL = 16
_BITS = 64


def covering_masks(radius: int, bits: int = _BITS, shift: int = 0) -> list[int]:
    """Signed 64-bit masks; shift gives another assignment of vectors to bits."""
    size = (1 << (radius + 1)) - 1
    vector = [1 + (i + shift + (i // size) * shift) % size for i in range(bits)]
    masks = []
    for v in range(1, size + 1):
        m = sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _shingle_hashes(text: str, words: int):
    import numpy as np
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only the six ASCII spaces part words
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], 42) for s, e in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes) -> int:
    """The fingerprint: bit j is set if it is in over half of the hashes."""
    import numpy as np

    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; repeated shingles count as often as they occur."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([majority(_shingle_hashes(t, words)) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return texts(documents).mapInArrow(run, "doc_id long, fp long")


def forest(fps, within: int) -> list[tuple[int, int]]:
    """Index pairs of a minimum spanning forest of the Hamming distances, links beyond `within` left out (Prim, n steps of n)."""
    import numpy as np

    n = len(fps)
    if n <= SMALL:
        d = np.bitwise_count(fps[:, None] ^ fps[None, :])
        a, b = np.nonzero(np.triu(d <= within, 1))
        return list(zip(a.tolist(), b.tolist(), strict=True))
    near, link = np.bitwise_count(fps ^ fps[0]).astype(np.int16), np.zeros(n, np.int64)
    near[0], out, left = 999, [], n - 1
    while left:
        j = int(near.argmin())
        if near[j] <= within:
            out.append((int(link[j]), j))
        d = np.bitwise_count(fps ^ fps[j]).astype(np.int16)
        closer = (d < near) & (near < 999)
        near[closer], link[closer], near[j] = d[closer], j, 999
        left -= 1
    return out


def _bucket_links(rows: DataFrame, keys: list[str], within: int) -> DataFrame:
    """rows: keys, g, fp; links (g, u, v) of each bucket's forest. The rows of a bucket come one after another."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []  # the parts of the bucket that is not known to have ended

        def links(cols):
            g, fp = cols[-2], cols[-1].view(np.uint64)
            change = np.zeros(len(fp), bool)
            for c in cols[:-2]:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.nonzero(change)[0].tolist(), len(fp)]
            out = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:
                    out += [(int(g[s]), int(cols[-1][s + a]), int(cols[-1][s + b])) for a, b in forest(fp[s:e], within)]
            return out

        def batch(found):
            c = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())], ["g", "u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
            last = [c[-1] for c in held[-1][:-2]]
            first_of_last = len(held[-1][0])
            same = np.ones(first_of_last, bool)
            for c, x in zip(held[-1][:-2], last, strict=True):
                same &= c == x
            first_of_last -= int(same[::-1].argmin()) if not same.all() else first_of_last
            if first_of_last == 0:
                continue
            cols = [np.concatenate([h[i] for h in held[:-1]] + [held[-1][i][:first_of_last]]) for i in range(len(held[-1]))]
            held = [[c[first_of_last:] for c in held[-1]]]
            yield batch(links(cols))
        if held:
            yield batch(links([np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]))

    dealt = rows.select(*keys, "g", "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(run, "g int, u long, v long").distinct()


def covering_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """nodes: g, fp (each pair once). Links (g, u, v) that connect all nodes of one g within the radius."""
    first = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius))])).alias("x")
    keyed = nodes.select("g", "fp", first).select("g", "fp", (F.col("g") * 64 + F.col("x.t")).alias("t"), F.col("x.k").alias("k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")  # most buckets hold one node and go here
    shared = cut(keyed.join(sizes, ["t", "k"]))
    links = _bucket_links(shared.where(F.col("n") <= HEAVY), ["t", "k"], radius)
    if (shared.agg(F.max("n")).first()[0] or 0) > HEAVY:
        again = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius, shift=7))])).alias("x")
        finer = shared.where(F.col("n") > HEAVY).select("g", "fp", "t", "k", again).select("g", "fp", "t", "k", F.col("x.t").alias("t2"), F.col("x.k").alias("k2"))
        links = links.unionByName(_bucket_links(finer, ["t", "k", "t2", "k2"], radius)).distinct()
    return links


def simhash_components(documents: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over fingerprints within the radius."""
    prints = cut(fingerprints(documents, words))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = covering_links(prints.select(F.lit(0).alias("g"), "fp").distinct(), radius)
    named = connected_components(links.select("u", "v")).select(F.col("node").alias("fp"), "component")
    classes = classes.join(named, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = classes.join(least, "component").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- Near-duplicate documents by similarity: SimHash candidates first, then an exact prefix-filter join for the rest

#: Shingles are counted in 2 to this power buckets, of which tasks get a byte each; commoner ones come last in prefixes.
COUNT_BITS = 20
#: Bits of a bucket's number within one part of the counts.
_PART_BITS = 16
#: Earlier sets that each set is first verified against.
FIRST = 4


def shingle_set(text: str, words: int):
    """Distinct 64-bit hashes of the lower-case shingles of a text, sorted; of fewer words, of all of them; none without words."""
    import numpy as np
    import xxhash

    own = text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    return np.unique(run_hashes(h, min(words, len(own))).view(np.int64))


def _node(text: str) -> int:
    import hashlib

    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    return int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True)


def _mixed(x):
    """Hashes mixed anew, so that buckets and orders don't follow how the hash was made."""
    import numpy as np

    y = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return y ^ (y >> np.uint64(31))


def _read_once(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, node (a digest of the lower-case words in their order) and fp (SimHash of their shingles) of every row; and rows of part and counts, the number of sets that hold shingles of each bucket."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        names = ["doc_id", "node", "fp", "part", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            nodes, fps = [], []
            for t in b.column(1).to_pylist():
                x = shingle_set(t, words)
                counts += np.bincount(_mixed(x) & np.uint64((1 << COUNT_BITS) - 1), minlength=len(counts)).astype(np.uint32) if len(x) > 1 << 16 else 0
                if 0 < len(x) <= 1 << 16:
                    np.add.at(counts, _mixed(x) & np.uint64((1 << COUNT_BITS) - 1), 1)
                nodes.append(_node(t))
                fps.append(majority(_mixed(x)))
            own = [b.column(0), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.nulls(len(nodes), kinds[3]), pa.nulls(len(nodes), kinds[4])]
            yield pa.RecordBatch.from_arrays(own, names)
        parts = counts.reshape(-1, 1 << _PART_BITS)
        if counts.any():
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, k) for k in kinds[:3]] + [pa.array(range(n), kinds[3]), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], kinds[4])], names)

    return texts(documents).mapInArrow(run, "doc_id long, node long, fp long, part int, counts binary")


def _commonness(parts: DataFrame):
    """A byte for each bucket: four times the binary logarithm of its count. parts: part, counts; what reaches the driver is one byte a bucket."""
    import numpy as np

    def add(batches):
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
                total[p] = total[p] + x if p in total else x
        if total:
            classes = [np.minimum(255, 4 * np.log2(np.maximum(1, x))).astype(np.uint8).tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(classes, pa.binary())], ["part", "classes"])

    out = np.zeros((1 << (COUNT_BITS - _PART_BITS), 1 << _PART_BITS), np.uint8)
    for r in parts.repartition(1 << (COUNT_BITS - _PART_BITS), "part").mapInArrow(add, "part int, classes binary").collect():
        out[r.part] = np.frombuffer(r.classes, np.uint8)
    return out.ravel()


def _prefixes(reps: DataFrame, words: int, similarity: float, common) -> DataFrame:
    """place (the node), n, bits, i, tok of each shingle in the prefix of a set, rare ones first; reps: node, text."""
    sent = reps.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                rows = []
                for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = shingle_set(text, words)
                    n = len(x)
                    if not n:
                        continue
                    y = _mixed(x)
                    order = np.lexsort((y, sent.value[y & np.uint64((1 << COUNT_BITS) - 1)]))
                    tok = x[order[: n - math.ceil(similarity * n - 1e-9) + 1]]
                    parity = np.bitwise_xor.reduce(np.left_shift(np.uint64(1), y & np.uint64(63))).view(np.int64)
                    k = len(tok)
                    rows.append((np.full(k, node), np.full(k, n, np.int32), np.full(k, parity), np.arange(k, dtype=np.int32), tok))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["place", "n", "bits", "i", "tok"])

    return reps.mapInArrow(run, "place long, n int, bits long, i int, tok long")


def _alike(pairs: DataFrame, reps: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v of the pairs (u, v) whose sets of shingles have the Jaccard similarity or more. Only the candidates' texts are read again."""

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["place", "x"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = []
            for a, c in zip(b.column(2), b.column(3), strict=True):
                x, y = a.values.to_numpy(), c.values.to_numpy()
                o = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(o >= similarity * (len(x) + len(y) - o) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    own = stored(reps.join(wanted, "node", "left_semi").mapInArrow(sets, "place long, x array<long>"), "shingle-sets")
    both = pairs.join(own.select(F.col("place").alias("u"), F.col("x").alias("su")), "u").join(own.select(F.col("place").alias("v"), F.col("x").alias("sv")), "v")
    found = cut(both.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long").distinct())
    discard(own)
    return found


def _covered_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) of nodes whose fingerprints the covering tables link: of one fingerprint the least node stands for all."""
    heads = cut(classes.groupBy("fp").agg(F.min("node").alias("head")))
    links = covering_links(heads.select(F.lit(0).alias("g"), "fp"), radius)
    far = links.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    near = classes.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    return near.unionByName(far.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def alike_links(reps: DataFrame, classes: DataFrame, common, words: int, similarity: float, radius: int) -> DataFrame:
    """Links (u, v) that connect any two nodes whose sets reach the similarity.

    First candidates are what SimHash's covering tables link, and a few earlier sets of each set's postings: both are linear. All
    pairs that share a shingle of their prefixes and pass the filters include all that are similar (see lines.py); of
    these, what is left is verified unless what was verified connects its ends already.
    """
    shared = stored(lines.postings(_prefixes(reps, words, similarity, common), similarity, 1), "shingle-postings")
    seen = shared.where(F.size("found") > 0).groupBy("place").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, FIRST).alias("x"))  # of one document
    first = seen.select(F.explode("x.p1").alias("u"), F.col("place").alias("v")).unionByName(_covered_pairs(classes, radius))
    links = _alike(cut(first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), reps, words, similarity)
    named = connected_components(links).select(F.col("node").alias("place"), "component")
    open_ = shared.select("tok", "place", "n", "i", "bits").join(named, "place", "left").withColumn("component", F.coalesce("component", "place"))
    open_ = stored(open_, "shingle-open")
    discard(shared)
    a, b = open_.alias("a"), open_.alias("b")
    fit = lines.fits(F.col("a.n"), F.col("a.i"), F.col("a.bits"), F.col("b.n"), F.col("b.i"), F.col("b.bits"), similarity)
    rest = a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.place") < F.col("b.place")) & (F.col("a.component") != F.col("b.component")) & fit)
    rest = cut(rest.select(F.col("a.place").alias("u"), F.col("b.place").alias("v")).distinct())
    discard(open_)
    return links.unionByName(_alike(rest, reps, words, similarity))


def near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """doc_id, component_id (the least doc_id of its group), one row per row of documents that has a doc_id.

    Groups are the components of all pairs whose sets of shingles reach the similarity. Texts of the same words (letter
    case aside) are one class and one node; texts without words are one class. Rows of one doc_id are placed together.
    """
    documents = documents.where("doc_id IS NOT NULL")
    once = cut(_read_once(documents, words))
    common = _commonness(once.where("part IS NOT NULL").select("part", "counts"))
    prints = once.where("part IS NULL").select("doc_id", "node", "fp")
    classes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp")))
    reps = stored(_of_nodes(documents, classes), "near-texts")
    one_id = prints.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("most")).where("u < most").select("doc_id", "u")
    together = prints.join(one_id, "doc_id").select("u", F.col("node").alias("v"))
    named = connected_components(alike_links(reps, classes, common, words, similarity, radius).unionByName(together))
    discard(reps)
    members = classes.join(named, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = members.groupBy("component").agg(F.min("id").alias("component_id"))
    return prints.join(members.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def _of_nodes(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """node and text of the row that stands for each class."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            nodes = [_node(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), b.column(0), b.column(1)], ["node", "id", "text"])

    docs = texts(documents).select(F.col("doc_id").alias("id"), "text").join(classes.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    return docs.mapInArrow(run, "node long, id long, text string").drop("id")  # a node more than once, if an id has several texts: no harm


def keep_first(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents, all their columns, but for those of a group whose least doc_id is another. Rows without doc_id stay."""
    gone = near_duplicates(documents, **options).groupBy("doc_id").agg(F.min(F.col("component_id")).alias("c")).where("c <> doc_id").select(F.col("doc_id").alias("__gone"))
    return documents.join(gone, documents["doc_id"].cast("long") == F.col("__gone"), "left_anti")
