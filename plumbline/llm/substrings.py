"""Substring dedup by suffix automata (operator 2).

A window is `window` consecutive words of a document. A word goes if it is in a window whose words also start
anywhere else, in the same document or another.

An automaton over a shard of reference texts gives, for a text streamed through it, at every word the state of
the longest match that ends there, and with occurrence counts whether the last `window` words occur twice; the
union of such windows is the maximal spans to remove. With a given reference of bounded size (remove_reference_spans)
the shards' automata are broadcast. Where the reference is the corpus itself no broadcast has a size bound and each
text would pass every shard, so shards are dealt out by content instead: of the 10-word runs in a window the one
with the least hash is its anchor, equal windows have equal anchors, and runs of windows with one anchor
(pieces of up to 60 words) meet in the shard of that anchor. Only anchors seen twice have pieces at all.

An anchor that occurs more than HOT times isn't given to one automaton: its pieces are counted, and the windows of the
different ones are dealt one by one, by their 128-bit digests. So no anchor, however frequent, is one task's work.

Words are runs without the six ASCII spaces, compared as they are. Null and empty texts have no words. Rows of
one doc_id are documents of their own; a repeated row's windows start in both. Empty tables give an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stored, texts

#: Words of the run that anchors a window (at most the window): shorter ones are fewer, but more are seen twice by chance.
ANCHOR = 10
#: Pieces of one anchor up to which one automaton takes them.
HOT = 2_000
#: Words of the automata that are broadcast at once, and of one shard.
BROADCAST_WORDS, SHARD_WORDS = 2_000_000, 250_000


class Automaton:
    """A suffix automaton over several texts (sequences of hashable words), with weighted occurrence counts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]
        self._counted = True

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.count.append(0)
        return len(self.len) - 1

    def _after(self, last: int, word) -> int:
        """The state of the text that ended in `last`, with word added."""
        nxt, link, length = self.next, self.link, self.len
        p = last
        if word in nxt[p]:
            q = nxt[p][word]
            return q if length[q] == length[p] + 1 else self._split(p, q, word)
        new = self._state(length[last] + 1, 0, {})
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word) -> int:
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words, weight: int = 1) -> None:
        self._counted = False
        state = 0
        for w in words:
            state = self._after(state, w)
            self.count[state] += weight

    def settle(self) -> None:
        """Give every state the occurrences of all states that it is a suffix of."""
        if not self._counted:
            for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
                self.count[self.link[s]] += self.count[s]
            self._counted = True

    def spans(self, words, window: int, least: int) -> list[tuple[int, int]]:
        """Maximal [start, end) ranges of words in windows that occur `least` times or more."""
        self.settle()
        state, match, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                match = self.len[state]
            if w in self.next[state]:
                state, match = self.next[state][w], match + 1
            while self.len[self.link[state]] >= window if state else False:
                state = self.link[state]
                match = self.len[state]
            if match >= window and self.count[state] >= least:
                s, e = i + 1 - window, i + 1
                if out and s <= out[-1][1]:
                    out[-1] = (out[-1][0], e)
                else:
                    out.append((s, e))
        return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _join(a, b):
    """A hash of the sequences with hashes a and b, one after the other; arrays of unsigned 64-bit integers."""
    import numpy as np

    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def run_hashes(words, n: int):
    """Hashes of all runs of n words, from hashes of runs of powers of two."""
    power, size, done, have = words, 1, None, 0
    while True:
        if n & size:
            if done is None:
                done, have = power, size
            else:
                done = _join(done[: len(words) - have - size + 1], power[have:])
                have += size
        if size * 2 > n:
            return done
        power = _join(power[: len(words) - 2 * size + 1], power[size:])
        size *= 2


def least_of(h, width: int):
    """The place of the least of each `width` values, the first of equals."""
    import numpy as np

    at, size = np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        a, b = at[: len(h) - size - step + 1], at[step : step + len(h) - size - step + 1]
        at = np.where(h[b] < h[a], b, a)
        size += step
    return at


def anchored_runs(words: list[bytes], window: int, anchor: int):
    """(anchor hash, first window, windows) of each run of windows with one anchor."""
    import numpy as np
    import xxhash

    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none
    h = xxhash.xxh64_intdigest
    runs = run_hashes(np.array([h(w) for w in words], np.uint64), anchor)
    at = least_of(runs, window - anchor + 1)
    first = np.concatenate(([0], np.nonzero(at[1:] != at[:-1])[0] + 1))
    return runs[at[first]].view(np.int64), first, np.diff(np.append(first, len(at)))


def _keyed(documents: DataFrame) -> DataFrame:
    """d and h, which stand for a row, and its text and doc_id."""
    return texts(documents).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), "doc_id", "text")


def _sites(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                b = batch.slice(s, 500)
                found = [anchored_runs(words_of(t), window, anchor) for t in b.column(2).to_pylist()]
                times = np.array([len(f[0]) for f in found], np.int64)
                keys = [np.repeat(b.column(i).to_numpy(), times) for i in (0, 1)]
                a, first, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, *keys, first.astype(np.int32), n.astype(np.int32))], ["anchor", "d", "h", "lo", "n"])

    return docs.select("d", "h", "text").mapInArrow(run, "anchor long, d long, h long, lo int, n int")


def _pieces(with_sites: DataFrame, window: int) -> DataFrame:
    """anchor, piece, digest, place and heat of every run of windows listed for a document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                b = batch.slice(s, 200)
                rows = []
                for d, h, text, sites in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    words = words_of(text)
                    for site in sites:
                        piece = b" ".join(words[site["lo"] : site["lo"] + site["n"] + window - 1])
                        rows.append((site["anchor"], piece, hashlib.blake2b(piece, digest_size=16).digest(), d, h, site["lo"], site["hot"]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor", "piece", "digest", "d", "h", "lo", "hot"])

    return with_sites.mapInArrow(run, "anchor long, piece binary, digest binary, d long, h long, lo int, hot boolean")


_FLAGS = "digest binary, s array<int>, e array<int>"


def _flag_batch(rows):
    import pyarrow as pa

    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([[x for x, _ in r[1]] for r in rows], ints), pa.array([[y for _, y in r[1]] for r in rows], ints)], ["digest", "s", "e"])


def _shards(pieces: DataFrame, window: int) -> DataFrame:
    """Flagged ranges of each different piece; pieces: anchor, digest, piece, sorted by anchor and digest."""

    def group(rows):
        kinds: dict[bytes, list] = {}
        for _, digest, piece in rows:
            kinds.setdefault(digest, [piece, 0])[1] += 1
        if len(kinds) == 1:
            ((digest, (piece, n)),) = kinds.items()
            return [(digest, [(0, piece.count(b" ") + 1)])] if n > 1 else []
        automaton, split = Automaton(), {digest: piece.split(b" ") for digest, (piece, _) in kinds.items()}
        for digest, words in split.items():
            automaton.add(words, kinds[digest][1])
        found = [(digest, automaton.spans(words, window, 2)) for digest, words in split.items()]
        return [f for f in found if f[1]]

    def run(batches):
        held = []
        for b in batches:
            out = []
            for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and held[-1][0] != r[0]:
                    out += group(held)
                    held = []
                held.append(r)
            yield _flag_batch(out)
        if held:
            yield _flag_batch(group(held))

    return pieces.select("anchor", "digest", "piece").mapInArrow(run, _FLAGS)


def _hot_shards(distinct: DataFrame, window: int) -> DataFrame:
    """The same for anchors with many pieces: windows are counted one by one."""

    def windows(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for digest, piece, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = piece.split(b" ")
                rows += [(digest, i, hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=16).digest(), n) for i in range(len(words) - window + 1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["digest", "i", "w", "n"])

    every = distinct.select("digest", "piece", "n").mapInArrow(windows, "digest binary, i int, w binary, n long")
    twice = every.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w")
    found = every.join(twice, "w").groupBy("digest").agg(F.sort_array(F.collect_list("i")).alias("s"))  # at most `window` of a piece
    return found.select("digest", "s", F.transform("s", lambda i: i + window).alias("e"))


def repeated_spans(documents: DataFrame, window: int = 35) -> DataFrame:
    """d, h (see _keyed) and the ranges s[i], e[i] of words, possibly overlapping, that repeated windows cover."""
    anchor = min(ANCHOR, window)
    docs = _keyed(documents)
    sites = stored(_sites(docs, window, anchor), "substring-sites")
    # Stored, so that the join reads two plain exchanges, of which Spark can split the partition of a frequent anchor.
    twice = stored(sites.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor", (F.col("c") > HOT).alias("hot")), "substring-anchors")
    chosen = stored(sites.join(twice, "anchor").groupBy("d", "h").agg(F.collect_set(F.struct("anchor", "lo", "n", "hot")).alias("sites")), "substring-chosen")  # of one document
    discard(sites)
    pieces = stored(_pieces(docs.select("d", "h", "text").join(chosen, ["d", "h"]).select("d", "h", "text", "sites"), window), "substring-pieces")
    normal = pieces.where("NOT hot").select("anchor", "digest", "piece").repartition("anchor").sortWithinPartitions("anchor", "digest")
    counted = pieces.where("hot").groupBy("digest", "piece").agg(F.count("*").alias("n"))
    flags = stored(_shards(normal, window).unionByName(_hot_shards(counted, window)), "substring-flags")
    placed = pieces.select("digest", "d", "h", "lo").join(flags, "digest")
    moved = placed.select("d", "h", F.transform("s", lambda x: x + F.col("lo")).alias("s"), F.transform("e", lambda x: x + F.col("lo")).alias("e"))
    spans = stored(moved.groupBy("d", "h").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("e")).alias("e")), "substring-spans")  # of one document
    for x in (pieces, chosen, twice, flags):
        discard(x)
    return spans


def _removed(joined: DataFrame, text: bool) -> DataFrame:
    """joined: doc_id, text, s, e. doc_id, n_words, n_removed and the kept words: their SHA-256, or as kept_text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                rows = []
                for doc, t, s, e in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    words = words_of(t)
                    gone = 0
                    if s:
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, e, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        gone = int(len(words) - stay.sum())
                        kept = b" ".join([w for w, k in zip(words, stay.tolist(), strict=True) if k])
                    else:
                        kept = b" ".join(words)
                    rows.append((doc, len(words), gone, kept.decode("utf-8", "surrogatepass") if text else hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text" if text else "kept_sha256"])

    return joined.select("doc_id", "text", "s", "e").mapInArrow(run, f"doc_id long, n_words long, n_removed long, {'kept_text' if text else 'kept_sha256'} string")


def dedup_substrings(documents: DataFrame, window: int = 35, text: bool = False) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_removed, kept_sha256 (or, where text, kept_text)."""
    joined = _keyed(documents).join(repeated_spans(documents, window), ["d", "h"], "left")
    return _removed(joined, text)


def remove_reference_spans(documents: DataFrame, reference: list[str], window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: words in windows that also occur in one of the reference texts go.

    The reference is cut into shards of texts, whose automata are broadcast; it is refused beyond BROADCAST_WORDS words.
    """
    split = [words_of(t) for t in reference]
    if sum(map(len, split)) > BROADCAST_WORDS:
        raise ValueError(f"a reference of over {BROADCAST_WORDS} words is not broadcast")
    shards, size = [Automaton()], 0
    for words in split:
        if size and size + len(words) > SHARD_WORDS:
            shards.append(Automaton())
            size = 0
        shards[-1].add(words)
        size += len(words)
    for a in shards:
        a.settle()
    sent = documents.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        import pyarrow as pa

        ints = pa.list_(pa.int32())
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                found.append([x for a in sent.value for x in a.spans(words, window, 1)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[s for s, _ in f] for f in found], ints), pa.array([[e for _, e in f] for f in found], ints)], ["doc_id", "text", "s", "e"])

    return _removed(texts(documents).mapInArrow(run, "doc_id long, text string, s array<int>, e array<int>"), True)
