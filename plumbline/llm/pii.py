"""Personal data by base patterns and bootstrapped contextual extraction (operator 4). DataFrame functions only.

Base patterns find emails, IPv4 addresses, card numbers and phone numbers, leftmost and non-overlapping within a
kind; matches that fail a kind's test are dropped. These are the seeds of a graph of lexical patterns (the one or two
words before a token) and instances (tokens with a digit or an @). Rounds score it: an instance that a base span
covers scores 1 for that kind, another the best score of its patterns; a pattern scores, for a kind, the mean of
its distinct instances' scores. Patterns with MIN_SEEDS distinct seeds or more of a kind and a score of MIN_SCORE or
more are trusted, and a token after a trusted pattern that no base span overlaps is a discovered identifier, of kind `id`.

Places are code points, the end exclusive. They are sums over the matches of a document, in windows of one document;
patterns are counted by partial aggregates, so a frequent pattern is no hot task.

Null texts count as empty and have no spans. Repeated rows and rows of one doc_id are documents of their own. An
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts

KINDS = ("email", "ip", "card", "phone", "id")
# Fixed patterns. Possessive forms (++, *+) match the same as greedy ones here, as nothing can be given back to any
# use; card runs of under 14 digits fail their test and are not matched at all.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
MIN_SEEDS, MIN_SCORE, ROUNDS = 5, 0.8, 3


def _tail(gap: Column) -> Column:
    """An end of the text that holds its last two words: 64 characters where they do, else all of it."""
    end = F.right(gap, F.lit(64))
    return F.when(F.size(F.split(F.trim(end, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", 4)) >= 3, end).otherwise(gap)


def _matches(text: Column, order: int, pattern: str, may: Column) -> Column:
    """Of each match: kind, number, the match, the length of the text since the last one, and that text's end."""
    found = F.transform(
        F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("gap")),
        lambda z, i: F.struct(F.lit(order).alias("kind"), i.alias("i"), z["m"].alias("m"), F.length(z["gap"]).alias("skip"), _tail(z["gap"]).alias("before")),
    )
    none = F.array().cast("array<struct<kind:int,i:int,m:string,skip:int,before:string>>")
    return F.when(may, found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _passes(kind: Column, m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    n = F.length(_digits(m))
    return (
        F.when(kind == 1, F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255)))
        .when(kind == 2, F.when((n >= 14) & (n <= 19), luhn(_digits(m))).otherwise(False))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def located(documents: DataFrame) -> DataFrame:
    """row, doc_id, kind (place in KINDS; 9: a token that may be an instance; -1: one per document), start, end, m, before."""
    t = F.col("text")
    digit = F.col("text").rlike("[0-9]")
    every = F.concat(
        F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit("").alias("m"), F.lit(0).alias("skip"), F.lit("").alias("before"))),
        _matches(t, 0, EMAIL, t.contains("@")), _matches(t, 1, IP, t.rlike(r"[0-9]\.[0-9]")), _matches(t, 2, CARD, t.rlike(r"[0-9][\x20-]?[0-9]")), _matches(t, 3, PHONE, t.contains("+")),
        _matches(t, 9, TOKEN, digit | t.contains("@")),
    )
    rows = texts(documents).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode_outer(every).alias("x")).select("row", "doc_id", "x.*")
    far = F.sum(F.col("skip").cast("long") + F.length("m")).over(W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("end", far).withColumn("start", F.col("end") - F.length("m"))
    return placed.where(_passes(F.col("kind"), F.col("m"))).select("row", "doc_id", "kind", "start", "end", "m", "before")


def _overlapping(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """tokens with `seed`, the least kind of a base span that overlaps; both are spans of the same rows, a few each."""
    spans = base.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    seen = F.array_min(F.transform(F.filter("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), lambda s: s["kind"]))
    return tokens.join(spans, "row", "left").withColumn("seed", F.when(F.col("spans").isNotNull(), seen)).drop("spans")


def trusted_patterns(tokens: DataFrame) -> DataFrame:
    """pattern, score of the trusted ones; tokens: pattern (array), m, seed."""
    edges = cut(tokens.select(F.explode("patterns").alias("pattern"), "m", "seed").groupBy("pattern", "m").agg(F.min("seed").alias("seed")))
    kinds = F.array(*[F.when(F.col("seed") == k, 1.0).otherwise(0.0) for k in range(4)])
    scores = edges.select("pattern", "m", kinds.alias("s"))
    trusted = None
    for _ in range(ROUNDS):
        means = [F.avg(F.get("s", F.lit(k))).alias(f"k{k}") for k in range(4)]
        seeds = [F.sum(F.when(F.get("s", F.lit(k)) == 1.0, 1).otherwise(0)).alias(f"n{k}") for k in range(4)]
        graded = scores.groupBy("pattern").agg(*means, *seeds)
        best = F.greatest(*[F.when(F.col(f"n{k}") >= MIN_SEEDS, F.col(f"k{k}")).otherwise(0.0) for k in range(4)])
        trusted = cut(graded.withColumn("score", best).where(F.col("score") >= MIN_SCORE))
        # Instances of no seed take the best scores of their patterns, damped by that score.
        lent = edges.where("seed IS NULL").join(trusted, "pattern").groupBy("m").agg(*[F.max(F.col("score") * F.col(f"k{k}")).alias(f"k{k}") for k in range(4)])
        scores = edges.join(lent, "m", "left").select("pattern", "m", F.when(F.col("seed").isNotNull() | F.col("k0").isNull(), kinds).otherwise(F.array(*[F.col(f"k{k}") for k in range(4)])).alias("s"))
    return trusted.select("pattern", "score")


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and discovered) of every row, and n_discovered."""
    spans = cut(located(documents))
    base = spans.where("kind BETWEEN 0 AND 3")
    tokens = spans.where("kind = 9")
    words = F.split(F.trim(F.lower("before"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    one, two = F.element_at(words, -1), F.array_join(F.slice(words, -2, 2), " ")
    tokens = tokens.withColumn("patterns", F.filter(F.array(F.when(F.size(words) >= 2, two), F.when(one != "", one)), lambda p: p.isNotNull()))
    tokens = cut(_overlapping(tokens, base))
    trusted = trusted_patterns(tokens)
    found = tokens.where("seed IS NULL").select("row", "doc_id", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern", "left_semi")
    found = found.select("row", "doc_id", F.lit(4).alias("kind"), "start", "end").distinct()
    every = base.select("row", "doc_id", "kind", "start", "end").unionByName(found).unionByName(spans.where("kind = -1").select("row", "doc_id", "kind", "start", "end"))
    packed = every.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end")))).alias("s"), *[F.sum((F.col("kind") == k).cast("long")).alias(f"n{k}") for k in range(5)])
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return packed.select(
        "doc_id", F.col("n0").alias("n_email"), F.col("n1").alias("n_ip"), F.col("n2").alias("n_card"), F.col("n3").alias("n_phone"),
        F.sha2(text(F.filter("s", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), text(F.col("s")).alias("spans"), F.col("n4").alias("n_discovered"),
    )
