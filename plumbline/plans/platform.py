"""Scalar functions, sources, pages, release checks and streams over the test tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import expr as E
from plumbline.functions import policy as L
from plumbline.operators import relational as R
from plumbline.plans.base import read
from plumbline.sources import sinks, tables
from plumbline.streaming import ingest

#: Fixed value: the namespace of canonical ids here.
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def json_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result-set payloads built from events, parsed back to rows."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("string")
    rows = F.array(F.array(F.col("user_id").cast("string"), "event_type", k))
    payload = F.to_json(F.struct(F.array(F.struct(F.lit("log").alias("name"), F.array(F.lit("USER"), F.lit("TYPE"), F.lit("K")).alias("headers"), rows.alias("rowSet"))).alias("resultSets")))
    return tables.result_rows(e.select("event_id", payload.alias("payload")), "payload", ["USER", "TYPE", "K"], "log", ["event_id"]).select("event_id", F.col("USER").cast("bigint").alias("user_id"), F.col("TYPE").alias("event_type"), F.col("K").cast("bigint").alias("k"), "bad_width")


def search_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names and slugs, and which contain the query's words."""
    c = read(spark, sf_dir, "customer")
    raw = F.concat(F.lit("  Él-"), F.col("c_name"), F.lit(" ÑANDÚ Jokić Šarić ("), F.col("c_mktsegment"), F.lit(")"))
    return c.select("c_custkey", E.search_name(raw).alias("name"), E.slug(raw).alias("slug"), E.search_name(raw).contains("saric build").alias("hit"))


def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids (version 5) of suppliers."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", E.canonical_id("player", "test", "s_suppkey", NAMESPACE).alias("id"))


def hash_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", E.hash_fold("c_custkey", 5).alias("fold"), E.hash_fold("c_custkey", 32).alias("bucket"))


def output_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-independent SHA-256 of each market segment's customers."""
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"), E.fingerprint("c_custkey", "c_name", "c_nationkey").alias("fingerprint"))


def scalar_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant casts, labels, ages and heights from generated strings."""
    o = read(spark, sf_dir, "orders")
    y = F.year("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).otherwise(F.concat((F.col("o_custkey") % 60).cast("string"), F.lit(":30")))
    return o.select(
        "o_orderkey", E.season_label(y).alias("label"), E.season_start(E.season_label(y)).alias("start"), E.season_start(F.lit("1999-05")).alias("bad_label"), E.whole_number(text).alias("whole"), F.round(E.parse_minutes(text), 6).alias("minutes"),
        F.round(E.age_on(F.make_date(y + 1, F.lit(2), F.lit(1)), F.make_date(1950 + F.col("o_orderkey") % 40, F.lit(1), F.lit(1))), 6).alias("age"), E.height_cm(F.concat((5 + F.col("o_orderkey") % 3).cast("string"), F.lit("-"), (F.col("o_orderkey") % 12).cast("string"))).alias("height"), L.era_group(y - 40).alias("era"),
    )


def leaderboard_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty of a filtered leaderboard."""
    c = read(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY' AND c_acctbal > 0")
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name", "c_acctbal")


def top100_bubble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred by balance and the next twenty, with the gap to the hundredth."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(120)
    p = c.withColumn("position", F.row_number().over(W.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("bigint"))  # 120 rows
    edge = p.where("position = 100").select(F.col("c_acctbal").alias("edge"))
    return p.crossJoin(edge).select("position", "c_custkey", F.round(F.col("c_acctbal") - F.col("edge"), 2).alias("margin"), F.when(F.col("position") <= 100, "IN").otherwise("BUBBLE").alias("side"))


def largest_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest rank changes of parts between two orders."""
    p = read(spark, sf_dir, "part")
    a = p.withColumn("a", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).withColumn("b", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")))
    return a.select("p_partkey", "p_brand", (F.col("b") - F.col("a")).cast("bigint").alias("change")).orderBy(F.desc(F.abs("change")), "p_partkey").limit(10)


def dedupe_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lines with several versions: the canonical row's ship day, and conflicts within a version counted."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"))
    keep, clash = R.latest_wins(li, ["l_orderkey", "l_linenumber"], "day", ["l_partkey"])
    n = clash.groupBy("l_orderkey").agg(F.count("*").alias("clashes"))
    return keep.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.max("day").cast("string").alias("last_day")).join(n, "l_orderkey", "left").select("l_orderkey", "n_lines", "last_day", F.coalesce("clashes", F.lit(0)).cast("bigint").alias("clashes"))


def pivot_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts of each customer by priority, one column each."""
    o = read(spark, sf_dir, "orders")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    p = o.groupBy("o_custkey").pivot("o_orderpriority", names).agg(F.count(F.lit(1)))
    return p.select("o_custkey", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(f"n{n[0]}") for n in names])


def rectangular_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with other columns as one, absent columns NULL."""
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    u = R.rectangular_union(s.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier")), c.select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return u.groupBy("kind", "nation").agg(F.count("supplier").alias("suppliers"), F.count("segment").alias("segments"), F.count("*").alias("n"))


def game_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as games between customer and supplier nations, two rows each, summed by nation."""
    o, c, li, s = (read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem", "supplier"))
    g = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    games = g.select("l_orderkey", F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"), F.col("l_quantity").cast("bigint").alias("hs"), F.col("l_linenumber").cast("bigint").alias("as_"))
    return R.two_sides(games, "home", "away", "hs", "as_", ["l_orderkey"]).groupBy("team").agg(F.count("*").alias("n"), F.sum("own").alias("own"), F.sum("other").alias("other"), F.count_if(F.col("own") > F.col("other")).alias("won"))


def acquisition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.acquisition_plan(spark, 1990, 2001, ["regular", "playoffs"], {"base": 1990, "advanced": 1996})


def resumable_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the work list remains after the years with finished orders are done."""
    done = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("period")).agg(F.when(F.count("*") > 1000, "OK").otherwise("SERVER_ERROR").alias("status"))
    return sinks.pending(acquisition_plan(spark, sf_dir), done, ["period"]).groupBy("period").agg(F.count("*").alias("open"))


def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses classified: errors, empty results and malformed bodies are told apart."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, 429).when(F.col("event_id") % 10 == 2, 503).when(F.col("event_id") % 10 == 3, 404).otherwise(200)
    body = F.when(F.col("event_id") % 10 == 4, "not json").when(F.col("event_id") % 10 == 5, '{"resultSets":[{"name":"a","headers":["X"],"rowSet":[]}]}').otherwise('{"resultSets":[{"name":"a","headers":["X"],"rowSet":[["1"]]}]}')
    return e.groupBy(tables.classify_response(status, body).alias("outcome"), "event_type").agg(F.count("*").alias("n"))


def _tmp(spark: SparkSession, what: str) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="plumbline-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def streaming_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: each batch is written once, and the hours' counts come from what was written."""
    table, checkpoint = _tmp(spark, "events"), _tmp(spark, "events-checkpoint")
    stream = ingest.event_stream(spark, sf_dir, read(spark, sf_dir, "events").schema, "events.parquet")
    ingest.ingest(stream, table, checkpoint, ["event_id"])
    w = ingest.windowed(spark.read.parquet(table), "ts", ["event_type"], "1 hour", "10 minutes")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps of thirty minutes, counted by user."""
    s = ingest.sessions(read(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes", "1 hour")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


_PREFIX = "concat('  Él-', c_name, ' ÑANDÚ Jokić Šarić (', c_mktsegment, ')')"
_NAME = f"trim(regexp_replace(lower(strip_accents({_PREFIX})), '[^a-z0-9]+', ' ', 'g'))"
_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN concat(o_custkey, '.0') ELSE concat(o_custkey % 60, ':30') END"
SQL = {
    "json_payload_rows": "SELECT event_id, user_id, event_type, CAST(props->>'k' AS BIGINT) AS k, false AS bad_width FROM events",
    "search_normalise": f"SELECT c_custkey, {_NAME} AS name, replace({_NAME}, ' ', '-') AS slug, contains({_NAME}, 'saric build') AS hit FROM customer",
    "canonical_id": "WITH h AS (SELECT s_suppkey, sha1(unhex('" + NAMESPACE.replace("-", "") + "') || encode('player:test:' || s_suppkey)) AS h FROM supplier), p AS (SELECT s_suppkey, substr(h, 1, 12) || '5' || substr(h, 14, 3) || lower(to_hex((CAST('0x' || substr(h, 17, 1) AS BIGINT) % 4) + 8)) || substr(h, 18, 15) AS x FROM h) SELECT s_suppkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) AS id FROM p",
    "hash_fold": "SELECT c_custkey, CAST(CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, CAST(CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 32 AS INTEGER) AS bucket FROM customer",
    "output_fingerprint": "WITH h AS (SELECT c_mktsegment, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR))) AS h FROM customer) SELECT c_mktsegment, count(*) AS n_rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)) AS VARCHAR)" for k in range(4)) + ")) AS fingerprint FROM h GROUP BY 1",
    "scalar_parsing": f"""WITH o AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y, {_TEXT} AS t FROM orders)
      SELECT o_orderkey, printf('%d-%02d', y, (y + 1) % 100) AS label, y AS start, CAST(NULL AS INTEGER) AS bad_label, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey END AS whole,
      CASE WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS DOUBLE) WHEN o_orderkey % 4 > 1 THEN round(o_custkey % 60 + 0.5::DOUBLE, 6) END AS minutes,
      round(date_diff('day', make_date(CAST(1950 + o_orderkey % 40 AS BIGINT), 1, 1), make_date(CAST(y + 1 AS BIGINT), 2, 1)) / 365.2425::DOUBLE, 6) AS age, round(((5 + o_orderkey % 3) * 12 + o_orderkey % 12) * 2.54::DOUBLE, 1) AS height, CASE WHEN y - 40 < 1960 THEN 'PRE_1960' ELSE '1960S' END AS era FROM o""",
    "leaderboard_page": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40",
    "top100_bubble": "WITH p AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer) SELECT position, c_custkey, round(c_acctbal - (SELECT c_acctbal FROM p WHERE position = 100), 2) AS margin, CASE WHEN position <= 100 THEN 'IN' ELSE 'BUBBLE' END AS side FROM p WHERE position <= 120",
    "largest_movers": "WITH a AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS change FROM part) SELECT * FROM a ORDER BY abs(change) DESC, p_partkey LIMIT 10",
    "dedupe_quarantine": "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day FROM lineitem), k AS (SELECT l_orderkey, l_linenumber, max(day) AS day FROM l GROUP BY 1, 2), c AS (SELECT l_orderkey, count(*) AS clashes FROM (SELECT l_orderkey, l_linenumber, day FROM l GROUP BY 1, 2, 3 HAVING count(DISTINCT l_partkey) > 1) GROUP BY 1) SELECT k.l_orderkey, count(*) AS n_lines, CAST(max(day) AS VARCHAR) AS last_day, coalesce(max(clashes), 0) AS clashes FROM k LEFT JOIN c ON k.l_orderkey = c.l_orderkey GROUP BY 1",
    "pivot_primitives": "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (WHERE starts_with(o_orderpriority, '{i}')) AS n{i}" for i in range(1, 6)) + " FROM orders GROUP BY 1",
    "rectangular_union": "SELECT 's' AS kind, s_nationkey AS nation, count(*) AS suppliers, CAST(0 AS BIGINT) AS segments, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'c', c_nationkey, 0, count(*), count(*) FROM customer GROUP BY 2",
    "game_sides": "WITH g AS (SELECT c_nationkey AS h, s_nationkey AS a, CAST(l_quantity AS BIGINT) AS hs, CAST(l_linenumber AS BIGINT) AS s2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), t AS (SELECT h AS team, hs AS own, s2 AS other FROM g UNION ALL SELECT a, s2, hs FROM g) SELECT team, count(*) AS n, CAST(sum(own) AS BIGINT) AS own, CAST(sum(other) AS BIGINT) AS other, count(*) FILTER (WHERE own > other) AS won FROM t GROUP BY 1",
    "acquisition_plan": "SELECT CAST(p AS INTEGER) AS period, t AS type, m AS measure FROM range(1990, 2002) r(p), (VALUES ('regular'), ('playoffs')) k(t), (VALUES ('base', 1990), ('advanced', 1996)) w(m, s) WHERE p >= s",
    "resumable_pending": "WITH pl AS (SELECT CAST(p AS INTEGER) AS period FROM range(1990, 2002) r(p), (VALUES ('regular'), ('playoffs')) k(t), (VALUES ('base', 1990), ('advanced', 1996)) w(m, s) WHERE p >= s) SELECT period, count(*) AS open FROM pl WHERE period NOT IN (SELECT year(o_orderdate) FROM orders GROUP BY 1 HAVING count(*) > 1000) GROUP BY 1",
    "request_outcomes": "SELECT CASE event_id % 10 WHEN 0 THEN 'NETWORK_ERROR' WHEN 1 THEN 'RATE_LIMITED' WHEN 2 THEN 'SERVER_ERROR' WHEN 3 THEN 'CLIENT_ERROR' WHEN 4 THEN 'MALFORMED' WHEN 5 THEN 'EMPTY' ELSE 'OK' END AS outcome, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "streaming_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM c GROUP BY 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        json_payload_rows, search_normalise, canonical_id, hash_fold, output_fingerprint, scalar_parsing, leaderboard_page, top100_bubble, largest_movers, dedupe_quarantine, pivot_primitives, rectangular_union, game_sides,
        acquisition_plan, resumable_pending, request_outcomes, streaming_event_counts, event_sessions,
    )
}
