"""Queries on order: newest rows, journals, runs, ranges and greedy folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources.tables import load
from ..streaming import feeds
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
READ = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _lines(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", *READ)


@R.query("""
SELECT user_id, event_type, generation, event_id, ties, ties > 1 AS ambiguous FROM (SELECT user_id, event_type, generation, event_id, count(*) FILTER (WHERE generation = top) OVER (PARTITION BY user_id, event_type) AS ties,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY generation DESC, CAST(event_id % 3 = 0 AS INT) DESC, event_id) AS n
  FROM (SELECT *, max(generation) OVER (PARTITION BY user_id, event_type) AS top FROM (SELECT user_id, event_type, event_id, date_trunc('day', ts) AS generation FROM events))) WHERE n = 1
""")
def newest_generation(spark, sf_dir):
    """Newest per user and type by day, so that generations tie; every third event counts as a failure."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("generation"), "event_id")
    return W.newest(e, ["user_id", "event_type"], "generation", F.col("event_id") % 3 == 0)


@R.query("SELECT * FROM (SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 5")
def upsert_newest_n(spark, sf_dir):
    return W.newest_n(load(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("event_id")], 5)


@R.query("""
SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type IN ('signup', 'purchase')) AS lease, arg_max(event_type, event_id) AS last_kind, count(*) AS events, arg_max(event_type, event_id) <> 'error' AS in_effect,
  coalesce(min(event_id) FILTER (WHERE event_type = 'purchase') IS NULL OR min(event_id) FILTER (WHERE event_type = 'signup') < min(event_id) FILTER (WHERE event_type = 'purchase'), false) AS valid
FROM events GROUP BY user_id
""")
def journal_fold(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("kind"), F.col("value").alias("lease"))
    return W.journal(e, ["user_id"], ["event_id"], "signup", "purchase", "error")


@R.query("""
WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, event_id, event_type, repeats FROM (SELECT *, count(*) OVER (PARTITION BY user_id, run) - 1 AS repeats FROM b) WHERE c = 1
""")
def verdict_transitions(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return W.transitions(e, ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "event_type", "repeats")


@R.query("SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS windowed FROM events")
def sliding_max_offer(spark, sf_dir):
    return W.sliding_max(load(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 3)


@R.query("""
WITH a AS (SELECT user_id, event_id, ts, value, value > 30 AS o, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events),
b AS (SELECT *, sum(CASE WHEN NOT o OR gap IS NULL OR gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM a)
SELECT user_id, event_id, value, streak, streak >= 2 AS due FROM (SELECT *, CAST(CASE WHEN o THEN sum(CAST(o AS INT)) OVER (PARTITION BY user_id, island ORDER BY ts) ELSE 0 END AS BIGINT) AS streak FROM b)
""")
def consecutive_exceedance(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return W.exceedance(e, ["user_id"], "ts", "value", 30.0, 43200.0, 2).drop("ts")


@R.query("""
SELECT user_id, event_id, delta, delta < 0 AS reset, CASE WHEN delta >= 0 AND s > 0 THEN delta / s END AS rate FROM (SELECT user_id, event_id, value - lag(value) OVER w AS delta, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
""", rounds={'delta': 4, 'rate': 6})
def counter_rate(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return W.counter_rates(e, ["user_id"], "ts", "value", ["event_id"]).select("user_id", "event_id", "delta", "reset", "rate")


@R.query("""
WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, event_id, event_type, event_id - min(event_id) OVER (PARTITION BY user_id, run) >= 100 AS confirmed FROM b
""")
def debounced_terminal(spark, sf_dir):
    return W.debounced(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 100)


@R.query("""
WITH e AS (SELECT user_id, event_id, nullif(event_type, 'error') AS who FROM events), a AS (SELECT *, CASE WHEN who IS NULL OR who IS DISTINCT FROM lag(who) OVER w OR event_id - lag(event_id) OVER w > 200 THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, event_id, who, CASE WHEN who IS NOT NULL THEN min(event_id) OVER (PARTITION BY user_id, run) END AS since FROM b
""")
def absence_windows(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.expr("nullif(event_type, 'error')").alias("who"))
    return W.absence_windows(e, ["user_id"], "event_id", "who", 200)


@R.query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, e - l_quantity AS start, e AS end FROM r WHERE e - l_quantity < 60 AND e > 20
""")
def interval_overlap(spark, sf_dir):
    """Entries that share a byte with [20, 60) of their order's read order."""
    r = W.running_ranges(_lines(spark, sf_dir), ["l_orderkey"], READ, "l_quantity")
    return W.overlapping(r, F.lit(20), F.lit(60)).select("l_orderkey", "l_linenumber", "start", "end")


@R.query("""
SELECT o_custkey, o_orderkey, coalesce(lag(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS start, c AS end FROM (SELECT o_custkey, o_orderkey, sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS c FROM orders)
""")
def phase_ranges(spark, sf_dir):
    from pyspark.sql import Window

    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("CAST(round(o_totalprice) AS BIGINT)").alias("b"))
    o = o.withColumn("c", F.sum("b").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return W.phase_ranges(o, ["o_custkey"], "o_orderkey", "c").select("o_custkey", "o_orderkey", "start", "end")


@R.query("""
SELECT l_orderkey, coalesce(max(e) FILTER (WHERE e <= 75), 0) AS target FROM (SELECT l_orderkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS e FROM lineitem) GROUP BY 1
""")
def window_target(spark, sf_dir):
    r = W.running_ranges(_lines(spark, sf_dir), ["l_orderkey"], READ, "l_quantity")
    return W.window_target(r, ["l_orderkey"], F.lit(25), F.lit(50))


@R.query("""
SELECT l_orderkey, bool_and(NOT f OR n = s) AS prefix FROM (SELECT l_orderkey, f, row_number() OVER w AS n, sum(CAST(f AS INT)) OVER w AS s FROM (SELECT *, l_returnflag = 'N' AS f FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)) GROUP BY 1
""")
def declared_prefix(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*READ).alias("pos"), (F.col("l_returnflag") == "N").alias("f"))
    return W.contiguous_prefix(li, ["l_orderkey"], "pos", "f")


@R.query("""
WITH RECURSIVE o AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
f AS (SELECT l_orderkey, n, q AS open, CAST(1 AS BIGINT) AS chunk FROM o WHERE n = 1 UNION ALL SELECT f.l_orderkey, o.n, CASE WHEN open + q <= 60 THEN open + q ELSE q END, CASE WHEN open + q <= 60 THEN chunk ELSE chunk + 1 END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1)
SELECT l_orderkey, max(chunk) AS n_chunks, max(open) AS largest FROM f GROUP BY 1
""")
def chunk_packing(spark, sf_dir):
    return W.chunks(_lines(spark, sf_dir), ["l_orderkey"], READ, "l_quantity", 60.0).drop("sizes")


@R.query("""
WITH RECURSIVE o AS (SELECT s_nationkey, s_suppkey, round(abs(s_acctbal)) AS need, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(s_acctbal < 0 AS INT), s_suppkey) AS n FROM supplier),
f AS (SELECT s_nationkey, 0 AS n, 12000.0::DOUBLE AS unspent, CAST(NULL AS BIGINT) AS head, CAST(0 AS BIGINT) AS granted FROM (SELECT DISTINCT s_nationkey FROM supplier)
  UNION ALL SELECT f.s_nationkey, o.n, CASE WHEN head IS NULL AND need <= unspent THEN unspent - need ELSE unspent END, CASE WHEN head IS NULL AND need <= unspent THEN head ELSE coalesce(head, s_suppkey) END, CASE WHEN head IS NULL AND need <= unspent THEN granted + 1 ELSE granted END FROM f JOIN o ON o.s_nationkey = f.s_nationkey AND o.n = f.n + 1)
SELECT s_nationkey, granted AS n_granted, head, unspent FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC) AS last FROM f) WHERE last = 1
""")
def ranked_budget(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal") < 0).cast("int").alias("blocked"), "s_suppkey", F.round(F.abs("s_acctbal")).alias("need"))
    return W.budget_walk(s, ["s_nationkey"], ["blocked", "s_suppkey"], "s_suppkey", "need", 12000.0).drop("granted")


@R.query("""
WITH RECURSIVE o AS (SELECT n_regionkey, n_name, cost, row_number() OVER (PARTITION BY n_regionkey ORDER BY cost DESC, n_name) AS n FROM (SELECT n_regionkey, n_name, CAST(count(*) AS DOUBLE) AS cost FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)),
f AS (SELECT DISTINCT n_regionkey, 0 AS n, [0.0, 0.0, 0.0]::DOUBLE[] AS loads, [0, 0, 0]::BIGINT[] AS members FROM nation
  UNION ALL SELECT f.n_regionkey, o.n, list_transform(range(1, 4), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN cost ELSE 0 END), list_transform(range(1, 4), lambda i: members[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN 1 ELSE 0 END) FROM f JOIN o ON o.n_regionkey = f.n_regionkey AND o.n = f.n + 1)
SELECT n_regionkey, CAST(s - 1 AS INTEGER) AS shard, loads[s] AS load, CAST(members[s] AS BIGINT) AS members FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC) AS last FROM f), (SELECT unnest(range(1, 4)) AS s) WHERE last = 1
""")
def lpt_shards(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    cost = n.join(c, n.n_nationkey == c.c_nationkey).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).cast("double").alias("cost"))
    return W.lpt_shards(cost, ["n_regionkey"], "n_name", "cost", 3)


@R.query("SELECT o_orderstatus, o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 4 AS INTEGER) AS shard FROM orders")
def round_robin_shards(spark, sf_dir):
    return W.round_robin(load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderkey"], 4, ["o_orderstatus"])


@R.query("""
SELECT p_brand, cost, files, CAST(least(row_number() OVER (ORDER BY cost DESC, p_brand) - 1, 3) AS INTEGER) AS shard FROM (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS cost, count(*) AS files FROM part GROUP BY 1)
""")
def setup_shards(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("file"), "p_size")
    return W.setup_shards(p, "p_brand", "p_size", 4).withColumn("files", F.size("files").cast("long"))


@R.query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS n FROM lineitem) WHERE n = 1")
def best_source(spark, sf_dir):
    return W.best_source(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), ["l_orderkey"], "l_quantity", "l_partkey")


@R.query("SELECT o_custkey AS host, o_orderkey AS \"group\", CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) AS INTEGER) AS position FROM orders")
def election_position(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("host"), F.col("o_orderkey").alias("group"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("first_published"))
    return W.elections(o, "host").select("host", "group", "position")


@R.query("SELECT s_nationkey, CASE WHEN bool_and(s_acctbal < 9000) AND count(*) > 1 THEN arg_max(s_suppkey, s_suppkey) END AS victim FROM supplier GROUP BY 1")
def stuck_victim(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_acctbal") < 9000).alias("blocked"), F.col("s_suppkey").alias("consumer"), F.col("s_suppkey").alias("rank"))
    return W.stuck_victim(s, ["s_nationkey"])


@R.query("""
WITH a AS (SELECT user_id, event_id, event_type = 'error' AS short, CASE WHEN event_type = 'error' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') <> 'error' THEN 1 ELSE 0 END AS s FROM events), b AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS episode FROM a)
SELECT user_id, event_id, episode, event_id - min(event_id) FILTER (WHERE short) OVER (PARTITION BY user_id, episode) AS age FROM b WHERE short
""".replace("FROM b WHERE short", "FROM b QUALIFY short"))
def drain_episodes(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("short"))
    return W.episodes(e, ["user_id"], "event_id", "short").drop("short")


@R.query("SELECT user_id, max(value) AS units, bool_or(coalesce(value < p, false)) AS regressed FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def progress_report(spark, sf_dir):
    return W.progress(load(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@R.query("""
SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS was, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR was IS DISTINCT FROM event_type
""")
def message_change_stream(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return feeds.changed(e, ["user_id"], ["event_id"], F.col("event_type"))


@R.query("SELECT event_id AS seq, event_type AS topic, user_id AS id, CAST(NULL AS VARCHAR) AS reset FROM events WHERE event_id > 5000 AND event_type IN ('error', 'signup')")
def cursor_read(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("topic"), F.col("user_id").alias("id"))
    out, reason = feeds.cursor_read(e, "a", 5000, ["error", "signup"], "a", 0)
    return out.withColumn("reset", F.lit(reason).cast("string"))


@R.query("SELECT epoch, seq, id, greatest(last - 49, 0) AS floor FROM (SELECT event_type AS epoch, s AS seq, event_id AS id, max(s) OVER (PARTITION BY event_type) AS last FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS s FROM events)) WHERE seq > last - 50")
def event_ring(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id")
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("epoch"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("event_id").alias("id"))
    return feeds.ring(e, 50).select("epoch", "seq", "id", "floor")
