"""Queries on telemetry, tier, residency and collection gauges: events stand for samples, lineitems for moves, suppliers for hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import load
from .metrics import NOW, _flat, _unix
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_UNIX = "epoch_us(o_orderdate) / 1e6"


@R.query("""
WITH s AS (SELECT user_id % 40 AS host, event_id % 11 AS nonce, epoch_us(ts) / 1e6 AS t, value AS cpu, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 10 + event_id % 7 END AS wall, user_id AS peak, event_id AS io, value - 3 AS pc, epoch_us(ts) / 1e6 - 5 AS pt FROM events),
u AS (SELECT *, 1706000000 - t AS age, nonce < 10 AND 1706000000 - t BETWEEN 0 AND 1400000 AND wall > 0 AS ok FROM s), r AS (SELECT *, CASE WHEN ok AND t > pt AND cpu >= pc THEN (cpu - pc) / (t - pt) END AS rec FROM u),
g AS (SELECT host, CASE WHEN bool_and(ok) THEN sum(cpu / CASE WHEN wall > 0 THEN wall END) END AS cores, CASE WHEN bool_and(ok) THEN count(*) END AS jobs, count(*) FILTER (WHERE NOT ok) AS lost, max(peak) FILTER (WHERE ok) AS peak, sum(io) FILTER (WHERE ok) AS io, max(age) FILTER (WHERE ok) AS oldest, sum(rec) AS rec, count(rec) AS rn FROM r GROUP BY host),
m AS (
SELECT 'attempt_observed_resources' AS name, 'host=' || host || ',resource=cpu_cores' AS labels, CAST(cores AS DOUBLE) AS value FROM g UNION ALL SELECT 'attempt_peak_resources', 'host=' || host || ',resource=memory_peak_bytes', peak FROM g UNION ALL SELECT 'attempt_peak_resources', 'host=' || host || ',resource=io_read_bytes', io FROM g
UNION ALL SELECT 'attempt_telemetry_jobs', 'host=' || host, jobs FROM g UNION ALL SELECT 'attempt_telemetry_unavailable_jobs', 'host=' || host, lost FROM g UNION ALL SELECT 'attempt_telemetry_age_seconds', 'host=' || host, oldest FROM g
UNION ALL SELECT 'attempt_recent_cores', 'host=' || host, rec FROM g UNION ALL SELECT 'attempt_recent_cores_jobs', 'host=' || host, CASE WHEN rn > 0 THEN rn END FROM g)
SELECT * FROM m WHERE value IS NOT NULL
""", rounds={"value": 3})
def attempt_telemetry_gauges(spark, sf_dir):
    """A host's aggregates need a usable sample of each of its claims: nonces of 10 are wrong ones, a wall time of 0 is no sample."""
    e = load(spark, sf_dir, "events")
    at = _unix("ts")
    nonce = F.col("event_id") % 11
    samples = e.select(
        (F.col("user_id") % 40).alias("host"), F.col("event_id").alias("claim"), nonce.alias("nonce"), F.when(nonce < 10, nonce).otherwise(-1).alias("expected_nonce"), at.alias("sampled_unix"), F.col("value").alias("cpu_s"),
        F.when(F.col("event_id") % 17 == 0, 0).otherwise(10 + F.col("event_id") % 7).alias("wall_s"), F.col("user_id").alias("memory_peak"), F.col("event_id").alias("io_read"), (F.col("value") - 3).alias("prev_cpu_s"), (at - 5).alias("prev_unix"),
    )
    return _flat(M.telemetry(samples, 1706000000.0, 1_400_000.0))


@R.query(f"""
WITH g AS (SELECT s_suppkey AS host, s_nationkey FROM supplier)
SELECT 'admission_evidence_age_seconds' AS name, 'host=' || host || ',resource=' || r AS labels, CAST(s_nationkey AS DOUBLE) AS value FROM g, (VALUES ('cpu'), ('gpu')) x(r)
UNION ALL SELECT 'admission_plateau', 'host=' || host || ',resource=gpu', CASE WHEN s_nationkey % 3 = 1 THEN 1 ELSE 0 END FROM g WHERE s_nationkey % 3 > 0
""")
def admission_gauges(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    n = F.col("s_nationkey")
    status = F.when(n % 3 == 1, "plateau").when(n % 3 == 2, "rising")
    evidence = s.select(F.col("s_suppkey").alias("host"), F.explode(F.array(F.lit("cpu"), F.lit("gpu"))).alias("resource"), (F.lit(NOW) - n).alias("sampled_unix"), status.alias("status"))
    return _flat(M.admission(evidence, NOW))


@R.query("""
WITH s AS (SELECT l_suppkey AS tier, max(l_extendedprice) AS best, arg_max(l_extendedprice, struct_pack(a := l_shipdate, b := l_orderkey, c := l_partkey, d := l_linenumber)) AS ceiling, arg_max(l_quantity, struct_pack(a := l_shipdate, b := l_orderkey, c := l_partkey, d := l_linenumber)) AS probe FROM lineitem GROUP BY 1),
t AS (SELECT s_suppkey AS tier, s_nationkey + 10 AS cap, s_nationkey AS av FROM supplier)
SELECT 'tier_fill_supply_mb_s' AS name, 'stat=best,tier=' || tier AS labels, best AS value FROM s UNION ALL SELECT 'tier_fill_supply_mb_s', 'stat=ceiling,tier=' || tier, ceiling FROM s UNION ALL SELECT 'tier_fill_supply_mb_s', 'stat=probe_offer,tier=' || tier, probe FROM s
UNION ALL SELECT 'tier_tokens', 'resource=gib,state=' || st || ',tier=' || tier, CASE st WHEN 'capacity' THEN cap WHEN 'available' THEN av ELSE cap - av END FROM t, (VALUES ('capacity'), ('available'), ('held')) x(st)
""")
def tier_gauges(spark, sf_dir):
    """Fill supply of tiers by their receipts (a supplier is a tier), and tokens by state; the latest receipt is that of the last line."""
    li, s = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier")
    supply = li.select(F.col("l_suppkey").alias("tier"), F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_linenumber").alias("at"), F.col("l_extendedprice").alias("rate"), F.col("l_quantity").alias("probe"))
    tokens = s.select(F.col("s_suppkey").alias("tier"), F.lit("gib").alias("resource"), (F.col("s_nationkey") + 10).alias("capacity"), F.col("s_nationkey").alias("available"))
    return _flat(M.tiers(supply, tokens))


@R.query("""
WITH i AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'claimed' ELSE 'done' END AS state, CASE WHEN o_custkey % 9 < 7 THEN 't' || o_custkey % 9 END AS tier FROM orders WHERE o_orderpriority <> '5-LOW'), p AS (SELECT coalesce(tier, 'unknown') AS tier, state, count(*) AS n FROM i GROUP BY 1, 2),
g AS (SELECT 't' || k AS tier, st AS state FROM (SELECT unnest(range(0, 12)) AS k), (VALUES ('ready'), ('claimed')) x(st) UNION SELECT tier, state FROM p)
SELECT 'mover_queue_depth' AS name, 'state=' || state AS labels, CAST(sum(n) AS DOUBLE) AS value FROM p GROUP BY state UNION ALL SELECT 'mover_queue_depth_tier', 'state=' || g.state || ',tier=' || g.tier, coalesce(n, 0) FROM g LEFT JOIN p USING (tier, state)
""")
def mover_gauges(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 9
    state = F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "claimed").otherwise("done")
    items = o.select(state.alias("state"), F.when(k < 7, F.concat(F.lit("t"), k)).alias("tier"), (F.col("o_orderpriority") != "5-LOW").alias("moves"))
    return _flat(M.movers(items, spark.range(12).select(F.concat(F.lit("t"), "id").alias("tier"))))


@R.query(f"""
WITH q AS (SELECT o_custkey % 20 AS tier, {NOW} - {_UNIX} AS quiet FROM orders WHERE o_orderstatus = 'P'), g AS (SELECT tier, count(*) AS n, max(quiet) AS q FROM q WHERE quiet > 100000000 GROUP BY tier)
SELECT 'starvation_waiting_consumers' AS name, 'tier=' || tier AS labels, CAST(n AS DOUBLE) AS value FROM g UNION ALL SELECT 'starvation_waiting_quiet_max_seconds', 'tier=' || tier, q FROM g
""")
def starvation_gauges(spark, sf_dir):
    c = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 20).alias("tier"), _unix("o_orderdate").alias("last_progress_unix"))
    return _flat(M.starvation(c, NOW, 100_000_000.0))


@R.query("""
WITH p AS (SELECT c_nationkey % 6 AS tier, coalesce(o_orderstatus, 'absent') AS state FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 7),
l AS (SELECT l_suppkey % 6 AS tier, l_linenumber % 2 AS leg, l_linenumber AS pos, l_quantity % 5 AS cur, CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS pub, l_partkey AS bytes FROM lineitem),
g AS (SELECT tier, leg, count(*) FILTER (WHERE pos <= cur AND coalesce(pub, false)) AS st, count(*) FILTER (WHERE pos >= cur AND coalesce(NOT pub, false)) AS un, sum(CASE WHEN pos >= cur AND coalesce(NOT pub, false) THEN bytes ELSE 0 END) AS b FROM l GROUP BY 1, 2)
SELECT 'residency_plans' AS name, 'state=' || state || ',tier=' || tier AS labels, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY state, tier
UNION ALL SELECT 'residency_staged_phases', 'leg=' || leg || ',tier=' || tier, st FROM g UNION ALL SELECT 'residency_unstaged_phases', 'leg=' || leg || ',tier=' || tier, un FROM g UNION ALL SELECT 'residency_unstaged_bytes', 'leg=' || leg || ',tier=' || tier, b FROM g
""")
def residency_gauges(spark, sf_dir):
    """Plans of customers by the state of the order they wait for, and phases (lines) staged behind and unstaged ahead of a cursor; flag R is unknown."""
    c, o, li = (load(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    plans = c.select(F.col("c_custkey").alias("plan"), (F.col("c_nationkey") % 6).alias("tier"), (F.col("c_custkey") * 7).alias("consumer"))
    published = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False)
    phases = li.select(
        F.col("l_orderkey").alias("plan"), (F.col("l_suppkey") % 6).alias("tier"), (F.col("l_linenumber") % 2).alias("leg"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") % 5).alias("cursor"), published.alias("published"), F.col("l_partkey").alias("bytes")
    )
    return _flat(M.residency(plans, o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state")), phases))


@R.query("""
WITH r AS (SELECT l_suppkey AS tier, epoch_us(l_shipdate) / 1e6 AS f, l_linestatus <> 'X' AS ok, CASE WHEN l_discount < 0.09 THEN l_extendedprice END AS st, l_quantity * 2000 AS pool, l_tax * 100 AS sec FROM lineitem), i AS (SELECT *, st IS NOT NULL AND pool IS NOT NULL AS bb FROM r WHERE f > 900000000 AND f <= 1000000000 AND ok),
x AS (SELECT *, CASE WHEN bb AND sec > 0 AND pool >= 0.5 * st THEN pool / sec / 1e6 END AS rate FROM i),
g AS (SELECT tier, count(*) AS jobs, count(*) FILTER (WHERE bb AND pool >= 0.5 * st) AS measured, sum(CASE WHEN bb THEN st END) AS st, sum(CASE WHEN bb THEN pool END) AS pool, max(rate) AS best, avg(rate) AS mean, count(rate) AS rated FROM x GROUP BY tier),
m AS (SELECT 'tier_move_jobs' AS name, 'tier=' || tier AS labels, CAST(jobs AS DOUBLE) AS value FROM g UNION ALL SELECT 'tier_move_measured_jobs', 'tier=' || tier, measured FROM g UNION ALL SELECT 'tier_move_staged_bytes', 'tier=' || tier, st FROM g UNION ALL SELECT 'tier_move_pool_read_bytes', 'tier=' || tier, pool FROM g
UNION ALL SELECT 'tier_move_rate_jobs', 'tier=' || tier, rated FROM g UNION ALL SELECT 'tier_move_pool_rate_mb_s', 'stat=best,tier=' || tier, best FROM g UNION ALL SELECT 'tier_move_pool_rate_mb_s', 'stat=mean,tier=' || tier, mean FROM g
UNION ALL SELECT 'tier_move_window_seconds', '', 100000000 UNION ALL SELECT 'tier_move_window_complete', '', CAST((SELECT count(*) FROM r) <= 100000000 AS INT))
SELECT * FROM m WHERE value IS NOT NULL
""", rounds={"value": 4})
def move_gauges(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    receipts = li.select(
        F.col("l_suppkey").alias("tier"), _unix("l_shipdate").alias("filed_unix"), (F.col("l_linestatus") != "X").alias("readable"), F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice")).alias("staged"), (F.col("l_quantity") * 2000).alias("pool_read"), (F.col("l_tax") * 100).alias("seconds")
    )
    return _flat(M.moves(receipts, NOW, 100_000_000.0, cap=100_000_000))


@R.query("""
SELECT 'terminal_box_window' AS name, 'host=' || user_id % 30 || ',metric=' || event_type || ',scope=' || CASE WHEN event_id % 2 = 0 THEN 'box' ELSE 'job' END AS labels, max(value) AS value FROM events GROUP BY 1, 2
""")
def box_window_gauges(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return _flat(M.box_windows(e.select((F.col("user_id") % 30).alias("host"), F.col("event_type").alias("metric"), F.when(F.col("event_id") % 2 == 0, "box").otherwise("job").alias("scope"), "value")))


@R.query(f"""
WITH i AS (SELECT o_custkey % 50 AS host, {_UNIX} AS t, o_orderpriority <> '5-LOW' AS ok FROM orders WHERE o_orderstatus = 'F')
SELECT 'unstarted_release_events' AS name, 'host=' || host AS labels, CAST(count(*) AS DOUBLE) AS value FROM i WHERE t > {NOW} - 200000000 AND ok GROUP BY host UNION ALL SELECT 'unstarted_release_events_complete', '', CAST((SELECT bool_and(ok) AND count(*) <= 100000000 FROM i) AS INT)
""")
def release_event_gauges(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    rows = o.select((F.col("o_custkey") % 50).alias("held_by"), _unix("o_orderdate").alias("released_unix"), (F.col("o_orderpriority") != "5-LOW").alias("readable"))
    return _flat(M.release_events(rows, NOW, 200_000_000.0, 100_000_000))


@R.query("""
SELECT 'collection_success' AS name, '' AS labels, CAST((SELECT bool_and(length(html) > 0) FROM pages) AS INT)::DOUBLE AS value UNION ALL SELECT 'scrape_reads', 'kind=' || event_type, count(*) FROM events GROUP BY event_type
""")
def collection_gauges(spark, sf_dir):
    reads = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return _flat(M.collection(load(spark, sf_dir, "pages").select((F.length("html") > 0).alias("readable")), reads))


@R.query("""
WITH h AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS host FROM customer WHERE c_acctbal > 9990) SELECT CAST(s_nationkey AS VARCHAR) AS host, sum(s_acctbal) * 2 AS value FROM supplier WHERE s_suppkey % 3 <> 0 AND CAST(s_nationkey AS VARCHAR) IN (SELECT host FROM h) GROUP BY 1
""", rounds={"value": 2})
def dashboard_on_label(spark, sf_dir):
    """A gauge's used and free dimensions, of the hosts that another metric names, summed by host and scaled."""
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "cached").when(F.col("s_suppkey") % 3 == 1, "used").otherwise("free")
    memory = M.gauges(s.select(F.col("s_nationkey").alias("host"), kind.alias("dimension"), "s_acctbal"), {"fb_memory": "s_acctbal"}, "host", "dimension")
    up = M.gauges(c.where("c_acctbal > 9990").select(F.col("c_nationkey").alias("host"), "c_acctbal"), {"worker_up": "c_acctbal"}, "host")
    return M.by(M.on_label(M.select(memory, "fb_memory", like={"dimension": "used|free"}), M.select(up, "worker_up"), "host"), "host", scale=2.0)


@R.query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS host FROM customer WHERE c_acctbal > 9900")
def dashboard_label_values(spark, sf_dir):
    c = load(spark, sf_dir, "customer").where("c_acctbal > 9900")
    m = M.union(M.gauges(c.select(F.col("c_nationkey").alias("host"), "c_acctbal"), {"worker_up": "c_acctbal"}, "host"), M.gauges(c.select("c_custkey"), {"other": "c_custkey"}))
    return M.label_values(m, "worker_up", "host")
