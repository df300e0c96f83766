"""Queries on the metric catalogue: orders stand for queue items, nations for hosts, events for telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
NOW = 1_000_000_000.0
_UNIX = "epoch_us(o_orderdate) / 1e6"


def _flat(m):
    """Labels as text, so that rows compare across engines."""
    entries = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return m.select("name", F.array_join(entries, ",").alias("labels"), "value")


def _unix(c):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


@R.query(f"""
WITH g AS (SELECT o_orderstatus AS s, count(*) AS n, {NOW} - min({_UNIX}) AS age, sum(o_custkey % 3) AS r FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT 'queue_items' AS name, 'state=' || s AS labels, CAST(n AS DOUBLE) AS value FROM g UNION ALL SELECT 'queue_oldest_age_seconds', 'state=' || s, age FROM g UNION ALL SELECT 'queue_unstarted_releases', 'state=' || s, CAST(r AS DOUBLE) FROM g
""")
def queue_gauges(spark, sf_dir):
    """The listing of state F is incomplete, so it has no gauges."""
    items = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state"), _unix("o_orderdate").alias("published_unix"), (F.col("o_custkey") % 3).alias("unstarted_releases"))
    states = spark.createDataFrame([("O", True), ("P", True), ("F", False)], "state string, complete boolean")
    return _flat(M.queue(items, states, NOW))


@R.query(f"""
WITH o AS (SELECT s_suppkey AS host, CAST({NOW} - s_acctbal AS DOUBLE) AS a, s_nationkey FROM supplier), v AS (SELECT *, {NOW} - a AS age FROM o WHERE {NOW} - a >= 0), f AS (SELECT * FROM v WHERE age <= 5000)
SELECT 'worker_up' AS name, 'host=' || host AS labels, CAST(age <= 5000 AS INT)::DOUBLE AS value FROM v UNION ALL SELECT 'worker_offer_age_seconds', 'host=' || host, age FROM v
UNION ALL SELECT 'worker_capacity', 'host=' || host || ',resource=cpu', 8 FROM f UNION ALL SELECT 'worker_observed_capacity', 'host=' || host || ',resource=cpu', s_nationkey FROM f
UNION ALL SELECT 'worker_memory_domain_info', 'domain=' || d || ',host=' || host, 1 FROM f, (VALUES ('a'), ('b')) x(d) UNION ALL SELECT 'worker_memory_available_bytes', 'host=' || host, s_nationkey * 1073741824.0 FROM f UNION ALL SELECT 'worker_loops', 'host=' || host, 2 FROM f
""", rounds={"value": 3})
def worker_gauges(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    offers = s.select(
        F.col("s_suppkey").alias("host"), (F.lit(NOW) - F.col("s_acctbal")).alias("announced_unix"), F.create_map(F.lit("cpu"), F.lit(8)).alias("capacity"), F.create_map(F.lit("cpu"), F.col("s_nationkey")).alias("observed"), F.array(F.lit("a"), F.lit("b")).alias("domains"), F.col("s_nationkey").cast("long").alias("memory_gib"), F.lit(2).alias("loops")
    )
    return _flat(M.workers(offers, NOW, 5000.0))


@R.query(f"""
WITH a AS (SELECT o_custkey % 40 AS host, CASE WHEN o_orderstatus = 'P' THEN 'gpu' ELSE 'cpu' END AS kind, {NOW} - {_UNIX} > 205000000 AS stale, o_orderpriority = '1-URGENT' AS cleanup, {_UNIX} AS t, o_orderkey % 5 AS need FROM orders)
SELECT 'active_jobs' AS name, 'host=' || host || ',kind=' || kind AS labels, CAST(count(*) AS DOUBLE) AS value FROM a WHERE host NOT IN (SELECT host FROM a WHERE stale) GROUP BY host, kind
UNION ALL SELECT 'cleanup_pending_claims', 'host=' || host, count(*) FROM a WHERE cleanup GROUP BY host UNION ALL SELECT 'cleanup_pending_oldest_seconds', 'host=' || host, max({NOW} - t) FROM a WHERE cleanup GROUP BY host
UNION ALL SELECT 'reserved_resources', 'host=' || h || ',resource=cpu', coalesce(v, 0) FROM (SELECT unnest(range(0, 50)) AS h) LEFT JOIN (SELECT host, sum(need) AS v FROM a GROUP BY 1) ON host = h
""")
def claim_gauges(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    active = o.select(
        (F.col("o_custkey") % 40).alias("host"), F.when(F.col("o_orderstatus") == "P", "gpu").otherwise("cpu").alias("kind"), _unix("o_orderdate").alias("leased_unix"), (F.col("o_orderpriority") == "1-URGENT").alias("cleanup_pending"), _unix("o_orderdate").alias("first_failure_unix"), F.create_map(F.lit("cpu"), F.col("o_orderkey") % 5).alias("demand")
    )
    hosts = spark.range(50).select(F.col("id").alias("host"), F.lit("cpu").alias("resource"))
    return _flat(M.claims(active, hosts, NOW, 205_000_000.0))


@R.query(f"""
WITH r AS (SELECT o_custkey % 100 AS host, CASE WHEN o_orderstatus = 'O' THEN 'done' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'unknown' END AS outcome, {_UNIX} AS p, {_UNIX} + o_custkey AS c, {_UNIX} + o_totalprice AS f FROM orders), i AS (SELECT * FROM r WHERE f > {NOW} - 100000000 AND f <= {NOW}),
g AS (SELECT host, avg(c - p) AS wm, max(c - p) AS wx, avg(f - c) AS rm, max(f - c) AS rx, count(*) AS n FROM i GROUP BY host)
SELECT 'terminal_outcomes' AS name, 'host=' || host || ',outcome=' || outcome AS labels, CAST(count(*) AS DOUBLE) AS value FROM i GROUP BY host, outcome
UNION ALL SELECT 'terminal_outcomes_window_jobs', '', (SELECT count(*) FROM i) UNION ALL SELECT 'terminal_outcomes_window_seconds', '', 100000000 UNION ALL SELECT 'terminal_outcomes_window_complete', '', CAST((SELECT count(*) FROM r) <= 10000000 AS INT) UNION ALL SELECT 'terminal_collection_success', '', 1
UNION ALL SELECT 'queue_wait_seconds', 'host=' || host || ',stat=mean', wm FROM g UNION ALL SELECT 'queue_wait_seconds', 'host=' || host || ',stat=max', wx FROM g UNION ALL SELECT 'execution_seconds', 'host=' || host || ',stat=mean', rm FROM g UNION ALL SELECT 'execution_seconds', 'host=' || host || ',stat=max', rx FROM g
UNION ALL SELECT 'terminal_timing_window_jobs', 'host=' || host || ',phase=queue_wait', n FROM g UNION ALL SELECT 'terminal_timing_window_jobs', 'host=' || host || ',phase=execution', n FROM g
""", rounds={"value": 3})
def terminal_gauges(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    at = _unix("o_orderdate")
    outcome = F.when(F.col("o_orderstatus") == "O", "done").when(F.col("o_orderstatus") == "F", "failed").otherwise("lost")
    records = o.select((F.col("o_custkey") % 100).alias("host"), outcome.alias("outcome"), F.lit(True).alias("readable"), at.alias("published_unix"), (at + F.col("o_custkey")).alias("claimed_unix"), (at + F.col("o_totalprice")).alias("finished_unix"))
    return _flat(M.terminals(records, NOW, 100_000_000.0, 10_000_000))


@R.query("""
WITH i AS (SELECT user_id % 10 AS host, event_type AS reason, user_id AS k, value, event_id FROM events WHERE epoch_us(ts) / 1e6 > 1705276800 - 604800 AND epoch_us(ts) / 1e6 <= 1705276800), l AS (SELECT arg_max(host, event_id) AS host, arg_max(reason, event_id) AS reason FROM i GROUP BY k)
SELECT 'claim_denials' AS name, 'host=' || host || ',reason=' || reason AS labels, CAST(count(*) AS DOUBLE) AS value FROM l GROUP BY host, reason
""")
def denial_gauges(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("host"), F.col("user_id").alias("key"), F.lit(1).alias("generation"), _unix("ts").alias("denied_unix"), F.col("event_type").alias("reason"))
    return _flat(M.denials(rows, 1705276800.0, 604800.0))


@R.query("""
WITH m AS (SELECT s_nationkey AS host, count(*) AS cap FROM supplier GROUP BY 1), j AS (SELECT c_nationkey AS host, count(*) AS jobs FROM customer WHERE c_acctbal > 9000 GROUP BY 1), w AS (SELECT n_nationkey AS host, n_regionkey AS region FROM nation)
SELECT host, cap / 2.0::DOUBLE AS capacity, CAST(jobs AS DOUBLE) AS jobs, CAST(region AS DOUBLE) AS region FROM (SELECT CAST(host AS VARCHAR) AS host, cap FROM m) FULL JOIN (SELECT CAST(host AS VARCHAR) AS host, jobs FROM j) USING (host) FULL JOIN (SELECT CAST(host AS VARCHAR) AS host, region FROM w) USING (host)
""")
def dashboard_overview(spark, sf_dir):
    """Grouped queries side by side per host, as an overview table shows them."""
    s, c, n = (load(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    m = M.union(
        M.gauges(s.groupBy(F.col("s_nationkey").alias("host")).agg(F.count(F.lit(1)).alias("v")), {"worker_capacity": "v"}, "host"),
        M.gauges(c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("host")).agg(F.count(F.lit(1)).alias("v")), {"active_jobs": "v"}, "host"),
        M.gauges(n.select(F.col("n_nationkey").alias("host"), F.col("n_regionkey").alias("v")), {"worker_up": "v"}, "host"),
    )
    return M.side_by_side("host", capacity=M.by(M.select(m, "worker_capacity"), "host", "max", 0.5), jobs=M.by(M.select(m, "active_jobs"), "host"), region=M.by(M.select(m, "worker_up"), "host", "max"))


@R.query("SELECT sum(n) AS value FROM (SELECT s_nationkey AS h, count(*) AS n FROM supplier GROUP BY 1) WHERE CAST(h AS VARCHAR) SIMILAR TO '1.*' AND CAST(h AS VARCHAR) NOT SIMILAR TO '.*[05]'")
def dashboard_total(spark, sf_dir):
    g = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("host")).agg(F.count(F.lit(1)).alias("v"))
    m = M.gauges(g, {"worker_up": "v"}, "host")
    return M.total(M.select(m, "worker_up", like={"host": "1.*"}, unlike={"host": ".*[05]"}))


ORACLES["dashboard_total"] = ORACLES["dashboard_total"].replace("SELECT sum(n)", "SELECT CAST(sum(n) AS DOUBLE)")
