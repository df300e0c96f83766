"""Queries on aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..sources.records import bounded_scan
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.query("""
SELECT event_type, count(value) AS n, count(*) - count(value) AS skipped, avg(value) AS mean, max(value) AS peak, min(value) AS least, arg_max(value, event_id) AS last, true AS complete
FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type
""", rounds={'mean': 6})
def window_summary(spark, sf_dir):
    """Per event type the samples of a week."""
    e = load(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-08' AND ts < TIMESTAMP_NTZ '2024-01-15'")
    return A.window_summary(e, ["event_type"], "value", ["ts", "event_id"]).withColumn("complete", F.lit(True))


@R.query("""
SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type
""")
def nearest_rank_latency(spark, sf_dir):
    return A.nearest_rank(load(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.9, 0.95, 0.99])


@R.query("SELECT coalesce(nullif(quantile_disc(p_retailprice, 0.9), 0), 1.0) AS value FROM part")
def percentile_fallback(spark, sf_dir):
    return A.percentile_or(load(spark, sf_dir, "part"), "p_retailprice", 0.9, 1.0)


@R.query("""
WITH w AS (SELECT o_orderstatus, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS wait FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderstatus, count(*) FILTER (WHERE wait >= 0) AS jobs, count(*) FILTER (WHERE wait < 0) AS negative, avg(wait) FILTER (WHERE wait >= 0) AS mean_s, max(wait) FILTER (WHERE wait >= 0) AS max_s FROM w GROUP BY o_orderstatus
""", rounds={'mean_s': 4})
def queue_wait_exec(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return A.latency(o.join(li, o.o_orderkey == li.l_orderkey), ["o_orderstatus"], F.col("o_orderdate"), F.col("l_shipdate"))


@R.query("""
WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS at_us FROM events),
h AS (SELECT max(at_us) AS horizon FROM e),
s AS (SELECT user_id, min(at_us) FILTER (WHERE event_type = 'signup') AS fs, min(at_us) FILTER (WHERE event_type = 'purchase') AS fe, count(*) FILTER (WHERE event_type = 'signup') AS starts FROM e GROUP BY user_id),
d AS (SELECT e.user_id, min(at_us) AS ended FROM e JOIN s USING (user_id) WHERE event_type = 'purchase' AND at_us >= fs GROUP BY e.user_id)
SELECT s.user_id, (coalesce(ended, horizon) - fs) / 1e6 AS seconds, fs IS NOT NULL AND ended IS NULL AS right_censored, coalesce(fe < fs, fs IS NULL) AS left_censored, greatest(starts - 1, 0) AS retries
FROM s LEFT JOIN d USING (user_id), h WHERE fs IS NOT NULL OR fe IS NOT NULL
""", rounds={'seconds': 4})
def censored_latency(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    horizon = e.agg(F.max("at")).first()[0]
    return A.censored(e, "user_id", "signup", "purchase", F.lit(horizon).cast("long"))


@R.query("""
WITH s AS (SELECT CAST(l_shipmode AS VARCHAR) AS l_shipmode FROM (SELECT l_linestatus AS l_shipmode FROM lineitem))
SELECT o_orderpriority AS test, l_returnflag AS arch, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome IS NULL) AS missing,
  CASE WHEN count(*) FILTER (WHERE outcome IS NULL) > 0 THEN 'incomplete' WHEN count(*) FILTER (WHERE outcome = 'passed') > 0 AND count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'flaky' WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'failing' ELSE 'stable' END AS class
FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN (SELECT unnest(range(1, 9)) AS repeat)
LEFT JOIN (SELECT o_orderpriority, l_returnflag, CAST(l_linenumber AS BIGINT) AS repeat, CASE WHEN count(*) FILTER (WHERE l_discount > 0.05) * 2 > count(*) THEN 'failed' ELSE 'passed' END AS outcome
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) USING (o_orderpriority, l_returnflag, repeat)
GROUP BY o_orderpriority, l_returnflag
""")
def census_pivot(spark, sf_dir):
    """Outcomes over a fixed grid of repeats; the grid's lists are declared (a few values each)."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    s = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_orderpriority").alias("test"), F.col("l_returnflag").alias("arch"), F.col("l_linenumber").cast("long").alias("repeat"))
    s = s.agg(F.when(F.count_if(F.col("l_discount") > 0.05) * 2 > F.count(F.lit(1)), "failed").otherwise("passed").alias("outcome"))
    return A.outcome_grid(s, o.select(F.col("o_orderpriority").alias("test")).distinct(), ["A", "N", "R"], range(1, 9))


ORACLES["census_pivot"] = ORACLES["census_pivot"].replace("WITH s AS (SELECT CAST(l_shipmode AS VARCHAR) AS l_shipmode FROM (SELECT l_linestatus AS l_shipmode FROM lineitem))\n", "")


@R.query("""
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority, o_orderstatus) AS BIGINT) AS gid, count(*) FILTER (WHERE o_totalprice >= 200000) AS n_opened, count(*) FILTER (WHERE NOT o_totalprice >= 200000) AS n_closed,
  count(*) FILTER (WHERE o_totalprice >= 200000) - count(*) FILTER (WHERE NOT o_totalprice >= 200000) AS net
FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())
""")
def flow_counts(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("opened", F.col("o_totalprice") >= 200000)
    out = A.flow(o, F.expr("TIMESTAMP_NTZ '1997-01-01'"), F.expr("TIMESTAMP_NTZ '1998-01-01'"), "o_orderdate", [["o_orderstatus", "o_orderpriority"], ["o_orderpriority"], []])
    return out.withColumn("gid", F.col("gid").cast("long"))


@R.query("""
SELECT o_orderstatus AS repo, count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_0, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n_1, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n_2 FROM orders GROUP BY 1
""")
def priority_rollup(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "repo")
    return A.rollup_counts(o, "repo", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@R.query("SELECT o_custkey, arg_min(o_orderpriority, (o_totalprice, o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey")
def first_by_rank(spark, sf_dir):
    return A.ranked_first(load(spark, sf_dir, "orders"), "o_custkey", F.struct("o_totalprice", "o_orderkey"), "o_orderpriority")


@R.query("""
SELECT user_id, CAST(CASE WHEN count(v) = count(*) THEN sum(v) END AS BIGINT) AS used, count(*) AS n FROM (SELECT user_id, CASE WHEN event_type = 'error' AND value < 1 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS v FROM events) GROUP BY user_id
""")
def poisoned_totals(spark, sf_dir):
    """Sums that one unknown reading makes unknown."""
    v = F.expr("CASE WHEN event_type = 'error' AND value < 1 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END")
    return load(spark, sf_dir, "events").select("user_id", v.alias("v")).groupBy("user_id").agg(A.poisoned_sum(F.col("v")).alias("used"), F.count(F.lit(1)).alias("n"))


@R.query("""
SELECT l_suppkey, sum(v) AS l_quantity FROM (SELECT l_suppkey, l_partkey, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1
""")
def shared_namespace_sum(spark, sf_dir):
    return A.deduplicated_sum(load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity"), "l_suppkey", "l_partkey", "l_quantity")


@R.query("""
SELECT l_orderkey, max(l_quantity + coalesce(nx, 0)) AS peak FROM (SELECT l_orderkey, l_quantity, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nx FROM lineitem) GROUP BY 1
""")
def adjacent_peak(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"), "l_quantity")
    return A.union_peak(li, "l_orderkey", "pos", "l_quantity")


@R.query("""
SELECT caps, list_aggregate(list_sort(list(file)), 'string_agg', ',') AS files, count(*) AS n FROM (SELECT p_type AS file, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS caps FROM part GROUP BY 1) GROUP BY caps
""")
def capability_cohorts(spark, sf_dir):
    f = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("file")).agg(F.collect_set("p_brand").alias("caps"))
    return A.cohorts(f, "caps").withColumn("files", F.array_join("files", ","))


@R.query("""
WITH per AS (SELECT o_custkey AS test, count(*) AS files, sum(loc) AS loc FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) JOIN w ON w.file = o_orderpriority GROUP BY 1), t AS (SELECT count(*) AS n_files, sum(loc) AS n_loc FROM w)
SELECT avg(files) AS mean_files, quantile_cont(files, 0.5) AS median_files, quantile_disc(files, 0.9) AS p90_files, max(files) AS max_files, avg(files / n_files) AS share_files, avg(loc / n_loc) AS share_loc FROM per, t
""".replace("WITH per", "WITH w AS (SELECT o_orderpriority AS file, count(*) AS loc FROM orders GROUP BY 1), per"), rounds={'mean_files': 6, 'share_files': 6, 'share_loc': 6})
def reach_figures(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    reach = o.select(F.col("o_custkey").alias("test"), F.col("o_orderpriority").alias("file")).distinct()
    weights = o.groupBy(F.col("o_orderpriority").alias("file")).agg(F.count(F.lit(1)).alias("loc"))
    return A.reach_figures(reach, weights, F.lit(1))


@R.query("""
WITH per AS (SELECT l_suppkey AS node, l_linenumber AS repeat, sum(l_quantity) AS s, max(l_returnflag) AS outcome FROM lineitem GROUP BY 1, 2),
c AS (SELECT node, string_agg(outcome || ':' || n, ',' ORDER BY outcome) AS outcomes FROM (SELECT node, outcome, count(*) AS n FROM per GROUP BY 1, 2) GROUP BY 1)
SELECT node, quantile_cont(s, 0.5) AS median_s, max(s) AS max_s, count(*) AS n, any_value(outcomes) AS outcomes FROM per JOIN c USING (node) GROUP BY node
""")
def repeat_ranking(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_linenumber").alias("repeat"), F.col("l_quantity").alias("seconds"), F.col("l_returnflag").alias("outcome"))
    return A.repeat_figures(li).withColumn("outcomes", F.array_join(F.transform(F.map_entries("outcomes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","))


@R.query("SELECT CASE WHEN count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'P', 'F')) > 0 THEN 2 WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 1 WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 3 ELSE 0 END AS exit FROM orders")
def leg_verdict(spark, sf_dir):
    return A.worst_verdict(load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("result")), [("F", 1), ("P", 3), ("O", 0)])


@R.query("""
SELECT frame, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT DISTINCT l_orderkey, l_returnflag AS frame FROM lineitem) JOIN (SELECT l_orderkey, count(*) AS weight FROM lineitem GROUP BY 1) USING (l_orderkey) GROUP BY frame
""")
def inclusive_profile(spark, sf_dir):
    stacks = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("frames"), F.count(F.lit(1)).alias("weight"))
    return A.inclusive_weights(stacks)


@R.query("""
SELECT category, count(*) / 50.0::DOUBLE AS seconds FROM (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS category FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2
""")
def category_seconds(spark, sf_dir):
    category = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return A.category_seconds(load(spark, sf_dir, "part"), category, 50.0, 2)


@R.query("SELECT l_orderkey AS scope, l_linenumber AS name, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def shadowed_names(spark, sf_dir):
    return A.shadowed(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("name")))


@R.query("SELECT s_nationkey AS kind, CASE WHEN count(f) = count(*) THEN greatest(0.0, max(w) - sum(f)) END AS capacity FROM (SELECT s_nationkey, 10000.0 AS w, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS f FROM supplier) GROUP BY 1", rounds={'capacity': 4})
def observed_capacity(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kind"), F.lit(10000.0).alias("wanted"), F.expr("CASE WHEN s_acctbal >= 0 THEN s_acctbal END").alias("foreign"))
    return A.observed_capacity(s)


@R.query("""
SELECT host, bytes, span, best, CASE WHEN span > 0 THEN bytes / span END AS rate FROM (SELECT user_id AS host, CAST(count(*) AS DOUBLE) AS bytes, max(e) - min(b) AS span, max(CASE WHEN e > b THEN 1 / (e - b) END) AS best FROM (SELECT user_id, epoch_us(ts) / 1e6 AS b, epoch_us(ts) / 1e6 + value AS e FROM events) GROUP BY 1)
""", rounds={'rate': 6, 'span': 4, 'best': 6})
def mover_throughput(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    m = load(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("mover"), F.lit(1.0).alias("bytes"), at.alias("begun"), (at + F.col("value")).alias("ended"))
    return A.throughput(m)


@R.query("""
WITH t AS (SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 101)
SELECT event_id, user_id, value, (SELECT count(*) FROM t) <= 100 AS complete FROM t ORDER BY event_id LIMIT 100
""")
def bounded_candidates(spark, sf_dir):
    """The feature is the bound: the first hundred candidates, and whether these are all."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    return bounded_scan(e, F.col("event_type") == "purchase", [F.col("event_id")], 100).select("event_id", "user_id", "value", "complete")
