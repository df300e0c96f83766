"""Queries on joins, sets and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ledger as L
from ..operators import sets as S
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.query("""
SELECT s.event_id, s.user_id, (SELECT min(e.event_id) FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'signup' AND e.event_id > s.event_id) AS next_id FROM events s WHERE s.event_type = 'error'
""")
def asof_successor(spark, sf_dir):
    """Each error with its user's next signup."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    out = J.successor(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'signup'").drop("event_type"), ["user_id"], "event_id")
    return out.select("event_id", "user_id", F.col("next.event_id").alias("next_id"))


@R.query("""
WITH b AS (SELECT user_id, event_type, min(value) AS v, min(event_id % 7) AS who FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2), a AS (SELECT user_id, event_type, max(value) AS v, min(event_id % 7) AS who FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
SELECT a.event_type, sum(CASE WHEN b.user_id IS NULL THEN a.v WHEN a.who IS NOT DISTINCT FROM b.who AND a.v >= b.v THEN a.v - b.v END) AS delta, count(CASE WHEN b.user_id IS NULL THEN a.v WHEN a.who IS NOT DISTINCT FROM b.who AND a.v >= b.v THEN a.v - b.v END) AS members
FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1
""", rounds={"delta": 4})
def attributed_deltas(spark, sf_dir):
    """Two half-month snapshots, joined where a member's identity is the same in both."""
    e = load(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    early, late = e.where("ts < TIMESTAMP_NTZ '2024-01-16'"), e.where("ts >= TIMESTAMP_NTZ '2024-01-16'")
    b = early.groupBy("key").agg(F.min("value").alias("v"), F.min(F.col("event_id") % 7).alias("who"))
    a = late.groupBy("key", "event_type").agg(F.max("value").alias("v"), F.min(F.col("event_id") % 7).alias("who"))
    return J.attributed_deltas(b, a, "key", ["who"], "event_type", "v")


@R.query("""
WITH b AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS started, c_acctbal - c_custkey % 3 AS cpu FROM customer WHERE c_custkey % 4 > 0)
SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal - cpu > 0) AS grown FROM customer JOIN b ON pid = c_custkey AND started = c_nationkey GROUP BY 1
""")
def identity_bracket(spark, sf_dir):
    """Processes (customers) that are in both snapshots with one start: a quarter is missing before, a tenth had another start under the same number."""
    c = load(spark, sf_dir, "customer")
    before = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("pid"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("started"), (F.col("c_acctbal") - F.col("c_custkey") % 3).alias("cpu"))
    after = c.select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("started"), F.col("c_acctbal").alias("cpu"))
    joined = J.identity_join(before, after, "pid", ["started"])
    return joined.groupBy(F.col("started").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cpu") - F.col("was.cpu") > 0).alias("grown"))


@R.query("""
WITH p AS (SELECT page_id, '/' || regexp_extract(url, '^[^:]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages), s(scope, prefix) AS (VALUES ('english', '/en'), ('german', '/de'), ('one', '/en/1'), ('all', ''))
SELECT page_id, arg_max(scope, length(prefix)) AS scope FROM p LEFT JOIN s ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id
""")
def path_prefix_join(spark, sf_dir):
    """Pages with the innermost scope that holds their path."""
    p = load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", r"^[^:]+://[^/?#]*/([^?#]*)", 1)).alias("path"))
    s = spark.createDataFrame([("english", "/en"), ("german", "/de"), ("one", "/en/1"), ("all", "")], "scope string, prefix string")
    return J.path_join(p, "path", s, "prefix").select("page_id", "scope.scope")


@R.query("""
SELECT s.s_suppkey, count(*) AS n, min(c_custkey) AS first FROM supplier s JOIN customer c ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 50 GROUP BY 1
""")
def range_join(spark, sf_dir):
    """Customers whose balance lies in a span above each supplier's, over buckets."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 50).alias("hi"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return J.interval_join(c, "c_acctbal", s, "lo", "hi", 100).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))


_HALVES = """
WITH h AS (SELECT o_custkey, o_orderkey % 2 AS half, CASE WHEN bool_or(o_totalprice > 450000) THEN 'failed' ELSE 'passed' END AS outcome FROM orders GROUP BY 1, 2), n AS (SELECT o_custkey, outcome AS now FROM h WHERE half = 0), b AS (SELECT o_custkey, outcome AS before FROM h WHERE half = 1)
"""


def _halves(spark, sf_dir):
    h = load(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("half")).agg(F.when(F.bool_or(F.col("o_totalprice") > 450000), "failed").otherwise("passed").alias("outcome"))
    return h.where("half = 0").drop("half"), h.where("half = 1").drop("half")


@R.query(_HALVES + """
SELECT o_custkey, now, before, CASE WHEN now IS NULL THEN 'gone' WHEN now <> 'passed' AND starts_with(CAST(o_custkey AS VARCHAR), '99') THEN 'quarantined' WHEN now <> 'passed' AND coalesce(before <> 'passed', false) THEN 'known' WHEN now <> 'passed' THEN 'new' WHEN before <> 'passed' THEN 'recovered' ELSE 'fine' END AS change FROM n FULL JOIN b USING (o_custkey)
""")
def status_diff(spark, sf_dir):
    now, before = _halves(spark, sf_dir)
    return J.status_diff(now, before, ["o_custkey"], quarantined=["99"])


@R.query(_HALVES + "SELECT o_custkey, now AS left_value, before AS right_value, CASE WHEN now IS NULL OR before IS NULL THEN 'unknown' WHEN now = before THEN 'match' ELSE 'drift' END AS verdict FROM n FULL JOIN b USING (o_custkey)")
def drift_compare(spark, sf_dir):
    now, before = _halves(spark, sf_dir)
    return J.compare(now, before, ["o_custkey"], "outcome")


@R.query(_HALVES + """
SELECT o_custkey, before AS old, now AS new, CASE WHEN n.now IS NULL THEN 'left' WHEN b.before IS NULL THEN 'entered' ELSE 'changed' END AS change FROM b FULL JOIN n USING (o_custkey) WHERE before IS DISTINCT FROM now
""")
def reconcile_roots(spark, sf_dir):
    now, before = _halves(spark, sf_dir)
    return J.reconcile(before, now, "o_custkey", "outcome")


@R.query("""
SELECT l_orderkey AS consumer, CASE WHEN bool_or(coalesce(o_orderstatus = 'F', false)) THEN 'hold' WHEN bool_and(coalesce(o_orderstatus = 'O', false)) THEN 'release' ELSE 'wait' END AS decision FROM (SELECT DISTINCT l_orderkey, l_partkey % 15000 AS p FROM lineitem) LEFT JOIN orders ON o_orderkey = p GROUP BY 1
""")
def release_decisions(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("consumer"), (F.col("l_partkey") % 15000).alias("producer")).distinct()
    s = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"))
    return J.release(e, s, done=["O"], bad=["F"])


@R.query("""
SELECT o_orderkey AS key, generation, arg_min(s, CASE s WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS state FROM (SELECT o_orderkey, 1 AS generation FROM orders) LEFT JOIN (SELECT l_orderkey, l_linenumber AS g, l_returnflag AS s FROM lineitem) ON l_orderkey = o_orderkey AND g = generation GROUP BY 1, 2
""")
def generation_states(spark, sf_dir):
    m = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(1).alias("generation"))
    s = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("generation"), F.col("l_returnflag").alias("state"))
    return J.generation_state(m, s, ["A", "N", "R"])


@R.query("SELECT c_custkey AS key, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000 UNION SELECT user_id FROM events) AS admitted FROM customer")
def admitted_units(spark, sf_dir):
    u = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = load(spark, sf_dir, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("key"))
    return J.admitted(u, o, load(spark, sf_dir, "events").select(F.col("user_id").alias("key")))


@R.query("SELECT DISTINCT l_suppkey AS key FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey > 20)")
def newly_durable(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "key")
    children = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"))
    return J.newly_durable(children, s.where("s_acctbal > 0"), s.where("s_nationkey < 5"), s.where("s_nationkey > 20"))


@R.query("""
SELECT p_brand AS label, max(p_retailprice / 1000) AS burst, max(p_size) AS processes, max(p_partkey) AS memory, any_value(m) AS mean_cpu, CAST(CASE WHEN max(p_retailprice / 1000) > 1.25 THEN ceil(max(p_retailprice / 1000)) ELSE 1 END AS BIGINT) AS cpus
FROM part JOIN (SELECT p_brand AS b, CASE WHEN sum(l_extendedprice) > 0 THEN sum(l_quantity) / sum(l_extendedprice) END AS m FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) ON b = p_brand GROUP BY 1
""", rounds={"mean_cpu": 8, "burst": 6})
def test_sizing(spark, sf_dir):
    p, li = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    samples = p.select(F.col("p_brand").alias("label"), (F.col("p_retailprice") / 1000).alias("burst_cpu"), F.col("p_size").alias("processes"), F.col("p_partkey").alias("peak_memory_bytes"))
    execs = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("label"), F.col("l_quantity").alias("cpu_seconds"), F.col("l_extendedprice").alias("wall_seconds"))
    return J.sizing(samples, execs).withColumn("cpus", F.col("cpus").cast("long"))


@R.query("""
SELECT o_orderkey AS key, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE coalesce(arg_max(CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE l_returnflag END, (l_linenumber, l_partkey, l_suppkey)), 'missing') END AS verdict FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def attempt_verdicts(spark, sf_dir):
    a = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("attempt"), F.when(F.col("l_returnflag") == "R", "failed").otherwise(F.col("l_returnflag")).alias("outcome"))
    return J.attempts_verdict(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), a)


@R.query("""
WITH f AS (SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1)
SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS m FROM f) WHERE m = 1
""")
def latest_artifacts(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return J.latest_artifacts(o, ["o_custkey", "o_orderpriority"], "o_orderkey", ["o_custkey"], "o_orderkey")


@R.query("""
SELECT owner, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT CAST(l_quantity AS BIGINT) AS b, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) THEN 'owned' WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_retailprice < 1500) THEN 'source_only' ELSE 'unattributed' END AS owner FROM lineitem) GROUP BY 1
""")
def attribution_bytes(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key")
    files = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("bytes"))
    return J.attribution(files, ("owned", p.where("p_size < 10")), ("source_only", p.where("p_retailprice < 1500")))


@R.query("SELECT o_orderkey AS key, o_custkey AS idx, o_custkey AS inode FROM (SELECT *, max(o_custkey) OVER (PARTITION BY o_orderkey % 100) AS newest FROM orders) WHERE 1700000000 - epoch_us(o_orderdate) / 1e6 > 800000000 AND o_custkey < newest AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def log_retention(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey"), (F.col("o_orderkey") % 100).alias("key"), F.col("o_custkey").alias("idx"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("mtime"), F.col("o_custkey").alias("inode"))
    held = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("inode"))
    return J.retention(o, held, 1_700_000_000.0, 800_000_000.0).select(F.col("o_orderkey").alias("key"), "idx", "inode")


@R.query("SELECT c_custkey AS key, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name) AS last_pass FROM customer LEFT JOIN nation ON n_nationkey = c_custkey")
def carried_forward(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.expr("CASE WHEN c_acctbal > 0 THEN c_mktsegment END").alias("last_pass"))
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("last_pass"))
    return J.carried_forward(c, n, "key", "last_pass")


def _edges(spark, sf_dir, half):
    o = load(spark, sf_dir, "orders").where((F.col("o_orderkey") % 2) == half)
    return o.select(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))


@R.query("SELECT o_custkey AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 EXCEPT SELECT c_custkey, '5-LOW' FROM customer")
def set_growth(spark, sf_dir):
    exempt = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.lit("5-LOW").alias("b"))
    return S.growth(_edges(spark, sf_dir, 0), _edges(spark, sf_dir, 1), exempt)


@R.query("SELECT o_custkey AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 2 = 1 EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0")
def set_gone(spark, sf_dir):
    return S.gone(_edges(spark, sf_dir, 0), _edges(spark, sf_dir, 1))


@R.query("SELECT o_custkey AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 2 = 1 INTERSECT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0")
def set_ratchet(spark, sf_dir):
    return S.ratchet(_edges(spark, sf_dir, 0), _edges(spark, sf_dir, 1))


@R.query("SELECT o_custkey AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def bag_difference(spark, sf_dir):
    return S.bag_difference(_edges(spark, sf_dir, 0), _edges(spark, sf_dir, 1))


@R.query("SELECT l_suppkey AS key, least(a, b) AS figure FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS b FROM lineitem GROUP BY 1)")
def ratchet_figures(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b"))
    return S.ratchet_figures(g.select("key", F.col("b").alias("figure")), g.select("key", F.col("a").alias("figure")), "key", "figure")


@R.query("SELECT target, count(*) AS n, bool_or(coalesce(trim(owner) = '', true)) AS ownerless FROM (SELECT n_regionkey AS target, n_name AS owner FROM nation UNION ALL SELECT r_regionkey, '' FROM region WHERE r_regionkey < 2 UNION ALL SELECT s_suppkey + 1000, CASE WHEN s_acctbal > 0 THEN s_name END FROM supplier) GROUP BY 1 HAVING count(*) > 1 OR bool_or(coalesce(trim(owner) = '', true))")
def exclusion_faults(spark, sf_dir):
    n, r, s = (load(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    lists = S.exclusions(
        ("lane", n.select(F.col("n_regionkey").cast("long").alias("target"), F.col("n_name").alias("owner"))),
        ("manual", r.where("r_regionkey < 2").select(F.col("r_regionkey").cast("long").alias("target"), F.lit("").alias("owner"))),
        ("hold", s.select((F.col("s_suppkey") + 1000).alias("target"), F.expr("CASE WHEN s_acctbal > 0 THEN s_name END").alias("owner"))),
    )
    return S.exclusion_faults(lists)


@R.query("""
SELECT s_nationkey AS kind, s_suppkey AS n, CASE WHEN s_acctbal < 0 THEN 'old' WHEN (SELECT bool_and(h >= 2) FROM (SELECT count(*) FILTER (WHERE s_acctbal >= 0) AS h FROM supplier WHERE s_nationkey < 3 GROUP BY s_nationkey)) AND s_nationkey < 3 AND nth <= 2 THEN 'me' END AS holder
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, s_acctbal >= 0 ORDER BY s_suppkey) AS nth FROM supplier)
""")
def ledger_take(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    tokens = s.select(F.col("s_nationkey").alias("kind"), F.col("s_suppkey").alias("n"), F.when(F.col("s_acctbal") < 0, "old").alias("holder"))
    demand = s.where("s_nationkey < 3").select(F.col("s_nationkey").alias("kind"), F.lit(2).alias("need")).distinct()
    return L.take(tokens, demand, "me")


@R.query("""
WITH want AS (SELECT c_custkey AS holder, c_nationkey AS kind, c_acctbal AS want FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)), have AS (SELECT c_custkey AS holder, c_nationkey AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE 0.0 END AS have FROM customer WHERE c_custkey % 2 = 0)
SELECT holder, kind, want, have, CASE WHEN want.want IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM want FULL JOIN have USING (holder, kind) WHERE want.want IS DISTINCT FROM have.have
""")
def ledger_reconcile(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("holder"), F.col("c_nationkey").alias("kind"), F.col("c_acctbal").alias("amount"))
    live = load(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("holder"))
    mirror = c.where("holder % 2 = 0").withColumn("amount", F.when(F.col("holder") % 3 == 0, F.col("amount")).otherwise(0.0))
    return L.reconcile(c, mirror, live)


@R.query("""
SELECT s_nationkey AS kind, s_name AS name FROM (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n FROM supplier WHERE s_acctbal < 5000) JOIN (SELECT n_nationkey, 3 - count(s_suppkey) AS need FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal >= 5000 GROUP BY 1) ON n_nationkey = s_nationkey WHERE n <= need
""")
def ledger_resurrect(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("kind"), F.col("s_name").alias("name"), "s_acctbal")
    wanted = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kind"), F.lit(3).alias("n"))
    return L.resurrect(s.where("s_acctbal < 5000").drop("s_acctbal"), s.where("s_acctbal >= 5000"), wanted)
