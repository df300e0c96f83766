"""Queries on scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as C
from ..sources.records import json_fault
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.query("SELECT o_custkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM (SELECT o_custkey, min(m) AS lo, max(m) AS hi FROM (SELECT *, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS island FROM (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders)) GROUP BY o_custkey, island) GROUP BY 1")
def range_list_codec(spark, sf_dir):
    """Months with orders as range lists; parsing them again gives the months."""
    m = load(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"))
    return C.as_ranges(m, ["o_custkey"], "m")


@R.query("SELECT o_custkey, list_aggregate(list_sort(list(DISTINCT year(o_orderdate) * 12 + month(o_orderdate))), 'string_agg', ',') AS months FROM orders GROUP BY 1")
def range_list_parse(spark, sf_dir):
    return range_list_codec(spark, sf_dir).select("o_custkey", F.array_join(C.parse_ranges(F.col("ranges")), ",").alias("months"))


@R.query("""SELECT event_id, sha256('{"type":"' || event_type || '","user":' || user_id || '}') AS digest FROM events""")
def canonical_digest(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", C.canonical_digest(user=F.col("user_id"), type=F.col("event_type")).alias("digest"))


@R.query("SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest, 'grant-' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 12) AS key FROM orders GROUP BY 1")
def list_digests(spark, sf_dir):
    g = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("k"))
    return g.select("o_custkey", C.list_digest(F.col("k")).alias("digest"), C.digest_key("grant", F.col("o_custkey").cast("string")).alias("key"))


@R.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS VARCHAR) AS fault FROM events")
def strict_props(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", C.json_number(F.col("props"), "$.k").alias("k"), json_fault(F.col("props")).alias("fault"))


@R.query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0, CAST(l_quantity AS BIGINT) - CAST(floor(l_extendedprice * 1000000 / 1073741824) AS BIGINT)) AS rounding, CASE WHEN l_tax >= 0 THEN l_tax END AS tax FROM lineitem")
def rounding_amounts(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", C.rounding_gib(F.col("l_quantity").cast("long"), F.col("l_extendedprice") * 1000000).alias("rounding"), C.nonnegative(F.col("l_tax")).alias("tax"))


@R.query("""
SELECT doc_id, list_aggregate(list_distinct(list_transform(regexp_extract_all(text, '#([0-9]+)', 1), lambda x: CAST(x AS BIGINT))), 'count') AS n_refs, regexp_matches(text, '(?i)\\b(fixed|resolved|passes|verified)\\b') AND NOT regexp_matches(text, 'https?://\\S+|\\b[0-9a-f]{40}\\b') AS unproven FROM documents
""".replace("\\\\", "\\"))
def text_references(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(C.references(F.col("text"))).cast("long").alias("n_refs"), C.claims_without_proof(F.col("text")).alias("unproven"))


@R.query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS package, CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN CAST(regexp_extract(url, 'page=([0-9]+)', 1) AS INTEGER) END AS page, CASE WHEN contains(url, 'utm_source') THEN 'campaign' WHEN contains(url, 'page=') THEN 'paged' ELSE 'plain' END AS kind FROM pages")
def text_cascade(spark, sf_dir):
    u = F.col("url")
    kind = C.cascade((F.contains(u, F.lit("utm_source")), "campaign"), (F.contains(u, F.lit("page=")), "paged"), otherwise="plain")
    package = F.regexp_extract(u, r"^(.*)/[^/]*$", 1)
    return load(spark, sf_dir, "pages").select("page_id", package.alias("package"), C.first_group(u, r"page=([0-9]+)").alias("page"), kind.alias("kind"))


@R.query("SELECT conv_id, turn, substr(text, 1, 40) AS head, octet_length(encode(text)) AS full_bytes, length(text) > 40 AS was_cut FROM conversations")
def inline_streams(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", C.inline_stream(F.col("text"), 40).alias("s"))
    return c.select("conv_id", "turn", F.col("s.text").alias("head"), F.col("s.full_bytes").cast("long").alias("full_bytes"), "s.was_cut")


_TAGS = "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), c AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer)"


@R.query(_TAGS + """
SELECT o_orderkey, len(list_filter([o_orderstatus, CASE WHEN o_orderpriority < '3' THEN 'fast' ELSE o_orderstatus END], lambda t: NOT list_contains(CASE WHEN c_acctbal > 0 THEN ['O', 'P', 'fast'] ELSE ['O'] END, t))) = 0 AND (o_orderpriority <> '1-URGENT' OR coalesce(CASE WHEN c_nationkey < 20 THEN c_acctbal > 5000 END, false)) AS fits
FROM o JOIN c ON c_custkey = o_custkey
""")
def placement_match(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    need = F.array("o_orderstatus", F.when(F.col("o_orderpriority") < "3", "fast").otherwise(F.col("o_orderstatus")))
    offered = F.when(F.col("c_acctbal") > 0, F.array(F.lit("O"), F.lit("P"), F.lit("fast"))).otherwise(F.array(F.lit("O")))
    gpu = F.when(F.col("c_nationkey") < 20, F.col("c_acctbal") > 5000)
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", P.placement(need, offered, F.col("o_orderpriority") == "1-URGENT", gpu).alias("fits"))


@R.query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity > 45 OR p_size > 40 AS never, 50 - l_quantity >= 10 AND 50 - p_size >= l_linenumber AS room,
  CASE WHEN 10 - l_quantity > 0 AND l_linenumber - p_size > 0 THEN 'cpu,mem' WHEN 10 - l_quantity > 0 THEN 'cpu' WHEN l_linenumber - p_size > 0 THEN 'mem' ELSE '' END AS unfunded
FROM lineitem JOIN part ON p_partkey = l_partkey
""")
def resource_fit(spark, sf_dir):
    """Needs against totals and against what is free, as maps by kind, and what funding leaves of a need."""
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    both = li.join(p, li.l_partkey == p.p_partkey)
    kinds = lambda cpu, mem: F.create_map(F.lit("cpu"), cpu.cast("double"), F.lit("mem"), mem.cast("double"))
    used, total, need = kinds(F.col("l_quantity"), F.col("p_size")), kinds(F.lit(45), F.lit(40)), kinds(F.lit(10), F.col("l_linenumber"))
    free = kinds(50 - F.col("l_quantity"), 50 - F.col("p_size"))
    left = F.array_join(F.array_sort(F.map_keys(C.funded_remainder(need, used))), ",")
    return both.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", P.never_fits(used, total).alias("never"), P.room_fits(need, free).alias("room"), left.alias("unfunded"))


@R.query("""
SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'no capacity' WHEN o_totalprice > 450000 THEN 'never fits' WHEN o_totalprice + c_acctbal * 10 > 450000 THEN 'no room now' END AS reason, CASE WHEN c_acctbal < 0 THEN false ELSE o_totalprice > 450000 END AS permanent,
  coalesce(o_totalprice + c_acctbal + 1 <= CASE WHEN c_nationkey < 20 THEN 300000 END, false) AS fenced
FROM orders JOIN customer ON c_custkey = o_custkey
""")
def capability_cascade(spark, sf_dir):
    """The first refusal of a cascade, and a fence whose unknown capacity never admits."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    verdict = P.admission(F.col("o_totalprice"), F.col("c_acctbal") * 10, F.when(F.col("c_acctbal") >= 0, F.lit(450000.0)))
    reason = F.when(F.col("v.reason") == "capacity unknown", "no capacity").otherwise(F.col("v.reason"))
    fence = P.fence_fits(F.col("o_totalprice"), F.col("c_acctbal"), F.lit(1), F.when(F.col("c_nationkey") < 20, F.lit(300000)))
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("v", verdict).select("o_orderkey", reason.alias("reason"), F.col("v.permanent").alias("permanent"), fence.alias("fenced"))


@R.query("SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AND count(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END) = count(*) AS agree FROM (SELECT o_custkey, o_orderpriority, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def digests_agree(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", F.expr("CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END").alias("digest"))
    return P.all_agree(o, ["o_custkey"], "digest")


@R.query("SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def conflicting_digests(spark, sf_dir):
    return P.conflicting(load(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@R.query("SELECT user_id, event_id, 1704600000 - epoch_us(ts) / 1e6 BETWEEN 0 AND 86400 AS fresh FROM events")
def freshness(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return load(spark, sf_dir, "events").select("user_id", "event_id", P.fresh(F.lit(1704600000), at, 86400.0).alias("fresh"))
