"""Queries on predicates, ledgers, deadlines, verdicts and baselines: customers stand for claims, suppliers for hosts, parts for files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as C
from ..functions import sources
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import sets
from ..operators import similarity as K
from ..operators import windows as W
from ..sources import series
from ..sources.tables import load
from ..streaming import feeds
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.query("""
SELECT event_id, '{"a": ' || value || ', "b": "é\\u00e9 ' || event_type || '"}' AS spaced, '{"a":' || value || ',"b":"\\u00e9\\u00e9 ' || event_type || '"}' AS compact FROM (SELECT event_id, event_type, CAST(value AS VARCHAR) AS value FROM events)
""".replace("é\\u00e9", "éé"))
def rewritten_json(spark, sf_dir):
    """Documents with sorted keys: spaced and unescaped, and compact with ASCII escapes."""
    e = load(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"b" : "éé '), "event_type", F.lit('","a": '), F.col("value").cast("string"), F.lit("}"))
    return e.select("event_id", C.ascii_json(raw, spaced=True, ascii_only=False).alias("spaced"), C.ascii_json(raw).alias("compact"))


@R.query("SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"sub\":{\"text\":\"' || left(regexp_replace(text, '[^a-z ]', '', 'g'), 30) || '\"}}' AS view FROM conversations")
def allowed_views(spark, sf_dir):
    """Only allow-listed keys of documents, long strings cut; what hides at any depth is gone."""
    c = load(spark, sf_dir, "conversations")
    plain = F.regexp_replace("text", "[^a-z ]", "")
    raw = F.to_json(F.struct(F.col("role"), F.lit("x").alias("secret"), F.struct(F.lit(1).alias("hidden"), plain.alias("text")).alias("sub")))
    return c.select("conv_id", "turn", C.allowed_view(raw, ["role", "sub", "text"], width=30).alias("view"))


@R.query("SELECT s_suppkey, 'k' || s_suppkey AS action_key, CAST(s_nationkey AS BIGINT) AS published_unix, s_acctbal AS cpu, CASE WHEN s_suppkey % 2 = 0 THEN 'gpu' END AS first_tag, CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 1 END AS max_attempts FROM supplier")
def queue_rows(spark, sf_dir):
    """Nested actions as flat queue rows; what is absent is null."""
    s = load(spark, sf_dir, "supplier")
    tags = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("gpu")))
    retry = F.struct(F.when(F.col("s_suppkey") % 3 == 0, 5).alias("max_attempts"))
    params = F.struct(F.create_map(F.lit("cpu"), F.col("s_acctbal")).alias("demand"), F.struct(tags.alias("tags")).alias("placement"), retry.alias("retry_policy"))
    action = F.struct(F.concat(F.lit("k"), "s_suppkey").alias("action_key"), F.col("s_nationkey").cast("long").alias("published_unix"), params.alias("params"))
    r = s.select("s_suppkey", C.queue_row(action).alias("r"))
    return r.select("s_suppkey", "r.action_key", "r.published_unix", F.col("r.demand")["cpu"].alias("cpu"), F.get("r.tags", F.lit(0)).alias("first_tag"), "r.max_attempts")


@R.query("SELECT s_suppkey, s_nationkey % 3 = 0 AS same FROM supplier")
def changed_meanings(spark, sf_dir):
    """Whether documents mean the same once volatile fields are left out."""
    s = load(spark, sf_dir, "supplier")
    doc = lambda at, v: F.create_map(F.lit("x"), F.struct(v.alias("verdict"), at.alias("sampled_unix"), (at * 2).alias("age")))
    a, b = doc(F.col("s_acctbal"), F.lit(0)), doc(F.col("s_acctbal") + 1, F.col("s_nationkey") % 3)
    meaning = lambda d: F.to_json(C.without_fields(d, "sampled_unix", "age"))
    return s.select("s_suppkey", (meaning(a) == meaning(b)).alias("same"))


@R.query("""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE ts - INTERVAL 2 HOUR * (event_id % 2) END AS at FROM events
""")
def zoned_times(spark, sf_dir):
    """ISO times with a zone, of which a quarter has none and is null."""
    e = load(spark, sf_dir, "events")
    zone = F.when(F.col("event_id") % 4 == 3, "").when(F.col("event_id") % 2 == 1, "+02:00").otherwise("Z")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return e.select("event_id", C.utc_timestamp(text).cast("timestamp_ntz").alias("at"))


@R.query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'P0' ELSE 'P1' END WHEN o_orderkey % 3 = 1 THEN 'P2' END AS priority, 'a\\*b \\[' || o_orderkey || '\\] c' AS literal FROM orders
""".replace("\\\\", "\\"))
def priorities_and_literals(spark, sf_dir):
    """Priority by label, else by the mark of the title; and texts made harmless."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    labels = F.when(k == 0, F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("P1"), F.lit("P0"))).otherwise(F.array(F.lit("x"), F.lit("P1")))).otherwise(F.array().cast("array<string>"))
    title = F.when(k == 1, "[p2] something").otherwise("P2 is no mark")
    text = F.concat(F.lit("a*b\n["), "o_orderkey", F.lit("]\tc"))
    return o.select("o_orderkey", C.priority(labels, title, ["P0", "P1", "P2"]).alias("priority"), C.literal_text(text).alias("literal"))


@R.query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN -l_partkey ELSE l_suppkey END AS code FROM lineitem
""")
def receipt_codes(spark, sf_dir):
    """The first integer among several places of a receipt."""
    li = load(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 3
    raw = F.when(k == 0, '{"returncode":"x"}').when(k == 1, F.concat(F.lit('{"returncode":-'), "l_partkey", F.lit("}"))).otherwise(F.concat(F.lit('{"result":{"code":'), "l_suppkey", F.lit("}}")))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", C.first_int(raw, "$.returncode", "$.result.code").alias("code"))


@R.query("SELECT p_partkey, list_aggregate(list_sort(list_distinct([x for x in [trim(p_brand), p_type, lower(p_type)] if x <> ''])), 'string_agg', ',') AS advertised FROM part")
def advertised_names(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(C.normal_strings(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), "p_type", F.lower("p_type"), F.concat("p_type", F.lit(" ")))), ",").alias("advertised"))


@R.query("SELECT s_suppkey, CASE WHEN s_nationkey > 0 THEN 'cpu@t' || s_suppkey % 3 || '=' || s_nationkey ELSE '' END || CASE WHEN s_suppkey % 2 > 0 THEN CASE WHEN s_nationkey > 0 THEN ',' ELSE '' END || 'ram@t' || s_suppkey % 3 || '=1' ELSE '' END AS terms, sha256('a=' || s_nationkey || chr(10) || 'b=2') AS digest FROM supplier")
def owner_terms(spark, sf_dir):
    """Windows by kind and tier with zero ones dropped, and a map's digest."""
    s = load(spark, sf_dir, "supplier")
    kinds = F.array(F.struct(F.lit("cpu").alias("kind"), F.col("s_nationkey").alias("window")), F.struct(F.lit("ram").alias("kind"), (F.col("s_suppkey") % 2).cast("int").alias("window")))
    terms = C.owner_terms(kinds, F.concat(F.lit("t"), F.col("s_suppkey") % 3))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(terms), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return s.select("s_suppkey", text.alias("terms"), C.map_digest(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.col("s_nationkey"))).alias("digest"))


@R.query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a/b' || page_id ELSE regexp_extract(url, '^(.*)/[^/]*$', 1) END AS package FROM pages")
def packages(spark, sf_dir):
    """The folder of a path, or of a label before its colon."""
    p = load(spark, sf_dir, "pages")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("//a/b"), "page_id", F.lit(":target"))).otherwise(F.regexp_replace("url", "^[a-z]+:", ""))
    return p.select("page_id", C.package_of(path).alias("package"))


ORACLES["packages"] = ORACLES["packages"].replace("regexp_extract(url,", "regexp_extract(regexp_replace(url, '^[a-z]+:', ''),")


@R.query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN true WHEN c_custkey % 3 = 0 THEN false END AS present, c_nationkey > 5 AND c_custkey % 4 > 0 AS unmeasured, c_custkey % 3 > 0 AND c_acctbal > 0 AND c_custkey % 5 > 0 AS replenish, c_custkey % 2 = 0 AND c_mktsegment = 'BUILDING' AS preempted, c_mktsegment = 'MACHINERY' AS selected,
c_acctbal * 2000000000 + 100000000000 - 1073741824 - c_custkey * 100000 >= 20000000000 AND c_acctbal * 2000000000 + 100000000000 - 1073741824 >= ceil(1.5 * c_custkey * 100000) + 20 * 1073741824.0 AS room, c_custkey % 2 > 0 AND (c_custkey % 3 = 0 OR c_nationkey < 9) AND NOT (c_custkey % 5 > 0 AND 3 <= c_custkey % 5) AS held,
CASE WHEN c_acctbal + 500 > 9000 THEN c_acctbal END AS denied, CASE WHEN c_custkey % 2 = 0 THEN 'a,b' || c_nationkey END AS topics, c_custkey % 2 = 0 AS same FROM customer
""")
def policy_predicates(spark, sf_dir):
    """Predicates of admission, drains, parking and writes; unknown never passes."""
    c = load(spark, sf_dir, "customer")
    k, n, b = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    text = lambda x: F.array(F.lit(x))
    decision = F.format_string('{"reason":"measurement_host_not_idle","fresh":%s,"baseline":{"basis":"unmeasured","exceeds":%s}}', (k % 4 > 0).cast("string"), (n > 5).cast("string"))
    odd = F.when(k % 2 > 0, F.lit("x"))
    return c.select(
        "c_custkey",
        P.present(text("gpu"), F.when(k % 2 == 0, text("gpu")).otherwise(text("cpu")), k % 3 == 0).alias("present"),
        P.unmeasured_refusal(F.lit("adaptive_cpu_refused"), decision).alias("unmeasured"),
        P.replenish_ok(k % 3 == 0, b, F.when(k % 5 > 0, True)).alias("replenish"),
        P.preempted(F.when(k % 2 == 0, "k"), F.when(F.col("c_mktsegment") == "BUILDING", "withdrawn").otherwise("failed"), F.lit(1.0)).alias("preempted"),
        P.runs_any(F.array(F.lit("/bin/sh"), F.concat(F.lit("/opt/"), "c_mktsegment")), ["MACHINERY"]).alias("selected"),
        P.write_space(b * 2_000_000_000 + 100_000_000_000, F.lit(200_000_000_000.0), F.lit(1.0), F.lit(0.1), k * 100_000).alias("room"),
        P.held_back(odd, F.when(k % 3 > 0, text("gpu")), n < 9, F.when(k % 5 > 0, k % 5), F.lit(3)).alias("held"),
        P.unified_memory_denial(b, F.lit(500.0), F.lit(9000.0))["committed"].alias("denied"),
        F.array_join(P.topic_filter(F.when(k % 2 == 0, F.concat(F.lit("a,b"), n)).otherwise("A bad,topic")), ",").alias("topics"),
        P.same_identity((k % 2, F.lit(0)), (F.lit(None), F.lit(None))).alias("same"),
    )


_LINES = "l AS (SELECT l_orderkey AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx, l_partkey AS path, l_suppkey AS o, CAST(l_quantity AS BIGINT) AS bytes FROM lineitem)"


@R.query(f"""
WITH {_LINES}, t AS (SELECT m, count(*) + CASE WHEN m % 11 = 0 THEN 1 ELSE 0 END AS n, sum(bytes) AS b FROM l GROUP BY m), d AS (SELECT DISTINCT m FROM l GROUP BY m, path, o HAVING count(*) > 1)
SELECT m AS manifest, 'duplicate entry' AS fault FROM d UNION ALL SELECT m, 'totals' FROM t WHERE m % 11 = 0 UNION ALL SELECT DISTINCT m, 'unread entry' FROM l WHERE m % 13 = 0 AND idx > 1 UNION ALL SELECT m, 'cumulative' FROM t WHERE m % 17 = 0
""")
def manifest_faults(spark, sf_dir):
    """Orders as manifests of lines: totals that are off by one in an eleventh, entries no phase reads in a thirteenth, and running sums that are off in a seventeenth."""
    entries = _entries(spark, sf_dir)
    totals = entries.groupBy("manifest").agg((F.count(F.lit(1)) + F.when(F.col("manifest") % 11 == 0, 1).otherwise(0)).alias("entry_count"), F.sum("bytes").alias("total_bytes"))
    off = F.when(F.col("manifest") % 17 == 0, 1).otherwise(0)
    read = entries.where("manifest % 13 <> 0 OR idx = 1")
    phases = read.groupBy("manifest").agg(F.array_sort(F.collect_list("idx")).alias("indices"), (F.sum("bytes") + off).alias("cumulative")).withColumn("phase", F.lit(0))
    return P.manifest_faults(entries, phases, totals)


def _entries(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = load(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(w))
    return li.select(F.col("l_orderkey").alias("manifest"), "idx", F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("offset"), F.col("l_quantity").cast("long").alias("bytes"))


@R.query(f"""
WITH {_LINES}, c AS (SELECT m, idx, sum(bytes) OVER (PARTITION BY m ORDER BY idx) AS upto, count(*) OVER (PARTITION BY m) AS n, sum(bytes) OVER (PARTITION BY m) AS total FROM l),
p AS (SELECT m, idx, CASE WHEN m % 7 = 0 AND idx = 2 THEN 0 WHEN m % 9 = 0 AND idx = n THEN upto + 1 ELSE upto END AS v, total, n FROM c), w AS (SELECT *, lag(v) OVER (PARTITION BY m ORDER BY idx) AS was FROM p)
SELECT m AS manifest, idx AS pos, 'goes back' AS fault FROM w WHERE v < was UNION ALL SELECT m, idx, 'off boundary' FROM w WHERE v NOT IN (SELECT upto FROM c WHERE c.m = w.m) UNION ALL SELECT m, idx, 'not the total' FROM w WHERE idx = n AND v <> total
""")
def boundary_faults(spark, sf_dir):
    """Phases that go back in a seventh of the manifests, or end beyond the total in a ninth."""
    from pyspark.sql import Window

    e = _entries(spark, sf_dir)
    whole = Window.partitionBy("manifest")
    c = e.withColumn("upto", F.sum("bytes").over(whole.orderBy("idx"))).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("total", F.sum("bytes").over(whole))
    off = F.when((F.col("manifest") % 7 == 0) & (F.col("idx") == 2), 0).when((F.col("manifest") % 9 == 0) & (F.col("idx") == F.col("n")), F.col("upto") + 1).otherwise(F.col("upto"))
    phases = c.select("manifest", F.col("idx").alias("pos"), off.alias("upto"), "total")
    return P.boundary_faults(phases, c.select("manifest", "upto").distinct(), F.col("total"))


@R.query("""
SELECT doc_id, 'test_' || doc_id AS test, line, rule FROM documents, (VALUES (2, 'constant'), (3, 'self comparison'), (7, 'swallowed')) x(line, rule) WHERE doc_id % 4 > 0
""")
def weak_assertions(spark, sf_dir):
    """Assertions that cannot fail in tests; a quarter of the texts does not parse."""
    sources.register(spark)
    good = F.format_string("def test_%d():\n    assert True\n    assert a.b == a.b\n    assert a == b\n    try:\n        assert a\n    except Exception:\n        pass\n", "doc_id")
    load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "def (").otherwise(good).alias("src")).createOrReplaceTempView("millrace_assertion_sources")
    return spark.sql("SELECT doc_id, f.test, f.line, f.rule FROM millrace_assertion_sources, LATERAL weak_assertions(src) f")


@R.query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'm' || doc_id % 9 END AS marker, CASE doc_id % 4 WHEN 1 THEN 'keyword arguments' WHEN 2 THEN 'an argument that is no constant name' WHEN 3 THEN 'does not parse' END AS refusal FROM documents
""")
def declared_markers(spark, sf_dir):
    """Capability names that tests declare, or why they cannot be told."""
    sources.register(spark)
    k = F.col("doc_id") % 4
    call = F.when(k == 0, F.format_string("'m%d', 'm%d'", F.col("doc_id") % 9, F.col("doc_id") % 9)).when(k == 1, "kind='x'").when(k == 2, "NAME").otherwise("'x'")
    src = F.concat(F.when(k == 3, "def (\n").otherwise(""), F.lit("@pytest.mark.needs("), call, F.lit(")\ndef test_a(): pass\n"))
    load(spark, sf_dir, "documents").select("doc_id", src.alias("src")).createOrReplaceTempView("millrace_marker_sources")
    return spark.sql("SELECT doc_id, f.marker, f.refusal FROM millrace_marker_sources, LATERAL test_markers(src, 'needs') f")


@R.query("""
SELECT doc_id, name, CASE WHEN name = '<module>' THEN doc_id % 3 = 1 WHEN name = 'K.g' THEN doc_id % 3 > 0 ELSE false END AS changed FROM documents, (VALUES ('K.g'), ('h'), ('<module>')) x(name)
UNION ALL SELECT doc_id, name, NULL FROM documents, (VALUES ('LIMIT')) y(name)
""")
def changed_functions(spark, sf_dir):
    """Functions and import-time code of two versions of source texts: a third changes a default, a third a body; and their literal declarations."""
    sources.register(spark)
    text = lambda default, value: F.concat(F.lit("LIMIT = [1, 2]\nclass K:\n    def g(self, a="), default, F.lit("):\n        return "), value, F.lit("\ndef h(): pass\n"))
    k = F.col("doc_id") % 3
    d = load(spark, sf_dir, "documents").select("doc_id", text(F.lit("1"), F.lit("1")).alias("before"), text(F.when(k == 1, "2").otherwise("1"), F.when(k == 2, "2").otherwise("1")).alias("after"))
    d.createOrReplaceTempView("millrace_function_sources")
    side = lambda c: spark.sql(f"SELECT doc_id, f.name, f.body AS {c} FROM millrace_function_sources, LATERAL function_definitions({c}) f")
    both = side("before").join(side("after"), ["doc_id", "name"], "full").select("doc_id", "name", (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))
    names = spark.sql("SELECT doc_id, f.name, CAST(NULL AS BOOLEAN) AS changed FROM millrace_function_sources, LATERAL literal_declarations(before) f")
    return both.unionByName(names)


@R.query("""
WITH r(name, was, change) AS (SELECT 'f' || s_suppkey, NULL, 'changed' FROM supplier WHERE s_suppkey % 5 = 1 UNION ALL SELECT 'f' || s_suppkey, NULL, 'deleted' FROM supplier WHERE s_suppkey % 5 = 2 UNION ALL SELECT 'new' || s_suppkey, 'f' || s_suppkey, 'renamed' FROM supplier WHERE s_suppkey % 5 = 3 UNION ALL SELECT 'more' || s_suppkey, NULL, 'added' FROM supplier WHERE s_suppkey % 10 = 0) SELECT * FROM r
""")
def renamed_functions(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    old = s.select(F.concat(F.lit("f"), k).alias("name"), F.concat(F.lit("body "), k).alias("body"))
    new = s.where(k % 5 != 2).select(F.concat(F.when(k % 5 == 3, "new").otherwise("f"), k).alias("name"), F.concat(F.lit("body "), k, F.when(k % 5 == 1, " more").otherwise("")).alias("body"))
    more = s.where(k % 10 == 0).select(F.concat(F.lit("more"), k).alias("name"), F.concat(F.lit("another "), k).alias("body"))
    return J.renamed_functions(old, new.unionByName(more))


@R.query("""
SELECT o_custkey AS grp, bool_and(CASE WHEN o_orderstatus = 'P' THEN true WHEN o_orderstatus = 'O' THEN o_orderkey % 100 < 60 ELSE false END) AND count(DISTINCT o_orderkey % 100) = count(*) AS ready FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1
""")
def siblings_ready(spark, sf_dir):
    """Groups all of whose members are claimed, or ready on a fresh host, no two on one."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    members = o.select(F.col("o_custkey").alias("group"), F.when(F.col("o_orderstatus") == "P", "claimed").otherwise("ready").alias("state"), (F.col("o_orderkey") % 100).alias("host"))
    offers = spark.range(100).select(F.col("id").alias("host"), F.when(F.col("id") < 60, 990.0).otherwise(100.0).alias("announced_unix"))
    return J.siblings_ready(members, offers, 1000.0, 60.0).withColumnRenamed("group", "grp")


@R.query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def dangling_holders(spark, sf_dir):
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return J.dangling(c.select(F.col("c_custkey").alias("key")), o.where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("key")).distinct(), complete=True)


@R.query("SELECT kind, capacity, CAST(greatest(0, capacity - CASE WHEN held > capacity THEN 0 ELSE held END) AS BIGINT) AS available, CAST(CASE WHEN held > capacity THEN 0 ELSE held END AS BIGINT) AS held FROM (SELECT s_nationkey AS kind, count(*) AS capacity, s_nationkey % 4 AS held FROM supplier GROUP BY 1)")
def token_figures(spark, sf_dir):
    """Tokens per kind after a holder takes what it needs of each kind that has enough, counted."""
    s = load(spark, sf_dir, "supplier")
    tokens = s.select(F.col("s_nationkey").alias("kind"), F.col("s_suppkey").alias("n"), F.lit(None).cast("string").alias("holder"))
    demand = s.groupBy(F.col("s_nationkey").alias("kind")).agg(F.count(F.lit(1)).alias("have")).select("kind", (F.col("kind") % 4).alias("need"), "have").where("need <= have").drop("have")
    return L.token_counts(L.take(tokens, demand, "h"))


@R.query("SELECT s_nationkey AS kind, s_suppkey AS n, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'b' WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'c' END AS holder FROM supplier")
def ledger_handover(spark, sf_dir):
    """Named tokens of one holder go to another; those of a third do not."""
    s = load(spark, sf_dir, "supplier")
    tokens = s.select(F.col("s_nationkey").alias("kind"), F.col("s_suppkey").alias("n"), F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("c").alias("holder"))
    return L.handover(tokens, "a", "b", tokens.where("n % 3 = 0").select("kind", "n"))


@R.query("""
SELECT kind, n, CASE WHEN holder = 'a' AND nth > 2 * CAST(kind % 2 = 0 AS INT) THEN NULL WHEN holder = 'c' AND kind > 20 THEN NULL ELSE holder END AS holder
FROM (SELECT s_nationkey AS kind, s_suppkey AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'a' WHEN s_nationkey > 20 THEN 'c' ELSE 'd' END AS holder, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 = 0 ORDER BY s_suppkey) AS nth FROM supplier)
""")
def ledger_releases(spark, sf_dir):
    """A holder keeps two tokens of each even kind and none of the others; an idle holder's become free."""
    s = load(spark, sf_dir, "supplier")
    holder = F.when(F.col("s_suppkey") % 2 == 0, "a").when(F.col("s_nationkey") > 20, "c").otherwise("d")
    tokens = s.select(F.col("s_nationkey").alias("kind"), F.col("s_suppkey").alias("n"), holder.alias("holder"))
    keep = tokens.where("kind % 2 = 0").select("kind", F.lit(2).alias("keep")).distinct()
    return L.reclaim_idle(L.release_unspent(tokens, "a", keep), spark.createDataFrame([("c",)], "holder string"))


@R.query("""
WITH w AS (SELECT s_suppkey AS holder, s_nationkey AS amount FROM supplier WHERE s_suppkey % 4 > 0), h AS (SELECT s_suppkey AS holder, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE s_nationkey + 1 END AS amount FROM supplier WHERE s_suppkey % 5 > 0)
SELECT holder, 'cpu' AS kind, w.amount AS want, h.amount AS have, CASE WHEN w.amount IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM w FULL JOIN h USING (holder) WHERE w.amount IS NULL OR w.amount IS DISTINCT FROM h.amount
""")
def ledger_mirror(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    ledger = s.select(k.alias("holder"), F.lit("cpu").alias("kind"), F.col("s_nationkey").alias("amount"))
    mirror = s.where(k % 5 > 0).select(k.alias("holder"), F.lit("cpu").alias("kind"), F.when(k % 3 == 0, F.col("s_nationkey")).otherwise(F.col("s_nationkey") + 1).alias("amount"))
    return L.reconcile(ledger, mirror, s.where(k % 4 > 0).select(k.alias("holder")))


@R.query("SELECT c_nationkey AS unit, CAST(sum(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) - sum(c_acctbal) FILTER (WHERE c_custkey % 4 = 0) AS DOUBLE) AS remainder FROM customer WHERE c_acctbal >= 0 GROUP BY 1", rounds={"remainder": 2})
def obligations_left(spark, sf_dir):
    """What is still to be had of peaks beside what is owned, summed per unit."""
    c = load(spark, sf_dir, "customer").where("c_acctbal >= 0")
    g = c.groupBy(F.col("c_nationkey").alias("unit")).agg(F.sum(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))).alias("peak"), F.sum(F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal"))).alias("owned"))
    return g.select("unit", C.remainder(F.col("peak"), F.col("owned")).alias("remainder"))


@R.query("SELECT s_suppkey, greatest(0, least(CAST(floor(s_nationkey * 2) AS BIGINT), CAST(floor((s_acctbal * 10000000 + 40 * 1073741824.0 - 1073741824.0 * 5 - 1073741824.0 * 2 + 1073741824.0 * 3) / 1073741824.0) AS BIGINT))) AS gib, greatest(0, s_acctbal - 100 - 50) AS foreign_ FROM supplier")
def local_room(spark, sf_dir):
    """Room on local disks within a floor and an allowance, and memory that belongs to nobody known."""
    s = load(spark, sf_dir, "supplier")
    gib = float(C.GIB)
    room = C.capacity_gib(F.col("s_nationkey") * 2, F.col("s_acctbal") * 10000000 + 40 * gib, F.lit(5 * gib), F.lit(2 * gib), F.lit(3 * gib))
    return s.select("s_suppkey", room.cast("long").alias("gib"), C.external_bytes(F.col("s_acctbal"), F.lit(100.0), F.lit(50.0)).alias("foreign_"))


@R.query(f"""
WITH {_LINES}, p AS (SELECT m, 0 AS pos, idx FROM l WHERE idx % 2 = 1 UNION ALL SELECT m, 1, idx FROM l WHERE idx <= 2) SELECT p.m AS manifest, p.idx, pos, path, row_number() OVER (PARTITION BY p.m ORDER BY pos, p.idx) - 1 AS read_no FROM p JOIN l USING (m, idx)
""")
def manifest_read_order(spark, sf_dir):
    """Entries in the order that phases read them: the odd ones, then the first two again."""
    e = _entries(spark, sf_dir)
    odd = e.where("idx % 2 = 1").groupBy("manifest").agg(F.array_sort(F.collect_list("idx")).alias("indices")).withColumn("pos", F.lit(0))
    two = e.where("idx <= 2").groupBy("manifest").agg(F.array_sort(F.collect_list("idx")).alias("indices")).withColumn("pos", F.lit(1))
    return W.read_order(odd.unionByName(two), e.select("manifest", "idx", "path"), "manifest").select("manifest", "idx", "pos", "path", "read_no")


@R.query("""
WITH l AS (SELECT o_custkey AS k, arg_max(o_orderdate, o_orderkey) AS d FROM orders GROUP BY 1), h AS (SELECT k, [epoch_us(d) / 1e6, epoch_us(d) / 1e6 + 50000000] AS ds FROM l) SELECT k, list_aggregate(list_filter(ds, lambda x: x > 900000000), 'count') AS ahead FROM h WHERE ds[1] <= 900000000
""")
def due_deadlines(spark, sf_dir):
    """Deadlines of the last observation per key that have come, each consumed once, with how many are still ahead."""
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.array(at, at + 50_000_000).alias("d"))
    due, _ = W.due_deadlines(o, ["k"], ["seq"], "d", F.lit(900_000_000.0))
    return due.select("k", F.size("ahead").cast("long").alias("ahead"))


@R.query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN least(c_acctbal, CAST(c_nationkey AS DOUBLE)) WHEN c_custkey % 3 = 1 THEN c_acctbal END AS deadline FROM customer")
def earliest_deadlines(spark, sf_dir):
    k = F.col("c_custkey") % 3
    c = load(spark, sf_dir, "customer").select("c_custkey", F.when(k < 2, F.col("c_acctbal")).alias("a"), F.when(k == 0, F.col("c_nationkey").cast("double")).alias("b"))
    return W.deadlines(c, "a", "b").select("c_custkey", "deadline")


@R.query("""
WITH e AS (SELECT user_id AS k, event_id AS t, CASE event_type WHEN 'view' THEN 'changed' WHEN 'error' THEN 'failed' ELSE 'completed' END AS kind FROM events), r AS (SELECT *, sum(CASE WHEN kind <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t) AS run, lag(kind) OVER (PARTITION BY k ORDER BY t) AS was FROM e),
f AS (SELECT *, sum(CASE WHEN kind = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY k, run ORDER BY t) AS fails FROM r)
SELECT k, t, kind, CASE WHEN kind = 'completed' THEN 'clean' ELSE 'dirty' END AS state, CASE WHEN kind = 'failed' THEN t + least(5.0, 0.25 * power(2.0, fails - 1))::DOUBLE END AS retry_at, kind = 'changed' AND coalesce(was <> 'completed', false) AS coalesced FROM f
""")
def coalesced_retries(spark, sf_dir):
    """A latched flag per user: views change, errors fail with doubling retries, other events complete."""
    kind = F.when(F.col("event_type") == "view", "changed").when(F.col("event_type") == "error", "failed").otherwise("completed")
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("t"), kind.alias("kind"))
    return W.coalesced_runs(e, ["k"], "t").select("k", "t", "kind", "state", "retry_at", "coalesced")


@R.query("""
WITH o AS (SELECT o_custkey AS key, count(*) FILTER (WHERE o_orderstatus = 'O') AS tr, count(*) FILTER (WHERE o_orderstatus = 'P') AS un, count(*) FILTER (WHERE o_orderstatus = 'F') AS la FROM orders GROUP BY 1),
q AS (SELECT c_custkey AS key, c_nationkey, c_custkey % 6 + 1 >= 3 AS eligible, c_custkey % 7 = 0 AS foreign_, c_custkey % 500 AS age, c_custkey % 5 AS need, coalesce(tr, 0) AS tr, coalesce(un, 0) AS un, coalesce(la, 0) AS la FROM customer LEFT JOIN o ON key = c_custkey),
d AS (SELECT *, tr + CASE WHEN age <= 300 THEN un ELSE 0 END AS draining, la + CASE WHEN age <= 300 THEN 0 ELSE un END AS in_way FROM q)
SELECT key, eligible, CASE WHEN NOT eligible THEN 'not_starved' WHEN foreign_ THEN 'foreign_load' WHEN draining + in_way = 0 THEN CASE WHEN age <= 300 THEN 'in_flight' ELSE 'unknown_past_ceiling' END WHEN draining < need THEN CASE WHEN in_way = 0 THEN 'holders_cannot_cover' WHEN la = 0 THEN 'unknown_past_ceiling' ELSE 'holder_does_not_drain_soon' END ELSE 'drains_soon' END AS why, draining, in_way FROM d
""")
def drain_verdicts(spark, sf_dir):
    """Whether to withhold room for customers until the holders (their orders: open ones drain, pending ones are unknown, finished ones stay) cover what is short."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    none = F.lit(None).cast("double")
    need, nothing = F.create_map(F.lit("cpu"), (k % 5).cast("int")), F.create_map(F.lit("cpu"), F.lit(0))
    questions = c.select(k.alias("key"), F.lit("tokens").alias("mode"), need.alias("need"), nothing.alias("available"), (k % 6).alias("passes"), (F.lit(1000.0) - k % 500).alias("first_unix"), F.when(k % 7 == 0, 900.0).alias("foreign_unix"), none.alias("epoch_unix"), none.alias("expired_unix"), F.lit(1000.0).alias("now"))
    bound = F.when(F.col("o_orderstatus") == "O", "transient").when(F.col("o_orderstatus") == "P", "unknown").otherwise("lasting")
    holders = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("holder"), bound.alias("bound"), F.lit(10.0).alias("claimed_unix"), F.create_map(F.lit("cpu"), F.lit(1)).alias("counts"))
    return W.drain_verdicts(questions, holders, 300.0).select("key", "eligible", "why", "draining", "in_way")


@R.query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey) AS place FROM orders ORDER BY place LIMIT 50")
def promoted_rows(spark, sf_dir):
    """The first fifty rows once eligible ones are promoted (a top-k report)."""
    first = W.promoted(load(spark, sf_dir, "orders").withColumn("ready", F.col("o_orderstatus") == "P"), "ready", "o_orderkey").limit(50).collect()
    return spark.createDataFrame([(r.o_orderkey, i + 1) for i, r in enumerate(first)], "o_orderkey long, place long")


@R.query("SELECT s_nationkey AS host, s_suppkey AS grp, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 4 DESC, s_acctbal, s_suppkey) AS position FROM supplier")
def declared_units(spark, sf_dir):
    """Units best-ranked first: priority, then the time they were published, then their name."""
    s = load(spark, sf_dir, "supplier")
    units = s.select(F.col("s_nationkey").alias("host"), F.col("s_suppkey").alias("group"), (F.col("s_suppkey") % 4).alias("priority"), F.col("s_acctbal").alias("first_published"))
    return W.elections(units, "host").select("host", F.col("group").alias("grp"), F.col("position").cast("long").alias("position"))


@R.query("SELECT DISTINCT p_type, p_size FROM part WHERE (p_type, p_size) NOT IN (SELECT p_type, p_size FROM part WHERE p_partkey % 2 = 0)")
def subset_faults(spark, sf_dir):
    """What a list names beyond what is allowed: acknowledgements, fences and baselines alike."""
    p = load(spark, sf_dir, "part").select("p_type", "p_size", "p_partkey")
    return sets.subset_faults(p.select("p_type", "p_size").distinct(), p.where("p_partkey % 2 = 0").select("p_type", "p_size").distinct())


@R.query("SELECT event_id, kind, side FROM (SELECT event_id, event_type AS kind, 'a' AS side FROM events WHERE event_id % 100 = 0 UNION ALL SELECT event_id, event_type || '!', 'b' FROM events WHERE event_id % 100 = 0)")
def sequence_differences(spark, sf_dir):
    """Rows in which two event sequences differ once their times are left out."""
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "ts")
    other = e.select("event_id", F.concat("kind", F.when(F.col("event_id") % 100 == 0, "!").otherwise("")).alias("kind"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return sets.same_sequence(e, other, "event_id", "ts")


@R.query("SELECT DISTINCT a AS src, b AS dst FROM (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem UNION ALL SELECT s_suppkey, s_nationkey FROM supplier)")
def merged_edges(spark, sf_dir):
    li, s = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier")
    return sets.merged_edges(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")))


@R.query("SELECT DISTINCT p_brand AS family, p_type AS site FROM part WHERE (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size < 5)")
def unregistered_sites(spark, sf_dir):
    """Sites of a family that have no registered exception."""
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_type").alias("site"), "p_size")
    return K.unregistered(K.sites(p, "family", "site"), p.where("p_size < 5").select("family", "site").distinct(), ["family", "site"])


@R.query("""
WITH u AS (SELECT user_id % 7 AS host, ts, 'local' AS source FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id % 7, ts, 'remote' FROM events WHERE event_id % 3 = 0)
SELECT host, min(ts) AS at, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u GROUP BY host, time_bucket(INTERVAL 1 HOUR, ts)
""")
def host_wakes(spark, sf_dir):
    """The first wake of each host and hour over all sources that may ring, with those that rang."""
    e = load(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("host"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    both = feeds.wake_sources(("local", e.where("event_id % 2 = 0")), ("remote", e.where("event_id % 3 = 0")))
    return feeds.wakes(both, "1 hour", "1 day").select("host", F.col("at").cast("timestamp_ntz").alias("at"), F.array_join("sources", ",").alias("sources"))


@R.query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'work' WHEN event_id % 3 = 1 THEN 'tier' END AS topic, CASE WHEN event_id % 3 = 0 THEN 'k' || event_id WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END AS id FROM events")
def topics_of_paths(spark, sf_dir):
    """The topic and identity that a changed path stands for."""
    k = F.col("event_id") % 3
    path = F.when(k == 0, F.concat(F.lit("queue/ready/k"), "event_id", F.lit(".json"))).when(k == 1, F.concat(F.lit("tiers/"), "user_id", F.lit("/state"))).otherwise("other/x")
    t = feeds.topic_of(path, [("work", r"^queue/ready/(\w+)\.json$"), ("tier", r"^tiers/(\d+)/")])
    return load(spark, sf_dir, "events").select("event_id", t["topic"].alias("topic"), t["id"].alias("id"))


@R.query("SELECT s_name FROM (SELECT s_name, CASE WHEN s_name > 'Supplier#000000050' THEN 0 ELSE 1 END AS lap FROM supplier WHERE s_nationkey % 2 = 0) ORDER BY lap, s_name LIMIT 20")
def rotated_round(spark, sf_dir):
    """A bounded round of fresh names from behind a cursor, wrapping around (the feature: twenty a round)."""
    return feeds.rotated(load(spark, sf_dir, "supplier"), "s_name", "Supplier#000000050", 20, F.col("s_nationkey") % 2 == 0).select("s_name")


@R.query("SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-02-28', DATE '2024-03-01', INTERVAL 1 DAY) t(d)")
def window_days(spark, sf_dir):
    """The days that a window touches, across a leap day."""
    return spark.createDataFrame([(d,) for d in series.days(1709150400.0, 1709251200.0)], "day date")


@R.query("""
SELECT p_partkey, array_to_string(declared, ',') AS declared, array_to_string(offered, ',') AS offered,
  array_to_string(CASE WHEN p_size > 25 THEN ['wait'] ELSE [] END || CASE WHEN p_partkey % 3 = 0 THEN ['install'] ELSE [] END || CASE WHEN p_size <= 25 AND p_size % 2 = 0 THEN ['wait'] ELSE [] END, ',') AS remedies
FROM (SELECT *, CASE WHEN p_size > 25 THEN ['progress'] ELSE [] END || CASE WHEN p_partkey % 3 = 0 THEN ['image'] ELSE [] END || CASE WHEN p_size % 2 = 0 THEN ['gang'] ELSE [] END AS declared,
  ['progress'] || CASE WHEN p_partkey % 5 = 0 THEN ['canary', 'generation:' || p_brand] ELSE [] END AS offered FROM part)
""")
def contract_tags(spark, sf_dir):
    """Tags that a claim declares and a host offers, by ordered rules, and the remedies of the declared ones."""
    p = load(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    declared = P.contract_tags(("progress", F.col("p_size") > 25), ("image", F.col("p_partkey") % 3 == 0), ("gang", F.col("p_size") % 2 == 0))
    offered = P.offered_tags(("progress", F.lit(True), none), ("canary", F.col("p_partkey") % 5 == 0, F.array(F.concat(F.lit("generation:"), "p_brand"))))
    remedies = P.remedies(F.col("declared"), ("progress", "wait"), ("image", "install"), ("gang", "wait"))
    return p.select("p_partkey", declared.alias("declared"), offered.alias("offered")).select("p_partkey", *[F.array_join(c, ",").alias(n) for c, n in ((F.col("declared"), "declared"), (F.col("offered"), "offered"), (remedies, "remedies"))])


@R.query("""
SELECT c_custkey, CASE WHEN fault IS NULL THEN stated END AS status, CASE WHEN fault IS NULL AND stated <> 'active' THEN trim(reason) END AS reason, CASE WHEN fault IS NULL AND stated <> 'active' THEN c_acctbal END AS since, fault
FROM (SELECT *, CASE WHEN stated NOT IN ('active', 'retired', 'held') THEN 'unknown status ' || stated WHEN stated <> 'active' AND (trim(reason) = '' OR c_custkey % 7 = 0) THEN 'without ' || concat_ws('; ', CASE WHEN trim(reason) = '' THEN 'reason' END, CASE WHEN c_custkey % 7 = 0 THEN 'by' END) END AS fault
FROM (SELECT *, coalesce(CASE c_custkey % 5 WHEN 0 THEN 'retired' WHEN 1 THEN 'held' WHEN 2 THEN 'lost' WHEN 3 THEN 'active' END, 'active') AS stated, CASE WHEN c_nationkey > 5 THEN ' moved ' ELSE '  ' END AS reason FROM customer))
""")
def presence_statuses(spark, sf_dir):
    """Hosts' presence with its provenance, or what is wrong with it."""
    c = load(spark, sf_dir, "customer")
    status = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'retired' WHEN 1 THEN 'held' WHEN 2 THEN 'lost' WHEN 3 THEN 'active' END")
    reason = F.when(F.col("c_nationkey") > 5, " moved ").otherwise("  ")
    by = F.when(F.col("c_custkey") % 7 != 0, "operator")
    got = P.presence_status(status, reason, by, F.col("c_acctbal").cast("double"), ("active", "retired", "held"))
    return c.select("c_custkey", got.alias("s")).select("c_custkey", "s.status", "s.reason", F.col("s.unix").alias("since"), "s.fault")


@R.query("""
WITH i AS (SELECT o_orderkey AS number, unnest([o_custkey, o_custkey + 1]) AS key FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'),
f AS (SELECT key, min(number) AS number FROM i GROUP BY key)
SELECT c_custkey AS key, number, c_nationkey > 3 AND number IS NULL AS planned FROM customer LEFT JOIN f ON key = c_custkey
""")
def issue_plans(spark, sf_dir):
    """First owners of nodes, and the nodes of complete censuses that have none."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key")
    issues = o.select(F.col("o_orderkey").alias("number"), (F.col("o_orderstatus") == "F").alias("pull_request"), F.array("o_orderpriority").alias("labels"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("keys"))
    owners = J.first_owners(issues, "1-URGENT")
    plans = J.issue_plans(c.select("key", "c_nationkey"), owners, F.col("c_nationkey") > 3).select("key", F.lit(True).alias("planned"))
    return c.select("key").join(owners, "key", "left").join(plans, "key", "left").select("key", "number", F.coalesce("planned", F.lit(False)).alias("planned"))


@R.query("""
SELECT o_orderkey AS key, count(*) AS blockers FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey <> 3
WHERE o_custkey % 4 <> 0 GROUP BY 1 HAVING bool_and(coalesce(s_acctbal > 2000, false))
""")
def closed_chains(spark, sf_dir):
    """Issues whose blockers are fully listed and all known to be closed."""
    o, li, s = (load(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    states = s.where("s_nationkey <> 3").select(F.col("s_suppkey").alias("blocker"), F.when(F.col("s_acctbal") > 2000, "CLOSED").otherwise("OPEN").alias("state"))
    waiting = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_custkey") % 8 != 0, F.col("o_custkey") % 4 != 0).alias("complete"))
    return J.closed_chains(waiting, li.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("blocker")), states)


@R.query("""
WITH l AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 > 0 THEN c_custkey // 2 END AS parent, CASE c_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'text' ELSE 'native' END AS source, c_custkey // 4 AS root, c_custkey % 2 AS faults FROM customer),
j AS (SELECT l.*, CASE WHEN p.c_acctbal > 3000 THEN 'CLOSED' WHEN p.c_custkey IS NOT NULL THEN 'OPEN' END AS state FROM l LEFT JOIN customer p ON p.c_custkey = parent),
a AS (SELECT key, parent, root, CASE WHEN state = 'CLOSED' THEN CASE WHEN faults = 0 THEN 'reparent' ELSE 'create_parent' END WHEN source = 'text' AND state = 'OPEN' AND faults = 0 THEN 'native_sub_issue' WHEN source = 'none' AND key NOT IN (SELECT parent FROM l WHERE parent IS NOT NULL) THEN 'link_parent' END AS action FROM j),
r AS (SELECT action, key AS issue, CASE action WHEN 'reparent' THEN root WHEN 'native_sub_issue' THEN parent END AS target, action IN ('reparent', 'native_sub_issue') AS proposed, CAST(NULL AS VARCHAR) AS candidate FROM a WHERE action IS NOT NULL
UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'remove_blocked_labels' ELSE 'close' END, s_suppkey, NULL, true, 'c' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 OR s_nationkey > 9),
d AS (SELECT *, substr(sha256('["' || action || '","' || issue || '",' || coalesce('"' || target || '"', 'null') || ']'), 1, 16) AS id FROM r)
SELECT action, CAST(issue AS BIGINT) AS issue, CAST(target AS BIGINT) AS target, id, CASE WHEN NOT proposed THEN 'needs_parent_design' WHEN candidate IS NULL OR substr(candidate, 2)::BIGINT % 5 > 2 THEN 'needs_hindsight' WHEN substr(candidate, 2)::BIGINT % 5 = 0 THEN 'needs_hindsight_source_review' ELSE 'proposed' END AS status FROM d
""")
def parent_actions(spark, sf_dir):
    """What to write about parents, labels and fixes, held against the receipts of its review."""
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    states = c.select(F.col("c_custkey").cast("long").alias("parent"), F.when(F.col("c_acctbal") > 3000, "CLOSED").otherwise("OPEN").alias("parent_state"))
    links = c.selectExpr("CAST(c_custkey AS LONG) AS key", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey DIV 2 END AS parent", "CASE c_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'text' ELSE 'native' END AS source", "c_custkey DIV 4 AS root", "c_custkey % 2 AS faults")
    found = s.selectExpr("CAST(s_suppkey AS LONG) AS key", "CASE WHEN s_suppkey % 2 = 0 THEN 'dead_blocked_chain' ELSE 'default_branch_fix' END AS kind", "concat('c', s_suppkey) AS candidate", "s_nationkey > 9 AS verified")
    receipts = s.where("s_suppkey % 5 < 3").selectExpr("concat('c', s_suppkey) AS id", "s_suppkey % 5 > 0 AS reviewed")
    return J.parent_actions(links.join(states, "parent", "left"), found, receipts)
