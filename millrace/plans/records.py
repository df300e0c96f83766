"""Queries on scans and sinks: the driver's tables are written as the files that a source reads, and what a sink wrote is read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as C
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..sources import logs, records, series, sinks
from ..sources.tables import load, scratch
from ..streaming import feeds
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
START, END = 1704196800.0, 1704330000.0  # from noon of the second to one o'clock of the fourth of January 2024, UTC


def _samples(spark, sf_dir):
    """Samples of three hosts as daily CSV files named by host and day; every 31st time is torn and every 13th cell no number."""
    folder = scratch(spark, "series")
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    ms = F.unix_micros(F.col("ts").cast("timestamp")).cast("long")
    at = F.when(F.col("event_id") % 31 == 0, F.concat(F.lit("x"), F.floor(ms / 1000))).otherwise(F.floor(ms / 1000).cast("string"))
    cpu = F.when(F.col("event_id") % 13 == 0, "nan").otherwise(F.col("value").cast("string"))
    rows = e.select((F.col("user_id") % 3).alias("host"), "day", "event_id", at.alias("epoch_ms"), cpu.alias("cpu"), F.col("user_id").cast("string").alias("load"))
    for host in range(3):
        for day in series.days(START, END):
            part = rows.where((F.col("host") == host) & (F.col("day") == F.lit(day))).coalesce(1).sortWithinPartitions("event_id")
            part.select("epoch_ms", "cpu", "load").write.option("header", True).csv(f"{folder}/box{host}-{day.isoformat()}.csv")
    return folder


_SERIES = f"""s AS (SELECT user_id % 3 AS host, event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, CASE WHEN event_id % 13 > 0 THEN value END AS cpu, CAST(user_id AS DOUBLE) AS load FROM events
WHERE event_id % 31 > 0 AND floor(epoch_us(ts) / 1000) BETWEEN {START * 1000:.0f} AND {END * 1000:.0f})"""


@R.query(f"WITH {_SERIES} SELECT host, ms AS epoch_ms, cpu, load FROM s")
def csv_window(spark, sf_dir):
    """The samples of a window from daily files: torn rows are skipped, unreadable cells are null."""
    folder = _samples(spark, sf_dir)
    frames = [series.csv_series(spark, folder, f"box{h}", START, END, ["cpu", "load"]).select(F.lit(h).cast("long").alias("host"), "epoch_ms", "cpu", "load") for h in range(3)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@R.query(f"WITH {_SERIES} SELECT host, count(*) AS samples, count(cpu) AS measured, avg(cpu) AS mean, max(cpu) AS peak, avg(load) AS load FROM s GROUP BY host", rounds={"mean": 6, "load": 6})
def csv_window_summary(spark, sf_dir):
    """From daily CSV files to the summary of a window."""
    w = csv_window(spark, sf_dir)
    return w.groupBy("host").agg(F.count(F.lit(1)).alias("samples"), F.count("cpu").alias("measured"), F.avg("cpu").alias("mean"), F.max("cpu").alias("peak"), F.avg("load").alias("load"))


@R.query(f"WITH {_SERIES} SELECT ms AS epoch_ms, load FROM s WHERE host = 1 AND ms >= 1704326400000 ORDER BY event_id DESC LIMIT 20")
def newest_samples(spark, sf_dir):
    """The last twenty rows of a day's file, from its end (the feature: a bounded tail)."""
    s = series.csv_series(spark, _samples(spark, sf_dir), "box1", 1704326400.0, END, ["load"])
    return series.newest_first(s).limit(20).select("epoch_ms", "load")


@R.query("""
WITH c AS (SELECT hour(ts) AS t, event_type AS d, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT t, d, CASE WHEN d = 'error' AND t = 7 THEN NULL ELSE n END AS v FROM c), w AS (SELECT t, CASE WHEN count(*) = count(v) THEN sum(v) END AS v FROM p WHERE d NOT IN ('view') AND t BETWEEN 3 AND 20 GROUP BY t)
SELECT count(v) AS n, avg(v) AS mean, CAST(max(v) AS DOUBLE) AS peak FROM w WHERE v IS NOT NULL
""", rounds={"mean": 6})
def chart_window(spark, sf_dir):
    """A chart document of events per hour and type, read by the chart source between two times; an hour with a missing dimension is left out."""
    spark.dataSource.register(series.ChartSource)
    per = load(spark, sf_dir, "events").groupBy(F.hour("ts").alias("t"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    found = {(r.t, r.event_type): r.n for r in per.collect()}  # 24 hours of a few types: a chart
    kinds = sorted({k for _, k in found})
    data = [[t, *[None if (t, k) == (7, "error") else found.get((t, k)) for k in kinds]] for t in range(24)]
    chart = spark.read.format("chart").option("document", json.dumps({"labels": ["time", *kinds], "data": data})).option("after", "3").option("before", "20").load()
    return series.chart_totals(chart, idle=("view",))


@R.query("SELECT user_id % 5 AS host, CAST(hour(ts) AS DOUBLE) AS time, event_type AS dimension, CAST(count(*) AS DOUBLE) AS value FROM events WHERE hour(ts) BETWEEN 3 AND 20 GROUP BY ALL")
def chart_files(spark, sf_dir):
    """Chart documents of five hosts, written a file each and read back between two times."""
    path = scratch(spark, "charts")
    e = load(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a few types
    per = e.groupBy((F.col("user_id") % 5).alias("host"), F.hour("ts").cast("double").alias("t")).agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds])
    docs = per.groupBy("host").agg(F.to_json(F.struct(F.lit(["time", *kinds]).alias("labels"), F.collect_list(F.array("t", *kinds)).alias("data"))).alias("value"))
    docs.write.partitionBy("host").text(path)
    found = series.charts(spark, path, 3.0, 20.0)
    return found.where("value > 0").select(F.regexp_extract("file", r"host=(\d+)", 1).cast("long").alias("host"), "time", "dimension", "value")


@R.query("""
SELECT s_nationkey AS worker, sum(CASE WHEN s_suppkey % 7 = 0 THEN 10 * s_suppkey + 5 ELSE 5 END) AS ticks, count(*) AS processes, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS loops FROM supplier GROUP BY 1
""")
def process_deltas(spark, sf_dir):
    """CPU ticks of workers' processes between two captures of their stat files: a process under a used number (every seventh) counts whole, others by their growth; and those that run a loop."""
    s = load(spark, sf_dir, "supplier")
    stat = lambda started, ticks: F.format_string("%d (my (odd) name) S %d 1 1 0 -1 0 0 0 0 0 %d 0 0 0 20 0 1 0 %d 1000 77 0\n", "s_suppkey", "s_nationkey", ticks, started)
    k = F.col("s_suppkey")
    capture = lambda line: logs.process_stats(s.select(F.concat(F.lit("/proc/"), k, F.lit("/stat")).alias("path"), line.alias("text")))
    before, after = capture(stat(k * 100, k * 10)), capture(stat(F.when(k % 7 == 0, k * 100 + 1).otherwise(k * 100), k * 10 + 5))
    grown = _process_growth(before, after)
    argv = logs.process_arguments(s.select(F.concat(F.lit("/proc/"), k, F.lit("/cmdline")).alias("path"), F.concat(F.lit("/usr/bin/python3\0/opt/"), F.when(k % 2 == 0, "loop.py").otherwise("other.py"), F.lit("\0")).alias("text")))
    loops = argv.where(P.runs_any(F.col("argv"), ["loop.py"])).join(after.select("pid", "parent"), "pid").groupBy(F.col("parent").alias("worker")).agg(F.count(F.lit(1)).alias("loops"))
    return grown.join(loops, "worker", "left").select("worker", "ticks", "processes", F.coalesce("loops", F.lit(0)).alias("loops"))


def _process_growth(before, after):
    same = J.identity_join(before, after, "pid", ["started"]).select("pid", (F.col("cpu_ticks") - F.col("was.cpu_ticks")).alias("growth"))
    rows = after.join(same, "pid", "left").withColumn("growth", F.coalesce("growth", "cpu_ticks"))
    return rows.groupBy(F.col("parent").alias("worker")).agg(F.sum("growth").alias("ticks"), F.count(F.lit(1)).alias("processes"))


@R.query("SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77 AND epoch_us(o_orderdate) = (SELECT epoch_us(o_orderdate) FROM orders WHERE o_orderkey = 77)")
def point_record(spark, sf_dir):
    """The record of a key and generation; both predicates reach the scan."""
    o = load(spark, sf_dir, "orders")
    when = o.where("o_orderkey = 77").select("o_orderdate").first()[0]
    return records.point(o, {"o_orderkey": 77}, ("o_orderdate", when)).select("o_custkey", "o_totalprice")


def _item_files(spark, sf_dir):
    """Each benchmark item as a file of its text, in a folder named by its id."""
    folder = scratch(spark, "items")
    load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(folder)
    return files.withColumn("item_id", F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long"))


@R.query("""
SELECT item_id, item_id % 4 > 0 AND strlen(text) + 1 <= 400 AS verified, strlen(text) + 1 AS length, right(text || chr(10), 16) AS last, sha256(substr(text || chr(10), 6, 20)) AS part FROM benchmark
""")
def verified_files(spark, sf_dir):
    """Files whose bytes have the expected digest and are not too long, their tails and a ranged digest; a quarter of the expectations is of other bytes."""
    b = load(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.concat("text", F.when(F.col("item_id") % 4 == 0, "no").otherwise("\n")), 256).alias("expected"))
    files = records.verified(_item_files(spark, sf_dir).join(b, "item_id"), F.col("expected"), 400)
    text = F.col("content").cast("string")
    return files.select("item_id", "verified", "length", F.substring(text, F.greatest(F.length(text) - 15, F.lit(1)), F.lit(16)).alias("last"), F.sha2(F.encode(F.substring(text, 6, 20), "UTF-8"), 256).alias("part"))


@R.query("SELECT item_id, octet_length(encode(text)) + 1 AS length, sha256(CAST(item_id AS VARCHAR) || '-abcdefgh') AS whole, sha256('abcd') AS part, 'efgh' AS last FROM benchmark")
def stream_tails(spark, sf_dir):
    """The last bytes of streams, and the digest of a byte range."""
    content = F.encode(F.concat(F.col("item_id").cast("string"), F.lit("-abcdefgh")), "UTF-8")
    b = load(spark, sf_dir, "benchmark").select("item_id", F.octet_length(F.encode("text", "UTF-8")).alias("n"), content.alias("content"))
    from_ = F.octet_length("content") - 8
    last = records.tail(F.col("content"), 4).cast("string")
    ranged = records.ranged_digest(F.substring("content", from_ + 1, F.lit(8)), 0, 4)
    return b.select("item_id", (F.col("n") + 1).cast("long").alias("length"), F.sha2("content", 256).alias("whole"), ranged.alias("part"), last.alias("last"))


@R.query("SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def backfilled_records(spark, sf_dir):
    """JSON records taken into a table in bounded, restartable steps."""
    source, out, at = (scratch(spark, x) for x in ("json", "table", "cursor"))
    load(spark, sf_dir, "conversations").repartition(6).write.json(source)
    for _ in range(2):  # the second pass finds nothing new
        records.backfill(spark, source, "conv_id long, turn long, role string, text string", at, out, 2)
    return spark.read.parquet(out).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


@R.query("SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS has, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'old ' || s_suppkey END AS name FROM supplier")
def layouts_of_a_capture(spark, sf_dir):
    """Two layouts of one capture; the earlier wins where both have a key."""
    s = load(spark, sf_dir, "supplier")
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(True).alias("has"))
    old = s.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("old "), "s_suppkey").alias("name"))
    return records.first_layout(new, old, key="k").select("k", F.coalesce("has", F.lit(False)).alias("has"), "name")


@R.query("""
SELECT n_nationkey AS host, CASE n_nationkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'open' WHEN 3 THEN 'closed' ELSE 'closed' END AS hold FROM nation
""")
def host_holds(spark, sf_dir):
    """Holds per host: no record is open, a record says, an unreadable or malformed one is closed."""
    n = load(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 5
    raw = F.when(k == 1, '{"held":true}').when(k == 2, '{"held":false}').when(k == 3, '{"held":true,"held":false}')
    held = n.where(k > 0).select(F.col("n_nationkey").alias("host"), raw.alias("raw"), (k != 4).alias("readable"))
    return records.holds(held, n.select(F.col("n_nationkey").alias("host")))


@R.query("""
SELECT CAST(s AS VARCHAR) AS subject, 'missing shard' AS fault FROM (SELECT unnest(range(0, 30)) AS s) WHERE s NOT IN (SELECT p_size % 25 FROM part) UNION ALL SELECT CAST(p_size % 25 AS VARCHAR), 'partial shard' FROM part GROUP BY p_size % 25 HAVING NOT bool_and(p_partkey % 97 > 0)
UNION ALL SELECT p_name, 'node in several shards' FROM part GROUP BY p_name HAVING count(DISTINCT p_size % 25) > 1
""")
def shard_faults(spark, sf_dir):
    p = load(spark, sf_dir, "part").select((F.col("p_size") % 25).cast("long").alias("shard"), (F.col("p_partkey") % 97 > 0).alias("complete"), F.col("p_name").alias("node"))
    return logs.shard_results(p, spark.range(30).select(F.col("id").alias("shard")))


@R.query("SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def label_edges(spark, sf_dir):
    """Edges of label documents, each a JSON line with its dependencies."""
    path = scratch(spark, "labels")
    docs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label")).agg(F.collect_list("l_partkey").alias("deps"))
    docs.write.json(path)
    return logs.edges(spark.read.schema("label long, deps array<long>").json(path))


def _reports(spark, sf_dir):
    """JUnit reports of orders as test cases of files (customers)."""
    path = scratch(spark, "junit")
    o = load(spark, sf_dir, "orders")
    inner = F.when(F.col("o_orderstatus") == "F", '<failure message="f">why &lt;</failure>').when(F.col("o_orderpriority") == "5-LOW", "<skipped>later</skipped>").otherwise("<system-out>ok</system-out>")
    case = F.format_string('<testcase file="t%d.py" classname="c" name="n%d" time="%s">', "o_custkey", "o_orderkey", F.col("o_totalprice").cast("string"))
    cases = o.select((F.col("o_custkey") % 8).alias("shard"), F.concat(case, inner, F.lit("</testcase>")).alias("case"))
    suites = cases.groupBy("shard").agg(F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list("case"), "\n"), F.lit("</testsuite>")).alias("value"))
    suites.write.partitionBy("shard").text(path)  # a document per file
    return logs.junit(spark, path)


@R.query("SELECT 't' || o_custkey || '.py' AS file, 't' || o_custkey || '.py::n' || o_orderkey AS node, o_totalprice AS seconds, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderpriority = '5-LOW' THEN 'skipped' ELSE 'passed' END AS outcome FROM orders")
def junit_cases(spark, sf_dir):
    return _reports(spark, sf_dir)


@R.query("""
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS seconds FROM orders GROUP BY 1) SELECT 't' || o_custkey || '.py' AS file, seconds, CASE WHEN o_custkey % 2 = 0 THEN 1e6 ELSE 2e6 END AS budget FROM s WHERE seconds > CASE WHEN o_custkey % 2 = 0 THEN 1e6 ELSE 2e6 END
""", rounds={"seconds": 2})
def budget_overruns(spark, sf_dir):
    """Files whose cases took longer than their budget, or than the default."""
    c = load(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.format_string("t%d.py", "c_custkey").alias("file"), F.lit(1e6).alias("budget"))
    return logs.over_budget(_reports(spark, sf_dir), c, 2e6)


@R.query("SELECT s_suppkey AS mount_id, s_nationkey AS parent_id, '0:' || s_suppkey AS device, '/' AS root, '/mnt/' || s_name || ' x' AS point, 'nfs4' AS kind, 'host:/' || s_suppkey AS source FROM supplier")
def mount_table(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    line = F.format_string("%d %d 0:%d / /mnt/%s\\040x rw,relatime shared:1 - nfs4 host:/%d rw", "s_suppkey", "s_nationkey", "s_suppkey", "s_name", "s_suppkey")
    torn = s.limit(1).select(F.lit("torn line").alias("value"))
    m = logs.mounts(s.select(line.alias("value")).unionByName(torn))
    return m.select("mount_id", "parent_id", "device", "root", "point", "kind", "source")


@R.query("""
SELECT event_id * 2 AS seq, user_id AS pid, 'openat' AS call, CAST(event_id AS DOUBLE) AS begun, event_id + 0.5 AS ended, '/data/' || event_id AS path FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id * 2, user_id, 'read', event_id::DOUBLE, event_id::DOUBLE, '/dev/' || user_id FROM events WHERE event_id % 3 = 1
""")
def traced_calls(spark, sf_dir):
    """System calls of a trace: those cut in two lines are joined, a beginning without an end is dropped; with the path that each names."""
    e = load(spark, sf_dir, "events")
    pid, at, k = F.col("user_id"), F.col("event_id"), F.col("event_id") % 3
    begun = F.format_string('%d %d.0 openat(AT_FDCWD, "/data/%d", O_RDONLY <unfinished ...>', pid, at, at)
    resumed = F.format_string("%d %d.5 <... openat resumed>) = 3", pid, at)
    whole = F.format_string("%d %d.0 read(3</dev/%d>, 4096) = 0", pid, at, pid)
    open_ = F.format_string("%d %d.0 ppoll(5 <unfinished ...>", pid, at)
    lines = e.where(k == 0).select((at * 2 - 1).alias("seq"), begun.alias("value")).unionByName(e.where(k == 0).select((at * 2).alias("seq"), resumed.alias("value"))).unionByName(e.where(k == 1).select((at * 2).alias("seq"), whole.alias("value"))).unionByName(e.where(k == 2).select((at * 2).alias("seq"), open_.alias("value")))
    calls = logs.completed_calls(lines)
    return calls.select("seq", "pid", "call", "begun", "ended", logs.shared_path(F.col("text")).alias("path"))


@R.query("""
SELECT doc_id, 'dir/' || doc_id || '.json' AS reference FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 'pkg/base/' || doc_id FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, x FROM documents, (VALUES ('os.path'), ('pkg/t.py'), ('pkg/base')) v(x) WHERE doc_id % 5 > 0
""")
def source_references(spark, sf_dir):
    """What source texts refer to: modules, literal paths and paths joined from their own place; a fifth of the texts does not parse."""
    from ..functions import sources

    sources.register(spark)
    good = F.format_string("import os.path\nFILE = 'dir/%d.json'\nBASE = Path(__file__).parent / 'base'\nuse(BASE / '%d')\n", "doc_id", "doc_id")
    d = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "def (").otherwise(good).alias("src"))
    d.createOrReplaceTempView("millrace_reference_sources")
    return spark.sql("SELECT doc_id, f.reference FROM millrace_reference_sources, LATERAL source_references(src, 'pkg/t.py') f")


@R.query("SELECT DISTINCT s_suppkey AS k, s_name AS name FROM supplier")
def published_once(spark, sf_dir):
    """Records published if absent, twice over with another body: the first writer's stay."""
    path = scratch(spark, "published")
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    sinks.publish_new(s.where("k % 2 = 0"), s.limit(0), ["k"], path)
    sinks.publish_new(s.select("k", F.concat("name", F.when(F.col("k") % 2 == 0, " again").otherwise("")).alias("name")), spark.read.parquet(path), ["k"], path)
    return spark.read.parquet(path)


@R.query("SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0")
def publication_conflicts(spark, sf_dir):
    """Records published again with another body; an equal one is a repeat, no conflict."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return sinks.conflicts(s.select("k", F.when(F.col("k") % 3 == 0, "other").otherwise(F.col("name")).alias("name")), s, ["k"]).select("k")


@R.query("SELECT facet, facet_value, day, count(*) AS n FROM (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS day, unnest(['status', 'priority']) AS facet, unnest([o_orderstatus, o_orderpriority]) AS facet_value FROM orders) GROUP BY ALL")
def facet_index(spark, sf_dir):
    """Records indexed by facet and day (here the first of the year), read back by partition."""
    path = scratch(spark, "facets")
    o = load(spark, sf_dir, "orders")
    year = F.unix_micros(F.date_trunc("year", "o_orderdate").cast("timestamp")) / 1e6
    sinks.index_by_facets(o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), year.alias("published_unix")), ["status", "priority"], path)
    return spark.read.parquet(path).groupBy("facet", "facet_value", "day").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT user_id AS k, max(event_id) AS generation, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1")
def newest_record_table(spark, sf_dir):
    """The newest record per key, kept by a stream whose batches replace whole versions."""
    source, out, at = (scratch(spark, x) for x in ("stream", "newest", "cursor"))
    load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("generation"), F.col("event_type").alias("kind")).repartition(5).write.parquet(source)
    stream = spark.readStream.schema("k long, generation long, kind string").option("maxFilesPerTrigger", 2).parquet(source)
    feeds.newest_records(stream, "k", "generation", out, at).awaitTermination()
    return spark.read.parquet(f"{out}/version={max(feeds._versions(spark, out))}")


@R.query("SELECT user_id AS k, count(*) AS events, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY 1")
def appended_journal(spark, sf_dir):
    """A journal appended to in turns and folded per key."""
    path = scratch(spark, "journal")
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", F.col("event_type").alias("kind"), F.col("event_id").alias("lease"))
    for turn in range(3):
        sinks.append_journal(e.where(F.col("event_id") % 3 == turn), path)
    return W.journal(spark.read.parquet(path), ["k"], ["event_id"], "view", "click", "error").select("k", "events", "last_kind")


@R.query("""
SELECT rtrim(rpad(n_name, 12, ' ') || '  ' || rpad(coalesce(CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) END, '-'), 4, ' ')) AS line FROM nation
""")
def rendered_lines(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    return sinks.table_lines(n, {"n_name": 12, "region": 4})


@R.query("""
SELECT '| r | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || replace(r_name, '|', '\\|') || ' |', chr(10) ORDER BY r_regionkey) || chr(10) || chr(10) || 'Only the first 3 rows are shown.' AS report FROM region WHERE r_regionkey < 3
""")
def rendered_report(spark, sf_dir):
    """A ranked report as Markdown, which says where it is cut."""
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("name")).orderBy("r")
    return spark.createDataFrame([(sinks.markdown(r, 3),)], "report string")


@R.query("SELECT p_brand AS path, count(DISTINCT p_type) AS hashes FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def mixed_sources(spark, sf_dir):
    return sinks.mixed_sources(load(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("sha")))


@R.query("""
WITH r AS (SELECT n_nationkey, n_name AS name, ['a' || n_nationkey // 2, 'b' || n_nationkey] AS aliases FROM nation), h AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'NATION_' || s_nationkey WHEN 1 THEN 'b' || s_nationkey WHEN 2 THEN 'a' || s_nationkey // 2 ELSE 'none' END AS host FROM supplier),
a AS (SELECT alias, min(name) AS name, count(DISTINCT name) AS n FROM (SELECT name, unnest(aliases) AS alias FROM r) GROUP BY 1)
SELECT DISTINCT h.host, coalesce(r.name, CASE WHEN a.n = 1 THEN a.name END) AS name, r.name IS NULL AND coalesce(a.n > 1, false) AS ambiguous FROM h LEFT JOIN r ON r.name = h.host LEFT JOIN a ON alias = h.host
""")
def roster_entries(spark, sf_dir):
    """Hosts by canonical name or the only entry with them as an alias."""
    n, s = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    roster = n.select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("a"), F.floor(F.col("n_nationkey") / 2)), F.concat(F.lit("b"), "n_nationkey")).alias("aliases"))
    k, m = F.col("s_suppkey") % 4, F.col("s_nationkey")
    host = F.when(k == 0, F.concat(F.lit("NATION_"), m)).when(k == 1, F.concat(F.lit("b"), m)).when(k == 2, F.concat(F.lit("a"), F.floor(m / 2))).otherwise("none")
    return J.roster_entry(s.select(host.alias("host")).distinct(), roster)


@R.query("SELECT alias FROM (SELECT n_name AS name, unnest(['a' || n_nationkey // 2, 'b' || n_nationkey, n_name]) AS alias FROM nation) GROUP BY alias HAVING count(DISTINCT name) > 1")
def roster_conflicts(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return J.shared_aliases(n.select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("a"), F.floor(F.col("n_nationkey") / 2)), F.concat(F.lit("b"), "n_nationkey")).alias("aliases")))


@R.query("""
SELECT CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS INTEGER) AS errno, count(*) AS n, sum(length(html)) AS bytes FROM pages UNION ALL SELECT 'lang', CASE WHEN page_id % 3 = 0 THEN 'absent' ELSE 'present' END, NULL, count(*), NULL FROM pages GROUP BY 2 UNION ALL SELECT 'acl', 'unavailable', CAST(page_id % 4 AS INTEGER), count(*), NULL FROM pages GROUP BY 3
""")
def attribute_census(spark, sf_dir):
    """Counts and bytes of files, and the states and error numbers of each attribute."""
    state = lambda s, e: F.struct(s.alias("state"), e.cast("int").alias("errno"))
    attributes = F.create_map(F.lit("lang"), state(F.when(F.col("page_id") % 3 == 0, "absent").otherwise("present"), F.lit(None)), F.lit("acl"), state(F.lit("unavailable"), F.col("page_id") % 4))
    return A.attribute_census(load(spark, sf_dir, "pages").select(F.length("html").cast("long").alias("bytes"), attributes.alias("attributes")))


@R.query("""
WITH s AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'worker' ELSE 'main' END AS thread, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'hash' ELSE 'other' END AS category, user_id AS n FROM events WHERE event_id % 7 > 0), g AS (SELECT thread, category, sum(n) AS n FROM s GROUP BY 1, 2)
SELECT thread, category, n / 100.0 AS seconds, n / sum(n) OVER (PARTITION BY thread) AS share FROM g
""", rounds={"seconds": 2, "share": 4})
def stack_costs(spark, sf_dir):
    """Thread seconds by cost from folded stacks; a seventh of the lines has no count."""
    frame = F.when(F.col("user_id") % 3 == 0, "start (t.py);worker (stage_move.py)").otherwise("start (t.py);run (main.py)")
    count = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit(" "), "user_id")).otherwise("")
    stacks = load(spark, sf_dir, "events").select(F.concat(frame, F.lit(";"), F.when(F.col("event_type") == "view", "pread (os.py)").when(F.col("event_type") == "click", "update (hashlib.py)").otherwise("idle (x.py)"), count).alias("value"))
    return A.stack_costs(stacks, 100.0, [("read", r"\bpread \("), ("hash", r"hashlib\.py")], r"worker \(stage_move\.py\)")


@R.query("SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(p_size AS BIGINT) END AS span_end, sha256('{\"a\":' || p_size || ',\"b\":\"' || p_brand || '\"}') AS digest FROM part")
def label_spans(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", C.label_span(F.col("p_size"))["end_bytes"].alias("span_end"), C.canonical_digest(b=F.col("p_brand"), a=F.col("p_size")).alias("digest"))
