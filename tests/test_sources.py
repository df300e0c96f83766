import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import logs, records, series, sinks


def test_strict_json(spark):
    rows = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', "[" * 80 + "]" * 80, "{", None, '{"a": ' + "9" * 500 + "}"]
    got = records.strict_json(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string"), "raw", "a int").orderBy("i").collect()
    assert [r.fault is None for r in got] == [True] + [False] * 7
    assert got[0].record.a == 1 and all(r.record is None for r in got[1:])
    assert got[1].fault == "duplicate key" and got[6].fault == "missing"


def test_verified_bytes_and_tail(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"hello world")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    good = F.sha2(F.lit(b"hello world"), 256)
    row = records.verified(files, good).select("verified", records.tail(F.col("content"), 5).alias("tail"), records.ranged_digest(F.col("content"), 0, 5).alias("d")).first()
    assert row.verified and bytes(row.tail) == b"world"
    assert row.d == spark.range(1).select(F.sha2(F.lit(b"hello"), 256)).first()[0]
    assert not records.verified(files, F.lit("x")).first().verified and not records.verified(files, good, 3).first().verified


def test_bounded_scan_and_points(spark):
    df = spark.range(10).withColumn("g", F.lit(1.5))
    few = records.bounded_scan(df, F.col("id") > 2, [F.desc("id")], 3).collect()
    assert [(r.id, r.complete) for r in few] == [(9, False), (8, False), (7, False)]
    assert all(r.complete for r in records.bounded_scan(df, F.col("id") > 7, [F.col("id")], 3).collect())
    assert records.bounded_scan(df, F.col("id") > 99, [F.col("id")], 3).count() == 0
    assert records.point(df, {"id": 4}, ("g", 1.5)).count() == 1 and records.point(df, {"id": 4}, ("g", 2.0)).count() == 0


def test_layouts_and_holds(spark):
    a, b = spark.createDataFrame([(1, "new")], "k int, v string"), spark.createDataFrame([(1, "old"), (2, "only")], "k int, v string")
    assert {(r.k, r.v) for r in records.first_layout(a, b, key="k").collect()} == {(1, "new"), (2, "only")}
    recs = spark.createDataFrame([("a", '{"held": true}', True), ("b", "{", True), ("c", None, False), ("d", '{"held": false}', True)], "host string, raw string, readable boolean")
    hosts = spark.createDataFrame([(h,) for h in "abcde"], "host string")
    assert {r.host: r.hold for r in records.holds(recs, hosts).collect()} == {"a": "closed", "b": "closed", "c": "closed", "d": "open", "e": "open"}


def test_backfill_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"i": i}))
    run = lambda: records.backfill(spark, str(tmp_path / "in"), "i int", str(tmp_path / "cp"), str(tmp_path / "out"), 1)
    run()
    (tmp_path / "in" / "9.json").write_text(json.dumps({"i": 9}))
    run()
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 9]


def test_csv_series(spark, tmp_path):
    (tmp_path / "h-2024-01-02.s1.csv").write_text("epoch_ms,power,util\n1704153600000,1.5,\n1704153602000,nan,7\n17041")
    (tmp_path / "h-2024-01-05.s1.csv").write_text("epoch_ms,power\n1704412800000,9\n")
    got = series.csv_series(spark, str(tmp_path), "h", 1704153600, 1704153700, ["power", "util", "absent"]).orderBy("row").collect()
    assert [(r.epoch_ms, r.power, r.util, r.absent) for r in got] == [(1704153600000, 1.5, None, None), (1704153602000, None, 7.0, None)]
    with pytest.raises(ValueError):
        series.days(0, 86400 * 5)


def test_chart_source(spark):
    doc = json.dumps({"labels": ["time", "user", "idle", "sys"], "data": [[1, 2, 90, 3], [2, None, 80, 1], [3, 4, 70, 6], [9, 1, 1, 1]]})
    spark.dataSource.register(series.ChartSource)
    rows = spark.read.format("chart").option("document", doc).option("before", "5").load()
    assert rows.count() == 9
    assert tuple(series.chart_totals(rows).first()) == (2, 7.5, 10.0)


def test_completed_calls(spark):
    lines = ['10 1.0 openat(3</d>, "f", 0) = 4', '11 1.1 read(5</x>, <unfinished ...>', '10 1.2 stat("/a b", {}) = 0', "11 1.5 <... read resumed>) = 9", "12 2.0 <... read resumed>) = 1", "13 3.0 write(1, <unfinished ...>"]
    got = logs.completed_calls(spark.createDataFrame(list(enumerate(lines)), "seq int, value string")).withColumn("path", logs.shared_path(F.col("text"))).orderBy("seq").collect()
    assert [(r.pid, r.call, r.begun, r.ended, r.path) for r in got] == [(10, "openat", 1.0, 1.0, "/d/f"), (10, "stat", 1.2, 1.2, "/a b"), (11, "read", 1.1, 1.5, "/x")]


def test_mounts(spark):
    line = r"36 35 98:0 /mnt1 /mnt\0402 rw,noatime master:1 - ext3 /dev/root rw"
    r = logs.mounts(spark.createDataFrame([(line,), ("junk",)], "value string")).first()
    assert (r.mount_id, r.point, r.kind, r.source) == (36, "/mnt 2", "ext3", "/dev/root")


def test_junit(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuite><testcase file="a.py" classname="c" name="t1" time="1.5"/><testcase file="a.py" classname="c" name="t2" time="2"><failure message="x">boom</failure></testcase><testcase classname="b" name="t3" time="0.5"><skipped/></testcase></testsuite>')
    cases = logs.junit(spark, str(tmp_path / "r.xml"))
    got = {r.node: r.outcome for r in cases.collect()}
    assert got["a.py::t1"] == "passed" and got["a.py::t2"] == "failed"
    budgets = spark.createDataFrame([("a.py", 3.0)], "file string, budget double")
    assert [r.file for r in logs.over_budget(cases, budgets, 10.0).collect()] == ["a.py"]


def test_edges_and_shards(spark):
    docs = spark.createDataFrame([("a", ["b", "c", "b"])], "label string, deps array<string>")
    assert logs.edges(docs).count() == 2
    shards = spark.createDataFrame([(0, True, "n1"), (1, False, "n1"), (1, True, "n2")], "shard int, complete boolean, node string")
    faults = {(r.subject, r.fault) for r in logs.shard_results(shards, spark.range(3).select(F.col("id").cast("int").alias("shard"))).collect()}
    assert faults == {("2", "missing shard"), ("1", "partial shard"), ("n1", "node in several shards")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    sinks.publish_new(new, spark.createDataFrame([], "k int, v string"), ["k"], path)
    sinks.publish_new(spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string"), spark.read.parquet(path), ["k"], path)
    there = spark.read.parquet(path)
    assert {(r.k, r.v) for r in there.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert [r.k for r in sinks.conflicts(spark.createDataFrame([(2, "z"), (3, "d")], "k int, v string"), there, ["k"]).collect()] == [2]
    recs = spark.createDataFrame([("x", "u", 0.0), (None, "u", 90000.0)], "repo string, user string, published_unix double")
    sinks.index_by_facets(recs, ["repo", "user"], str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    assert index.where("facet = 'user'").count() == 2 and index.where("facet = 'repo'").count() == 1
    assert "PartitionFilters: [isnotnull(facet" in index.where("facet = 'user'")._jdf.queryExecution().toString()
    functions, tests = sinks.dictionary_map(spark.createDataFrame([("t", "g"), ("t", "f"), ("s", "g")], "test string, function string"))
    assert {(r.id, r.function) for r in functions.collect()} == {(0, "f"), (1, "g")} and {r.test: r.ids for r in tests.collect()} == {"t": [0, 1], "s": [1]}
    assert sinks.mixed_sources(spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "1")], "path string, sha string")).count() == 1
    assert [r.line for r in sinks.table_lines(new.limit(1), {"k": 4, "v": 3}).collect()] == ["1     a"]
    assert "| 1 | a |" in sinks.markdown(new.orderBy("k", "v"))
