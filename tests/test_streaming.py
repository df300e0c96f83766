import json
import os

import pandas as pd
from pyspark.sql import functions as F

from millrace.streaming import feeds


def files(tmp_path, batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(batches):
        (folder / f"{n:03}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{n:03}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in order of time
    return str(folder)


def collected(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


def test_cursor(spark):
    e = spark.createDataFrame([(s, "t" if s % 2 else "u", s) for s in range(10)], "seq int, topic string, id int")
    out, reason = feeds.cursor_read(e, "a", 4, ["t"], "a", 0)
    assert sorted(r.seq for r in out.collect()) == [5, 7, 9] and reason is None
    assert feeds.cursor_read(e, "a", 4, ["t"], "a", 0, ids=[7])[0].count() == 1
    assert feeds.cursor_read(e, "b", 4, ["t"], "a", 0)[1] == "epoch"
    assert feeds.cursor_read(e, "a", 4, ["t"], "a", 6)[1] == "history_lost"
    assert feeds.cursor_read(e, "a", 5, ["t"], "a", 6)[1] is None
    assert feeds.cursor_read(e, "a", 5, ["t"], "a", 0, coverage=1, current_coverage=2)[1] == "coverage"


def test_changes_stream_as_in_batch(spark, tmp_path):
    rows = [(k, n, m) for n, (k, m) in enumerate([("a", "x"), ("a", "x"), ("b", "x"), ("a", "y"), ("a", "x"), ("b", "x"), ("b", "z")])]
    data = [[{"k": k, "n": n, "m": m} for k, n, m in rows[i : i + 2]] for i in range(0, len(rows), 2)]
    stream = spark.readStream.schema("k string, n long, m string").option("maxFilesPerTrigger", 1).json(files(tmp_path, data))
    got = collected(spark, feeds.changed_stream(stream, "k", "m", "n"), "changes", tmp_path)
    batch = feeds.changed(spark.createDataFrame(rows, "k string, n long, m string"), ["k"], ["n"], F.col("m"))
    assert sorted(got) == sorted((r.k, r.n, r.m) for r in batch.collect())


def test_guard_counts_across_batches(spark, tmp_path):
    values = [(0, 9), (1, 9), (2, 1), (3, 9), (20, 9), (21, 9), (22, 9)]
    data = [[{"k": "a", "t": pd.Timestamp(t, unit="s").isoformat(), "v": float(v)}] for t, v in values]
    stream = spark.readStream.schema("k string, t timestamp, v double").option("maxFilesPerTrigger", 1).json(files(tmp_path, data))
    got = collected(spark, feeds.guard_stream(stream, "k", "t", "v", 5.0, 5.0, 2), "guard", tmp_path)
    assert sorted(got) == [("a", 1.0, 2), ("a", 21.0, 2), ("a", 22.0, 3)]


def test_newest_records(spark, tmp_path):
    data = [[{"k": "a", "g": 2, "v": 1}], [{"k": "a", "g": 1, "v": 9}, {"k": "b", "g": 1, "v": 2}]]
    stream = spark.readStream.schema("k string, g long, v long").option("maxFilesPerTrigger", 1).json(files(tmp_path, data))
    feeds.newest_records(stream, "k", "g", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = max(feeds._versions(spark, str(tmp_path / "out")))
    assert {(r.k, r.g, r.v) for r in spark.read.parquet(str(tmp_path / "out" / f"version={last}")).collect()} == {("a", 2, 1), ("b", 1, 2)}


def test_windowed_counts(spark, tmp_path):
    data = [[{"t": "2024-01-01T00:00:10", "k": "a"}, {"t": "2024-01-01T00:00:20", "k": "a"}], [{"t": "2024-01-01T01:00:00", "k": "a"}], [{"t": "2024-01-01T01:01:00", "k": "a"}], [{"t": "2024-01-01T00:00:30", "k": "a"}, {"t": "2024-01-01T03:00:00", "k": "b"}]]
    stream = spark.readStream.schema("t timestamp, k string").option("maxFilesPerTrigger", 1).json(files(tmp_path, data))
    got = collected(spark, feeds.windowed_counts(stream, "t", "k", "1 minute", "10 minutes"), "counts", tmp_path)
    assert sorted(r[2] for r in got)[-1] == 2


def test_rounds_topics_and_ring(spark):
    df = spark.createDataFrame([(n, n != "c") for n in "abcde"], "name string, ok boolean")
    assert [r.name for r in feeds.rotated(df, "name", "b", 3, F.col("ok")).collect()] == ["d", "e", "a"]
    paths = spark.createDataFrame([("queue/ready/x.json",), ("tier/t1",), ("other",)], "p string")
    got = paths.select(feeds.topic_of(F.col("p"), [("ready", r"^queue/ready/(.*)\.json$"), ("tier", r"^tier/(.*)$")]).alias("t")).collect()
    assert [r.t and tuple(r.t) for r in got] == [("ready", "x"), ("tier", "t1"), None]
    ring = feeds.ring(spark.range(10).selectExpr("'e' AS epoch", "id AS seq"), 4)
    assert sorted((r.seq, r.floor) for r in ring.collect()) == [(6, 6), (7, 6), (8, 6), (9, 6)]
