"""Change feeds on Structured Streaming: cursor reads with loss detection, semantic changes, guards and newest records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ring(events: DataFrame, capacity: int) -> DataFrame:
    """A bounded ring of events(epoch, seq, topic, id): the newest `capacity` of each epoch, with the floor, the first seq still held.

    seq is dense within an epoch, so the newest are those above the greatest less the capacity: no sort of all events.
    """
    last = events.groupBy("epoch").agg(F.max("seq").alias("last"))
    kept = events.join(last, "epoch").where(F.col("seq") > F.col("last") - capacity)
    return kept.withColumn("floor", F.greatest(F.col("last") - capacity + 1, F.lit(0))).drop("last")


def cursor_read(events: DataFrame, epoch: str, since: int, topics: Sequence[str], current_epoch: str, floor: int, ids: Sequence[str] | None = None, coverage: int | None = None, current_coverage: int | None = None) -> tuple[DataFrame, str | None]:
    """(events after the cursor on the topics, why to reset or None).

    A cursor of another epoch, behind the floor, or of another coverage has lost history: the reader must start anew and is told so.
    """
    reason = "epoch" if epoch != current_epoch else "history_lost" if since + 1 < floor else "coverage" if coverage != current_coverage else None
    out = events.where((F.col("seq") > since) & F.col("topic").isin(*topics))
    if ids is not None:
        out = out.where(F.col("id").isin(*ids))
    return out, reason


def changed(df: DataFrame, key: Sequence[str], order: Sequence[str], meaning: Column) -> DataFrame:
    """Observations whose meaning differs from the one before; others coalesce into it."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("meaning", F.sha2(F.coalesce(meaning, F.lit("\x00")), 256))
    return rows.withColumn("nth", F.row_number().over(w)).withColumn("was", F.lag("meaning").over(w)).where("nth = 1 OR NOT (meaning <=> was)").drop("nth", "was", "meaning")


def changed_stream(stream: DataFrame, key: str, meaning: str, order: str, idle_ms: int | None = None) -> DataFrame:
    """The streaming twin of changed: (key, order, meaning) is emitted when a key's meaning differs from the last. With idle_ms, for continuous triggers, idle keys are forgotten."""
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {meaning} {kinds[meaning]}"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        keep = []
        for value in rows[meaning].tolist():
            keep.append(value != last)
            last = value
        state.update((last,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows.loc[keep, [key, order, meaning]]

    return stream.groupBy(key).applyInPandasWithState(step, out, f"last {kinds[meaning]}", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def guard_stream(stream: DataFrame, key: str, at: str, value: str, limit: float, gap_s: float, need: int) -> DataFrame:
    """Consecutive exceedances per key across batches: a row not above the limit or a gap beyond gap_s starts anew; a row per decision (streak >= need).

    Rows older than the last seen are dropped, so a replay counts nothing twice.
    """
    kind = dict(stream.dtypes)[key]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak = state.get if state.exists else (None, 0)
        out = []
        for t, v in pd.concat(list(batches)).sort_values(at)[[at, value]].itertuples(index=False):
            t = pd.Timestamp(t).timestamp()
            if last is not None and t <= last:
                continue
            if v > limit:
                streak = streak + 1 if last is not None and t - last <= gap_s and streak else 1
            else:
                streak = 0
            last = t
            if streak >= need:
                out.append((name[0], t, streak))
        state.update((last, streak))
        yield pd.DataFrame(out, columns=[key, "at", "streak"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at double, streak long", "last double, streak long", "append", GroupStateTimeout.NoTimeout)


def newest_records(stream: DataFrame, key: str, generation: str, path: str, checkpoint: str):
    """Keeps the newest record per key in a table under path: each batch is merged with what is there, whole versions replace each other."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, version: int) -> None:
        before = [v for v in _versions(spark, path) if v < version]
        both = batch if not before else batch.unionByName(spark.read.parquet(f"{path}/version={max(before)}"))
        newest = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), generation).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/version={version}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped, earlier ones are merged."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n"))


def rotated(df: DataFrame, name: str, cursor: str, limit: int, fresh: Column) -> DataFrame:
    """A round of fresh names in order from behind a cursor, wrapping around, at most limit of them (the feature: a bounded round)."""
    return df.where(fresh).orderBy(F.when(F.col(name) > cursor, 0).otherwise(1), name).limit(limit)


def topic_of(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(topic, id) of a changed path by (topic, pattern with one group) rules; the first that matches."""
    out: Column = F.lit(None).cast("struct<topic:string,id:string>")
    for topic, pattern in reversed(rules):
        out = F.when(path.rlike(pattern), F.struct(F.lit(topic).alias("topic"), F.regexp_extract(path, pattern, 1).alias("id"))).otherwise(out)
    return out


def wake_sources(*sources: tuple[str, DataFrame]) -> DataFrame:
    """One stream of the (name, frame with host and at) sources that may wake a waiter: host, at, source."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [df.select("host", "at", F.lit(name).alias("source")) for name, df in sources])


def wakes(stream: DataFrame, width: str, late: str) -> DataFrame:
    """The first wake of each host and window of a merged stream, with the sources that rang in it; what comes later than the watermark is dropped."""
    g = stream.withWatermark("at", late).groupBy("host", F.window("at", width))
    return g.agg(F.min("at").alias("at"), F.array_sort(F.collect_set("source")).alias("sources")).select("host", "at", "sources")
