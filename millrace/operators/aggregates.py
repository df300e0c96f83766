"""Aggregates: window summaries, exact percentiles, censored latencies, grids, flows and sums that unknown poisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def poisoned_sum(value: Column) -> Column:
    """The sum, or null if any value is null: what is unknown does not count as 0."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def window_summary(samples: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per group count, mean, peak, least and last (by order) of the finite values; rows without one are counted as skipped."""
    v = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    return samples.groupBy(*group).agg(
        F.count(v).alias("n"), (F.count(F.lit(1)) - F.count(v)).alias("skipped"), F.avg(v).alias("mean"), F.max(v).alias("peak"), F.min(v).alias("least"), F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias("last")
    )


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact nearest-rank percentiles, p50 and so on: the value at ceil(n * p) in order."""
    return df.groupBy(*group).agg(F.count(value).alias("n"), *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in points])


def percentile_or(df: DataFrame, value: str, p: float, fallback: float) -> DataFrame:
    """One nearest-rank percentile of the whole, or the fallback if there is none or it is 0."""
    found = F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.agg(F.coalesce(F.nullif(found, F.lit(0.0)), F.lit(float(fallback))).alias("value"))


def latency(df: DataFrame, group: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Mean and greatest seconds of rows with both times; negative ones (a clock set back) are dropped and counted."""
    wait = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    ok = F.when(wait >= 0, wait)
    return df.withColumn("wait", wait).groupBy(*group).agg(F.count(ok).alias("jobs"), F.count_if(wait < 0).alias("negative"), F.avg(ok).alias("mean_s"), F.max(ok).alias("max_s"))


def censored(events: DataFrame, key: str, start: str, end: str, horizon: Column) -> DataFrame:
    """Per key the time from its first start to its first end after that.

    `events` has kind and at (microseconds). Right-censored: started, not ended by the horizon; its time runs to the horizon. Left-censored: an
    end before any start. Further starts count as retries.
    """
    first = F.min(F.when(F.col("kind") == start, F.col("at")))
    starts = events.groupBy(key).agg(first.alias("first_start"), F.min(F.when(F.col("kind") == end, F.col("at"))).alias("first_end"), F.count_if(F.col("kind") == start).alias("starts"))
    after = events.where(F.col("kind") == end).join(starts.select(key, "first_start"), key).where(F.col("at") >= F.col("first_start")).groupBy(key).agg(F.min("at").alias("ended"))
    out = starts.join(after, key, "left").where("first_start IS NOT NULL OR first_end IS NOT NULL")
    right = F.col("first_start").isNotNull() & F.col("ended").isNull()
    left = F.coalesce(F.col("first_end") < F.col("first_start"), F.col("first_start").isNull())
    return out.select(key, ((F.coalesce("ended", horizon) - F.col("first_start")) / 1e6).alias("seconds"), right.alias("right_censored"), left.alias("left_censored"), F.greatest(F.col("starts") - 1, F.lit(0)).alias("retries"))


def outcome_grid(samples: DataFrame, tests: DataFrame, archs: Sequence[str], repeats: Sequence[int]) -> DataFrame:
    """Per (test, arch) the outcomes over a fixed grid of repeats, a missing sample counted as such, and a class.

    The architectures and repeats are declared lists, laid out beside each test.
    """
    lists = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    grid = tests.select("test", lists("arch", archs)).select("test", "arch", lists("repeat", repeats))
    cells = grid.join(samples, ["test", "arch", "repeat"], "left")
    counted = cells.groupBy("test", "arch").agg(
        F.count_if(F.col("outcome") == "passed").alias("passed"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome").isNull()).alias("missing")
    )
    kind = F.when(F.col("missing") > 0, "incomplete").when((F.col("passed") > 0) & (F.col("failed") > 0), "flaky").when(F.col("failed") > 0, "failing").otherwise("stable")
    return counted.withColumn("class", kind)


def flow(events: DataFrame, start: Column, end: Column, at: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Opened, closed and net counts in the half-open time (start, end], for several groupings in one pass; `opened` tells which an event is."""
    columns = sorted({c for s in sets for c in s})
    inside = events.where((F.col(at) > start) & (F.col(at) <= end))
    plus, minus = F.count_if(F.col("opened")), F.count_if(~F.col("opened"))
    return inside.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("gid"), plus.alias("n_opened"), minus.alias("n_closed"), (plus - minus).alias("net"))


def rollup_counts(units: DataFrame, repo: str, priority: str, levels: Sequence[str]) -> DataFrame:
    """Units per repo and priority as columns, with the total."""
    return units.groupBy(repo).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(priority) == p).alias(f"n_{i}") for i, p in enumerate(levels)])


def ranked_first(df: DataFrame, key: str, rank: Column, value: str) -> DataFrame:
    """Per key the value of the smallest rank."""
    return df.groupBy(key).agg(F.min_by(value, rank).alias(value))


def deduplicated_sum(members: DataFrame, group: str, namespace: str, value: str) -> DataFrame:
    """Per group the sum over namespaces that members share, each counted once at its largest; members without one count alone."""
    shared = members.where(F.col(namespace).isNotNull()).groupBy(group, namespace).agg(F.max(value).alias("v")).select(group, "v")
    alone = members.where(F.col(namespace).isNull()).groupBy(group).agg(F.sum(value).alias("v"))
    return shared.unionByName(alone).groupBy(group).agg(F.sum("v").alias(value))


def union_peak(members: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """Per group the largest sum of two adjacent members."""
    w = Window.partitionBy(group).orderBy(pos)
    pair = F.col(value) + F.coalesce(F.lead(value).over(w), F.lit(0))
    return members.withColumn("pair", pair).groupBy(group).agg(F.max("pair").alias("peak"))


def cohorts(files: DataFrame, caps: str) -> DataFrame:
    """Files by their exact set of capabilities."""
    return files.groupBy(F.array_join(F.array_sort(F.array_distinct(caps)), ",").alias("caps")).agg(F.array_sort(F.collect_list("file")).alias("files"), F.count(F.lit(1)).alias("n"))


def reach_figures(reach: DataFrame, weights: DataFrame, total: Column) -> DataFrame:
    """Over tests' reach(test, file): mean, median, nearest-rank p90 and greatest number of files, and mean share by file and by weight."""
    per = reach.join(weights, "file").groupBy("test").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    all_ = weights.agg(F.count(F.lit(1)).alias("n_files"), F.sum("loc").alias("n_loc"))
    return per.join(F.broadcast(all_)).agg(
        F.avg("files").alias("mean_files"), F.expr("percentile(files, 0.5)").alias("median_files"), F.expr("CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY files) AS BIGINT)").alias("p90_files"), F.max("files").alias("max_files"),
        F.avg(F.col("files") / F.col("n_files")).alias("share_files"), F.avg(F.col("loc") / F.col("n_loc")).alias("share_loc"),
    )


def worst_verdict(legs: DataFrame, severity: Sequence[tuple[str, int]]) -> DataFrame:
    """The exit code of the most severe leg result; unknown results are most severe."""
    order = F.lit(-1)
    code = F.lit(2)
    for rank, (name, exit_) in enumerate(severity):
        order, code = F.when(F.col("result") == name, rank).otherwise(order), F.when(F.col("result") == name, exit_).otherwise(code)
    return legs.agg(F.min_by(code, order).alias("exit"))


def inclusive_weights(stacks: DataFrame) -> DataFrame:
    """Weight per frame of stacks(frames, weight): once per stack however often the frame recurs in it."""
    return stacks.select(F.explode(F.array_distinct("frames")).alias("frame"), "weight").groupBy("frame").agg(F.sum("weight").alias("weight"))


def category_seconds(stacks: DataFrame, category: Column, rate: float, top: int) -> DataFrame:
    """Sampled stacks as seconds per category, the largest first (a top list)."""
    return stacks.groupBy(category.alias("category")).agg((F.count(F.lit(1)) / rate).alias("seconds")).orderBy(F.desc("seconds"), "category").limit(top)


def repeat_figures(samples: DataFrame) -> DataFrame:
    """Per node of samples(node, repeat, phase, seconds, outcome): median and greatest of summed phases, and outcome counts."""
    per = samples.groupBy("node", "repeat").agg(F.sum("seconds").alias("s"), F.max("outcome").alias("outcome"))
    counts = per.groupBy("node", "outcome").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    return per.groupBy("node").agg(F.expr("percentile(s, 0.5)").alias("median_s"), F.max("s").alias("max_s"), F.count(F.lit(1)).alias("n")).join(counts, "node").orderBy(F.desc("median_s"), "node")


def shadowed(names: DataFrame) -> DataFrame:
    return names.groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def observed_capacity(samples: DataFrame) -> DataFrame:
    """Per kind what is wanted less what foreign work uses, not below 0; a device without a figure makes the kind unknown."""
    per = samples.groupBy("kind").agg(F.max("wanted").alias("wanted"), poisoned_sum(F.col("foreign")).alias("used"))
    return per.select("kind", F.when(F.col("used").isNotNull(), F.greatest(F.lit(0), F.col("wanted") - F.col("used"))).alias("capacity"))


def throughput(moves: DataFrame) -> DataFrame:
    """Per host of moves(host, mover, bytes, begun, ended): span, bytes, rate over the span and the best mover's rate."""
    rate = F.when(F.col("ended") > F.col("begun"), F.col("bytes") / (F.col("ended") - F.col("begun")))
    g = moves.withColumn("rate", rate).groupBy("host").agg(F.sum("bytes").alias("bytes"), (F.max("ended") - F.min("begun")).alias("span"), F.max("rate").alias("best"))
    return g.withColumn("rate", F.when(F.col("span") > 0, F.col("bytes") / F.col("span")))


def attribute_census(items: DataFrame) -> DataFrame:
    """items(bytes, attributes map of name to struct(state, errno)) in all: rows (name, state, errno, n, bytes); the totals stand under a null name."""
    totals = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    none = F.lit(None).cast("string")
    head = totals.select(none.alias("name"), none.alias("state"), F.lit(None).cast("int").alias("errno"), "n", "bytes")
    each = items.select(F.explode("attributes").alias("name", "a")).groupBy("name", F.col("a.state").alias("state"), F.col("a.errno").cast("int").alias("errno"))
    return head.unionByName(each.agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", F.lit(None).cast(dict(head.dtypes)["bytes"])))


def stack_costs(stacks: DataFrame, rate: float, rules: Sequence[tuple[str, str]], worker: str) -> DataFrame:
    """Thread seconds by cost of folded stacks(value), 'frame;frame count' lines: thread (worker or main), category, seconds, share of its thread.

    A stack's category is the first of the (category, pattern) rules that it matches, else other; stacks that match `worker` are the
    worker's. Lines without a count are skipped.
    """
    count = F.regexp_extract("value", r" ([0-9]+)$", 1).try_cast("long")
    category = F.lit("other")
    for name, pattern in reversed(rules):
        category = F.when(F.col("value").rlike(pattern), name).otherwise(category)
    rows = stacks.select(F.when(F.col("value").rlike(worker), "worker").otherwise("main").alias("thread"), category.alias("category"), count.alias("n")).where("n IS NOT NULL")
    per = rows.groupBy("thread", "category").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("thread"))
    return per.select("thread", "category", F.round(F.col("n") / rate, 2).alias("seconds"), F.round(F.col("n") / whole, 4).alias("share"))
