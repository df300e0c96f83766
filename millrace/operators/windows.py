"""Operators over an order: newest generations, journals, runs, ranges and greedy folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, key: Sequence[str], at: str) -> list[Column]:
    """at, then every other column that can be ordered: ties in `at` have an order that does not depend on how rows were dealt."""
    rest = [c for c, kind in df.dtypes if c != at and c not in key and not kind.startswith(("map", "variant"))]
    return [F.col(at), *[F.col(c) for c in sorted(rest)]]


def newest(df: DataFrame, key: Sequence[str], generation: str, failure: Column) -> DataFrame:
    """Per key the row of the newest generation, with ties: how many rows share it.

    Success never wins a contested key: of tied rows a failure comes first. Rows without a generation lose to any that has one.
    """
    w = Window.partitionBy(*key)
    order = w.orderBy(F.col(generation).desc_nulls_last(), failure.desc(), *[c for c in df.columns if c not in (*key, generation)])
    top = F.max(generation).over(w)
    rows = df.withColumn("nth", F.row_number().over(order)).withColumn("ties", F.sum(F.when(F.col(generation).eqNullSafe(top), 1).otherwise(0)).over(w).cast("long"))
    return rows.where("nth = 1").drop("nth").withColumn("ambiguous", F.col("ties") > 1)


def newest_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Per key the newest n rows, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)


def journal(events: DataFrame, key: Sequence[str], order: Sequence[str], published: str, renewed: str, released: str) -> DataFrame:
    """Folds a journal (kind, lease) per key: the last lease published or renewed, the last event, and whether it is in effect; a renewal before any publication is invalid."""
    sets = F.col("kind").isin(published, renewed)
    at = F.struct(*order)
    g = events.groupBy(*key).agg(
        F.max_by(F.when(sets, F.col("lease")), F.when(sets, at)).alias("lease"), F.max_by("kind", at).alias("last_kind"), F.count(F.lit(1)).alias("events"),
        F.min(F.when(F.col("kind") == published, at)).alias("first_p"), F.min(F.when(F.col("kind") == renewed, at)).alias("first_r"),
    )
    return g.select(*key, "lease", "last_kind", "events", (F.col("last_kind") != released).alias("in_effect"), (F.col("first_r").isNull() | F.coalesce(F.col("first_p") < F.col("first_r"), F.lit(False))).alias("valid"))


def transitions(df: DataFrame, key: Sequence[str], order: Sequence[str], verdict: str) -> DataFrame:
    """Rows whose verdict differs from the one before (the first too), with how many rows repeat it."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("was", F.lag(verdict).over(w)).withColumn("change", (~F.col(verdict).eqNullSafe(F.col("was")) | (F.row_number().over(w) == 1)).cast("int"))
    rows = rows.withColumn("run", F.sum("change").over(w))
    return rows.withColumn("repeats", F.count(F.lit(1)).over(Window.partitionBy(*key, "run")) - 1).where("change = 1").drop("change")


def sliding_max(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, samples: int) -> DataFrame:
    """With the greatest value of the last `samples` rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(samples - 1), Window.currentRow)
    return df.withColumn("windowed", F.max(value).over(w))


def exceedance(df: DataFrame, key: Sequence[str], at: str, value: str, limit: float, gap_s: float, need: int) -> DataFrame:
    """Counts consecutive rows above a limit: a row not above it, or a gap of more than gap_s before it, starts anew; `due` from the need-th on."""
    order = ordered(df, key, at)
    w = Window.partitionBy(*key).orderBy(*order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    over = F.col(value) > limit
    rows = df.withColumn("over", over).withColumn("gap", (micros - F.lag(micros).over(w)) / 1e6)
    reset = (~F.col("over") | F.coalesce(F.col("gap") > gap_s, F.lit(True))).cast("int")
    rows = rows.withColumn("island", F.sum(reset).over(w))
    count = F.sum(F.col("over").cast("int")).over(Window.partitionBy(*key, "island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("streak", F.when(F.col("over"), count).otherwise(0).cast("long")).withColumn("due", F.col("streak") >= need).drop("island", "over", "gap")


def counter_rates(df: DataFrame, key: Sequence[str], at: str, counter: str, order: Sequence[str] = ()) -> DataFrame:
    """Growth of a counter per second since the row before; a fall is a reset, which has no rate."""
    w = Window.partitionBy(*key).orderBy(at, *order)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.withColumn("delta", F.col(counter) - F.lag(counter).over(w)).withColumn("seconds", (micros - F.lag(micros).over(w)) / 1e6)
    return rows.withColumn("reset", F.col("delta") < 0).withColumn("rate", F.when((F.col("delta") >= 0) & (F.col("seconds") > 0), F.col("delta") / F.col("seconds")))


def debounced(df: DataFrame, key: Sequence[str], at: str, signature: str, confirm: float) -> DataFrame:
    """Rows whose signature has stood unchanged for at least `confirm` (units of at) counts as confirmed."""
    w = Window.partitionBy(*key).orderBy(*ordered(df, key, at))
    change = (~F.col(signature).eqNullSafe(F.lag(signature).over(w))).cast("int")
    rows = df.withColumn("run", F.sum(change).over(w))
    return rows.withColumn("confirmed", F.col(at) - F.min(at).over(Window.partitionBy(*key, "run")) >= confirm).drop("run")


def absence_windows(df: DataFrame, key: Sequence[str], at: str, identity: str, gap: float) -> DataFrame:
    """Per row since when the same identity is observed without a gap of more than `gap`; an incomplete observation (null identity) clears."""
    w = Window.partitionBy(*key).orderBy(*ordered(df, key, at))
    new = (F.col(identity).isNull() | ~F.col(identity).eqNullSafe(F.lag(identity).over(w)) | F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True))).cast("int")
    rows = df.withColumn("run", F.sum(new).over(w))
    return rows.withColumn("since", F.when(F.col(identity).isNotNull(), F.min(at).over(Window.partitionBy(*key, "run")))).drop("run")


def running_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """Each entry's half-open byte range [start, end) in read order."""
    w = Window.partitionBy(*group).orderBy(*order)
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("end", end).withColumn("start", F.col("end") - F.col(size))


def phase_ranges(phases: DataFrame, group: Sequence[str], pos: str, cumulative: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(pos)
    return phases.withColumn("start", F.coalesce(F.lag(cumulative).over(w), F.lit(0))).withColumnRenamed(cumulative, "end")


def overlapping(ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """Ranges [start, end) that share a byte with the asked one."""
    return ranges.where((F.col("start") < end) & (F.col("end") > start) & (F.col("start") < F.col("end")))


def window_target(ranges: DataFrame, group: Sequence[str], consumed: Column, budget: Column) -> DataFrame:
    """Per group the furthest entry boundary that consumed plus budget covers."""
    return ranges.groupBy(*group).agg(F.coalesce(F.max(F.when(F.col("end") <= consumed + budget, F.col("end"))), F.lit(0)).alias("target"))


def contiguous_prefix(phases: DataFrame, group: Sequence[str], pos: str, flag: str) -> DataFrame:
    """Per group whether the flagged phases are a prefix of all."""
    w = Window.partitionBy(*group).orderBy(pos)
    rows = phases.withColumn("nth", F.row_number().over(w)).withColumn("so_far", F.sum(F.col(flag).cast("int")).over(w))
    return rows.groupBy(*group).agg(F.bool_and(~F.col(flag) | (F.col("nth") == F.col("so_far"))).alias("prefix"))


def read_order(phases: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    """Entries in the order that phases(pos, indices) read them; one may come up several times."""
    rows = phases.select(group, "pos", F.posexplode("indices").alias("step", "idx")).join(entries, [group, "idx"], "left")
    return rows.withColumn("read_no", F.row_number().over(Window.partitionBy(group).orderBy("pos", "step")) - 1)


def chunks(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, limit: float) -> DataFrame:
    """Greedy chunks of whole entries in order, each at most `limit`; an entry beyond it is a chunk alone.

    Returns per group the chunks' sizes. The fold runs over one group's sorted entries inside one expression; groups are records, not tables.
    """
    entries = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("double").alias("amount")))), lambda e: e["amount"])
    start = F.struct(F.lit(None).cast("double").alias("open"), F.array().cast("array<double>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        fits = a["open"].isNotNull() & (a["open"] + x <= limit)
        return F.struct(F.when(fits, a["open"] + x).otherwise(x).alias("open"), F.when(fits | a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"))

    packed = F.aggregate(entries, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return df.groupBy(*group).agg(packed.alias("sizes")).select(*group, F.size("sizes").cast("long").alias("n_chunks"), F.array_max("sizes").alias("largest"), "sizes")


def budget_walk(df: DataFrame, group: Sequence[str], order: Sequence[str], key: str, need: str, budget: float) -> DataFrame:
    """Walks claims in order and spends a budget: a claim that fits what is left is granted, the first that does not is the head, later ones are held back.

    Returns per group the granted keys, the head and what is left.
    """
    claims = F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("who"), F.col(need).cast("double").alias("amount"))))
    who = "string" if dict(df.dtypes)[key] == "string" else dict(df.dtypes)[key]
    start = F.struct(F.lit(float(budget)).alias("left"), F.lit(None).cast(who).alias("head"), F.array().cast(f"array<{who}>").alias("granted"))

    def step(a: Column, x: Column) -> Column:
        fits = a["head"].isNull() & (x["amount"] <= a["left"])
        return F.struct(
            F.when(fits, a["left"] - x["amount"]).otherwise(a["left"]).alias("left"),
            F.when(fits, a["head"]).otherwise(F.coalesce(a["head"], x["who"])).alias("head"),
            F.when(fits, F.concat(a["granted"], F.array(x["who"]))).otherwise(a["granted"]).alias("granted"),
        )

    walked = df.groupBy(*group).agg(F.aggregate(claims, start, step).alias("w"))
    return walked.select(*group, F.size("w.granted").cast("long").alias("n_granted"), F.col("w.head").alias("head"), F.col("w.left").alias("unspent"), F.col("w.granted").alias("granted"))


def lpt_shards(df: DataFrame, group: Sequence[str], name: str, cost: str, shards: int) -> DataFrame:
    """Longest first, ties by name, each to the least loaded of the group's shards (the first of equals): shard, load, members."""
    items = F.array_sort(F.collect_list(F.struct((-F.col(cost)).alias("minus"), F.col(name).alias("who"))))
    start = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.lit(0.0).alias("load"), i.alias("shard"), F.lit(0).cast("long").alias("members")))

    def step(a: Column, x: Column) -> Column:
        least = F.array_min(a)
        return F.transform(a, lambda s: F.when(s["shard"] == least["shard"], F.struct((s["load"] - x["minus"]).alias("load"), s["shard"].alias("shard"), (s["members"] + 1).alias("members"))).otherwise(s))

    packed = df.groupBy(*group).agg(F.aggregate(items, start, step).alias("s"))
    return packed.select(*group, F.explode("s").alias("s")).select(*group, "s.shard", "s.load", "s.members")


def round_robin(df: DataFrame, order: Sequence[str], shards: int, group: Sequence[str]) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1, F.lit(shards)))


def setup_shards(files: DataFrame, setup: str, cost: str, shards: int) -> DataFrame:
    """Files that share a setup are one unit; the shards-1 costliest units stand alone, the rest share the last shard."""
    units = files.groupBy(setup).agg(F.sum(cost).alias("cost"), F.array_sort(F.collect_list("file")).alias("files"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cost"), setup))  # a row per setup
    return units.withColumn("shard", F.least(rank - 1, F.lit(shards - 1)))


def best_source(df: DataFrame, key: Sequence[str], score: str, path: str) -> DataFrame:
    """Per key the path of the greatest score, ties by path."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), path))).where("nth = 1").drop("nth")


def promoted(df: DataFrame, eligible: str, pos: str) -> DataFrame:
    """Eligible rows first, otherwise in their order."""
    return df.orderBy(F.when(F.col(eligible), 0).otherwise(1), pos)


def elections(df: DataFrame, host: str) -> DataFrame:
    """Per host the best-ranked election: higher priority, then earlier, then by group."""
    order = Window.partitionBy(host).orderBy(F.desc("priority"), "first_published", "group")
    return df.withColumn("position", F.row_number().over(order))


def stuck_victim(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Where all claims of a group are blocked, the last ranked that is not the head."""
    g = df.groupBy(*group).agg(F.bool_and("blocked").alias("all_blocked"), F.max_by("consumer", "rank").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select(*group, F.when(F.col("all_blocked") & (F.col("n") > 1), F.col("last")).alias("victim"))


def deadlines(df: DataFrame, *sources: str) -> DataFrame:
    """The earliest of several deadlines; null where there is none."""
    return df.withColumn("deadline", F.array_min(F.array(*sources)))


def episodes(df: DataFrame, key: Sequence[str], at: str, short: str) -> DataFrame:
    """Drain episodes: runs of rows with a shortage, with their age at each row."""
    w = Window.partitionBy(*key).orderBy(*ordered(df, key, at))
    start = (F.col(short) & ~F.coalesce(F.lag(short).over(w), F.lit(False))).cast("int")
    rows = df.withColumn("episode", F.sum(start).over(w))
    first = F.min(F.when(F.col(short), F.col(at))).over(Window.partitionBy(*key, "episode"))
    return rows.where(short).withColumn("age", F.col(at) - first)


def progress(df: DataFrame, key: Sequence[str], at: str, units: str) -> DataFrame:
    """The greatest units reported per key, and whether any report went back."""
    w = Window.partitionBy(*key).orderBy(*ordered(df, key, at))
    return df.withColumn("back", F.coalesce(F.col(units) < F.lag(units).over(w), F.lit(False))).groupBy(*key).agg(F.max(units).alias("units"), F.bool_or("back").alias("regressed"))


def due_deadlines(observations: DataFrame, key: Sequence[str], order: Sequence[str], deadlines_: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(keys with a deadline at or before now, each with its deadlines still ahead; the earliest deadline still ahead) of the last observation per key.

    An observation replaces the deadlines of the one before; each is consumed once, so what is due leaves only later ones.
    """
    last = observations.groupBy(*key).agg(F.max_by(deadlines_, F.struct(*order)).alias("held"))
    rows = last.withColumn("ahead", F.filter("held", lambda d: d > now))
    due = rows.where(F.exists("held", lambda d: d <= now)).select(*key, "ahead")
    return due, rows.agg(F.min(F.array_min("ahead")).alias("next_deadline"))


def coalesced_runs(events: DataFrame, key: Sequence[str], order: str, first_delay: float = 0.25, most: float = 5.0) -> DataFrame:
    """What a latched flag with retries does with events(kind changed, failed or completed): a row per event with state (dirty or clean), retry_at and coalesced.

    A change sets the flag, and one that finds it set is coalesced; it cancels a pending retry, as a completion does, which clears the flag.
    A failure keeps the flag and retries after first_delay, which doubles with each failure in a row up to `most`.
    """
    w = Window.partitionBy(*key).orderBy(*ordered(events, key, order))
    rows = events.withColumn("reset", F.sum((F.col("kind") != "failed").cast("int")).over(w))
    run = Window.partitionBy(*key, "reset").orderBy(*ordered(events, key, order))
    fails = F.sum((F.col("kind") == "failed").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("fails", fails).withColumn("was", F.lag("kind").over(w))
    retry = F.when(F.col("kind") == "failed", F.col(order) + F.least(F.lit(most), F.lit(first_delay) * F.pow(F.lit(2.0), F.col("fails") - 1)))
    dirty = F.col("kind") != "completed"
    merged = (F.col("kind") == "changed") & F.coalesce(F.col("was") != "completed", F.lit(False))
    return rows.withColumn("state", F.when(dirty, "dirty").otherwise("clean")).withColumn("retry_at", retry).withColumn("coalesced", merged).drop("reset", "fails", "was")


def drain_verdicts(questions: DataFrame, holders: DataFrame, ceiling: float, starvation: int = 3) -> DataFrame:
    """Whether to withhold a host's room until its holders drain: questions and holders to key, eligible, withhold, why, covered, in_way, age, epoch and expired.

    questions(key, mode, need, available, passes, first_unix, foreign_unix, epoch_unix, expired_unix, now): need and available are maps of
    kind to amount, the stamps those of earlier passes. holders(key, holder, bound, claimed_unix, counts): bound is transient, unknown or lasting; an unknown one counts as
    transient while the question is no older than the ceiling.

    In order: before `starvation` passes nothing is withheld; foreign load within the ceiling waits; without holders an in-flight
    change is waited for up to the ceiling; holders that drain must cover every short kind (in mode exclusive none may be lasting). A claim since the
    episode began and before it expired is a refill: refills beyond the ceiling expire the episode, and an expired one without refills starts anew.
    """
    q = questions.withColumn("age", F.greatest(F.lit(0.0), F.col("now") - F.coalesce("first_unix", "now")))
    have = lambda kind: F.coalesce(F.try_element_at("available", kind), F.lit(0))
    q = q.withColumn("short", F.map_filter(F.transform_values("need", lambda k, v: v - have(k)), lambda _, v: v > 0)).withColumn("eligible", F.coalesce("passes", F.lit(0)) + 1 >= starvation)
    rows = holders.join(q.select("key", "age", "epoch_unix", "expired_unix", "now"), "key")
    drains = (F.col("bound") == "transient") | ((F.col("bound") == "unknown") & (F.col("age") <= ceiling))
    epoch = F.coalesce("epoch_unix", "now")
    refill = drains & (F.col("claimed_unix") > epoch) & (F.col("expired_unix").isNull() | (F.col("claimed_unix") < F.col("expired_unix")))
    per = rows.groupBy("key").agg(F.count_if(drains).alias("draining"), F.count_if(~drains).alias("in_way"), F.count_if(~drains & (F.col("bound") == "unknown")).alias("unknown_in_way"), F.count_if(F.coalesce(refill, F.lit(False))).alias("refills"))
    kinds = rows.where(drains).select("key", F.explode("counts").alias("kind", "n")).groupBy("key", "kind").agg(F.sum("n").alias("n")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("covered"))
    q = q.join(per, "key", "left").join(kinds, "key", "left").fillna(0, ["draining", "in_way", "unknown_in_way", "refills"])
    covers = F.when(F.col("mode") == "exclusive", F.col("in_way") == 0).otherwise(F.forall(F.map_entries("short"), lambda e: F.coalesce(F.try_element_at("covered", e["key"]), F.lit(0)) >= e["value"]))
    foreign = F.coalesce(F.col("now") - F.col("foreign_unix") <= ceiling, F.lit(False))
    nobody = (F.col("draining") == 0) & (F.col("in_way") == 0)
    started_anew = F.col("expired_unix").isNotNull() & (F.col("refills") == 0)
    expires_now = F.col("expired_unix").isNull() & (F.col("refills") > 0) & (F.col("now") - epoch > ceiling)
    q = q.withColumn("why", (
        F.when(~F.col("eligible"), "not_starved").when(foreign, "foreign_load")
        .when(nobody, F.when(F.col("mode") == "exclusive", "foreign_load").when(F.col("age") <= ceiling, "in_flight").otherwise("unknown_past_ceiling"))
        .when(~covers, F.when(F.col("in_way") == 0, "holders_cannot_cover").when(F.col("unknown_in_way") == F.col("in_way"), "unknown_past_ceiling").otherwise("holder_does_not_drain_soon"))
        .when(expires_now | (F.col("expired_unix").isNotNull() & ~started_anew), "refilled_past_ceiling").otherwise("drains_soon")
    ))
    runs = F.col("why").isin("drains_soon", "refilled_past_ceiling")
    return q.select(
        "key", "eligible", F.col("why").isin("drains_soon", "in_flight").alias("withhold"), "why", "draining", "in_way", "age",
        F.when(runs, F.when(started_anew, F.col("now")).otherwise(epoch)).alias("epoch"), F.when(runs & ~started_anew, F.when(expires_now, F.col("now")).otherwise(F.col("expired_unix"))).alias("expired"),
    )
