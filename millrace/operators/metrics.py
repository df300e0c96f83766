"""Gauges over queue, host, tier and terminal records, as rows (name, labels, value).

A gauge that could not be measured has no row; it never is 0 for lack of data.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def gauges(df: DataFrame, values: Mapping[str, str | Column], *labels: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row per row of df and named value; null values give none."""
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))] + [x for k, v in (extra or {}).items() for x in (F.lit(k), F.lit(v))]
    map_ = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value")) for n, v in values.items()])
    return df.select(map_.alias("labels"), F.explode(rows).alias("m")).select("m.name", "labels", "m.value").where("value IS NOT NULL")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def queue(items: DataFrame, states: DataFrame, now: float) -> DataFrame:
    """Items and oldest age per state of items(state, published_unix, unstarted_releases) where states(state, complete) was listed in full."""
    per = states.join(items.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("published_unix").alias("oldest"), F.sum("unstarted_releases").alias("r"), F.count("published_unix").alias("valid")), "state", "left").where("complete")
    age = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(F.col("valid") == F.col("n"), F.lit(now) - F.col("oldest"))
    return gauges(per, {"queue_items": F.coalesce("n", F.lit(0)), "queue_oldest_age_seconds": age, "queue_unstarted_releases": F.coalesce("r", F.lit(0))}, "state")


def workers(offers: DataFrame, now: float, horizon: float) -> DataFrame:
    """Liveness, age, capacities, memory domains and loops per host of offers(host, announced_unix, capacity, observed, domains, memory_gib, loops); invalid times give no row."""
    age = F.lit(now) - F.col("announced_unix")
    valid = offers.where(F.col("announced_unix").isNotNull() & (age >= 0)).withColumn("age", age).withColumn("fresh", age <= horizon)
    fresh = valid.where("fresh")
    pairs = lambda c: fresh.select("host", F.explode(F.map_entries(c)).alias("e")).select("host", F.col("e.key").alias("resource"), F.col("e.value").alias("v"))
    return union(
        gauges(valid, {"worker_up": F.col("fresh").cast("int"), "worker_offer_age_seconds": "age"}, "host"),
        gauges(pairs("capacity"), {"worker_capacity": "v"}, "host", "resource"),
        gauges(pairs("observed"), {"worker_observed_capacity": "v"}, "host", "resource"),
        gauges(fresh.select("host", F.explode("domains").alias("domain")), {"worker_memory_domain_info": F.lit(1)}, "host", "domain"),
        gauges(fresh, {"worker_memory_available_bytes": F.col("memory_gib") * (1 << 30), "worker_loops": "loops"}, "host"),
    )


def claims(active: DataFrame, hosts: DataFrame, now: float, lease: float) -> DataFrame:
    """Gauges of active(host, kind, leased_unix, cleanup_pending, first_failure_unix, demand) claims; hosts(host, resource) declares what is zero-filled.

    A host with a stale claim has no active_jobs; reservations count stale claims too.
    """
    stale = F.lit(now) - F.col("leased_unix") > lease
    per = active.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n"))
    bad = active.groupBy("host").agg(F.bool_or(F.coalesce(stale, F.lit(True))).alias("bad"))
    cleanup = active.where("cleanup_pending").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max(F.lit(now) - F.col("first_failure_unix")).alias("age"))
    held = active.select("host", F.explode(F.map_entries("demand")).alias("e")).groupBy("host", F.col("e.key").alias("resource")).agg(F.sum("e.value").alias("v"))
    return union(
        gauges(per.join(bad.where("NOT bad"), "host", "left_semi"), {"active_jobs": "n"}, "host", "kind"),
        gauges(cleanup, {"cleanup_pending_claims": "n", "cleanup_pending_oldest_seconds": "age"}, "host"),
        gauges(hosts.join(held, ["host", "resource"], "left"), {"reserved_resources": F.coalesce("v", F.lit(0))}, "host", "resource"),
    )


def telemetry(samples: DataFrame, now: float, max_age: float) -> DataFrame:
    """Observed use per host of samples(host, claim, nonce, expected_nonce, sampled_unix, cpu_s, wall_s, memory_peak, io_read, prev_cpu_s, prev_unix), one per live claim.

    Aggregates need a usable sample (complete, fresh, of the right nonce) of every claim of the host; peaks and counts do not.
    """
    age = F.lit(now) - F.col("sampled_unix")
    usable = F.coalesce((F.col("nonce") == F.col("expected_nonce")) & age.between(0, max_age) & (F.col("wall_s") > 0), F.lit(False))
    recent = F.when(usable & (F.col("sampled_unix") > F.col("prev_unix")) & (F.col("cpu_s") >= F.col("prev_cpu_s")), (F.col("cpu_s") - F.col("prev_cpu_s")) / (F.col("sampled_unix") - F.col("prev_unix")))
    rows = samples.withColumn("usable", usable).withColumn("recent", recent).withColumn("age", age)
    g = rows.groupBy("host").agg(
        F.when(F.bool_and("usable"), F.sum(F.col("cpu_s") / F.when(F.col("wall_s") > 0, F.col("wall_s")))).alias("cores"), F.when(F.bool_and("usable"), F.count(F.lit(1))).alias("jobs"), F.count_if(~F.col("usable")).alias("lost"),
        F.max(F.when(F.col("usable"), F.col("memory_peak"))).alias("peak"), F.sum(F.when(F.col("usable"), F.col("io_read"))).alias("io"), F.max(F.when(F.col("usable"), F.greatest(F.lit(0.0), F.col("age")))).alias("oldest"), F.sum("recent").alias("recent"), F.count("recent").alias("recent_n"),
    )
    return union(
        gauges(g, {"attempt_observed_resources": "cores"}, "host", extra={"resource": "cpu_cores"}),
        gauges(g, {"attempt_peak_resources": "peak"}, "host", extra={"resource": "memory_peak_bytes"}),
        gauges(g, {"attempt_peak_resources": "io"}, "host", extra={"resource": "io_read_bytes"}),
        gauges(g, {"attempt_telemetry_jobs": "jobs", "attempt_telemetry_unavailable_jobs": "lost", "attempt_telemetry_age_seconds": "oldest", "attempt_recent_cores": "recent", "attempt_recent_cores_jobs": F.when(F.col("recent_n") > 0, F.col("recent_n"))}, "host"),
    )


def admission(evidence: DataFrame, now: float) -> DataFrame:
    """Age of persisted evidence(host, resource, sampled_unix, status), and whether the GPU's status is a plateau."""
    return union(
        gauges(evidence, {"admission_evidence_age_seconds": F.lit(now) - F.col("sampled_unix")}, "host", "resource"),
        gauges(evidence.where("resource = 'gpu' AND status IS NOT NULL"), {"admission_plateau": (F.col("status") == "plateau").cast("int")}, "host", "resource"),
    )


def tiers(supply: DataFrame, tokens: DataFrame) -> DataFrame:
    """Fill supply of tiers (supply(tier, at, rate, probe)) and tokens(tier, resource, capacity, available) by state."""
    s = supply.groupBy("tier").agg(F.max("rate").alias("best"), F.max_by("rate", "at").alias("ceiling"), F.max_by("probe", "at").alias("probe_offer"))
    stat = lambda c: gauges(s, {"tier_fill_supply_mb_s": c}, "tier", extra={"stat": c})
    state = lambda c, v: gauges(tokens, {"tier_tokens": v}, "tier", "resource", extra={"state": c})
    return union(stat("best"), stat("ceiling"), stat("probe_offer"), state("capacity", "capacity"), state("available", "available"), state("held", F.col("capacity") - F.col("available")))


def denials(rows: DataFrame, now: float, window: float) -> DataFrame:
    """Latest denial per generation of rows(host, key, generation, denied_unix, reason) in the window, counted by host and reason."""
    inside = rows.where((F.col("denied_unix") > now - window) & (F.col("denied_unix") <= now))
    last = inside.groupBy("key", "generation").agg(F.max_by(F.struct("host", "reason"), F.struct("denied_unix", "host", "reason")).alias("r"))
    return gauges(last.groupBy(F.col("r.host").alias("host"), F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n")), {"claim_denials": "n"}, "host", "reason")


def movers(items: DataFrame, known_tiers: DataFrame) -> DataFrame:
    """Queue depth of items(state, tier, moves) that move data, in all and per tier; known tiers are zero-filled, an unnamed one is `unknown`."""
    rows = items.where("moves").withColumn("tier", F.coalesce("tier", F.lit("unknown")))
    per = rows.groupBy("tier", "state").agg(F.count(F.lit(1)).alias("n"))
    grid = known_tiers.select("tier", F.explode(F.array(F.lit("ready"), F.lit("claimed"))).alias("state")).unionByName(per.select("tier", "state")).distinct()
    return union(gauges(rows.groupBy("state").agg(F.count(F.lit(1)).alias("n")), {"mover_queue_depth": "n"}, "state"), gauges(grid.join(per, ["tier", "state"], "left"), {"mover_queue_depth_tier": F.coalesce("n", F.lit(0))}, "tier", "state"))


def starvation(consumers: DataFrame, now: float, grace: float) -> DataFrame:
    """Claimed consumers(tier, last_progress_unix) that have been quiet beyond the grace, and the longest quiet."""
    quiet = consumers.withColumn("quiet", F.lit(now) - F.col("last_progress_unix")).where(F.col("quiet") > grace)
    return gauges(quiet.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("quiet").alias("q")), {"starvation_waiting_consumers": "n", "starvation_waiting_quiet_max_seconds": "q"}, "tier")


def residency(plans: DataFrame, states: DataFrame, phases: DataFrame) -> DataFrame:
    """Plans(plan, tier, consumer) by the consumer's state, and phases(plan, tier, leg, pos, cursor, published, bytes) staged behind and known unstaged ahead of the cursor."""
    joined = plans.join(states.select(F.col("key").alias("consumer"), "state"), "consumer", "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    back = F.count_if((F.col("pos") <= F.col("cursor")) & F.coalesce("published", F.lit(False)))
    ahead = (F.col("pos") >= F.col("cursor")) & F.coalesce(~F.col("published"), F.lit(False))
    legs = phases.groupBy("tier", "leg").agg(back.alias("staged"), F.count_if(ahead).alias("unstaged"), F.sum(F.when(ahead, F.col("bytes")).otherwise(0)).alias("bytes"))
    return union(
        gauges(joined.groupBy("tier", "state").agg(F.count(F.lit(1)).alias("n")), {"residency_plans": "n"}, "tier", "state"),
        gauges(legs, {"residency_staged_phases": "staged", "residency_unstaged_phases": "unstaged", "residency_unstaged_bytes": "bytes"}, "tier", "leg"),
    )


def moves(receipts: DataFrame, now: float, window: float, share: float = 0.5, cap: int = 1000) -> DataFrame:
    """Movement receipts(tier, filed_unix, readable, staged, pool_read, seconds) filed in the window: jobs, those that read the pool, bytes, rates, and whether all were seen."""
    inside = receipts.where((F.col("filed_unix") > now - window) & (F.col("filed_unix") <= now))
    ok = inside.where("readable")
    both = F.col("staged").isNotNull() & F.col("pool_read").isNotNull()
    rate = F.when(both & (F.col("seconds") > 0) & (F.col("pool_read") >= share * F.col("staged")), F.col("pool_read") / F.col("seconds") / 1e6)
    g = ok.groupBy("tier").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(both & (F.col("pool_read") >= share * F.col("staged"))).alias("measured"), F.sum(F.when(both, F.col("staged"))).alias("staged"), F.sum(F.when(both, F.col("pool_read"))).alias("pool"), F.max(rate).alias("best"), F.avg(rate).alias("mean"), F.count(rate).alias("rated")
    )
    complete = receipts.agg((F.coalesce(F.bool_and("readable"), F.lit(True)) & (F.count(F.lit(1)) <= cap)).cast("int").alias("c"))
    return union(
        gauges(g, {"tier_move_jobs": "jobs", "tier_move_measured_jobs": "measured", "tier_move_staged_bytes": "staged", "tier_move_pool_read_bytes": "pool", "tier_move_rate_jobs": "rated"}, "tier"),
        gauges(g, {"tier_move_pool_rate_mb_s": "best"}, "tier", extra={"stat": "best"}),
        gauges(g, {"tier_move_pool_rate_mb_s": "mean"}, "tier", extra={"stat": "mean"}),
        gauges(complete, {"tier_move_window_seconds": F.lit(window), "tier_move_window_complete": "c"}),
    )


OUTCOMES = ("done", "failed", "withdrawn", "preempted")


def terminals(records: DataFrame, now: float, window: float = 3600.0, cap: int = 10_000) -> DataFrame:
    """Endings in the window of records(host, outcome, readable, published_unix, claimed_unix, finished_unix): counts, waits, runs, and whether all were read."""
    inside = records.where((F.col("finished_unix") > now - window) & (F.col("finished_unix") <= now) & F.col("readable"))
    named = inside.withColumn("outcome", F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("unknown"))
    wait, run_ = F.col("claimed_unix") - F.col("published_unix"), F.col("finished_unix") - F.col("claimed_unix")
    g = inside.groupBy("host").agg(F.avg(wait).alias("wm"), F.max(wait).alias("wx"), F.count(wait).alias("wn"), F.avg(run_).alias("rm"), F.max(run_).alias("rx"), F.count(run_).alias("rn"))
    whole = records.agg(F.coalesce(F.bool_and("readable"), F.lit(True)).cast("int").alias("ok"), F.count(F.lit(1)).alias("n"))
    jobs = inside.agg(F.count(F.lit(1)).alias("n"))
    stat = lambda name, c, s: gauges(g, {name: c}, "host", extra={"stat": s})
    return union(
        gauges(named.groupBy("host", "outcome").agg(F.count(F.lit(1)).alias("n")), {"terminal_outcomes": "n"}, "host", "outcome"),
        gauges(jobs, {"terminal_outcomes_window_jobs": "n", "terminal_outcomes_window_seconds": F.lit(window)}),
        gauges(whole, {"terminal_outcomes_window_complete": ((F.col("ok") == 1) & (F.col("n") <= cap)).cast("int"), "terminal_collection_success": "ok"}),
        stat("queue_wait_seconds", "wm", "mean"), stat("queue_wait_seconds", "wx", "max"), stat("execution_seconds", "rm", "mean"), stat("execution_seconds", "rx", "max"),
        gauges(g, {"terminal_timing_window_jobs": "wn"}, "host", extra={"phase": "queue_wait"}), gauges(g, {"terminal_timing_window_jobs": "rn"}, "host", extra={"phase": "execution"}),
    )


def box_windows(profiles: DataFrame) -> DataFrame:
    """The heaviest reading per host, metric and scope of profiles(host, metric, scope, value)."""
    return gauges(profiles.groupBy("host", "metric", "scope").agg(F.max("value").alias("v")), {"terminal_box_window": "v"}, "host", "metric", "scope")


def release_events(rows: DataFrame, now: float, window: float, cap: int = 10_000) -> DataFrame:
    """Claims released without an attempt, by the host that held them, of rows(held_by, released_unix, readable)."""
    inside = rows.where((F.col("released_unix") > now - window) & F.col("readable"))
    whole = rows.agg((F.coalesce(F.bool_and("readable"), F.lit(True)) & (F.count(F.lit(1)) <= cap)).cast("int").alias("c"))
    return union(gauges(inside.groupBy(F.col("held_by").alias("host")).agg(F.count(F.lit(1)).alias("n")), {"unstarted_release_events": "n"}, "host"), gauges(whole, {"unstarted_release_events_complete": "c"}))


def collection(inputs: DataFrame, reads: DataFrame) -> DataFrame:
    """Whether every input(readable) could be read, and how many reads(kind, n) of each kind the snapshot made."""
    ok = inputs.agg(F.coalesce(F.bool_and("readable"), F.lit(True)).cast("int").alias("ok"))
    return union(gauges(ok, {"collection_success": "ok"}), gauges(reads, {"scrape_reads": "n"}, "kind"))


# Dashboard queries: a metric frame (name, labels, value) in, rows out.


def select(m: DataFrame, name: str, equal: Mapping[str, str] | None = None, like: Mapping[str, str] | None = None, unlike: Mapping[str, str] | None = None) -> DataFrame:
    """Samples of a metric by label equality, whole-label pattern, or its negation."""
    out = m.where(F.col("name") == name)
    label = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    for k, v in (equal or {}).items():
        out = out.where(label(k) == v)
    for k, v in (like or {}).items():
        out = out.where(label(k).rlike(f"^(?:{v})$"))
    for k, v in (unlike or {}).items():
        out = out.where(~label(k).rlike(f"^(?:{v})$"))
    return out


def by(m: DataFrame, label: str, how: str = "sum", scale: float = 1.0) -> DataFrame:
    """Samples grouped by a label: sum or max, scaled."""
    return m.groupBy(F.try_element_at("labels", F.lit(label)).alias(label)).agg((F.expr(f"{how}(value)") * scale).alias("value"))


def total(m: DataFrame) -> DataFrame:
    return m.agg(F.sum("value").alias("value"))


def on_label(m: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """Samples whose label also is in other."""
    keys = other.select(F.try_element_at("labels", F.lit(label)).alias("k")).distinct()
    return m.withColumn("k", F.try_element_at("labels", F.lit(label))).join(keys, "k", "left_semi").drop("k")


def side_by_side(label: str, **queries: DataFrame) -> DataFrame:
    """Grouped queries joined on a label, each a column; a label that one lacks is null there."""
    frames = [q.withColumnRenamed("value", n) for n, q in queries.items()]
    return reduce(lambda a, b: a.join(b, label, "full"), frames)


def label_values(m: DataFrame, name: str, label: str) -> DataFrame:
    return select(m, name).select(F.try_element_at("labels", F.lit(label)).alias(label)).where(F.col(label).isNotNull()).distinct()
