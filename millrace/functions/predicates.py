"""Predicates over tags, resource maps and captured states. Unknown is null and never passes for present or for zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tags_match(required: Column, offered: Column) -> Column:
    """Every required tag is offered; no requirement always matches."""
    return F.size(F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(offered, F.array().cast("array<string>")))) == 0


def placement(required: Column, offered: Column, needs_gpu: Column, has_gpu: Column) -> Column:
    """Tags match and, where a GPU is needed, one is known to be there; unknown fails."""
    return tags_match(required, offered) & (~needs_gpu | has_gpu.eqNullSafe(F.lit(True)))


def never_fits(need: Column, total: Column) -> Column:
    """Some kind's need exceeds the whole of it."""
    return F.exists(F.map_entries(need), lambda e: F.coalesce(F.try_element_at(total, e["key"]), F.lit(0)) < e["value"])


def room_fits(need: Column, available: Column) -> Column:
    """Every kind's need is available."""
    return F.forall(F.map_entries(need), lambda e: F.coalesce(F.try_element_at(available, e["key"]), F.lit(0)) >= e["value"])


def fits_measured(need: Column, available: Column, observed: Column, ledger: bool = False) -> Column:
    """Every need fits the lesser of what is available and what was observed; without an observation it fails, or the ledger counts alone."""
    seen = lambda key: F.try_element_at(observed, key)
    have = lambda key: F.coalesce(F.try_element_at(available, key), F.lit(0))
    least = lambda key: F.least(have(key), F.coalesce(seen(key), have(key)) if ledger else F.coalesce(seen(key), F.lit(-1)))
    return F.forall(F.map_entries(need), lambda e: least(e["key"]) >= e["value"])


def room_taken(rooms: Column, need: Column) -> Column:
    """The first kept room (an ordered array of name and free map) that a candidate's need would break; null if none."""
    return F.get(F.filter(rooms, lambda r: ~room_fits(need, r["free"])), F.lit(0))["name"]


def present(required: Column, known: Column, complete: Column) -> Column:
    """Three-valued: all required are known (true), some are known absent (false), or the listing is incomplete (null)."""
    return F.when(F.size(F.array_except(required, known)) == 0, True).when(complete, False)


def fresh(now: Column, stamp: Column, max_age: float) -> Column:
    return F.coalesce((now - stamp >= 0) & (now - stamp <= max_age), F.lit(False))


def fence_fits(held: Column, ready: Column, output: Column, capacity: Column) -> Column:
    return F.coalesce(held + ready + output <= capacity, F.lit(False))


def admission(need: Column, obligations: Column, capacity: Column, lone: Column | None = None) -> Column:
    """struct(admit, reason, permanent): a need beyond capacity never fits, one beyond what is left does not now; a lone unit is exempt from the latter."""
    alone = lone if lone is not None else F.lit(False)
    verdict = lambda admit, reason, permanent: F.struct(F.lit(admit).alias("admit"), F.lit(reason).cast("string").alias("reason"), F.lit(permanent).alias("permanent"))
    return (
        F.when(capacity.isNull(), verdict(False, "capacity unknown", False))
        .when(need > capacity, verdict(False, "never fits", True))
        .when((need + obligations > capacity) & ~alone, verdict(False, "no room now", False))
        .otherwise(verdict(True, None, False))
    )


def unified_memory_denial(committed: Column, requested: Column, ceiling: Column) -> Column:
    return F.when(committed + requested > ceiling, F.struct(committed.alias("committed"), requested.alias("requested"), ceiling.alias("ceiling")))


def same_identity(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of every pair."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out


def topic_filter(text: Column, pattern: str = r"^[a-z][a-z0-9_.-]{0,63}$", limit: int = 64) -> Column:
    """A bounded comma list as an array, or null if any part is not well formed."""
    parts = F.split(text, ",")
    return F.when((F.size(parts) <= limit) & F.forall(parts, lambda p: p.rlike(pattern)), parts)


def unmeasured_refusal(source: Column, decision: Column) -> Column:
    """Of a JSON decision: a fresh CPU refusal for a busy measurement host whose baseline is unmeasured and exceeded. Unknown is false."""
    at = lambda path: F.get_json_object(decision, path)
    wanted = (source == "adaptive_cpu_refused") & (at("$.reason") == "measurement_host_not_idle") & (at("$.fresh") == "true") & (at("$.baseline.basis") == "unmeasured") & (at("$.baseline.exceeds") == "true")
    return F.coalesce(wanted, F.lit(False))


def replenish_ok(grant_outstanding: Column, need_gib: Column, prior_retired: Column) -> Column:
    """No grant is outstanding, there is a real need, and every earlier leg is known to be retired."""
    return F.coalesce(~grant_outstanding & (need_gib > 0) & prior_retired, F.lit(False))


def preempted(preempted_by: Column, status: Column, generation: Column) -> Column:
    """A withdrawn ending of a generation that names what took its place."""
    return generation.isNotNull() & preempted_by.isNotNull() & F.coalesce(status == "withdrawn", F.lit(False))


def runs_any(argv: Column, names: Sequence[str]) -> Column:
    """Some argument's last path component is one of the names."""
    return F.coalesce(F.exists(argv, lambda part: F.element_at(F.split(F.rtrim(part, F.lit("/")), "/"), -1).isin(*names)), F.lit(False))


def write_space(free_bytes: Column, total_bytes: Column, allowance_gib: Column, floor_fraction: Column, to_write: Column, gib: int = 1 << 30) -> Column:
    """A write leaves the floor of the disk free, and one and a half times its size and 20 GiB are there before it, the allowance taken off. Unknown fails."""
    available = free_bytes - F.ceil(allowance_gib * gib)
    floor = F.ceil(total_bytes * floor_fraction)
    return F.coalesce((available - to_write >= floor) & (available >= F.ceil(1.5 * to_write) + 20 * gib), F.lit(False))


def held_back(withheld_for: Column, withheld_kinds: Column, takes_kind: Column, reserving_priority: Column, withheld_priority: Column) -> Column:
    """A row waits while something withholds all kinds or one it takes, unless it reserves at the withholder's priority or above."""
    held = withheld_for.isNotNull() & (withheld_kinds.isNull() | takes_kind)
    return held & ~F.coalesce(withheld_priority <= reserving_priority, F.lit(False))


def all_agree(df: DataFrame, group: Sequence[str], digest: str) -> DataFrame:
    """Per group whether all digests are there and equal; no evidence is no agreement."""
    return df.groupBy(*group).agg(((F.count_distinct(digest) == 1) & (F.count(digest) == F.count(F.lit(1)))).alias("agree"))


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with two values."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).where("n > 1").select(key)


def manifest_faults(entries: DataFrame, phases: DataFrame, totals: DataFrame) -> DataFrame:
    """Integrity faults of manifests: entries(manifest, idx, path, offset, bytes), phases(manifest, phase, indices, cumulative), totals(manifest, entry_count, total_bytes).

    A (path, offset) twice, totals that are not the sums, an entry no phase reads, and cumulative bytes that are not the running sums.
    """
    twice = entries.groupBy("manifest", "path", "offset").count().where("count > 1").select("manifest", F.lit("duplicate entry").alias("fault")).distinct()
    sums = entries.groupBy("manifest").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    wrong = totals.join(sums, "manifest", "left").where("NOT (entry_count <=> coalesce(n, 0) AND total_bytes <=> coalesce(b, 0))").select("manifest", F.lit("totals").alias("fault"))
    read = phases.select("manifest", "phase", "cumulative", F.explode("indices").alias("idx"))
    unread = entries.join(read, ["manifest", "idx"], "left_anti").select("manifest", F.lit("unread entry").alias("fault")).distinct()
    per = read.join(entries, ["manifest", "idx"], "left").groupBy("manifest", "phase", "cumulative").agg(F.sum("bytes").alias("b"))
    running = per.withColumn("run", F.sum("b").over(Window.partitionBy("manifest").orderBy("phase")))
    off = running.where("NOT (run <=> cumulative)").select("manifest", F.lit("cumulative").alias("fault")).distinct()
    return twice.unionByName(wrong).unionByName(unread).unionByName(off)


def boundary_faults(phases: DataFrame, boundaries: DataFrame, total: Column) -> DataFrame:
    """Phases(manifest, pos, upto) that go back, end off an entry boundary(manifest, upto), or whose last is not the total."""
    w = Window.partitionBy("manifest").orderBy("pos")
    rows = phases.withColumn("was", F.lag("upto").over(w)).withColumn("next", F.lead("upto").over(w))
    back = rows.where("upto < was").select("manifest", "pos", F.lit("goes back").alias("fault"))
    off = rows.join(boundaries, ["manifest", "upto"], "left_anti").select("manifest", "pos", F.lit("off boundary").alias("fault"))
    short = rows.where(F.col("next").isNull() & (F.col("upto") != total)).select("manifest", "pos", F.lit("not the total").alias("fault"))
    return back.unionByName(off).unionByName(short)


def contract_tags(*rules: tuple[str, Column]) -> Column:
    """The tags, in the rules' order, whose condition holds; unknown does not."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(tag)) for tag, condition in rules]))


def offered_tags(*rules: tuple[str, Column, Column]) -> Column:
    """The tags, in the rules' order, that a host offers, each followed by its companion tags."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.when(condition, F.concat(F.array(F.lit(tag)), F.coalesce(companions, none))).otherwise(none) for tag, condition, companions in rules]))


def remedies(tags: Column, *rules: tuple[str, str]) -> Column:
    """The distinct remedies of those tags, in the order of the rules (tag, remedy)."""
    return F.array_distinct(contract_tags(*[(remedy, F.array_contains(tags, tag)) for tag, remedy in rules if remedy]))


def presence_status(status: Column, reason: Column, by: Column, unix: Column, known: Sequence[str], active: str = "active") -> Column:
    """A host's (status, reason, by, unix, fault).

    No status is active, and an active host has no detail. Any other needs a reason and an author that are not blank and a
    finite time; an unknown status or missing provenance is a fault, which leaves the rest null.
    """
    stated = F.coalesce(status, F.lit(active))
    wanting = F.concat_ws(
        "; ",
        F.when(F.coalesce(F.trim(reason) == "", F.lit(True)), "reason"),
        F.when(F.coalesce(F.trim(by) == "", F.lit(True)), "by"),
        F.when(F.coalesce(F.isnan(unix) | (F.abs(unix) == float("inf")), F.lit(True)), "unix"),
    )
    fault = F.when(~stated.isin(*known), F.concat(F.lit("unknown status "), stated)).when((stated != active) & (wanting != ""), F.concat(F.lit("without "), wanting))
    detailed = fault.isNull() & (stated != active)
    return F.struct(
        F.when(fault.isNull(), stated).alias("status"),
        F.when(detailed, F.trim(reason)).alias("reason"),
        F.when(detailed, F.trim(by)).alias("by"),
        F.when(detailed, unix).alias("unix"),
        fault.alias("fault"),
    )
