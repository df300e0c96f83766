"""Joins by identity, path, order in time and state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered


def identity_join(before: DataFrame, after: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """Rows of two snapshots whose key is in both with an equal identity; after's columns, and before's as struct `was`."""
    was = before.select(F.col(key), F.struct(*before.columns).alias("was"))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"was.{c}"))
    return after.join(was, key).where(same)


def attributed_deltas(before: DataFrame, after: DataFrame, key: str, identity: Sequence[str], group: str, counter: str) -> DataFrame:
    """Per group the counter's growth: of members in both snapshots with one identity the difference (never below 0), of members new in the second all of it."""
    was = before.select(F.col(key), *[F.col(c).alias(f"was_{c}") for c in identity], F.col(counter).alias("was_counter"))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"was_{c}"))
    delta = F.when(F.col("was_counter").isNull(), F.col(counter)).when(same & (F.col(counter) >= F.col("was_counter")), F.col(counter) - F.col("was_counter"))
    return after.join(was, key, "left").groupBy(group).agg(F.sum(delta).alias("delta"), F.count(delta).alias("members"))


def prefixes(path: Column) -> Column:
    """A path and all its parents."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def path_join(rows: DataFrame, path: str, scopes: DataFrame, scope_path: str) -> DataFrame:
    """Rows with their innermost scope whose path is theirs or a parent of it; null scope columns where none is.

    An equi-join on the parents of each distinct path, not a comparison of every pair; its scope comes back by the path.
    """
    paths = rows.select(F.col(path).alias("row_path")).where("row_path IS NOT NULL").distinct()
    wide = paths.select("row_path", F.explode(prefixes(F.col("row_path"))).alias("at"))
    hit = wide.join(scopes.withColumnRenamed(scope_path, "at"), "at")
    best = hit.groupBy("row_path").agg(F.max_by(F.struct(*[c for c in scopes.columns if c != scope_path], F.col("at").alias(scope_path)), F.length("at")).alias("scope"))
    return rows.join(best, F.col(path) == F.col("row_path"), "left").drop("row_path")


def successor(starts: DataFrame, events: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Each start with the earliest event of its key strictly after it (an as-of join forward), null if none.

    Both sides are laid in one order per key; one pass from the end carries the next event backward.
    """
    a = starts.select(*key, at, F.struct(*starts.columns).alias("start"), F.lit(None).cast("struct<" + ",".join(f"`{n}`:{t}" for n, t in events.dtypes) + ">").alias("event"))
    b = events.select(*key, at, F.lit(None).cast("struct<" + ",".join(f"`{n}`:{t}" for n, t in starts.dtypes) + ">").alias("start"), F.struct(*events.columns).alias("event"))
    w = Window.partitionBy(*key).orderBy(F.col(at)).rangeBetween(1, Window.unboundedFollowing) if _integral(starts, at) else None
    both = a.unionByName(b)
    if w is None:
        both = both.withColumn("at_us", F.unix_micros(F.col(at).cast("timestamp")))
        w = Window.partitionBy(*key).orderBy("at_us").rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("next", F.first("event", ignorenulls=True).over(w)).where("start IS NOT NULL").select("start.*", "next")


def _integral(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("int", "bigint")


def interval_join(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Points in half-open spans [start, end) of one numeric axis, joined over buckets of `width`: no pair outside a shared bucket is compared.

    A span is in every bucket from its start's to its end's, the last included: on an axis with fractions points just below an end may lie in it.
    """
    p = points.withColumn("bucket", F.floor(F.col(at) / width))
    s = spans.where(F.col(start) < F.col(end)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, "bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("bucket")


def status_diff(now: DataFrame, before: DataFrame, key: Sequence[str], ok: str = "passed", quarantined: Sequence[str] = ()) -> DataFrame:
    """Per key of either side (columns key, outcome) its change: new, known, recovered, gone, quarantined or fine."""
    n = now.select(*key, F.col("outcome").alias("now"))
    b = before.select(*key, F.col("outcome").alias("before"))
    held = F.lit(False)
    for p in quarantined:
        held = held | F.startswith(F.col(key[0]).cast("string"), F.lit(p))
    bad, was_bad = F.col("now") != ok, F.col("before") != ok
    change = (
        F.when(F.col("now").isNull(), "gone").when(bad & held, "quarantined").when(bad & F.coalesce(was_bad, F.lit(False)), "known").when(bad, "new").when(was_bad, "recovered").otherwise("fine")
    )
    return n.join(b, list(key), "full").withColumn("change", change)


def compare(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Per key match, drift or unknown (a side is missing or null)."""
    a, b = left.select(*key, F.col(value).alias("left_value")), right.select(*key, F.col(value).alias("right_value"))
    verdict = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), "unknown").when(F.col("left_value") == F.col("right_value"), "match").otherwise("drift")
    return a.join(b, list(key), "full").withColumn("verdict", verdict)


def reconcile(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that left, entered or changed their value."""
    both = old.select(key, F.col(value).alias("old"), F.lit(True).alias("was")).join(new.select(key, F.col(value).alias("new"), F.lit(True).alias("is")), key, "full")
    change = F.when(F.col("is").isNull(), "left").when(F.col("was").isNull(), "entered").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "old", "new", "change")


def renamed_functions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two maps (name, body): changed, added, deleted, and renamed where an added body is a deleted one's, one to one."""
    both = old.select("name", F.col("body").alias("old")).join(new.select("name", F.col("body").alias("new")), "name", "full")
    changed = both.where("old <> new").select("name", F.lit(None).cast("string").alias("was"), F.lit("changed").alias("change"))
    nth = lambda side: F.row_number().over(Window.partitionBy(side).orderBy("name"))
    gone = both.where("new IS NULL").select(F.col("name").alias("was"), F.col("old").alias("body"), nth("old").alias("nth"))
    come = both.where("old IS NULL").select("name", F.col("new").alias("body"), nth("new").alias("nth"))
    moved = come.join(gone, ["body", "nth"], "full")
    rest = moved.select(F.coalesce("name", "was").alias("name"), F.when(F.col("name").isNotNull(), F.col("was")).alias("was"), F.when(F.col("was").isNull(), "added").when(F.col("name").isNull(), "deleted").otherwise("renamed").alias("change"))
    return changed.unionByName(rest)


def roster_entry(hosts: DataFrame, roster: DataFrame) -> DataFrame:
    """hosts(host) with their roster(name, aliases) entry: a canonical name wins, else the only one that has it as an alias; several are ambiguous."""
    by_name = hosts.join(roster.select(F.col("name").alias("host"), F.col("name").alias("canonical")), "host", "left")
    alias = roster.select("name", F.explode("aliases").alias("host")).groupBy("host").agg(F.min("name").alias("by_alias"), F.count_distinct("name").alias("n"))
    out = by_name.join(alias, "host", "left")
    return out.select("host", F.coalesce("canonical", F.when(F.col("n") == 1, F.col("by_alias"))).alias("name"), F.coalesce(F.col("canonical").isNull() & (F.col("n") > 1), F.lit(False)).alias("ambiguous"))


def shared_aliases(roster: DataFrame) -> DataFrame:
    """Names that more than one entry claims as its name or an alias."""
    names = roster.select("name", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return names.groupBy("alias").agg(F.count_distinct("name").alias("owners")).where("owners > 1").select("alias")


def release(edges: DataFrame, states: DataFrame, done: Sequence[str] = ("done",), bad: Sequence[str] = ("failed", "withdrawn")) -> DataFrame:
    """Per consumer of edges(consumer, producer): hold if any producer is bad, release if all are done, else wait."""
    joined = edges.join(states.select(F.col("key").alias("producer"), "state"), "producer", "left")
    is_bad, is_done = F.coalesce(F.col("state").isin(*bad), F.lit(False)), F.coalesce(F.col("state").isin(*done), F.lit(False))
    return joined.groupBy("consumer").agg(F.when(F.bool_or(is_bad), "hold").when(F.bool_and(is_done), "release").otherwise("wait").alias("decision"))


def generation_state(members: DataFrame, states: DataFrame, order: Sequence[str]) -> DataFrame:
    """members(key, generation) with the state of exactly that generation, from the first of the namespaces that has it."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("state"))
    found = states.where(rank > 0).groupBy("key", "generation").agg(F.min_by("state", rank).alias("state"))
    return members.join(found, ["key", "generation"], "left")


def admitted(units: DataFrame, *sources: DataFrame) -> DataFrame:
    """units(key) with whether any of the sources has the key."""
    from functools import reduce

    keys = reduce(lambda a, b: a.unionByName(b), [s.select("key") for s in sources]).distinct().withColumn("admitted", F.lit(True))
    return units.join(keys, "key", "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def newly_durable(children: DataFrame, custody: DataFrame, baseline: DataFrame, counted: DataFrame) -> DataFrame:
    """Distinct children in custody that the baseline lacks and that were not counted before."""
    return children.select("key").distinct().join(custody, "key", "left_semi").join(baseline, "key", "left_anti").join(counted, "key", "left_anti")


def siblings_ready(members: DataFrame, offers: DataFrame, now: float, horizon: float) -> DataFrame:
    """Per group: every member is claimed or ready on a fresh host, and no two share a host."""
    fresh = offers.where(F.lit(now) - F.col("announced_unix") <= horizon).select("host", F.lit(True).alias("fresh"))
    ok = (F.col("state") == "claimed") | ((F.col("state") == "ready") & F.coalesce("fresh", F.lit(False)))
    return members.join(fresh, "host", "left").groupBy("group").agg((F.bool_and(F.coalesce(ok, F.lit(False))) & (F.count_distinct("host") == F.count(F.lit(1)))).alias("ready"))


def dangling(holders: DataFrame, live: DataFrame, complete: bool) -> DataFrame:
    """Holders of no live unit; none are named unless the census of live units is complete."""
    return holders.join(live, "key", "left_anti") if complete else holders.limit(0)


def retention(logs: DataFrame, held: DataFrame, now: float, max_age: float) -> DataFrame:
    """Logs(key, idx, mtime, inode) to prune: old, not the newest of their key, and not held open."""
    newest = F.max("idx").over(Window.partitionBy("key"))
    return logs.withColumn("newest", newest).where((F.lit(now) - F.col("mtime") > max_age) & (F.col("idx") < F.col("newest"))).join(held, "inode", "left_anti").drop("newest")


def carried_forward(current: DataFrame, previous: DataFrame, key: str, column: str) -> DataFrame:
    """current with null values of a column taken from the previous snapshot."""
    return current.join(previous.select(key, F.col(column).alias("previous_value")), key, "left").withColumn(column, F.coalesce(column, "previous_value")).drop("previous_value")


def sizing(samples: DataFrame, executions: DataFrame) -> DataFrame:
    """Per label of both: processes and CPUs to ask for; more than one and a quarter CPU in a burst asks for its ceiling, else one."""
    s = samples.groupBy("label").agg(F.max("burst_cpu").alias("burst"), F.max("processes").alias("processes"), F.max("peak_memory_bytes").alias("memory"))
    e = executions.groupBy("label").agg(F.sum("cpu_seconds").alias("cpu"), F.sum("wall_seconds").alias("wall"))
    ask = F.when(F.col("burst") > 1.25, F.ceil("burst")).otherwise(1)
    return s.join(e, "label").select("label", "burst", "processes", "memory", F.when(F.col("wall") > 0, F.col("cpu") / F.col("wall")).alias("mean_cpu"), ask.alias("cpus"))


def attempts_verdict(assignments: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per assignment: failed if any attempt failed, else the later attempt's outcome, else missing."""
    per = attempts.groupBy("key").agg(F.bool_or(F.col("outcome") == "failed").alias("failed"), F.max_by("outcome", "attempt").alias("last"))
    return assignments.join(per, "key", "left").select("key", F.when(F.col("failed"), "failed").otherwise(F.coalesce("last", F.lit("missing"))).alias("verdict"))


def latest_artifacts(rows: DataFrame, identity: Sequence[str], order: str, group: Sequence[str], newest: str) -> DataFrame:
    """First the earliest row per identity, then of those the newest per group; ties go by the other columns."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*identity).orderBy(*ordered(rows, identity, order)))).where("nth = 1").drop("nth")
    last = Window.partitionBy(*group).orderBy(F.desc(newest), *ordered(rows, group, newest))
    return first.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def attribution(files: DataFrame, *claims: tuple[str, DataFrame]) -> DataFrame:
    """Bytes and files by owner class: the first of the (class, frame with key) claims that has a file's key, else unattributed."""
    rows, flags = files, []
    for name, frame in claims:
        rows = rows.join(frame.select("key").distinct().withColumn(f"has_{name}", F.lit(True)), "key", "left")
        flags.append(F.when(F.col(f"has_{name}"), name))
    rows = rows.withColumn("owner", F.coalesce(*flags, F.lit("unattributed")))
    return rows.groupBy("owner").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def first_owners(issues: DataFrame, label: str) -> DataFrame:
    """(key, number): per key the lowest-numbered issue(number, pull_request, labels, keys) that names it, has the label and is no pull request."""
    owning = issues.where(F.array_contains("labels", label) & ~F.coalesce("pull_request", F.lit(False)))
    return owning.select("number", F.explode("keys").alias("key")).groupBy("key").agg(F.min("number").alias("number"))


def issue_plans(found: DataFrame, owned: DataFrame, complete: Column) -> DataFrame:
    """Rows of found(key, ...) to open an issue for: none that has an owner, and none of a census that is not known to be complete."""
    return found.where(F.coalesce(complete, F.lit(False))).join(owned.select("key"), "key", "left_anti")


def closed_chains(waiting: DataFrame, blockers: DataFrame, states: DataFrame) -> DataFrame:
    """Of waiting(key, complete) those whose blockers(key, blocker) are fully listed, at least one, and all closed by states(blocker, state); an unknown state is not closed."""
    closed = blockers.join(states, "blocker", "left").groupBy("key").agg(F.bool_and(F.coalesce(F.col("state") == "CLOSED", F.lit(False))).alias("closed"), F.count(F.lit(1)).alias("blockers"))
    return waiting.where(F.coalesce("complete", F.lit(False))).join(closed.where("closed"), "key").select("key", "blockers")


def parent_actions(links: DataFrame, found: DataFrame, receipts: DataFrame) -> DataFrame:
    """(action, issue, target, id, status): what to write, each row held against its review.

    links(key, parent, source, parent_state, root, faults): under a closed parent an issue moves to its open root if the chain
    has no fault, else a parent must be made; a parent named in the text alone becomes a native link; an issue without a
    parent that is no one's parent needs one. found(kind, key, candidate, verified): labels of dead chains go, verified
    fixes close. A proposed row without a receipt(id, reviewed) waits for one, or for its sources to be reviewed.
    """
    parents = links.where("parent IS NOT NULL").select(F.col("parent").alias("key")).distinct().withColumn("has_children", F.lit(True))
    known, sound = F.col("parent_state").isNotNull(), F.coalesce(F.col("faults") == 0, F.lit(False))
    moved = F.coalesce(F.col("root") != F.col("key"), F.lit(False)) & sound
    closed = F.coalesce(F.col("parent_state") == "CLOSED", F.lit(False))
    alone = (F.col("source") == "none") & F.col("has_children").isNull()
    action = F.when(closed, F.when(moved, "reparent").otherwise("create_parent")).when((F.col("source") == "text") & known & sound, "native_sub_issue").when(alone, "link_parent")
    target = F.when(F.col("action") == "reparent", F.col("root")).when(F.col("action") == "native_sub_issue", F.col("parent"))
    proposed = F.when(F.col("action").isin("reparent", "native_sub_issue"), "proposed").otherwise("needs_parent_design")
    linked = links.join(parents, "key", "left").withColumn("action", action).where("action IS NOT NULL")
    rows = linked.select("action", F.col("key").alias("issue"), target.alias("target"), proposed.alias("status"), F.lit(None).cast("string").alias("candidate"))
    act = F.when(F.col("kind") == "dead_blocked_chain", "remove_blocked_labels").when((F.col("kind") == "default_branch_fix") & F.col("verified"), "close")
    acts = found.withColumn("action", act).where("action IS NOT NULL")
    rows = rows.unionByName(acts.select("action", F.col("key").alias("issue"), F.lit(None).cast(links.schema["key"].dataType).alias("target"), F.lit("proposed").alias("status"), "candidate"))
    identity = F.to_json(F.array(F.col("action"), F.col("issue").cast("string"), F.col("target").cast("string")))
    rows = rows.withColumn("id", F.substring(F.sha2(identity, 256), 1, 16))
    held = receipts.select(F.col("id").alias("receipt"), "reviewed")
    rows = rows.join(held, F.coalesce("candidate", "id") == F.col("receipt"), "left")
    waits = F.when(F.col("receipt").isNull(), "needs_hindsight").when(~F.coalesce("reviewed", F.lit(False)), "needs_hindsight_source_review").otherwise("proposed")
    return rows.select("action", "issue", "target", "id", F.when(F.col("status") == "proposed", waits).otherwise(F.col("status")).alias("status"))
