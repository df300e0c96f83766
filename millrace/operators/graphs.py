"""Graphs as edge tables: closures, components, cycles, parents and flow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def _settled(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut in the checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every dst that a path of one edge or more reaches from src.

    Semi-naive: each round joins only the pairs found last with the edges, and drops those known before.
    """
    edges = _settled(edges.select("src", "dst").distinct())
    known = fresh = edges
    while True:
        step = fresh.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        fresh = _settled(step.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = _settled(known.unionByName(fresh))


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that a path reaches from any of seeds(node), the seeds included, with the fewest steps."""
    edges = edges.select("src", "dst").distinct()
    known = fresh = _settled(seeds.select("node").distinct().withColumn("steps", F.lit(0)))
    n = 0
    while True:
        n += 1
        step = fresh.join(edges, fresh.node == edges.src).select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti").withColumn("steps", F.lit(n))
        fresh = _settled(step)
        if fresh.isEmpty():
            return known
        known = _settled(known.unionByName(fresh))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of nodes on a cycle, the component named by its smallest node. Self-loops alone make no component.

    Each round every node takes the smallest node that reaches it as its colour; of a colour, the nodes that reach the node
    it is named by are that node's component. They leave the graph, with edges between colours and nodes that lack an edge in
    or out, and the rest goes on. Tables hold a row per node or edge, never a row per pair that a path joins.
    """
    left = _settled(edges.where("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        while True:  # a node on a cycle has edges both ways
            trimmed = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            trimmed = _settled(trimmed.select("src", "dst"))
            same = trimmed.count() == left.count()
            left = trimmed
            if same:
                break
        if left.isEmpty():
            break
        colour = _settled(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            offers = left.join(colour, left.src == colour.node).select(F.col("dst").alias("node"), "colour").unionByName(colour)
            after = _settled(offers.groupBy("node").agg(F.min("colour").alias("colour")))
            stable = after.join(colour.withColumnRenamed("colour", "was"), "node").where("colour <> was").isEmpty()
            colour = after
            if stable:
                break
        of = lambda side: colour.select(F.col("node").alias(side), F.col("colour").alias(f"c_{side}"))
        inside = _settled(left.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst"))
        known = fresh = _settled(colour.where("node = colour"))
        while not fresh.isEmpty():
            step = inside.join(fresh, inside.dst == fresh.node).select(F.col("src").alias("node"), "colour").distinct()
            fresh = _settled(step.join(known, "node", "left_anti"))
            known = _settled(known.unionByName(fresh))
        found = known if found is None else found.unionByName(known)
        gone = known.select("node")
        left = _settled(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return left.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size"))
    sizes = found.groupBy("colour").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return found.join(sizes, "colour").select("node", F.col("colour").alias("component"), "size")


def cycle_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges inside a component."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("ca"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    return edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("component"))


def causing_edges(edges: DataFrame, start: DataFrame, target: DataFrame) -> DataFrame:
    """Edges on any path from a start to a target: both ends lie in the forward reach and in the backward reach."""
    forward = reach(edges, start).select("node")
    backward = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), target).select("node")
    on = forward.join(backward, "node", "left_semi")
    return edges.join(on.withColumnRenamed("node", "src"), "src", "left_semi").join(on.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) by smallest labels with pointer jumping."""
    both = _settled(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = _settled(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        offers = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), "label").unionByName(labels)
        least = offers.groupBy("node").agg(F.min("label").alias("label"))
        hop = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = _settled(least.join(hop, "label").select("node", F.least("label", "further").alias("label")))
        if after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            return after.withColumnRenamed("label", "component")
        labels = after


def roots(parents: DataFrame) -> DataFrame:
    """(node, root, depth, cyclic) of parents(node, parent): the top of each node's chain, or the smallest node of the cycle it runs into.

    A root is its own ancestor at distance 0, and a parent that is no node is a root. Each round doubles the steps up, until none
    moves; once they exceed the number of nodes, an ancestor that is no root lies on a cycle.
    """
    tops = parents.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct().join(parents, "node", "left_anti")
    rows = parents.select("node", "parent").unionByName(tops.select("node", F.lit(None).cast(dict(parents.dtypes)["parent"]).alias("parent")))
    up = _settled(rows.select("node", F.coalesce("parent", "node").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"), F.least("node", "parent").alias("least")))
    for _ in range(up.count().bit_length()):
        far = up.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("least").alias("least2"))
        moved = _settled(up.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.least("least", "least2").alias("least"), (F.col("depth2") > 0).alias("moved")))
        up = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    end = up.select(F.col("node").alias("up"), F.col("depth").alias("end_depth"), F.col("least").alias("end_least"))
    cyclic = F.col("end_depth") > 0
    out = up.join(end, "up").select("node", F.when(cyclic, F.col("end_least")).otherwise(F.col("up")).alias("root"), F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic"))
    return out.join(parents.select("node"), "node", "left_semi")


def open_ancestors(issues: DataFrame) -> DataFrame:
    """(node, root, cyclic, incomplete, ambiguous, unknown) of issues(node, parent, open, complete, refs): the top open issue of each one's chain of parents.

    Itself counts, and where no issue on the chain is open it is its own root; a chain that runs into a cycle with open
    members has the smallest of these. incomplete, ambiguous and unknown count the issues on the chain whose metadata is incomplete, whose text names several
    parents, and whose parent is no issue. Each round doubles the steps up.
    """
    known = issues.select(F.col("node").alias("parent")).withColumn("known", F.lit(True))
    rows = issues.join(known, "parent", "left").select(
        "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.when(F.col("open"), F.col("node")).alias("top"), F.when(F.col("open"), F.col("node")).alias("least"),
        (~F.coalesce("complete", F.lit(True))).cast("long").alias("incomplete"), (F.size(F.coalesce("refs", F.array().cast("array<bigint>"))) > 1).cast("long").alias("ambiguous"), (F.col("parent").isNotNull() & F.col("known").isNull()).cast("long").alias("unknown"),
    )
    counts = ("incomplete", "ambiguous", "unknown")
    cyclic = roots(issues.select("node", F.col("parent"))).select("node", F.col("root").alias("loop"), "cyclic")
    onward = _settled(rows.join(cyclic, "node"))
    # nodes on a cycle end the chains that run into it
    on_cycle = _settled(onward.where("cyclic").select(F.col("node").alias("src"), F.col("up").alias("dst")))
    members = strong_components(on_cycle).select("node", "component").unionByName(on_cycle.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")))
    least = members.join(onward.select("node", "least", *counts), "node").groupBy("component").agg(F.min("least").alias("ring_least"), *[F.sum(c).alias(f"ring_{c}") for c in counts])
    ring = members.join(least, "component").drop("component")
    up = onward.join(ring, "node", "left")
    in_ring = F.col("ring_incomplete").isNotNull()
    up = _settled(up.select("node", F.when(~in_ring, F.col("up")).alias("up"), F.when(in_ring, F.coalesce("ring_least", "top")).otherwise(F.col("top")).alias("top"), "cyclic", *[F.coalesce(f"ring_{c}", c).alias(c) for c in counts]))
    for _ in range(up.count().bit_length()):
        far = up.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), *[F.col(c).alias(f"{c}2") for c in counts])
        up = _settled(up.join(far, "up", "left").select("node", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), "cyclic", *[(F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in counts]))
        if up.where("up IS NOT NULL").isEmpty():
            break
    return up.select("node", F.coalesce("top", "node").alias("root"), "cyclic", *counts)


def chosen_parent(nodes: DataFrame) -> DataFrame:
    """nodes(node, native, refs): the native parent, else the only one that the text names; several are ambiguous."""
    refs = F.array_distinct(F.coalesce("refs", F.array().cast("array<bigint>")))
    return nodes.select("node", F.coalesce("native", F.when(F.size(refs) == 1, F.get(refs, F.lit(0)))).alias("parent"), (F.col("native").isNull() & (F.size(refs) > 1)).alias("ambiguous"))


def import_owners(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports(file, name) resolved to the module of the longest dotted prefix of name that modules(module) has."""
    parts = F.split("name", r"\.")
    wide = imports.select("file", "name", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).withColumn("module", F.array_join(F.slice(F.split("name", r"\."), F.lit(1), F.col("n")), "."))
    return wide.join(modules.select("module"), "module").groupBy("file", "name").agg(F.max_by("module", "n").alias("module"))


def impacted(map_: DataFrame, changed: DataFrame, rules: DataFrame) -> DataFrame:
    """Tests of map_(test, function) that a changed(function) concerns, and those that rules(test, reason) add, with all reasons."""
    direct = map_.join(changed, "function").select("test", F.concat(F.lit("runs "), F.col("function")).alias("reason"))
    return direct.unionByName(rules.select("test", "reason")).groupBy("test").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))


def inherited(users: DataFrame, base: DataFrame) -> DataFrame:
    """New files and the package whose base consumers include all of theirs: users(file, consumer), base(package, consumer)."""
    need = users.groupBy("file").agg(F.collect_set("consumer").alias("need"))
    n = users.distinct().join(base.distinct(), "consumer").groupBy("file", "package").agg(F.count(F.lit(1)).alias("n"))
    return n.join(need, "file").where(F.col("n") == F.size("need")).groupBy("file").agg(F.min("package").alias("package"))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges(range, readers, cap) with equal readers as one, capacities summed."""
    return ranges.groupBy(F.array_sort("readers").alias("readers")).agg(F.sum("cap").alias("cap"), F.min("range").alias("range"))


def joint_need(needs: DataFrame, reach_: DataFrame, caps: DataFrame) -> DataFrame:
    """Per tier the largest part of its windows' needs that ranges can serve: a maximum flow from needs(tier, window, need) over
    reach_(tier, window, range) to caps(tier, range, cap). One tier's network, a row per link, is solved in one task."""
    links = (
        needs.select("tier", F.lit("need").alias("kind"), F.col("window").cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col("need").cast("long").alias("n"))
        .unionByName(reach_.select("tier", F.lit("reach").alias("kind"), F.col("window").cast("string").alias("a"), F.col("range").cast("string").alias("b"), F.lit(None).cast("long").alias("n")))
        .unionByName(caps.select("tier", F.lit("cap").alias("kind"), F.lit(None).cast("string").alias("a"), F.col("range").cast("string").alias("b"), F.col("cap").cast("long").alias("n")))
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import defaultdict, deque

        room: dict = defaultdict(lambda: defaultdict(int))
        total = 0
        for kind, a, b, n in zip(pdf["kind"], pdf["a"], pdf["b"], pdf["n"]):
            if kind == "need":
                room["source"]["w", a] += int(n)
                total += int(n)
            elif kind == "cap":
                room["r", b]["sink"] += int(n)
        for kind, a, b in zip(pdf["kind"], pdf["a"], pdf["b"]):
            if kind == "reach":
                room["w", a]["r", b] += total
        flow = 0
        while True:
            came, todo = {"source": None}, deque(["source"])
            while todo and "sink" not in came:
                u = todo.popleft()
                for v, left in list(room[u].items()):
                    if left > 0 and v not in came:
                        came[v] = u
                        todo.append(v)
            if "sink" not in came:
                return pd.DataFrame({"tier": [pdf["tier"].iloc[0]], "need": [total], "served": [flow]})
            path, v = [], "sink"
            while came[v] is not None:
                path.append((came[v], v))
                v = came[v]
            push = min(room[u][v] for u, v in path)
            for u, v in path:
                room[u][v] -= push
                room[v][u] += push
            flow += push

    return links.groupBy("tier").applyInPandas(solve, f"tier {dict(needs.dtypes)['tier']}, need long, served long")
