import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import predicates as P
from millrace.functions import scalars as C
from millrace.functions import sources as S
from millrace.operators import aggregates as A
from millrace.operators import graphs as G
from millrace.operators import joins as J
from millrace.operators import ledger as L
from millrace.operators import metrics as M
from millrace.operators import sets
from millrace.operators import similarity as K
from millrace.operators import windows as W


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_numbers(spark):
    r = one(
        spark, C.finite(F.lit("1e400")), C.finite(F.lit("nan")), C.finite(F.lit("2.5")), C.json_number(F.lit('{"a": true}'), "$.a"), C.json_number(F.lit('{"a": 3}'), "$.a"), C.nonnegative(F.lit("-1")), C.integral(F.lit("1.0")), C.integral(F.lit("17")),
        C.capacity_gib(F.lit(9.7), F.lit(5 << 30), F.lit(1 << 30), F.lit(0), F.lit(0)), C.external_bytes(F.lit(5), F.lit(3), F.lit(4)), C.remainder(F.lit(5), F.lit(2)), C.first_int(F.lit('{"a": "x", "b": -3}'), "$.a", "$.b"),
    )
    assert list(r) == [None, None, 2.5, None, 3.0, None, None, 17, 4, 0, 3, -3]
    with pytest.raises(Exception):
        one(spark, C.remainder(F.lit(-1), F.lit(2)))


def test_texts(spark):
    r = one(
        spark, C.priority(F.array(F.lit("bug"), F.lit("P1")), F.lit("[p0] x"), ["P0", "P1"]), C.priority(F.array(F.lit("bug")), F.lit("[p0] x"), ["P0", "P1"]), C.references(F.lit("a #3 #4 #3")), C.literal_text(F.lit("a\n*b*")),
        C.utc_timestamp(F.lit("2024-01-01T00:00:00")), F.unix_seconds(C.utc_timestamp(F.lit("2024-01-01T01:00:00+01:00"))), C.package_of(F.lit("//a/b:c")), C.package_of(F.lit("x/y/z.py")), C.normal_strings(F.array(F.lit(" b"), F.lit("a"), F.lit(""), F.lit("b"))),
        C.allowed_view(F.lit('{"a": {"b": 1, "z": 2}, "z": 3}'), ["a", "b"]), C.ascii_json(F.lit('{"é": 1, "a": [1, 2]}')), C.ascii_json(F.lit('{"b": 1, "a": 2}'), spaced=True), C.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"), c=F.lit('x"')),
    )
    assert list(r) == ["P1", "P0", [3, 4], r"a \*b\*", None, 1704067200, "a/b", "x/y", ["a", "b"], '{"a":{"b":1}}', '{"a":[1,2],"\\u00e9":1}', '{"a": 2, "b": 1}', '{"a":null,"b":1,"c":"x\\""}']


def test_maps_and_nested(spark):
    r = spark.sql("SELECT map('a', 5, 'b', 1) need, map('a', 2, 'b', 1) have, map('x', named_struct('v', 1, 'denied', 2)) docs, array(named_struct('kind', 'k', 'window', 3), named_struct('kind', 'z', 'window', 0)) kinds").select(
        C.funded_remainder(F.col("need"), F.col("have")), C.without_fields(F.col("docs"), "denied"), C.owner_terms(F.col("kinds"), F.lit("t")), P.never_fits(F.col("need"), F.col("have")), P.room_fits(F.col("have"), F.col("need")),
        P.fits_measured(F.col("have"), F.col("need"), F.lit(None).cast("map<string,int>")), P.fits_measured(F.col("have"), F.col("need"), F.lit(None).cast("map<string,int>"), ledger=True),
    ).first()
    assert r[0] == {"a": 3} and r[1]["x"].asDict() == {"v": 1} and r[2] == {"k@t": 3} and r[3] and r[4] and not r[5] and r[6]


def test_three_valued(spark):
    tags = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    r = one(
        spark, P.placement(tags("a"), tags("a", "b"), F.lit(True), F.lit(None).cast("boolean")), P.placement(tags(), tags(), F.lit(False), F.lit(None).cast("boolean")), P.present(tags("a"), tags("b"), F.lit(True)), P.present(tags("a"), tags("b"), F.lit(False)), P.present(tags("a"), tags("a"), F.lit(False)),
        P.fence_fits(F.lit(1), F.lit(1), F.lit(1), F.lit(None).cast("int")), P.topic_filter(F.lit("a,b")), P.topic_filter(F.lit("a,B")), P.fresh(F.lit(10), F.lit(11), 5.0),
    )
    assert list(r) == [False, True, False, None, True, False, ["a", "b"], None, False]


def test_manifest_faults(spark):
    entries = spark.createDataFrame([("m", 0, "p", 0, 5), ("m", 1, "p", 0, 7), ("m", 2, "q", 0, 1), ("ok", 0, "p", 0, 5), ("ok", 1, "q", 0, 6)], "manifest string, idx int, path string, offset int, bytes long")
    phases = spark.createDataFrame([("m", 0, [0, 1], 99), ("ok", 0, [0], 5), ("ok", 1, [1], 11)], "manifest string, phase int, indices array<int>, cumulative long")
    totals = spark.createDataFrame([("m", 3, 12), ("ok", 2, 11), ("none", 0, 0)], "manifest string, entry_count int, total_bytes long")
    assert {(r.manifest, r.fault) for r in P.manifest_faults(entries, phases, totals).collect()} == {("m", f) for f in ("duplicate entry", "totals", "unread entry", "cumulative")}


def test_ranges_round_trip(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(40)) for g in range(5) for _ in range(15)]
    got = C.as_ranges(spark.createDataFrame(rows, "g int, n int"), ["g"], "n").withColumn("back", C.parse_ranges(F.col("ranges"))).collect()
    assert {r.g: r.back for r in got} == {g: sorted({n for h, n in rows if h == g}) for g in range(5)}


def test_roots_and_cycles(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 6), (6, 4), (7, 4), (8, 8), (9, 77)]
    got = {r.node: (r.root, r.depth, r.cyclic) for r in G.roots(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (1, 2, False), 4: (4, None, True), 5: (4, None, True), 6: (4, None, True), 7: (4, None, True), 8: (8, None, True), 9: (77, 1, False)}


def test_graphs_by_brute_force(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(16)}
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    assert {tuple(r) for r in G.closure(df).collect()} == reach
    comp = {n: min([n] + [m for m in range(12) if (n, m) in reach and (m, n) in reach]) for n in range(12) if any((n, m) in reach and (m, n) in reach and m != n for m in range(12))}
    assert {r.node: r.component for r in G.strong_components(df).collect()} == comp
    ends = set(itertools.chain(*edges))
    near = {n: n for n in ends}
    for _ in ends:
        for a, b in edges:
            near[a] = near[b] = min(near[a], near[b])
    assert {r.node: r.component for r in G.connected(df).collect()} == near
    empty = df.limit(0)
    assert G.closure(empty).count() == G.strong_components(empty).count() == G.connected(empty).count() == 0


def test_joint_need_is_a_maximum_flow(spark):
    rng = random.Random(3)
    needs = [(0, w, rng.randrange(1, 9)) for w in range(4)]
    caps = [(0, r, rng.randrange(0, 9)) for r in range(5)]
    links = sorted({(0, rng.randrange(4), rng.randrange(5)) for _ in range(9)})
    best = min(sum(n for _, w, n in needs if w not in cut) + sum(c for _, r, c in caps if any((0, w, r) in links for w in cut)) for k in range(5) for cut in itertools.combinations(range(4), k))
    got = G.joint_need(spark.createDataFrame(needs, "tier int, window int, need int"), spark.createDataFrame(links, "tier int, window int, range int"), spark.createDataFrame(caps, "tier int, range int, cap int")).first()
    assert (got.need, got.served) == (sum(n for _, _, n in needs), best)


def test_parents_imports_and_inheritance(spark):
    nodes = spark.createDataFrame([(1, 9, [2]), (2, None, [3, 3]), (3, None, [1, 2]), (4, None, None)], "node long, native long, refs array<long>")
    assert {r.node: (r.parent, r.ambiguous) for r in G.chosen_parent(nodes).collect()} == {1: (9, False), 2: (3, False), 3: (None, True), 4: (None, False)}
    imports, modules = spark.createDataFrame([("f", "a.b.c"), ("g", "x")], "file string, name string"), spark.createDataFrame([("a",), ("a.b",)], "module string")
    assert {tuple(r) for r in G.import_owners(imports, modules).collect()} == {("f", "a.b.c", "a.b")}
    users, base = spark.createDataFrame([("n", "c1"), ("n", "c2"), ("m", "c9")], "file string, consumer string"), spark.createDataFrame([("p", "c1"), ("p", "c2"), ("q", "c1")], "package string, consumer string")
    assert [tuple(r) for r in G.inherited(users, base).collect()] == [("n", "p")]
    assert G.merged_ranges(spark.createDataFrame([(1, ["b", "a"], 2), (2, ["a", "b"], 3)], "range int, readers array<string>, cap int")).first().cap == 5


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(4)
    base = [[f"t{rng.randrange(500)}" for _ in range(120)] for _ in range(12)]
    texts = base + [b[:60] + ["x"] + b[61:] for b in base[:5]] + [base[0], base[0]] + [["few"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None)], "i int, t string").select("i", K.shingles(K.tokens(F.coalesce("t", F.lit("")))).alias("g"))
    grams = {r.i: set(r.g) for r in df.collect()}
    pairs = {(r.a, r.b) for r in K.near_duplicates(df, "i", "g", 0.85).collect()}
    found = {frozenset(p) for p in pairs}
    alike = {frozenset((a, b)) for a in grams for b in grams if a < b and grams[a] and len(grams[a] & grams[b]) >= 0.85 * len(grams[a] | grams[b])}
    assert found <= alike
    copies = {0, 17, 18}
    rest = {p for p in alike if len(p & copies) < 2 and not p & (copies - {0})}
    assert rest <= found and {frozenset((0, 17)), frozenset((0, 18))} <= found


def test_alike_titles_meet_whatever_their_first_word_and_length(spark):
    """Against every pair: titles that differ in the first word, in length across tens, in marks, case and punctuation."""
    import difflib
    import random
    import re

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9)))
    titles = ["Worker holds its lease while the host drains", "A Worker holds its lease while the host drains", "[P1] worker: holds its LEASE while the host drains!", "[P9] Worker holds its lease", "", None, "ÄÖ — ß", "äö ß"]
    for _ in range(60):
        base = " ".join(word() for _ in range(rng.randrange(4, 14)))
        titles.append(base)
        for _ in range(rng.randrange(4)):
            t = list(base)
            for _ in range(rng.randrange(1, 7)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = rng.choice("aeiou xyz")
            titles.append("".join(t))
    plain = [re.sub(r"\W+", " ", re.sub(K.TITLE_MARK, "", t or "").lower()).strip() for t in titles]
    root = list(range(len(titles)))
    for i in range(len(titles)):
        for j in range(i + 1, len(titles)):
            a, b = plain[i], plain[j]
            if a and b and (a == b or (min(len(a), len(b)) >= 30 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92)):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    expected = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert len(expected) > 30 and {0, 1, 2} <= set(expected)
    got = K.title_clusters(spark.createDataFrame(list(enumerate(titles)), "k int, t string").repartition(4), "k", "t")
    assert {r.node: r.component for r in got.collect()} == expected


def test_alike_titles_over_many_tiles(spark):
    """Against every pair, in tiles of 8 to all: lengths around a number's 64 places and beyond 200 (where the ratio has junk), letters of four bytes, turned words, a null rep."""
    import difflib

    rng = random.Random(7)
    titles = []
    for n in (12, 31, 62, 66, 130, 230):
        for _ in range(7):
            base = "".join(rng.choice("abcdefgh éß𝒳𝒴") for _ in range(n))
            titles.append(base)
            for edits in (1, n // 25, n // 12, n // 9):
                t = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(t))
                    t[at : at + rng.randrange(2)] = rng.choice("abc𝒳")
                titles.append("".join(t))
            titles.append(base[n // 2 :] + base[: n // 2])
    titles = list(dict.fromkeys(titles))
    root = list(range(len(titles)))
    for i in range(len(titles)):
        for j in range(i + 1, len(titles)):
            a, b = titles[i], titles[j]
            if 2 * min(len(a), len(b)) >= 0.92 * (len(a) + len(b)) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    expected = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert len(expected) > 80
    reps = spark.createDataFrame([*enumerate(titles), (None, titles[0] + "a")], "rep int, t string")
    for tile in (8, 40, None):
        assert {r.node: r.component for r in G.connected(K.alike_titles(reps, 0.92, tile)).collect()} == expected
    assert K.alike_titles(reps.limit(0), 0.92).count() == 0


def test_a_family_of_alike_titles_makes_no_row_per_pair(spark):
    titles = [(i, f"the worker of shard {i:04d} lost its lease while the host drained") for i in range(300)]
    reps = spark.createDataFrame(titles, "rep int, t string")
    edges = K.alike_titles(reps, 0.92)
    assert edges.count() == 299 and {r.component for r in G.connected(edges).collect()} == {0}


def test_open_ancestors(spark):
    """Chains, cycles with and without open members, unknown parents, against a walk."""
    import random

    rng = random.Random(2)
    rows = [(i, None if rng.random() < 0.2 else rng.randrange(70), rng.random() < 0.5, rng.random() < 0.9, [1, 2] if rng.random() < 0.2 else []) for i in range(60)]
    by = {r[0]: r for r in rows}
    expected = {}
    for i in by:
        path, cur, root = [], i, i
        cyclic = False
        while cur in by:
            if cur in path:
                ring = [k for k in path[path.index(cur):] if by[k][2]]
                root, cyclic = (min(ring) if ring else root), True
                break
            path.append(cur)
            if by[cur][2]:
                root = cur
            if by[cur][1] is None:
                break
            cur = by[cur][1]
        expected[i] = (root, cyclic, sum(not by[k][3] for k in path), sum(len(by[k][4]) > 1 for k in path), sum(by[k][1] is not None and by[k][1] not in by for k in path))
    got = G.open_ancestors(spark.createDataFrame(rows, "node long, parent long, open boolean, complete boolean, refs array<bigint>"))
    assert {r.node: (r.root, r.cyclic, r.incomplete, r.ambiguous, r.unknown) for r in got.collect()} == expected


def test_title_clusters(spark):
    rows = [(1, "Worker loses its lease after a clock step"), (2, "worker loses its lease after a clock steps"), (3, "Other"), (4, " other"), (5, "Worker of another kind entirely and long")]
    assert {r.node: r.component for r in K.title_clusters(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_folds_keep_what_they_are_given(spark):
    rng = random.Random(5)
    rows = [(g, i, float(rng.randrange(1, 90))) for g in range(20) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "g int, i int, s double")
    for r in W.chunks(df, ["g"], ["i"], "s", 60.0).collect():
        mine = [s for g, _, s in rows if g == r.g]
        assert sum(r.sizes) == sum(mine) and all(x <= 60 or x in mine for x in r.sizes)
    assert {r.g: r.sizes for r in W.chunks(df, ["g"], ["i"], "s", 60.0).collect()} == {r.g: r.sizes for r in W.chunks(df.orderBy(F.rand(1)), ["g"], ["i"], "s", 60.0).collect()}
    shards = W.lpt_shards(df, ["g"], "i", "s", 3).collect()
    for g in range(20):
        assert sum(r.load for r in shards if r.g == g) == sum(s for h, _, s in rows if h == g)
    assert W.chunks(df.limit(0), ["g"], ["i"], "s", 60.0).count() == 0


def test_journal_ties_and_states(spark):
    e = spark.createDataFrame([("a", 1, "p", 5), ("a", 2, "r", 6), ("a", 3, "x", None), ("b", 1, "r", 7)], "k string, n int, kind string, lease int")
    got = {r.k: (r.lease, r.in_effect, r.valid) for r in W.journal(e, ["k"], ["n"], "p", "r", "x").collect()}
    assert got == {"a": (6, False, True), "b": (7, True, False)}
    rows = spark.createDataFrame([("a", 2.0, "ok"), ("a", 2.0, "bad"), ("b", None, "ok"), ("b", 1.0, "bad")], "k string, g double, s string")
    got = {r.k: (r.s, r.ambiguous) for r in W.newest(rows, ["k"], "g", F.col("s") == "bad").collect()}
    assert got == {"a": ("bad", True), "b": ("bad", False)}
    ph = spark.createDataFrame([("m", 0, [1, 0]), ("m", 1, [1])], "m string, pos int, indices array<int>")
    en = spark.createDataFrame([("m", 0, "a"), ("m", 1, "b")], "m string, idx int, path string")
    assert [r.path for r in W.read_order(ph, en, "m").orderBy("read_no").collect()] == ["b", "a", "b"]
    assert W.deadlines(spark.createDataFrame([(3, None), (None, None)], "a int, b int"), "a", "b").orderBy(F.desc("deadline")).collect()[0].deadline == 3


def test_joins(spark):
    roster = spark.createDataFrame([("h1", ["a", "b"]), ("h2", ["b", "h1"])], "name string, aliases array<string>")
    hosts = spark.createDataFrame([("h1",), ("a",), ("b",), ("z",)], "host string")
    assert {r.host: (r.name, r.ambiguous) for r in J.roster_entry(hosts, roster).collect()} == {"h1": ("h1", False), "a": ("h1", False), "b": (None, True), "z": (None, False)}
    assert {r.alias for r in J.shared_aliases(roster).collect()} == {"b", "h1"}
    old, new = spark.createDataFrame([("f", "1"), ("g", "2"), ("h", "3")], "name string, body string"), spark.createDataFrame([("f", "9"), ("k", "2"), ("n", "7")], "name string, body string")
    assert {(r.name, r.was, r.change) for r in J.renamed_functions(old, new).collect()} == {("f", None, "changed"), ("k", "g", "renamed"), ("n", None, "added"), ("h", None, "deleted")}
    members = spark.createDataFrame([(1, "h1", "ready"), (1, "h2", "claimed"), (2, "h1", "ready"), (2, "h1", "ready"), (3, "h3", "ready")], "group int, host string, state string")
    offers = spark.createDataFrame([("h1", 100.0), ("h3", 1.0)], "host string, announced_unix double")
    assert {r.group: r.ready for r in J.siblings_ready(members, offers, 105.0, 10.0).collect()} == {1: True, 2: False, 3: False}
    h = spark.createDataFrame([("x",)], "key string")
    assert J.dangling(h, h.limit(0), True).count() == 1 and J.dangling(h, h.limit(0), False).count() == 0


def test_interval_join_on_fractions(spark):
    """Ends less than 1 beyond a bucket's border, ends on it, empty and negative spans, nulls, against every pair."""
    points = [-100.5, -100.0, -0.25, 0.0, 99.5, 99.99, 100.0, 100.25, 199.99, 200.0, None]
    spans = [(50.0, 100.5), (50.0, 100.0), (99.99, 100.26), (-150.0, -99.75), (-1.0, 200.01), (100.0, 100.0), (120.0, 80.0), (None, 1.0), (1.0, None)]
    p, s = spark.createDataFrame(list(enumerate(points)), "i int, x double"), spark.createDataFrame([(k, *v) for k, v in enumerate(spans)], "k int, lo double, hi double")
    got = [(r.k, r.i) for r in J.interval_join(p, "x", s, "lo", "hi", 100).collect()]
    assert sorted(got) == [(k, i) for k, (lo, hi) in enumerate(spans) for i, x in enumerate(points) if None not in (lo, hi, x) and lo <= x < hi]


def test_aggregates(spark):
    ns = spark.createDataFrame([("g", "s", 5), ("g", "s", 7), ("g", None, 1), ("g", None, 1)], "g string, space string, v int")
    assert A.deduplicated_sum(ns.withColumnRenamed("space", "ns"), "g", "ns", "v").first().v == 9
    legs = spark.createDataFrame([("ok",), ("mystery",)], "result string")
    assert A.worst_verdict(legs, [("bad", 1), ("ok", 0)]).first().exit == 2
    e = spark.createDataFrame([("a", "s", 10), ("a", "e", 5), ("a", "e", 30), ("b", "s", 1), ("b", "s", 2), ("c", "e", 4)], "k string, kind string, at long")
    got = {r.k: (r.seconds, r.right_censored, r.left_censored, r.retries) for r in A.censored(e, "k", "s", "e", F.lit(1_000_001).cast("long")).collect()}
    assert got["a"] == (20e-6, False, True, 0) and got["b"] == (1.0, True, False, 1) and got["c"][2] is True
    w = A.window_summary(spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 3.0), ("b", 1, None)], "g string, n int, v double"), ["g"], "v", ["n"]).orderBy("g").collect()
    assert [(r.n, r.skipped, r.last) for r in w] == [(1, 1, 3.0), (0, 1, None)]


def test_ledger(spark):
    t = spark.createDataFrame([("k", 1, None), ("k", 2, "h"), ("k", 3, None)], "kind string, n int, holder string")
    d = lambda n: spark.createDataFrame([("k", n)], "kind string, need int")
    holders = lambda df: [r.holder for r in df.orderBy("n").collect()]
    assert holders(L.take(t, d(2), "me")) == ["me", "h", "me"] and holders(L.take(t, d(3), "me")) == [None, "h", None]
    assert holders(L.handover(t, "h", "z", spark.createDataFrame([("k", 2), ("k", 1)], "kind string, n int"))) == [None, "z", None]
    assert holders(L.release_unspent(t, "h", spark.createDataFrame([("k", 0)], "kind string, keep int"))) == [None, None, None]
    assert holders(L.reclaim_idle(t, spark.createDataFrame([("h",)], "holder string"))) == [None, None, None]
    assert tuple(L.token_counts(t).first()) == ("k", 3, 2, 1)


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x", 9), (2, "y", 8)], "n int, v string, at int"), spark.createDataFrame([(1, "x", 1), (2, "z", 1)], "n int, v string, at int")
    assert {(r.n, r.v, r.side) for r in sets.same_sequence(a, b, "n", "at").collect()} == {(2, "y", "a"), (2, "z", "b")}
    assert sets.subset_faults(a, a).count() == 0 and sets.merged_edges(a, a).count() == 2


def test_metrics_absent_is_not_zero(spark):
    s = spark.createDataFrame(
        [("h", 1, "n", "n", 95.0, 10.0, 5.0, 7, 1, 4.0, 90.0), ("h", 2, "n", "other", 95.0, 1.0, 1.0, 9, 1, None, None), ("g", 3, "n", "n", 99.0, 3.0, 2.0, 5, 2, 1.0, 97.0)],
        "host string, claim int, nonce string, expected_nonce string, sampled_unix double, cpu_s double, wall_s double, memory_peak int, io_read int, prev_cpu_s double, prev_unix double",
    )
    got = {(r.name, r.labels["host"], r.labels.get("resource")): r.value for r in M.telemetry(s, 100.0, 30.0).collect()}
    assert ("attempt_observed_resources", "h", "cpu_cores") not in got and got["attempt_observed_resources", "g", "cpu_cores"] == 1.5
    assert got["attempt_telemetry_unavailable_jobs", "h", None] == 1 and got["attempt_recent_cores", "h", None] == 1.2 and got["attempt_peak_resources", "h", "memory_peak_bytes"] == 7
    adm = {r.name: r.value for r in M.admission(spark.createDataFrame([("h", "gpu", 90.0, "plateau")], "host string, resource string, sampled_unix double, status string"), 100.0).collect()}
    assert adm == {"admission_evidence_age_seconds": 10.0, "admission_plateau": 1.0}


def test_tier_metrics(spark):
    value = lambda m, name, **labels: [r.value for r in m.where(F.col("name") == name).collect() if labels.items() <= r.labels.items()]
    t = M.tiers(spark.createDataFrame([("t", 1, 5.0, 1.0), ("t", 2, 3.0, 2.0)], "tier string, at int, rate double, probe double"), spark.createDataFrame([("t", "gib", 10, 4)], "tier string, resource string, capacity int, available int"))
    assert value(t, "tier_fill_supply_mb_s", stat="best") == [5.0] and value(t, "tier_fill_supply_mb_s", stat="ceiling") == [3.0] and value(t, "tier_tokens", state="held") == [6.0]
    mv = M.movers(spark.createDataFrame([("ready", None, True), ("ready", "a", False)], "state string, tier string, moves boolean"), spark.createDataFrame([("a",)], "tier string"))
    assert value(mv, "mover_queue_depth_tier", tier="a", state="ready") == [0.0] and value(mv, "mover_queue_depth_tier", tier="unknown") == [1.0]
    st = M.starvation(spark.createDataFrame([("a", 10.0), ("b", 99.0)], "tier string, last_progress_unix double"), 100.0, 30.0)
    assert value(st, "starvation_waiting_quiet_max_seconds", tier="a") == [90.0] and not value(st, "starvation_waiting_consumers", tier="b")
    plans, states = spark.createDataFrame([(1, "a", "c1"), (2, "a", "c2")], "plan int, tier string, consumer string"), spark.createDataFrame([("c1", "claimed")], "key string, state string")
    phases = spark.createDataFrame([(1, "a", "stage", 0, 1, True, 5), (1, "a", "stage", 2, 1, False, 7), (1, "a", "stage", 3, 1, None, 9)], "plan int, tier string, leg string, pos int, cursor int, published boolean, bytes int")
    rs = M.residency(plans, states, phases)
    assert value(rs, "residency_plans", state="absent") == [1.0] and value(rs, "residency_unstaged_bytes") == [7.0] and value(rs, "residency_staged_phases") == [1.0]
    rc = M.moves(spark.createDataFrame([("a", 90.0, True, 100, 80, 2.0), ("a", 95.0, True, 100, 10, 1.0), ("a", 1.0, True, 1, 1, 1.0)], "tier string, filed_unix double, readable boolean, staged int, pool_read int, seconds double"), 100.0, 50.0)
    assert value(rc, "tier_move_jobs") == [2.0] and value(rc, "tier_move_measured_jobs") == [1.0] and value(rc, "tier_move_pool_rate_mb_s", stat="best") == [4e-05] and value(rc, "tier_move_window_complete") == [1.0]
    rel = M.release_events(spark.createDataFrame([("h", 90.0, True), ("h", 95.0, False)], "held_by string, released_unix double, readable boolean"), 100.0, 50.0)
    assert value(rel, "unstarted_release_events", host="h") == [1.0] and value(rel, "unstarted_release_events_complete") == [0.0]
    assert value(M.box_windows(spark.createDataFrame([("h", "m", "s", 1.0), ("h", "m", "s", 4.0)], "host string, metric string, scope string, value double")), "terminal_box_window") == [4.0]
    co = M.collection(spark.createDataFrame([(True,), (False,)], "readable boolean"), spark.createDataFrame([("listed", 4)], "kind string, n int"))
    assert value(co, "collection_success") == [0.0] and value(co, "scrape_reads", kind="listed") == [4.0]


def test_dashboard(spark):
    m = M.gauges(spark.createDataFrame([("a", "used", 2.0), ("b", "used", 3.0), ("b", "free", 4.0)], "host string, dimension string, v double"), {"ram": "v"}, "host", "dimension")
    assert {r.host: r.value for r in M.by(M.select(m, "ram", {"dimension": "used"}), "host", scale=10).collect()} == {"a": 20.0, "b": 30.0}
    assert M.select(m, "ram", unlike={"dimension": "fr.*"}).count() == 2 and M.total(m).first().value == 9.0
    assert M.on_label(m, M.select(m, "ram", {"dimension": "free"}), "host").count() == 2
    assert {r.host for r in M.label_values(m, "ram", "host").collect()} == {"a", "b"}


def _rows_of(spark, function, text, *args):
    spark.createDataFrame([(text,)], "src string").createOrReplaceTempView("one_source")
    more = "".join(f", '{a}'" for a in args)
    return [tuple(r) for r in spark.sql(f"SELECT f.* FROM one_source, LATERAL {function}(src{more}) f").collect()]


def test_function_definitions(spark):
    """A changed default, decorator or annotation changes the function and what runs on import; a changed body only the function."""
    S.register(spark)
    base = "N = 1\nclass K:\n    def g(self, a=1):\n        def inner():\n            return a\n        return inner\n@deco\nasync def h(x: int) -> str:\n    return x\nif N:\n    def h(): pass\n"
    rows = dict(_rows_of(spark, "function_definitions", base))
    assert set(rows) == {"K.g", "K.g.<locals>.inner", "h", "<module>"} and rows["h"].count("FunctionDef(") == 2
    module = lambda text: dict(_rows_of(spark, "function_definitions", text))["<module>"]
    assert module(base.replace("return x", "return x + 1")) == rows["<module>"] == module(base.replace("return inner", "return 7"))
    for changed in (base.replace("a=1", "a=2"), base.replace("@deco", "@other"), base.replace("x: int", "x: float"), base.replace("-> str", "-> int"), base.replace("N = 1", "N = 2"), base.replace("K", "L"), base.replace("if N", "if not N")):
        assert module(changed) != rows["<module>"]
    assert _rows_of(spark, "function_definitions", "def (")[0][0] == "<error>"
    assert [n for n, _ in _rows_of(spark, "function_definitions", None)] == ["<module>"]


def test_weak_assertions(spark):
    S.register(spark)
    text = """
class T:
    def test_a(self):
        assert True
        assert 0
        assert (1, 'x')
        assert x.y == x.y
        assert x.y < x.y
        assert f() == f()
        self.assertEqual(1, 1.0)
        self.assertEqual(a, a)
        self.assertTrue(0)
        self.assertFalse(0)
        self.assertIsNone(None)
        assertIsNotNone(3)
        self.assertGreater(a, a)
def test_b():
    try:
        check()
        self.assertIn(1, x)
    except (KeyError, AssertionError):
        'nothing'
        pass
    except ValueError:
        pass
    try:
        check()
    except Exception:
        pass
    try:
        assert x
    except Exception:
        raise
    try:
        assert x
    except:
        return
def helper():
    assert True
"""
    got = _rows_of(spark, "weak_assertions", text)
    line = lambda part: next(i for i, t in enumerate(text.split("\n"), 1) if part in t)
    assert {(t, r) for t, _, r in got} == {("test_a", "constant"), ("test_a", "self comparison"), ("test_b", "swallowed")}
    assert sorted(n for t, n, r in got if r == "constant") == [line("assert True"), line("(1, 'x')"), line("assertEqual(1, 1.0)"), line("assertFalse(0)"), line("assertIsNone(None)"), line("assertIsNotNone(3)")]
    assert sorted(n for t, n, r in got if r == "self comparison") == [line("x.y == x.y"), line("assertEqual(a, a)")]
    assert sorted(n for t, n, r in got if r == "swallowed") == [line("except (KeyError"), line("except:")]
    assert _rows_of(spark, "weak_assertions", "def (") == _rows_of(spark, "weak_assertions", None) == []


def test_markers(spark):
    S.register(spark)
    found = lambda text: sorted(_rows_of(spark, "test_markers", text, "needs"), key=repr)
    assert found("@pytest.mark.needs('gpu', 'x86')\ndef t(): pass\npytestmark = pytest.mark.needs('gpu')\n@pytest.mark.slow('z')\ndef u(): pass\n# mark.needs('no')\ns = \"mark.needs('no')\"") == [("gpu", None), ("x86", None)]
    assert found("@pytest.mark.needs(kind='gpu')\ndef t(): pass") == [(None, "keyword arguments")]
    assert found("@pytest.mark.needs('a', NAME)\ndef t(): pass") == [(None, "an argument that is no constant name")] == found("m = pytest.mark.needs('')")
    assert found("def (\npytest.mark.needs('gpu')") == [(None, "does not parse")] and found("def (") == found(None) == []


def test_references(spark):
    S.register(spark)
    text = """
import os.path
from pathlib import Path
ROOT = Path(__file__).resolve().parent.parent
DATA = ROOT / 'data'
if ROOT:
    NAME = 'one'
else:
    NAME = 'two'
FILE = os.path.join('conf', NAME, 'x.json')
def f(other):
    DATA = other
    return DATA / 'hidden', open(ROOT / 'docs' / 'a.md'), 'plain/path.txt', 'no path here/'
g = DATA.joinpath('sub', unknown()), DATA.glob('*.txt')
"""
    got = {r for (r,) in _rows_of(spark, "source_references", text, "pkg/tests/t.py")}
    assert {"os.path", "pathlib", "pkg/data", "pkg/docs/a.md", "conf/one/x.json", "conf/two/x.json", "plain/path.txt", "pkg/data/sub/**", "pkg/data/**"} <= got
    assert not {x for x in got if "hidden" in x} and "no path here/" not in got
    assert _rows_of(spark, "source_references", "def (", "a.py") == []


def test_literal_declarations(spark):
    S.register(spark)
    assert set(_rows_of(spark, "literal_declarations", "N = [1, 2]\nM = f()\nK: int = 3\nL: int\n")) == {("N", "[1, 2]"), ("K", "3")}


def test_predicates_of_policies(spark):
    decision = '{"reason":"measurement_host_not_idle","fresh":true,"baseline":{"basis":"unmeasured","exceeds":true}}'
    rows = [("adaptive_cpu_refused", decision, True), ("other", decision, False), ("adaptive_cpu_refused", decision.replace("true,", "false,", 1), False), ("adaptive_cpu_refused", None, False), ("adaptive_cpu_refused", "[]", False), (None, decision, False)]
    df = spark.createDataFrame(rows, "s string, d string, want boolean")
    assert df.where(~P.unmeasured_refusal(F.col("s"), F.col("d")).eqNullSafe(F.col("want"))).count() == 0
    df = spark.createDataFrame([(False, 3, True, True), (True, 3, True, False), (False, 0, True, False), (False, None, True, False), (False, 3, False, False), (False, 3, None, False)], "g boolean, n int, p boolean, want boolean")
    assert df.where(P.replenish_ok(F.col("g"), F.col("n"), F.col("p")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("k", "withdrawn", 1.0, True), (None, "withdrawn", 1.0, False), ("k", "failed", 1.0, False), ("k", None, 1.0, False), ("k", "withdrawn", None, False)], "b string, s string, g double, want boolean")
    assert df.where(P.preempted(F.col("b"), F.col("s"), F.col("g")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(["/usr/bin/python3", "/x/worker.py"], True), (["worker.py/"], True), (["my-worker.py"], False), ([], False), (None, False)], "a array<string>, want boolean")
    assert df.where(P.runs_any(F.col("a"), ["worker.py", "move.py"]) != F.col("want")).count() == 0
    gib = 1 << 30
    df = spark.createDataFrame([(100 * gib, 200 * gib, 1.0, 0.1, 50 * gib, True), (100 * gib, 200 * gib, 1.0, 0.25, 50 * gib, False), (90 * gib, 200 * gib, 1.0, 0.1, 50 * gib, False), (None, 200 * gib, 1.0, 0.1, 1, False)], "f long, t long, a double, r double, w long, want boolean")
    assert df.where(P.write_space(*[F.col(c) for c in "ftarw"]) != F.col("want")).count() == 0
    df = spark.createDataFrame([(None, None, True, None, 0, False), ("x", None, False, None, 0, True), ("x", ["gpu"], False, None, 0, False), ("x", ["gpu"], True, None, 0, True), ("x", None, True, 5, 5, False), ("x", None, True, 4, 5, True)], "w string, k array<string>, t boolean, r int, p int, want boolean")
    assert df.where(P.held_back(*[F.col(c) for c in "wktrp"]) != F.col("want")).count() == 0


def test_drain_verdicts(spark):
    q = "key string, mode string, need map<string,int>, available map<string,int>, passes int, first_unix double, foreign_unix double, epoch_unix double, expired_unix double, now double"
    base = ("tokens", {"cpu": 4}, {"cpu": 1}, 5, 900.0, None, None, None, 1000.0)
    rows = {
        "drains": (*base,), "early": (*base[:3], 1, *base[4:]), "foreign": (*base[:5], 950.0, *base[6:]), "short": (*base,), "lasting": (*base,), "alone": (*base,), "old": (*base[:4], 0.0, *base[5:]),
        "exclusive": ("exclusive", *base[1:]), "unknown": (*base,), "stale": (*base[:4], 0.0, *base[5:]), "refilled": (*base[:6], 100.0, None, 1000.0), "expired": (*base[:6], 100.0, 800.0, 1000.0), "anew": (*base[:6], 100.0, 150.0, 1000.0),
    }
    holders = [
        ("drains", "a", "transient", 50.0, {"cpu": 3}), ("early", "a", "transient", 50.0, {"cpu": 3}), ("foreign", "a", "transient", 50.0, {"cpu": 3}), ("short", "a", "transient", 50.0, {"cpu": 2}), ("lasting", "a", "lasting", 50.0, {"cpu": 3}),
        ("exclusive", "a", "lasting", 50.0, {"cpu": 9}), ("exclusive", "b", "transient", 50.0, {"cpu": 9}), ("unknown", "a", "unknown", 50.0, {"cpu": 3}), ("stale", "a", "unknown", 50.0, {"cpu": 3}),
        ("refilled", "a", "transient", 200.0, {"cpu": 3}), ("expired", "a", "transient", 200.0, {"cpu": 3}), ("anew", "a", "transient", 200.0, {"cpu": 3}),
    ]
    df = W.drain_verdicts(spark.createDataFrame([(k, *v) for k, v in rows.items()], q), spark.createDataFrame(holders, "key string, holder string, bound string, claimed_unix double, counts map<string,int>"), 300.0)
    got = {r.key: r for r in df.collect()}
    why = {k: r.why for k, r in got.items()}
    assert why == {
        "drains": "drains_soon", "early": "not_starved", "foreign": "foreign_load", "short": "holders_cannot_cover", "lasting": "holder_does_not_drain_soon", "alone": "in_flight", "old": "unknown_past_ceiling", "exclusive": "holder_does_not_drain_soon",
        "unknown": "drains_soon", "stale": "unknown_past_ceiling", "refilled": "refilled_past_ceiling", "expired": "refilled_past_ceiling", "anew": "drains_soon",
    }
    assert {k for k, r in got.items() if r.withhold} == {"drains", "alone", "unknown", "anew"}
    assert (got["drains"].epoch, got["refilled"].expired, got["expired"].expired, got["anew"].epoch, got["anew"].expired) == (1000.0, 1000.0, 800.0, 1000.0, None)


def test_deadlines_and_coalescing(spark):
    rows = [("a", 1, [5.0, 20.0]), ("a", 2, [7.0, 30.0]), ("b", 1, [50.0]), ("c", 1, []), ("d", 1, None)]
    due, ahead = W.due_deadlines(spark.createDataFrame(rows, "k string, seq int, d array<double>"), ["k"], ["seq"], "d", F.lit(10.0))
    assert [(r.k, r.ahead) for r in due.collect()] == [("a", [30.0])] and ahead.first()[0] == 30.0
    events = [("changed", 1.0), ("changed", 2.0), ("failed", 3.0), ("failed", 4.0), *[("failed", 5.0 + i) for i in range(6)], ("changed", 20.0), ("failed", 21.0), ("completed", 22.0), ("changed", 23.0)]
    got = W.coalesced_runs(spark.createDataFrame([("k", *e) for e in events], "key string, kind string, at double"), ["key"], "at").orderBy("at").collect()
    assert [round(r.retry_at - r.at, 3) for r in got if r.kind == "failed"] == [0.25, 0.5, 1.0, 2.0, 4.0, 5.0, 5.0, 5.0, 0.25]
    assert [(r.at, r.coalesced) for r in got if r.kind == "changed"] == [(1.0, False), (2.0, True), (20.0, True), (23.0, False)] and [r.at for r in got if r.state == "clean"] == [22.0]


def test_parent_actions_and_plans_of_nothing(spark):
    """Unknown states close nothing, unknown completeness plans nothing, and empty tables give no rows."""
    links = spark.createDataFrame([(1, None, "none", None, 1, 0), (2, 1, "text", "OPEN", 1, 0), (3, 9, "text", None, None, None), (4, 1, "native", "CLOSED", None, 0), (5, 1, "text", "OPEN", 1, 1)], "key long, parent long, source string, parent_state string, root long, faults int")
    found = spark.createDataFrame([("default_branch_fix", 2, "a", None), ("default_branch_fix", 3, "b", True), ("dead_blocked_chain", 4, "c", None), ("claim_without_evidence", 4, "d", None)], "kind string, key long, candidate string, verified boolean")
    receipts = spark.createDataFrame([("b", True), ("c", None)], "id string, reviewed boolean")
    rows = {(r.action, r.issue): (r.target, r.status) for r in J.parent_actions(links, found, receipts).collect()}
    assert rows == {("native_sub_issue", 2): (1, "needs_hindsight"), ("create_parent", 4): (None, "needs_parent_design"), ("close", 3): (None, "proposed"), ("remove_blocked_labels", 4): (None, "needs_hindsight_source_review")}
    assert J.parent_actions(links.limit(0), found.limit(0), receipts.limit(0)).count() == 0
    nodes = spark.createDataFrame([("n", True), ("m", None), ("o", True)], "key string, complete boolean")
    issues = spark.createDataFrame([(7, None, ["own"], ["o", "x"]), (3, True, ["own"], ["o", "n"]), (9, False, ["own"], ["o"]), (1, False, None, ["n"])], "number long, pull_request boolean, labels array<string>, keys array<string>")
    owners = J.first_owners(issues, "own")
    assert {tuple(r) for r in owners.collect()} == {("o", 7), ("x", 7)}
    assert [r.key for r in J.issue_plans(nodes, owners, F.col("complete")).collect()] == ["n"]
    blockers = spark.createDataFrame([("n", "b1"), ("o", "b1"), ("o", "b2"), ("m", "b1")], "key string, blocker string")
    states = spark.createDataFrame([("b1", "CLOSED"), ("b2", None)], "blocker string, state string")
    assert [tuple(r) for r in J.closed_chains(nodes, blockers, states).collect()] == [("n", 1)]


def test_presence_needs_provenance(spark):
    rows = [(None, None, None, None), ("held", " why ", "who", 5.0), ("held", "why", "who", float("inf")), ("held", None, " ", None), ("gone", "why", "who", 1.0)]
    hosts = spark.createDataFrame(rows, "status string, reason string, by string, unix double")
    got = [tuple(r.s) for r in hosts.select(P.presence_status(F.col("status"), F.col("reason"), F.col("by"), F.col("unix"), ("active", "held")).alias("s")).collect()]
    assert got == [("active", None, None, None, None), ("held", "why", "who", 5.0, None), (None,) * 4 + ("without unix",), (None,) * 4 + ("without reason; by; unix",), (None,) * 4 + ("unknown status gone",)]
