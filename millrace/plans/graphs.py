"""Queries on graphs and likeness. The graph is that of nations: each customer nation to the two supplier nations it buys most from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import similarity as K
from ..operators import windows as W
from ..sources.sinks import dictionary_map
from ..sources.tables import load
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_EDGES = """
n AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM n) WHERE k <= 2)"""
_CLOSURE = f"WITH RECURSIVE {_EDGES}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)"


def _edges(spark, sf_dir):
    li, o, c, s = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    buys = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey).join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey).join(s.select("s_suppkey", "s_nationkey"), li.l_suppkey == s.s_suppkey)
    n = buys.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return n.withColumn("k", rank).where("k <= 2").select("src", "dst")


@R.query(_CLOSURE + " SELECT src, dst FROM c")
def reach_closure(spark, sf_dir):
    return G.closure(_edges(spark, sf_dir))


@R.query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 0 AS node, 0 AS steps UNION SELECT e.dst, steps + 1 FROM r JOIN e ON e.src = r.node WHERE steps < 30) SELECT node, min(steps) AS steps FROM r GROUP BY 1")
def reach_steps(spark, sf_dir):
    return G.reach(_edges(spark, sf_dir), spark.createDataFrame([(0,)], "node int"))


@R.query(_CLOSURE + ", m AS (SELECT a.src AS node, a.dst AS other FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst), g AS (SELECT node, least(min(other), node) AS component FROM m GROUP BY node) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM g")
def scc(spark, sf_dir):
    return G.strong_components(_edges(spark, sf_dir))


@R.query(_CLOSURE + ", m AS (SELECT a.src AS node, a.dst AS other FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst), g AS (SELECT node, least(min(other), node) AS component FROM m GROUP BY node) SELECT e.src, e.dst, x.component FROM e JOIN g x ON x.node = e.src JOIN g y ON y.node = e.dst WHERE x.component = y.component")
def cycle_edges(spark, sf_dir):
    e = G._settled(_edges(spark, sf_dir))
    return G.cycle_edges(e, G.strong_components(e))


@R.query(_CLOSURE + ", f AS (SELECT src AS node FROM e UNION SELECT dst FROM e), t AS (SELECT max(dst) AS dst FROM e), b AS (SELECT dst AS node FROM t UNION SELECT src FROM c WHERE dst = (SELECT dst FROM t)) SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM f) AND src IN (SELECT node FROM b) AND dst IN (SELECT node FROM b)")
def causing_edges(spark, sf_dir):
    e = G._settled(_edges(spark, sf_dir))
    return G.causing_edges(e, e.select(F.col("src").alias("node")), e.agg(F.max("dst").alias("node")))


_PARENTS = "p AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey // 3 END AS parent FROM orders)"


@R.query(f"WITH RECURSIVE {_PARENTS}, u AS (SELECT node, node AS place, parent, CAST(0 AS BIGINT) AS depth FROM p UNION ALL SELECT u.node, p.node, p.parent, depth + 1 FROM u JOIN p ON p.node = u.parent) SELECT node, place AS root, depth, false AS cyclic FROM u WHERE parent IS NULL")
def ancestor_root(spark, sf_dir):
    """Orders as a forest: each one's parent is a third of its key, multiples of seven are roots."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey div 3 END").alias("parent"))
    return G.roots(o)


@R.query()
def title_clusters(spark, sf_dir):
    """Pages of equal or alike titles, at the ratio of 0.92 (SQL has no matching-blocks ratio: tested against every pair)."""
    t = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return K.title_clusters(t, "page_id", "title")


@R.query("""
WITH t AS (SELECT page_id AS node, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g')) AS t FROM pages), r AS (SELECT t, min(node) AS rep, count(*) AS n FROM t WHERE t <> '' GROUP BY 1)
SELECT node, rep AS component FROM t JOIN r USING (t) WHERE n > 1
""".replace("\\\\", "\\"))
def equal_titles(spark, sf_dir):
    """The equality arm alone, as SQL has it."""
    t = load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return K.title_clusters(t, "page_id", "title", least=1 << 30)


@R.query(f"""
WITH RECURSIVE p AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 50 = 49 THEN -1 ELSE o_orderkey // 3 END AS parent, o_orderstatus = 'O' AS open, o_custkey % 10 > 0 AS complete, CASE WHEN o_custkey % 6 = 0 THEN 2 ELSE 1 END AS refs FROM orders),
u AS (SELECT node, node AS place, parent, open, complete, refs, 0 AS step FROM p UNION ALL SELECT u.node, p.node, p.parent, p.open, p.complete, p.refs, step + 1 FROM u JOIN p ON p.node = u.parent)
SELECT node, coalesce(arg_max(place, step) FILTER (WHERE open), node) AS root, false AS cyclic, count(*) FILTER (WHERE NOT complete) AS incomplete, count(*) FILTER (WHERE refs > 1) AS ambiguous, count(*) FILTER (WHERE parent = -1) AS unknown FROM u GROUP BY node
""")
def open_ancestors(spark, sf_dir):
    """Orders as issues: the top open one of each chain of parents, with what is wrong along it (cycles are tested against a walk)."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    parent = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 50 = 49 THEN -1 ELSE o_orderkey div 3 END")
    refs = F.when(F.col("o_custkey") % 6 == 0, F.array(k, k + 1)).otherwise(F.array(k))
    return G.open_ancestors(o.select(k.alias("node"), parent.alias("parent"), (F.col("o_orderstatus") == "O").alias("open"), (F.col("o_custkey") % 10 > 0).alias("complete"), refs.alias("refs")))


@R.query("""
WITH d AS (SELECT p_partkey % 25 AS node, CASE WHEN p_size % 3 = 0 THEN p_partkey END AS native, [p_size, p_size + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END] AS refs, p_partkey FROM part)
SELECT p_partkey AS node, coalesce(native, CASE WHEN len(list_distinct(refs)) = 1 THEN refs[1] END) AS parent, native IS NULL AND len(list_distinct(refs)) > 1 AS ambiguous FROM d
""")
def chosen_parents(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    refs = F.array(size, size + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1))
    return G.chosen_parent(p.select(F.col("p_partkey").alias("node"), F.when(size % 3 == 0, F.col("p_partkey")).alias("native"), refs.alias("refs")))


@R.query("""
WITH u AS (SELECT DISTINCT l_orderkey AS file, l_suppkey % 7 AS consumer FROM lineitem), b AS (SELECT DISTINCT s_nationkey AS package, s_suppkey % 7 AS consumer FROM supplier), n AS (SELECT file, count(*) AS need FROM u GROUP BY 1),
h AS (SELECT file, package, count(*) AS n FROM u JOIN b USING (consumer) GROUP BY 1, 2)
SELECT file, min(package) AS package FROM h JOIN n USING (file) WHERE n = need GROUP BY file
""")
def inherited_packages(spark, sf_dir):
    """Orders whose suppliers' groups all lie within a nation's."""
    li, s = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "supplier")
    return G.inherited(li.select(F.col("l_orderkey").alias("file"), (F.col("l_suppkey") % 7).alias("consumer")), s.select(F.col("s_nationkey").alias("package"), (F.col("s_suppkey") % 7).alias("consumer")))


@R.query("""
WITH f AS (SELECT DISTINCT p_brand AS function FROM part), d AS (SELECT function, row_number() OVER (ORDER BY function) - 1 AS id FROM f)
SELECT p_type AS test, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT p_type, p_brand FROM part) JOIN d ON function = p_brand GROUP BY 1
""")
def dictionary_coded_map(spark, sf_dir):
    _, tests = dictionary_map(load(spark, sf_dir, "part").select(F.col("p_type").alias("test"), F.col("p_brand").alias("function")))
    return tests.select("test", F.array_join("ids", ",").alias("ids"))


@R.query("""
SELECT test, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM (SELECT l_orderkey AS test, 'runs ' || l_suppkey AS reason FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) UNION ALL SELECT o_orderkey, 'always' FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1
""")
def impact_select(spark, sf_dir):
    m = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test"), F.col("l_suppkey").cast("string").alias("function"))
    changed = load(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").cast("string").alias("function"))
    rules = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("test"), F.lit("always").alias("reason"))
    return G.impacted(m, changed, rules)


_REVERSED = "list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'))"


@R.query(f"""
WITH i AS (SELECT page_id AS file, {_REVERSED} AS parts FROM pages), n AS (SELECT file, array_to_string(parts, '.') AS name, unnest(range(1, len(parts) + 1)) AS k, parts FROM i),
m AS (SELECT DISTINCT array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'))[1:k], '.') AS module FROM pages, (VALUES (1), (2), (3)) x(k) WHERE page_id % 3 = 0 OR k < 3)
SELECT file, name, arg_max(module, k) AS module FROM n JOIN m ON module = array_to_string(parts[1:k], '.') GROUP BY file, name
""")
def import_owners(spark, sf_dir):
    """Hosts read from the right as dotted names (com.example.blog), each with the longest prefix among the modules: top levels, domains, and the full names of a third of the pages."""
    parts = F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), "[.]"))
    p = load(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    cut = p.select("page_id", "parts", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).where("page_id % 3 = 0 OR k < 3")
    modules = cut.select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ".").alias("module")).distinct()
    return G.import_owners(p.select(F.col("page_id").alias("file"), F.array_join("parts", ".").alias("name")), modules)


@R.query("""
WITH w AS (SELECT n_nationkey AS w, n_regionkey AS tier, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
c AS (SELECT w.tier, s_suppkey AS r, greatest(0, CAST(trunc(s_acctbal) AS BIGINT)) AS cap, (1 << w.i) | (1 << ((w.i + 1) % 5)) AS reach FROM supplier JOIN w ON w = s_nationkey), masks AS (SELECT unnest(range(0, 32)) AS mask),
cut AS (SELECT t.tier, mask, (SELECT coalesce(sum(9000), 0) FROM w WHERE w.tier = t.tier AND (mask >> i) & 1 = 0) + (SELECT coalesce(sum(cap), 0) FROM c WHERE c.tier = t.tier AND mask & reach <> 0) AS v FROM (SELECT DISTINCT tier FROM w) t, masks)
SELECT tier, CAST(45000 AS BIGINT) AS need, CAST(min(v) AS BIGINT) AS served FROM cut GROUP BY tier
""")
def joint_flow(spark, sf_dir):
    """Nations' needs served by the balances of suppliers of their own and of the region's next nation: a maximum flow per region, by SQL the least of all 32 cuts."""
    n, s = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    placed = n.withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    both = s.join(placed, s.s_nationkey == placed.n_nationkey).select("n_regionkey", "s_suppkey", "s_acctbal", F.explode(F.array(F.col("i"), (F.col("i") + 1) % 5)).alias("j"))
    reach = both.join(placed.select("n_regionkey", F.col("i").alias("j"), F.col("n_nationkey").alias("window")), ["n_regionkey", "j"])
    needs = n.select(F.col("n_regionkey").alias("tier"), F.col("n_nationkey").alias("window"), F.lit(9000).alias("need"))
    caps = both.select(F.col("n_regionkey").alias("tier"), F.col("s_suppkey").alias("range"), F.greatest(F.lit(0), F.col("s_acctbal")).cast("long").alias("cap")).distinct()
    return G.joint_need(needs, reach.select(F.col("n_regionkey").alias("tier"), "window", F.col("s_suppkey").alias("range")), caps)


@R.query("""
WITH w AS (SELECT doc_id AS k, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT DISTINCT k, array_to_string(w[i+1:i+6], ' ') AS g FROM (SELECT k, w, unnest(range(0, len(w) - 5)) AS i FROM w WHERE len(w) >= 6)),
s AS (SELECT k, list_sort(list(g)) AS s, count(*) AS n FROM g GROUP BY k), r AS (SELECT s, min(k) AS rep, any_value(n) AS n FROM s GROUP BY s), x AS (SELECT rep, n, unnest(s) AS g FROM r),
c AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL)
SELECT a, b, c / (na + nb - c) AS similarity FROM c WHERE c / (na + nb - c) >= 0.9 UNION ALL SELECT rep, k, 1.0 FROM s JOIN r USING (s) WHERE k <> rep
""".replace("\\\\", "\\"))
def near_duplicates(spark, sf_dir):
    """Whole documents by six-word shingles at 0.9; by SQL every pair that shares a shingle."""
    d = load(spark, sf_dir, "documents").select("doc_id", K.shingles(K.tokens(F.col("text"))).alias("grams"))
    return K.near_duplicates(d, "doc_id", "grams", 0.9)
