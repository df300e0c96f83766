"""URL filters: host and path rules, and gradient-boosted trees on lexical features (DataFrame functions only).

Rules decide the URLs that they fit. The others are judged by boosted trees fitted on a bounded sample of the distinct labelled
URLs. Two features are statistics of the host's suffix, counted over all labelled rows: their number and the smoothed share
of blocked ones; each URL sees those of the other folds only, so no URL's own label, nor its host's, is among its features. The
fitted trees become one SQL expression, so scoring is a projection inside code generation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keyed_join, written
from .mixing import uniform

#: Fixed values of the filter: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Parts of host names that are known to be bad: they label URLs where no labels are given. No feature sees the parts of a host.
SEED_WORDS = ("ads", "adult", "bets", "casino", "gambling", "loans", "malware", "phishing", "pills", "porn", "spam", "viagra", "warez", "xxx")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct labelled URLs that trees are fitted on, at most (give or take the hash's luck).
MAX_TRAIN = 20_000
TREES, DEPTH, SEED = 20, 5, 11
SMOOTHING, FOLDS = 10.0, 5
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "suffix_rows", "suffix_share")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or end, A-Z lower-cased; empty without a ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a parent of it) and begins path; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for at, begin, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(begin))
        rule, verdict = F.when(fits, at + begin).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character; 0 for the empty text."""
    n = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(parts, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def fold_of(host: Column) -> Column:
    """The fold of a host, so that all URLs of a host are in one."""
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def weak_label(host: Column, ruled: Column, seeds: Sequence[str] = SEED_WORDS) -> Column:
    """1 or 0: what the fitting rule says of a URL; without a rule, 1 where a part of host between dots and hyphens is a seed word."""
    seeded = F.arrays_overlap(F.split(host, r"[.\-]"), F.array(*[F.lit(w) for w in seeds]))
    return F.coalesce((ruled == "block").cast("int"), seeded.cast("int"))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]+"),
        "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url),
        "n_params": count(query, r"[^&]+"),
    }


def suffix_facts(labelled: DataFrame) -> DataFrame:
    """suffix, suffix_folds: for each fold the rows and blocked rows of labelled(host, label) that the other folds hold; last come all folds' together."""
    per = labelled.groupBy(suffix_of(F.col("host")).alias("suffix"), fold_of(F.col("host")).alias("fold")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("bad"))
    sums = [F.sum(F.when(F.col("fold") != k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k in range(FOLDS + 1) for c in ("n", "bad")]
    return per.groupBy("suffix").agg(*sums).select("suffix", F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.col(f"bad{k}").alias("bad")) for k in range(FOLDS + 1)]).alias("suffix_folds"))


def _tree_sql(node, names: Sequence[str]) -> str:
    """A fitted tree as nested conditions over columns."""
    if node.numDescendants() == 0:
        return repr(float(node.prediction())) + "D"
    split = node.split()
    name, threshold = names[split.featureIndex()], repr(float(split.threshold())) + "D"
    return f"CASE WHEN {name} <= {threshold} THEN {_tree_sql(node.leftChild(), names)} ELSE {_tree_sql(node.rightChild(), names)} END"


def with_features(rows: DataFrame, facts: DataFrame, share: float, out_of_fold: bool = False) -> DataFrame:
    """rows(url, host, path, ...) with the columns FEATURES; out_of_fold leaves each host's own fold out of its suffix's statistics.

    A suffix's share of blocked rows is smoothed towards `share`; a suffix that no labelled URL has counts 0 rows.
    Beyond BROADCAST_ROWS suffixes the facts are laid out for every suffix of rows, and those of hot ones alone are broadcast.
    """
    n = facts.count()
    rows = rows.withColumn("suffix", suffix_of(F.col("host")))
    total = None
    if n > BROADCAST_ROWS:
        held = written(rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("held")).join(facts, "suffix", "left"), "suffixes")
        facts, total = held, held.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    else:
        facts = facts.withColumn("held", F.lit(0))
    out = keyed_join(rows, facts, "suffix", "held", total or 0, None if n > BROADCAST_ROWS else n)
    seen = F.get("suffix_folds", fold_of(F.col("host")) if out_of_fold else F.lit(FOLDS))
    rows_, bad = (F.coalesce(seen[c], F.lit(0.0)) for c in ("n", "bad"))
    return out.withColumns({"suffix_rows": rows_, "suffix_share": (bad + SMOOTHING * share) / (rows_ + SMOOTHING)}).drop("suffix_folds").withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))


def training_rows(sample: DataFrame, facts: DataFrame, share: float) -> DataFrame:
    """(vector, label) of sample(url, host, path, label), in one partition and in order of url, so that a fit does not depend on how rows were dealt; sample is bounded by MAX_TRAIN."""
    rows = with_features(sample, facts, share, out_of_fold=True)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows).select("url", "vector", "label")
    return rows.repartition(1).sortWithinPartitions("url").select("vector", "label")


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> tuple[DataFrame, float, str]:
    """(suffix facts, share of blocked rows, SQL of the log odds over FEATURES) from labelled(url, label), label 1 for URLs to block.

    The facts cover all rows; the trees see about max_train distinct URLs, chosen by their hash, each once with the largest of
    its labels, however often one is repeated. Rows without URL or label are left out. No rows: odds are even. Labels of one
    kind: the log odds are those of the smoothed base rate.
    """
    known = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", host_of(F.col("url")).alias("host"), F.col("label").cast("double").alias("label"))
    facts = written(suffix_facts(known), "suffixes")
    every = F.get("suffix_folds", F.lit(FOLDS))
    n, positive = facts.agg(F.coalesce(F.sum(every["n"]), F.lit(0.0)), F.coalesce(F.sum(every["bad"]), F.lit(0.0))).first()
    share = (positive + 0.5) / (n + 1)
    if positive in (0, n):
        return facts, share, repr(math.log(share / (1 - share))) + "D"
    distinct = known.agg(F.approx_count_distinct("url")).first()[0]
    sample = known.where(uniform(F.col("url"), seed) < max_train / max(1, distinct)).groupBy("url", "host").agg(F.max("label").alias("label"))
    sample = written(sample.withColumn("path", path_of(F.col("url"))), "urls")
    if sample.agg(F.count_distinct("label")).first()[0] < 2:
        return facts, share, repr(math.log(share / (1 - share))) + "D"
    train = training_rows(sample, facts, share).persist()
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed, checkpointInterval=-1).fit(train)
    train.unpersist()
    parts = [f"{float(w)!r}D * ({_tree_sql(t._call_java('rootNode'), FEATURES)})" for t, w in zip(model.trees, model.treeWeights)]
    return facts, share, f"2D * ({' + '.join(parts)})"


def url_report(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, score.

    verdict is the longest fitting rule's; without one, block where the trees' score reaches threshold, else allow.
    Without labelled(url, label) the pages' own URLs are labelled, by the rules and else by known bad host parts (weak_label).
    Null url, or one without ://: empty host and path, no rule, and a score like any other. Repeated rows: each judged, alike.
    Very long URLs cost in proportion to their length times their distinct characters. Empty input: no rows. Other columns are ignored.
    """
    rows = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        labelled = rows.where("host <> ''").select("url", weak_label(F.col("host"), F.col("ruled")).alias("label"))
    facts, share, odds = fit(labelled)
    score = 1 / (1 + F.exp(-F.expr(odds)))
    out = with_features(rows, facts, share).withColumn("score", score)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
