"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed per source, each source's repetition rate is its target over its
size, and a document is emitted floor(rate) times plus once more when a uniform number
drawn from its seeded hash falls below the rate's fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, literal_rows, text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_RATE = 3.0
SEED = 17


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of md5("seed:key"); the same for every run and every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def source_rates(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per source of sized(source, size): source, n_docs, source_size, weight, target and rate.

    Sources in order of code points, null last, get the weights in turn. The targets share the whole
    size by weight; one that would exceed max_rate times its source's size stops there and its excess
    is reshared by weight among the rest. A source of size 0 has target and rate 0.

    Sources may be as many as domains: they are sorted by range, a source's number is its place in its range behind the
    rows of the ranges before, and the level of the uncapped ones is found by sums: it starts as if none were
    capped and rises with each round that finds more below it. The driver sees a count per range and sums.
    """
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    key = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    per = per.repartitionByRange(*key).sortWithinPartitions(*key)
    per = written(per.withColumn("_id", F.monotonically_increasing_id()), "sources")
    place = (1 << 33) - 1  # the rows of a range are numbered in the low 33 bits, ranges above
    before, offsets = 0, []
    for r in per.groupBy(F.shiftright("_id", 33).alias("range")).count().orderBy("range").collect():
        offsets.append((r["range"], before))
        before += r["count"]
    offsets = literal_rows(spark, offsets, "range long, before long")
    steps = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("range", F.shiftright("_id", 33)).join(F.broadcast(offsets), "range")
    per = per.withColumn("weight", F.element_at(steps, ((F.col("before") + F.col("_id").bitwiseAND(place)) % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.lit(float(max_rate)) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    zero = F.lit(0.0)
    total = float(per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = None, -1
    while True:
        below = F.lit(False) if level is None else F.col("_ratio") < level
        n, caps, open_ = per.agg(F.count_if(below), F.coalesce(F.sum(F.when(below, F.col("_cap"))), zero), F.coalesce(F.sum(F.when(~below, F.col("weight"))), zero)).first()
        if n == capped or not open_:
            break
        level, capped = (total - caps) / open_, n
    level = F.lit(float(level or 0.0))
    target = F.least(F.col("weight") * level, F.col("_cap"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_rate)))).otherwise(zero)
    return per.select("source", "n_docs", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def copies(doc_id: Column, rate: Column, seed: int = SEED) -> Column:
    return (F.floor(rate) + (uniform(doc_id, seed) < rate - F.floor(rate)).cast("int")).cast("long")


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows joined with rates on a null-safe source key; broadcast only after counting the sources."""
    rates = written(rates, "rates")
    n_sources, total = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    facts = rates.select(named.alias("_source"), F.col("n_docs").alias("_n_docs"), F.struct("source_size", "weight", "target", "rate").alias("_rate"))
    return keyed_join(rows.withColumn("_source", named), facts, "_source", "_n_docs", int(total), int(n_sources)).drop("_source")


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """How the mix takes each document: doc_id, source, size, source_size, target, rate, copies, taken.

    Null text: size 0. Null source: a source of its own, ordered last. Null doc_id: hashed as the empty
    string. Repeated rows: each counts, and all with one doc_id fall alike. Empty input: no rows. Other columns
    of docs are ignored. The text is read once; doc_id, source and size go to the shared folder.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"))
    sized = written(sized, "sizes")
    out = _with_rates(sized, source_rates(sized, weights, max_rate))
    n = copies(F.col("doc_id"), F.col("_rate.rate"), seed)
    return out.select("doc_id", "source", "size", "_rate.source_size", "_rate.target", "_rate.rate", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of docs, all its columns kept, as often as mix_plan takes it.

    Nulls, repeated rows and empty input are as in mix_plan; an empty text is emitted as its source's rate has it.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.struct("*").alias("_row"))
    sized = docs.select(F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"))
    out = _with_rates(rows, source_rates(sized, weights, max_rate))
    n = copies(F.col("doc_id"), F.col("_rate.rate"), seed).cast("int")
    return out.withColumn("_copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).select("_row.*")


#: The same rows as op5_mixing's, for an engine that has regexp_extract_all and md5.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM sized GROUP BY source
), caps AS (
  SELECT *, CAST((rn - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / CAST((rn - 1) % 3 + 1 AS DOUBLE) AS ratio FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM caps WINDOW w AS (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rn LIMIT 1
), rates AS (
  SELECT source, source_size, least(weight * (SELECT level FROM chosen), cap) AS target FROM levels
), drawn AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN least(r.target / r.source_size, 3.0) ELSE 0.0 END AS rate,
    ('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM drawn
"""
