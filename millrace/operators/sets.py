"""Set and bag operations on baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def growth(live: DataFrame, baseline: DataFrame, exempt: DataFrame | None = None) -> DataFrame:
    """Live rows that the baseline lacks, without the exempt."""
    out = live.subtract(baseline)
    return out.subtract(exempt) if exempt is not None else out


def gone(live: DataFrame, baseline: DataFrame) -> DataFrame:
    return baseline.subtract(live)


def ratchet(live: DataFrame, baseline: DataFrame) -> DataFrame:
    """A baseline may only shrink: what both have."""
    return baseline.intersect(live)


def ratchet_figures(live: DataFrame, baseline: DataFrame, key: str, figure: str) -> DataFrame:
    """Per key of both the smaller figure."""
    return baseline.join(live.select(key, F.col(figure).alias("live_figure")), key).select(key, F.least(figure, "live_figure").alias(figure))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Occurrences of a beyond those of b."""
    return a.exceptAll(b)


def exclusions(*lists: tuple[str, DataFrame]) -> DataFrame:
    """Lists(target, owner) as one, tagged by kind."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("kind", F.lit(kind)) for kind, df in lists])


def exclusion_faults(entries: DataFrame) -> DataFrame:
    """Targets listed twice or without an owner."""
    return entries.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.trim("owner") == "", F.lit(True))).alias("ownerless")).where("n > 1 OR ownerless")


def subset_faults(small: DataFrame, allowed: DataFrame) -> DataFrame:
    return small.join(allowed, small.columns, "left_anti")


def same_sequence(a: DataFrame, b: DataFrame, order: str, volatile: str) -> DataFrame:
    """Rows in which two event sequences differ once a volatile column is dropped; none if they are equal."""
    a, b = a.drop(volatile), b.drop(volatile)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b"))).orderBy(order)


def merged_edges(*groups: DataFrame) -> DataFrame:
    """The union of edge groups, each edge once."""
    return reduce(lambda a, b: a.unionByName(b), groups).distinct()
