"""Helpers shared by the text operators: tables, shared scratch space and joins that survive hot keys."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of short rows is broadcast; its size is counted first.
BROADCAST_ROWS = 50_000
#: A key held by more than one row in HOT_SHARE is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a local session gets a temporary one and a cluster's an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/millrace-{what}-{uuid.uuid4().hex}"


#: Paths written since each open temporary_tables began.
_written: list[list[str]] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """The tables written inside are deleted at the end; what is to stay must be written elsewhere, with written(keep=True)."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        for path in _written.pop():
            delete(spark, path)


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, and readable after any executor is lost."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    for paths in _written[-2:-1] if keep else _written[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], columns: str) -> DataFrame:
    """A few rows as a table whose columns are "name type, ...": a literal in the plan, with no Python on executors."""
    names = [c.split()[0] for c in columns.split(", ")]
    kind = "array<struct<" + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in columns.split(", ")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), kind)))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keyed_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, facts_rows: int | None = None) -> DataFrame:
    """Left join of rows with facts, which has one row per non-null key and in `weight` the number of rows that hold it.

    A key held by more than total/HOT_SHARE rows is hot. Fewer than HOT_SHARE keys can be, so these are
    broadcast; the rows of all other keys are shuffled, and none of those keys holds more than that share.
    Rows served by the broadcast side, and rows without a key, stay where they are, so repeated rows gather nowhere; for
    that rows is read twice. When facts_rows (counted beforehand) is at most BROADCAST_ROWS all facts are broadcast.
    """
    cols = [c for c in facts.columns if c not in (key, weight)]
    if facts_rows is not None and facts_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts.drop(weight)), key, "left")
    limit = max(1, total // HOT_SHARE)
    hot = facts.where(F.col(weight) > limit).select(F.col(key), F.struct(*cols).alias("_facts"))
    cold = facts.where(F.col(weight) <= limit).select(F.col(key), F.struct(*cols).alias("_facts"))
    side = rows.join(F.broadcast(hot), key, "left")
    to_do = F.col("_facts").isNull() & F.col(key).isNotNull()
    out = side.where(~to_do).unionByName(side.where(to_do).drop("_facts").join(cold, key, "left"))
    return out.select(*[F.col(c) for c in rows.columns], *[F.col(f"_facts.{c}").alias(c) for c in cols])
