"""Records kept as documents: strict JSON, verified bytes, point lookups and bounded scans that say if they are complete."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH, MAX_DIGITS = 64, 400


def _fault(raw: str | None) -> str | None:
    """Why raw is not one strict JSON document, or None: duplicate keys, NaN and infinities, depth and long integers are faults."""
    if raw is None:
        return "missing"

    def pairs(items):
        names = [k for k, _ in items]
        if len(names) != len(set(names)):
            raise ValueError("duplicate key")
        return dict(items)

    def constant(name):
        raise ValueError(f"not finite: {name}")

    def integer(digits):
        if len(digits) > MAX_DIGITS:
            raise ValueError("integer too long")
        return int(digits)

    def number(digits):
        value = float(digits)
        if value in (float("inf"), float("-inf")):
            raise ValueError("not finite")
        return value

    def depth(value, level=0):
        if level > MAX_DEPTH:
            raise ValueError("too deep")
        for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            depth(x, level + 1)

    try:
        depth(json.loads(raw, object_pairs_hook=pairs, parse_constant=constant, parse_int=integer, parse_float=number))
    except (ValueError, RecursionError) as e:
        return str(e) or type(e).__name__
    return None


def json_fault(raw: Column) -> Column:
    """The fault of a JSON string as strict readers see it, or null. Spark's own reader keeps the last of duplicate keys silently."""

    @F.pandas_udf("string")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_fault, na_action=None).astype(object)

    return check(raw)


def strict_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with `record` (column read by schema; null where faulty) and `fault`."""
    return df.withColumn("fault", json_fault(F.col(column))).withColumn("record", F.when(F.col("fault").isNull(), F.from_json(column, schema)))


def verified(files: DataFrame, expected: Column, max_bytes: int | None = None) -> DataFrame:
    """binaryFile rows with `verified`: their bytes have the expected SHA-256 and no more than max_bytes. A wrong digest never falls back to another copy."""
    ok = F.sha2(F.col("content"), 256) == expected
    return files.withColumn("verified", F.coalesce(ok & (F.lit(max_bytes is None) | (F.col("length") <= (max_bytes or 0))), F.lit(False)))


def tail(content: Column, n: int) -> Column:
    """The last n bytes of a stream."""
    return F.substring(content, F.greatest(F.octet_length(content) - n + 1, F.lit(1)), F.lit(n))


def ranged_digest(content: Column, offset: int, length: int) -> Column:
    """SHA-256 of `length` bytes of content from `offset`."""
    return F.sha2(F.substring(content, F.lit(offset + 1), F.lit(length)), 256)


def point(df: DataFrame, key: dict[str, object], generation: tuple[str, float]) -> DataFrame:
    """The row at a key that belongs to the wanted generation; both predicates reach the scan."""
    for name, value in (key | {generation[0]: generation[1]}).items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def bounded_scan(df: DataFrame, where: Column, order: Sequence[Column], max_rows: int) -> DataFrame:
    """The first max_rows rows that match, each with `complete`: whether these are all.

    One row more than asked is taken, a distributed top-k, so completeness costs no second scan.
    """
    taken = df.where(where).orderBy(*order).limit(max_rows + 1)
    place = F.row_number().over(_everything(order))
    total = F.count(F.lit(1)).over(_everything())
    return taken.withColumn("place", place).withColumn("complete", total <= max_rows).where(F.col("place") <= max_rows).drop("place")


def _everything(order: Sequence[Column] = ()):
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0))
    return w.orderBy(*order) if order else w


def first_layout(*captures: DataFrame, key: str) -> DataFrame:
    """Rows of several layouts of one capture; per key the earliest layout that has it wins."""
    from functools import reduce

    tagged = [c.withColumn("layout", F.lit(i)) for i, c in enumerate(captures)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = both.groupBy(key).agg(F.min_by(F.struct(*both.columns), "layout").alias("r"))
    return best.select("r.*")


def holds(records: DataFrame, hosts: DataFrame) -> DataFrame:
    """Each host's hold from its record: open if absent, closed if unreadable or malformed, else as the record says."""
    state = (
        F.when(F.col("raw").isNull() & F.col("readable").isNull(), F.lit("open"))
        .when(~F.coalesce("readable", F.lit(False)) | F.col("fault").isNotNull(), F.lit("closed"))
        .when(F.get_json_object("raw", "$.held") == "true", F.lit("closed"))
        .otherwise(F.lit("open"))
    )
    marked = records.withColumn("fault", json_fault(F.col("raw")))
    return hosts.join(marked, "host", "left").select("host", state.alias("hold"))


def backfill(spark: SparkSession, path: str, schema: str, checkpoint: str, out: str, files_per_step: int) -> None:
    """One restartable pass over a folder of records in bounded steps: the checkpoint is the cursor, so a rerun takes up where it stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).json(path)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
