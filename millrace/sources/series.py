"""Time series in daily CSV files and chart documents."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_DAYS = 3


def days(start_unix: float, end_unix: float, limit: int = MAX_DAYS) -> list[date]:
    """The UTC days that a window touches; a window of more than `limit` days is refused."""
    first = datetime.fromtimestamp(start_unix, timezone.utc).date()
    last = datetime.fromtimestamp(end_unix, timezone.utc).date()
    out = [first + timedelta(n) for n in range((last - first).days + 1)]
    if not out or len(out) > limit:
        raise ValueError(f"a window of {len(out)} days")
    return out


def csv_series(spark: SparkSession, folder: str, host: str, start_unix: float, end_unix: float, columns: Sequence[str]) -> DataFrame:
    """Samples of a host in [start, end] from files named {host}-{day}*.csv: epoch_ms, the columns as doubles, file and row.

    Only the window's days are listed. A torn row (an unreadable time) is skipped, an empty or unreadable cell is null; `row`
    keeps the order of appending within a file.
    """
    globs = [f"{folder}/{host}-{day.isoformat()}*.csv" for day in days(start_unix, end_unix)]
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(globs)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)") if c in raw.columns else F.lit(None).cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    at = F.expr("try_cast(epoch_ms AS BIGINT)")
    rows = raw.select(at.alias("epoch_ms"), *[finite(number(c)).alias(c) for c in columns], F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"))
    return rows.where((F.col("epoch_ms") >= int(start_unix * 1000)) & (F.col("epoch_ms") <= int(end_unix * 1000)))


def newest_first(series: DataFrame) -> DataFrame:
    return series.orderBy(F.desc("file"), F.desc("row"))


class ChartSource(DataSource):
    """Reads chart documents {labels, data} as rows (time, dimension, value); options path (JSON files' text comes by Spark), after and before."""

    @classmethod
    def name(cls) -> str:
        return "chart"

    def schema(self) -> str:
        return "time double, dimension string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _ChartReader(self.options)


class _ChartReader(DataSourceReader):
    def __init__(self, options):
        self.document, self.after, self.before = options["document"], float(options.get("after", "-inf")), float(options.get("before", "inf"))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        import json

        doc = json.loads(self.document)
        for row in doc["data"]:
            if self.after <= row[0] <= self.before:
                for name, value in zip(doc["labels"][1:], row[1:]):
                    yield (float(row[0]), name, None if value is None else float(value))


def charts(spark: SparkSession, path: str, after: float, before: float) -> DataFrame:
    """Chart documents {labels, data} of the JSON files under path, many at a time: file, time, dimension, value of the rows from after to before."""
    document = F.from_json("value", "labels array<string>, data array<array<double>>")
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), document.alias("d"))
    rows = docs.select("file", "d.labels", F.explode("d.data").alias("row")).withColumn("time", F.get("row", F.lit(0))).where(F.col("time").between(after, before))
    cells = F.slice(F.arrays_zip(F.col("labels").alias("dimension"), F.col("row").alias("value")), 2, F.size("labels") - 1)
    return rows.select("file", "time", F.inline(cells))


def chart_totals(samples: DataFrame, idle: Sequence[str] = ("idle", "iowait")) -> DataFrame:
    """Mean and peak over time of the sum of the dimensions that are not idle; times with a missing dimension are left out."""
    busy = samples.where(~F.col("dimension").isin(*idle))
    per = busy.groupBy("time").agg(F.when(F.count(F.lit(1)) == F.count("value"), F.sum("value")).alias("v")).where("v IS NOT NULL")
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.max("v").alias("peak"))
