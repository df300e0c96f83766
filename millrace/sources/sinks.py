"""Writes: publish if absent, append-only journals, facet indexes, dictionary-coded maps and rendered reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def publish_new(new: DataFrame, existing: DataFrame, keys: Sequence[str], path: str) -> None:
    """Appends the rows whose key is not there yet; of several new rows with a key the smallest is the first writer."""
    order = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys])
    first = new.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    first.join(existing.select(*keys), list(keys), "left_anti").write.mode("append").parquet(path)


def conflicts(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key exists with another body: publishing them again would be a conflict, not a repeat."""
    body = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys))), 256)
    there = existing.select(*keys, body(existing).alias("there"))
    return new.withColumn("here", body(new)).join(there, list(keys)).where("here <> there").drop("here", "there")


def index_by_facets(records: DataFrame, facets: Sequence[str], path: str) -> None:
    """One row per record and facet, partitioned by facet and day, so that a lookup by either prunes to its partitions."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("facet_value")) for f in facets])
    rows = records.withColumn("pair", F.explode(pairs)).where("pair.facet_value IS NOT NULL").select("*", "pair.*").drop("pair")
    rows = rows.withColumn("day", F.to_date(F.timestamp_seconds("published_unix")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("facet", "day").parquet(path)


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def dictionary_map(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions(id, function), tests(test, ids)) of records(test, function): ids number the functions in order, so the same records give the same bytes."""
    # numbers by rank within ranges of the sorted dictionary would need a second pass; the dictionary has a row per function
    functions = records.select("function").distinct().withColumn("id", F.row_number().over(Window.orderBy("function")) - 1)
    tests = records.distinct().join(functions, "function").groupBy("test").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return functions.select("id", "function"), tests


def mixed_sources(records: DataFrame) -> DataFrame:
    """Files that the merged records give two hashes: a map of them would mix commits."""
    return records.groupBy("path").agg(F.count_distinct("sha").alias("hashes")).where("hashes > 1")


def table_lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Each row as one line of fixed-width cells."""
    return df.select(F.rtrim(F.concat_ws("  ", *[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()])).alias("line"))


def markdown(df: DataFrame, limit: int = 100) -> str:
    """The first rows of a ranked report as a Markdown table; where there are more than limit, a last line says so."""
    clean = lambda v: str("" if v is None else v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    found = df.limit(limit + 1).collect()
    rows = [df.columns, ["---"] * len(df.columns), *([clean(v) for v in r] for r in found[:limit])]
    more = [f"\nOnly the first {limit} rows are shown."] if len(found) > limit else []
    return "\n".join(["| " + " | ".join(r) + " |" for r in rows] + more)
