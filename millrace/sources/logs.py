"""Log lines, test reports and label graphs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALL = r"^(\d+) +(\d+\.\d+) +(\w+)\((.*)$"
RESUMED = r"^(\d+) +(\d+\.\d+) +<\.\.\. (\w+) resumed>(.*)$"


def completed_calls(lines: DataFrame) -> DataFrame:
    """System calls of a trace with lines(seq, value): pid, call, begun, ended, text.

    A line that ends in <unfinished ...> is joined with the next <... call resumed> of its pid and call; a resumption without
    a beginning and a beginning without an end are dropped.
    """
    resumed = F.col("value").rlike(RESUMED)
    pick = lambda n: F.when(resumed, F.regexp_extract("value", RESUMED, n)).otherwise(F.regexp_extract("value", CALL, n))
    rows = lines.where(F.col("value").rlike(CALL) | resumed).select(
        "seq", pick(1).cast("long").alias("pid"), pick(2).cast("double").alias("at"), pick(3).alias("call"), pick(4).alias("rest"), resumed.alias("resumed")
    )
    rows = rows.withColumn("open", F.endswith("rest", F.lit("<unfinished ...>")))
    w = Window.partitionBy("pid", "call").orderBy("seq")
    rows = rows.withColumn("was", F.lag(F.struct("at", "rest", "open")).over(w))
    paired = F.col("resumed") & F.col("was.open")
    return rows.where(~F.col("open") & (~F.col("resumed") | paired)).select(
        "seq", "pid", "call", F.when(paired, F.col("was.at")).otherwise(F.col("at")).alias("begun"), F.col("at").alias("ended"),
        F.when(paired, F.concat(F.regexp_replace("was.rest", r" *<unfinished \.\.\.>$", ""), F.col("rest"))).otherwise(F.col("rest")).alias("text"),
    )


def shared_path(text, folder=None):
    """The path that a call's text names: the first quoted absolute one, or one relative to the folder of an annotated descriptor."""
    quoted = F.regexp_extract(text, r'"([^"]*)"', 1)
    base = F.regexp_extract(text, r"^\d+<([^>]*)>", 1)
    return F.when(F.startswith(quoted, F.lit("/")), quoted).when((quoted != "") & (base != ""), F.concat(base, F.lit("/"), quoted)).when(base != "", base)


def mounts(lines: DataFrame) -> DataFrame:
    """Rows of a mount table (lines(value)): mount_id, parent_id, device, root, point, kind, source; octal escapes undone."""
    part = F.split("value", " - ")
    left, right = F.split(part[0], " "), F.split(part[1], " ")
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\040"), F.lit(" ")), F.lit("\\011"), F.lit("\t")), F.lit("\\012"), F.lit("\n")), F.lit("\\134"), F.lit("\\"))
    return lines.where(F.size(part) == 2).select(
        left[0].cast("int").alias("mount_id"), left[1].cast("int").alias("parent_id"), left[2].alias("device"), plain(left[3]).alias("root"), plain(left[4]).alias("point"), right[0].alias("kind"), plain(right[1]).alias("source")
    )


def process_stats(files: DataFrame) -> DataFrame:
    """Captured stat files of processes, files(path, text), as pid, name, state, parent, cpu_ticks, started, resident_pages; what is no such file is dropped.

    The name stands in parentheses and may hold spaces and parentheses itself, so fields are counted from the last one.
    """
    rest = F.split(F.regexp_extract("text", r"(?s)^.*\) (.*)$", 1), r"\s+")
    field = lambda n: F.get(rest, F.lit(n - 3)).try_cast("long")  # noqa: E731  as numbered in the manual, from 1
    rows = files.select(
        F.regexp_extract("text", r"^(\d+) \(", 1).try_cast("long").alias("pid"), F.regexp_extract("text", r"(?s)^\d+ \((.*)\) ", 1).alias("name"), F.get(rest, F.lit(0)).alias("state"),
        field(4).alias("parent"), (field(14) + field(15)).alias("cpu_ticks"), field(22).alias("started"), field(24).alias("resident_pages"),
    )
    return rows.where("pid IS NOT NULL AND started IS NOT NULL")


def process_arguments(files: DataFrame) -> DataFrame:
    """Captured command lines of processes, files(path, text) with the pid in the path, as pid and argv."""
    argv = F.split(F.rtrim("text", F.lit("\0")), "\0")
    return files.where("text <> ''").select(F.regexp_extract("path", r"/(\d+)/cmdline$", 1).try_cast("long").alias("pid"), argv.alias("argv")).where("pid IS NOT NULL")


def junit(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of JUnit reports: file, node, seconds, outcome (passed, failed, error or skipped)."""
    schema = "_file string, _classname string, _name string, _time double, failure string, error string, skipped string"
    cases = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\x00").schema(schema).load(path)
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return cases.select(F.col("_file").alias("file"), F.concat_ws("::", F.coalesce("_file", "_classname"), "_name").alias("node"), F.col("_time").alias("seconds"), outcome.alias("outcome"))


def over_budget(cases: DataFrame, budgets: DataFrame, default: float) -> DataFrame:
    """Files whose summed seconds exceed their budget(file, budget), or the default where none is set."""
    spent = cases.groupBy("file").agg(F.sum("seconds").alias("seconds"))
    return spent.join(budgets, "file", "left").withColumn("budget", F.coalesce("budget", F.lit(default))).where("seconds > budget")


def edges(documents: DataFrame) -> DataFrame:
    """Edges of documents(label, deps array): src, dst; repeated ones once."""
    return documents.select(F.col("label").alias("src"), F.explode("deps").alias("dst")).distinct()


def shard_results(shards: DataFrame, expected: DataFrame) -> DataFrame:
    """Faults of collected shards(shard, complete, node) against expected(shard): a missing or partial shard, a node of two shards."""
    per = shards.groupBy("shard").agg(F.bool_and("complete").alias("complete"))
    missing = expected.join(per, "shard", "left").where("complete IS NULL").select(F.col("shard").cast("string").alias("subject"), F.lit("missing shard").alias("fault"))
    partial = per.where("NOT complete").select(F.col("shard").cast("string").alias("subject"), F.lit("partial shard").alias("fault"))
    twice = shards.groupBy("node").agg(F.count_distinct("shard").alias("n")).where("n > 1").select(F.col("node").cast("string").alias("subject"), F.lit("node in several shards").alias("fault"))
    return missing.unionByName(partial).unionByName(twice)
