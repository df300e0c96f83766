"""Token ledgers as tables: what a batch of requests would do to them. Locks and renames are no part of this."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def take(tokens: DataFrame, demand: DataFrame, holder: str) -> DataFrame:
    """tokens(kind, n, holder) after holder takes demand(kind, need) of the free ones, lowest numbers first; all or nothing."""
    w = Window.partitionBy("kind", F.col("holder").isNull()).orderBy("n")
    free = tokens.withColumn("nth", F.when(F.col("holder").isNull(), F.row_number().over(w)))
    have = tokens.where("holder IS NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("have"))
    enough = demand.join(have, "kind", "left").agg(F.coalesce(F.bool_and(F.coalesce("have", F.lit(0)) >= F.col("need")), F.lit(True)).alias("enough"))
    out = free.join(demand, "kind", "left").join(F.broadcast(enough))
    return out.select("kind", "n", F.when(F.col("enough") & (F.col("nth") <= F.col("need")), F.lit(holder)).otherwise(F.col("holder")).alias("holder"))


def handover(tokens: DataFrame, source: str, target: str, names: DataFrame) -> DataFrame:
    """Named tokens(kind, n) of source go to target."""
    out = tokens.join(names.select("kind", "n", F.lit(True).alias("named")), ["kind", "n"], "left")
    return out.withColumn("holder", F.when(F.col("named") & (F.col("holder") == source), F.lit(target)).otherwise(F.col("holder"))).drop("named")


def release_unspent(tokens: DataFrame, holder: str, keep: DataFrame) -> DataFrame:
    """A holder keeps `keep` tokens of each kind, lowest numbers first; the rest are free."""
    nth = F.row_number().over(Window.partitionBy("kind", "holder").orderBy("n"))
    out = tokens.withColumn("nth", nth).join(keep, "kind", "left")
    return out.select("kind", "n", F.when((F.col("holder") == holder) & (F.col("nth") > F.coalesce("keep", F.lit(0))), F.lit(None)).otherwise(F.col("holder")).alias("holder"))


def reclaim_idle(tokens: DataFrame, idle: DataFrame) -> DataFrame:
    """Tokens of idle holders become free."""
    return tokens.join(idle.select("holder", F.lit(True).alias("idle")), "holder", "left").withColumn("holder", F.when(F.col("idle").isNull(), F.col("holder"))).select("kind", "n", "holder")


def reconcile(ledger: DataFrame, mirror: DataFrame, live: DataFrame) -> DataFrame:
    """What a mirror(holder, kind, amount) needs to match a ledger's live holders: upsert or delete, with the amount."""
    want = ledger.join(live, "holder", "left_semi").select("holder", "kind", F.col("amount").alias("want"))
    both = want.join(mirror.select("holder", "kind", F.col("amount").alias("have")), ["holder", "kind"], "full")
    action = F.when(F.col("want").isNull(), "delete").when(~F.col("want").eqNullSafe(F.col("have")), "upsert")
    return both.withColumn("action", action).where("action IS NOT NULL")


def resurrect(dead: DataFrame, live: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first dead tokens(kind, name) per kind that bring the live count to wanted(kind, n)."""
    have = live.groupBy("kind").agg(F.count(F.lit(1)).alias("have"))
    need = wanted.join(have, "kind", "left").select("kind", (F.col("n") - F.coalesce("have", F.lit(0))).alias("need"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("name"))
    return dead.withColumn("nth", nth).join(need, "kind").where("nth <= need").select("kind", "name")


def token_counts(tokens: DataFrame) -> DataFrame:
    """Per kind its capacity and the available and held tokens."""
    return tokens.groupBy("kind").agg(F.count(F.lit(1)).alias("capacity"), F.count_if(F.col("holder").isNull()).alias("available"), F.count("holder").alias("held"))
