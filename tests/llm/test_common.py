from collections import Counter

from pyspark.sql import functions as F

from millrace.llm.common import keyed_join


def test_keyed_join_by_each_way(spark):
    """Hot keys, cold keys, keys without facts and null keys, by broadcast alone and by the spread join."""
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 900).cast("string")).alias("k"))
    counted = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most")).where("k <> '7'")
    expected = Counter(tuple(r) for r in rows.join(counted.drop("n"), "k", "left").select("id", "k", "most").collect())
    for n in (None, 1):
        got = keyed_join(rows, counted, "k", "n", 5000, n).select("id", "k", "most").collect()
        assert Counter(map(tuple, got)) == expected
