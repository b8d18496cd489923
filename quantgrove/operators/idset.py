"""Multisets of ids as (id, cnt) tables; counts saturate at a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset(df: DataFrame, column: str, cap: int | None = None) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("cnt"))
    return counted.withColumn("cnt", F.least("cnt", F.lit(cap).cast("long"))) if cap else counted


def _both(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    return a.select("id", F.col("cnt").alias("ca")).join(b.select("id", F.col("cnt").alias("cb")), "id", how)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The larger count of each id."""
    return _both(a, b, "full").select("id", F.greatest(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0))).alias("cnt"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smaller count of each id."""
    return _both(a, b, "inner").select("id", F.least("ca", "cb").alias("cnt"))


def plus(a: DataFrame, b: DataFrame, cap: int) -> DataFrame:
    """a, and one more of each id that b has, up to the cap."""
    one = F.when(F.coalesce("cb", F.lit(0)) > 0, 1).otherwise(0)
    return _both(a, b, "full").select("id", F.least(F.coalesce("ca", F.lit(0)) + one, F.lit(cap)).cast("long").alias("cnt"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of a's instances of ids that b lacks."""
    return a.join(b.select("id"), "id", "left_anti")


def is_subset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether no count of a exceeds b's."""
    over = _both(a, b, "left").where(F.col("ca") > F.coalesce("cb", F.lit(0)))
    return over.agg((F.count("*") == 0).alias("subset"), F.count("*").alias("exceeding"))


def is_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    differ = _both(a, b, "full").where(~F.col("ca").eqNullSafe(F.col("cb")))
    return differ.agg((F.count("*") == 0).alias("equal"))


def items(a: DataFrame) -> DataFrame:
    """Ids with repeats."""
    return a.select("id", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))).alias("copy"))


def summary(a: DataFrame) -> DataFrame:
    """Size, unique size, smallest and largest id."""
    return a.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("size"), F.count("*").alias("unique_size"), F.min("id").alias("low"), F.max("id").alias("high"))


def without(a: DataFrame, ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Erase all instances of some ids or of a range."""
    gone = F.lit(False)
    if ids:
        gone = gone | F.col("id").isin(ids)
    if low is not None and high is not None:
        gone = gone | F.col("id").between(low, high)
    return a.where(~gone)


def fingerprint(bags: DataFrame) -> DataFrame:
    """Order-free hash of each tree's bag; equal hashes mean bags that repeat."""
    return bags.groupBy("tree_id").agg(F.bit_xor(F.xxhash64("row", "weight")).alias("bag_hash"), F.sum("weight").alias("size"))


def insert_range(a: DataFrame, low: int, high: int, cap: int) -> DataFrame:
    """One more of each id from low to high, up to the cap."""
    more = a.sparkSession.range(low, high + 1).select("id", F.lit(1).cast("long").alias("cnt"))
    return plus(a, more, cap)


def fill(spark, low: int, high: int, cnt: int = 1) -> DataFrame:
    """Every id from low to high, as often."""
    return spark.range(low, high + 1).select("id", F.lit(cnt).cast("long").alias("cnt"))


def erase_one(a: DataFrame, ids: list[int]) -> DataFrame:
    """One instance less of some ids."""
    return a.withColumn("cnt", F.col("cnt") - F.col("id").isin(ids).cast("long")).where("cnt > 0")


def nth(a: DataFrame, n: int) -> DataFrame:
    """The n-th id from 0 in ascending order with repeats; no row beyond the end.

    Ids are counted by a range sort first, so that only the part that holds the
    place is looked into.
    """
    from quantgrove.operators.feedback import numbered

    parts = a.repartitionByRange("id").sortWithinPartitions("id").select("id", "cnt", F.spark_partition_id().alias("part"))
    sizes = parts.groupBy("part").agg(F.sum("cnt").alias("k"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("part").collect()  # a row a part
    before = 0
    for r in sizes:
        if n < before + r["k"]:
            own = numbered(items(a.where(F.col("id").between(r["low"], r["high"]))), ["id", "copy"])
            return own.where(F.col("pos") == n - before).select("id")
        before += r["k"]
    return a.select("id").limit(0)
