"""Splits, bags and folds: every draw is a function of a row's id, so a rerun makes the same one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrove.functions.arithmetic import draw, uniform


#: Slices of the draw in which rows are ranked: of a class, and of a whole table.
SLICES, WHOLE = 64, 1024


def ranked(df: DataFrame, row_id: str, keys: list[str], salt: int = 0, slices: int = SLICES, order: Column | None = None) -> DataFrame:
    """Adds ``__at`` (from 1, in order of the draw's slice, the draw, the id) and ``__n``, within the keys.

    Rows are numbered in windows per slice of the draw, and slices are offset
    by their sizes, so that a group of any size is spread over tasks.
    """
    drawn = df.withColumn("__draw", draw(row_id, salt) if order is None else order).withColumn("__slice", (F.col("__draw") % slices).cast("int"))
    sizes = drawn.groupBy(*keys, "__slice").agg(F.count("*").alias("__k"))  # ``slices`` rows a group
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.select(*keys, "__slice", F.coalesce(F.sum("__k").over(group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__k").over(group).alias("__n"))
    w = Window.partitionBy(*keys, "__slice").orderBy("__draw", row_id)
    numbered = drawn.withColumn("__own", F.row_number().over(w))
    same = F.lit(True)
    offsets = offsets.withColumnsRenamed({k: f"__k_{i}" for i, k in enumerate(keys)} | {"__slice": "__s"})
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
    joined = numbered.join(offsets, same & (F.col("__slice") == F.col("__s")))
    return joined.withColumn("__at", F.col("__own") + F.col("__before")).drop("__draw", "__slice", "__own", "__before", "__s", *[f"__k_{i}" for i in range(len(keys))])


def stratified_split(df: DataFrame, row_id: str, label: str, train: float = 0.7, valid: float = 0.15, salt: int = 0) -> DataFrame:
    """Adds ``part``: each class is cut at floor(size * ratio), at least one row for train and valid, the rest to test."""
    n_train = F.greatest(F.floor(F.col("__n") * train), F.lit(1))
    n_valid = F.greatest(F.floor(F.col("__n") * valid), F.lit(1))
    part = F.when(F.col("__at") <= n_train, "train").when(F.col("__at") <= n_train + n_valid, "valid").otherwise("test")
    return ranked(df, row_id, [label], salt).withColumn("part", part).drop("__at", "__n")


def random_split(df: DataFrame, row_id: str, train: float = 0.7, test: float = 0.15, validate: bool = True, salt: int = 0) -> DataFrame:
    """Adds ``part``: exactly floor(n * ratio) rows to train and test; what is left goes to valid, or to test without one."""
    n_train, n_test = F.floor(F.col("__n") * train), F.floor(F.col("__n") * test)
    part = F.when(F.col("__at") <= n_train, "train").when(F.col("__at") <= n_train + n_test, "test").otherwise("valid" if validate else "test")
    return ranked(df, row_id, [], salt, WHOLE).withColumn("part", part).drop("__at", "__n")


def bootstrap(n: int, trees: int, spark, salt: int = 0, cap: int | None = None, replacement: bool = True, nonce: int = 0) -> DataFrame:
    """(tree_id, row, weight): n draws with replacement a tree, or floor(0.632 n) distinct rows without."""
    if not replacement:
        rows = spark.range(n).withColumnRenamed("id", "row")
        each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id"), "row")
        key = draw(f"row * 131 + tree_id * 7919 + {nonce * 104_729}", salt)
        return ranked(each, "row", ["tree_id"], slices=WHOLE, order=key).where(F.col("__at") <= math.floor(0.632 * n)).select("tree_id", "row", F.lit(1).cast("long").alias("weight"))
    key = "id" if not nonce else f"id + {nonce * n * trees}"
    draws = spark.range(n * trees).select((F.col("id") % trees).cast("int").alias("tree_id"), F.floor(uniform(key, salt) * n).cast("long").alias("row"))
    bags = draws.groupBy("tree_id", "row").agg(F.count("*").alias("weight"))
    return bags.withColumn("weight", F.least("weight", F.lit(cap))) if cap else bags


def patched_bag(n: int, tree: int, draws: int, spark) -> DataFrame:
    """The bag of a tree whose draws keep repeating another's: five moved ids, then the ids in turn."""
    k = spark.range(draws).select(F.col("id").alias("k"))
    row = F.when(F.col("k") < 5, (2 * F.col("k") + tree) % n).otherwise(F.col("k") % n)
    return k.select(F.lit(tree).cast("int").alias("tree_id"), row.alias("row")).groupBy("tree_id", "row").agg(F.count("*").alias("weight"))


def unique_bags(n: int, trees: int, spark, salt: int = 0, tries: int = 8, replacement: bool = True) -> DataFrame:
    """Bootstrap bags of which no two are equal: a bag that repeats an earlier tree's is drawn anew, then patched.

    What reaches the driver is one hash a tree.
    """
    from quantgrove.operators.idset import fingerprint

    chosen, seen = dict.fromkeys(range(trees), 0), {}
    for nonce in range(tries + 1):
        open_ = [t for t in range(trees) if t not in seen]
        if not open_:
            break
        hashes = fingerprint(bootstrap(n, trees, spark, salt, None, replacement, nonce).where(F.col("tree_id").isin(open_))).collect()
        taken = set(seen.values())
        for r in sorted(hashes, key=lambda r: r["tree_id"]):
            if (h := r["bag_hash"]) not in taken:
                seen[r["tree_id"]], chosen[r["tree_id"]] = h, nonce
                taken.add(h)
    out = None
    for nonce in sorted({chosen[t] for t in seen}):
        some = bootstrap(n, trees, spark, salt, None, replacement, nonce).where(F.col("tree_id").isin([t for t in seen if chosen[t] == nonce]))
        out = some if out is None else out.unionByName(some)
    for t in sorted(set(range(trees)) - set(seen)):
        out = patched_bag(n, t, n, spark) if out is None else out.unionByName(patched_bag(n, t, n, spark))
    return out


def save_bags(bags: DataFrame, path: str) -> None:
    """One folder a tree, so that a tree's bag is read alone."""
    bags.repartition("tree_id").write.mode("overwrite").partitionBy("tree_id").parquet(path)


def load_bags(spark, path: str) -> DataFrame:
    return spark.read.schema("row long, weight long, tree_id int").parquet(path).select("tree_id", "row", "weight")


def distinct_sample(df: DataFrame, row_id: str, k: int, salt: int = 0) -> DataFrame:
    """k rows without repeats: those of the smallest draws. Only k rows of each task move."""
    return df.orderBy(draw(row_id, salt), row_id).limit(k)


def shuffled(df: DataFrame, row_id: str, salt: int = 0) -> DataFrame:
    """Adds ``place``, from 0: a permutation that the seed fixes."""
    return ranked(df, row_id, [], salt, WHOLE).withColumn("place", F.col("__at") - 1).drop("__at", "__n")


def poisson_bags(df: DataFrame, row_id: str, trees: int, salt: int = 0, cap: int = 7) -> DataFrame:
    """The table once per tree with a Poisson(1) weight from the row's draw: bagging without a shuffle."""
    u = uniform(f"{row_id} * 131 + tree_id * 7919", salt)
    weight, term, total = F.lit(0), 0.36787944117144233, 0.0
    for k in range(cap):
        total += term
        weight = weight + (u >= total).cast("int")
        term /= k + 1
    each = df.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return each.withColumn("weight", weight).where("weight > 0")


def out_of_bag(rows: DataFrame, bags: DataFrame, trees: int) -> DataFrame:
    """(tree_id, row) pairs where the tree's bag lacks the row."""
    return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree_id")).join(bags.select("tree_id", "row"), ["tree_id", "row"], "left_anti")


def folds(df: DataFrame, row_id: str, k: int = 4, salt: int = 0) -> DataFrame:
    """Adds ``fold``: runs of floor(n / k) rows of the shuffled table; the last fold takes the remainder."""
    size = F.greatest(F.floor(F.col("__n") / k), F.lit(1))
    return ranked(df, row_id, [], salt, WHOLE).withColumn("fold", F.least(F.floor((F.col("__at") - 1) / size), F.lit(k - 1)).cast("int")).drop("__at", "__n")


def feature_subset(features: int, nodes: DataFrame, k: int, salt: int = 0) -> DataFrame:
    """k features for each (tree_id, node), by draw."""
    each = nodes.select("tree_id", "node", F.explode(F.sequence(F.lit(0), F.lit(features - 1))).alias("feature"))
    order = draw("tree_id * 100003 + node * 1009 + feature * 17", salt)
    return each.withColumn("__r", F.row_number().over(Window.partitionBy("tree_id", "node").orderBy(order, "feature"))).where(F.col("__r") <= k).drop("__r")
