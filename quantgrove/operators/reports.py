"""Assessment: what quantising costs and saves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compression(df: DataFrame, features: Sequence[str], bits: int) -> DataFrame:
    """Rows, bytes as text, bytes packed (4 + 2 header, 1 label + bits a row), and their ratio."""
    text = F.lit(len(features)).cast("long")
    for f in features:
        text = text + F.length(F.col(f).cast("string"))
    packed = 1 + -(-len(features) * bits // 8)
    out = df.agg(F.count("*").alias("rows"), F.sum(text).alias("text_bytes"))
    return out.select("rows", "text_bytes", (F.lit(6) + F.col("rows") * packed).alias("packed_bytes"))


def separation(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean distance between class centroids over mean distance of rows to their own."""
    centroids = df.groupBy(label).agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    a, b = centroids.select(F.col(label).alias("la"), *[F.col(f"c_{f}").alias(f"a_{f}") for f in features]), centroids.select(F.col(label).alias("lb"), *[F.col(f"c_{f}").alias(f"b_{f}") for f in features])
    square = lambda x, y: (x - y) * (x - y)
    between = F.sqrt(sum((square(F.col(f"a_{f}"), F.col(f"b_{f}")) for f in features), F.lit(0.0)))
    inter = a.join(b, F.col("la") < F.col("lb")).agg(F.avg(between).alias("inter"))  # pairs of classes
    within = F.sqrt(sum((square(F.col(f), F.col(f"c_{f}")) for f in features), F.lit(0.0)))
    intra = df.join(centroids, label).agg(F.avg(within).alias("intra"))
    return inter.crossJoin(intra).withColumn("score", F.when(F.col("intra") > 0, F.col("inter") / F.col("intra")).otherwise(0.0))


def verdict(retained_accuracy: Column, retained_separation: Column) -> Column:
    low, high = F.least(retained_accuracy, retained_separation), F.greatest(retained_accuracy, retained_separation)
    return F.when(low >= 90, "recommended").when(low >= 80, "acceptable").when(high >= 70, "trade-off").otherwise("original")


def explained_variance(df: DataFrame, features: Sequence[str]) -> list[float]:
    """Shares of variance along principal axes, from one aggregate of products (numpy on a matrix of the features' size)."""
    import numpy as np

    n = len(features)
    sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]
    products = [F.avg(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)]
    r = df.agg(*sums, *products).first()
    m = np.array([r[f"m{i}"] for i in range(n)])
    c = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] - m[i] * m[j] for j in range(n)] for i in range(n)])
    values = np.sort(np.linalg.eigvalsh(c))[::-1]
    return (values / values.sum()).tolist()


def node_regression(grid: DataFrame) -> DataFrame:
    """Least-squares plane of max_nodes on (min_split, min_leaf, max_depth): coefficients from sums of products."""
    import numpy as np

    names = ["min_split", "min_leaf", "max_depth"]
    x = [F.lit(1.0)] + [F.col(c).cast("double") for c in names]
    y = F.col("max_nodes").cast("double")
    cells = [F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)] + [F.sum(a * y).alias(f"t{i}") for i, a in enumerate(x)]
    r = grid.agg(*cells, *[(F.max(c) - F.min(c)).alias(f"v_{c}") for c in names]).first()
    use = [0] + [i + 1 for i, c in enumerate(names) if (r[f"v_{c}"] or 0) > 0]
    a = np.array([[r[f"s{i}_{j}"] for j in use] for i in use]) + 1e-8 * np.eye(len(use))
    beta = np.zeros(4)
    beta[use] = np.linalg.solve(a, np.array([r[f"t{i}"] for i in use]))
    return grid.sparkSession.createDataFrame([tuple(float(b) for b in beta)], "intercept double, min_split double, min_leaf double, max_depth double")


def node_effects(grid: DataFrame) -> DataFrame:
    """Coefficients from the first and last level of each setting alone: intercept, min_split, min_leaf, accuracy.

    An effect is the difference of the mean node counts at the last and first
    level over the levels' distance; accuracy is 100 less the error's share of
    all nodes in per cent, cut to a whole number.
    """
    valid = grid.where("min_split > 0 and min_leaf > 0 and max_depth > 0 and max_nodes > 0")
    ends = valid.agg(F.min("min_split").alias("s0"), F.max("min_split").alias("s1"), F.min("min_leaf").alias("l0"), F.max("min_leaf").alias("l1"), F.avg("max_nodes").alias("mean"))
    rows = valid.crossJoin(ends)  # one row of ends
    at = lambda c, level: F.avg(F.when(F.col(c) == F.col(level), F.col("max_nodes")))
    one = rows.groupBy("s0", "s1", "l0", "l1", "mean").agg(at("min_split", "s0").alias("a0"), at("min_split", "s1").alias("a1"), at("min_leaf", "l0").alias("b0"), at("min_leaf", "l1").alias("b1"))
    effect = lambda hi, lo, y, x: F.when(F.col(hi) > F.col(lo), (F.col(y) - F.col(x)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0))).otherwise(0.0)
    one = one.withColumns({"split": effect("s1", "s0", "a1", "a0"), "leaf": effect("l1", "l0", "b1", "b0")})
    one = one.select((F.col("mean") - F.col("split") * F.col("s0") - F.col("leaf") * F.col("l0")).alias("intercept"), "split", "leaf")
    guess = F.greatest(F.col("intercept") + F.col("split") * F.col("min_split") + F.col("leaf") * F.col("min_leaf"), F.lit(10.0))
    error = valid.crossJoin(one).agg((F.sum(F.abs(guess - F.col("max_nodes"))) / F.sum("max_nodes") * 100).alias("mape"))
    return one.crossJoin(error).select("intercept", F.col("split").alias("min_split"), F.col("leaf").alias("min_leaf"), F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - F.col("mape")))).cast("int").alias("accuracy"))


def manual_estimate(min_split: Column, min_leaf: Column, max_depth: Column, rows: Column, features: Column, labels: Column) -> Column:
    """Nodes of a tree by rule of thumb, from its settings and the size of the data."""
    by_rows = F.when(rows > 100, F.least(F.lit(2.5), 1 + 0.5 * F.log2(rows / 100))).otherwise(1.0)
    by_features = F.when(features > 10, F.least(F.lit(2.0), 1 + 0.3 * F.log2(features / 10))).otherwise(1.0)
    by_labels = F.when(labels > 2, F.least(F.lit(1.5), 0.8 + 0.2 * labels / 10)).otherwise(1.0)
    base = 120 - min_split * 10 + 60 / F.greatest(F.lit(1), min_leaf) + F.least(F.lit(250), max_depth) / 50 * 15
    return F.when(min_split == 0, 100.0).otherwise(F.greatest(F.lit(10.0), base * by_rows * by_features * by_labels))


def save_node_predictor(spark, path: str, coefficients: Sequence[float], rows: int) -> None:
    spark.createDataFrame([(*map(float, coefficients), rows)], "intercept double, min_split double, min_leaf double, max_depth double, rows long").coalesce(1).write.mode("overwrite").json(path)


def load_node_predictor(spark, path: str) -> tuple[tuple[float, ...], int]:
    r = spark.read.schema("intercept double, min_split double, min_leaf double, max_depth double, rows long").json(path).first()
    return tuple(r[:4]), r["rows"]


def node_estimate(coefficients: Sequence[float], fitted_rows: int, min_split: Column, min_leaf: Column, max_depth: Column, rows: Column, features: Column, labels: Column) -> Column:
    """The fitted plane, at least 10, scaled by the change in rows; the rule of thumb where that change is too large."""
    b = coefficients
    plane = F.greatest(F.lit(10.0), F.lit(b[0]) + b[1] * min_split + b[2] * min_leaf + b[3] * max_depth)
    return guarded_estimate(plane, manual_estimate(min_split, min_leaf, max_depth, rows, features, labels), rows, F.lit(fitted_rows))


def memory_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """seconds, free_heap, largest_block, free_disk, event of a memory log; the header and torn lines are left out."""
    from quantgrove.sources.csv import cells

    c = cells(F.col(line))
    rows = lines.select(c.alias("c")).where(F.size("c") == 5)
    number = lambda i, kind: F.element_at("c", i).try_cast(kind)
    return rows.select(number(1, "double").alias("seconds"), number(2, "long").alias("free_heap"), number(3, "long").alias("largest_block"), number(4, "long").alias("free_disk"), F.element_at("c", 5).alias("event")).where("seconds is not null")


def memory_by_event(log: DataFrame) -> DataFrame:
    """event, n, least heap, most fragmentation, first and last second."""
    return log.groupBy("event").agg(F.count("*").alias("n"), F.min("free_heap").alias("least_heap"), F.max(1 - F.col("largest_block") / F.nullif(F.col("free_heap"), F.lit(0))).alias("most_fragmented"), F.min("seconds").alias("first"), F.max("seconds").alias("last"))


def guarded_estimate(predicted: Column, manual: Column, rows: Column, fitted_rows: Column) -> Column:
    """The regression's estimate scaled by the change in rows, or the manual one where that change is too large."""
    drift = rows / fitted_rows
    scaled = predicted * F.least(F.greatest(drift, F.lit(0.75)), F.lit(1.35))
    return F.when((drift > 1.75) | (drift < 0.5), manual).otherwise(scaled)
