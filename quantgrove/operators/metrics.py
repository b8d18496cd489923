"""Evaluation of (actual, predicted) tables, with abstention below a consensus."""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgrove.functions.arithmetic import f_beta, ratio


class Metric(IntFlag):
    ACCURACY = 1
    PRECISION = 2
    RECALL = 4
    F1 = 8


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """label, tp, fp, fn: one partial aggregate over (actual, predicted), then small."""
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(
        F.explode(
            F.when(F.col("a") == F.col("p"), F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))).otherwise(
                F.array(F.struct(F.col("p").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn")), F.struct(F.col("a").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.col("n").alias("fn")))
            )
        ).alias("s")
    )
    return sides.select("s.*").where("label is not null").groupBy("label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def per_label(table: DataFrame) -> DataFrame:
    """Precision, recall, F1 of each label; 0 where nothing is there to divide by."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return table.withColumns({"precision": p, "recall": r}).withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0))


def macro(table: DataFrame, supported_only: bool = False) -> DataFrame:
    """Averages over labels (all, or those that occur), accuracy over rows."""
    each = per_label(table)
    each = each.where("tp + fn > 0") if supported_only else each
    return each.agg(ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def score(row, flags: Metric) -> Column:
    """Mean of the chosen metrics' columns."""
    chosen = [F.col(m.name.lower()) for m in Metric if m & flags]
    return sum(chosen[1:], chosen[0]) / len(chosen)


def with_abstention(df: DataFrame, threshold: Column) -> list[Column]:
    """Aggregates where rows under the threshold are not answered and count as missed."""
    answered = F.col("consensus") >= threshold
    right = answered & (F.col("actual") == F.col("predicted"))
    return [F.count("*").alias("n"), F.count_if(answered).alias("answered"), F.count_if(right).alias("tp"), F.count_if(answered & ~right).alias("fp"), F.count_if(~right).alias("fn")]


def micro(table: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = table.withColumns({"precision": p, "recall": r, "coverage": ratio(F.col("answered"), F.col("n")), "accuracy": ratio(F.col("tp"), F.col("n"))})
    return out.withColumns({f"f{name}": f_beta(F.col("precision"), F.col("recall"), b) for name, b in (("05", 0.5), ("1", 1.0), ("2", 2.0))})


def objective(flags: Metric) -> Column:
    """Precision alone asks for F0.5, recall alone for F2, both without F1 for F1; otherwise the mean of what is chosen."""
    p, r, f1 = (bool(flags & m) for m in (Metric.PRECISION, Metric.RECALL, Metric.F1))
    if p and not r and not f1:
        return F.col("f05")
    if r and not p and not f1:
        return F.col("f2")
    if p and r and not f1:
        return F.col("f1")
    chosen = [F.col(m.name.lower()) for m in Metric if m & flags]
    return sum(chosen[1:], chosen[0]) / len(chosen)


def threshold_sweep(df: DataFrame, flags: Metric = Metric.ACCURACY) -> DataFrame:
    """Micro metrics at every distinct consensus, and 0 and 1, from one histogram and a running sum.

    Rows are first counted by consensus, so the sweep never multiplies rows by
    thresholds.
    """
    right = F.count_if(F.col("actual") == F.col("predicted")).alias("right")
    by = df.groupBy(F.col("consensus").alias("threshold")).agg(F.count("*").alias("k"), right)
    ends = df.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, k long, right long")
    by = by.unionByName(ends).groupBy("threshold").agg(F.sum("k").alias("k"), F.sum("right").alias("right"))
    # Distinct consensus values are votes over trees: few, whatever the rows.
    up = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(F.lit(1))
    table = by.select("threshold", F.sum("k").over(all_).alias("n"), F.sum("k").over(up).alias("answered"), F.sum("right").over(up).alias("tp"))
    table = table.withColumns({"fp": F.col("answered") - F.col("tp"), "fn": F.col("n") - F.col("tp")})
    return micro(table).withColumn("score", objective(flags))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Best score, then coverage, then lower threshold, equal within 1e-6."""
    key = F.struct(F.round("score", 6), F.round("coverage", 6), -F.col("threshold"))
    return sweep.orderBy(F.desc(key)).limit(1)


def majority(df: DataFrame, row: str, label: str) -> DataFrame:
    """row, label, votes, total, consensus: the lowest label wins ties."""
    counted = df.groupBy(row, label).agg(F.count("*").alias("k"))
    best = counted.groupBy(row).agg(F.min(F.struct((-F.col("k")).alias("m"), F.col(label).alias("label"))).alias("b"), F.sum("k").alias("total"))
    return best.select(row, F.col("b.label").alias("label"), (-F.col("b.m")).alias("votes"), "total", (-F.col("b.m") / F.col("total")).alias("consensus"))


def label_accuracy(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """label, recall of the label, and the accuracy over all rows beside it: both are called accuracy per label somewhere."""
    t = confusion(df, actual, predicted).where("tp + fn > 0")
    whole = t.agg(ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("overall"))
    return t.crossJoin(whole).select("label", ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), "overall")


def auto_config(df: DataFrame, label: str, features: int, use_gini: bool = True) -> DataFrame:
    """One row: metric, way of validating, split ratios and search ranges from the sizes of the classes."""
    one = imbalance(df, label)
    n, k, f, low = F.col("rows").cast("double"), F.greatest(F.col("classes"), F.lit(1)).cast("double"), F.lit(float(features)), F.col("rarest_percent")
    each, expected = n / k, 100 / k
    short = F.greatest(F.lit(0.0), expected - low) / expected
    within = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    top_split = F.least(F.lit(16), F.least(F.lit(8), F.floor(F.log2(n) / 4 + f / 25))).cast("int")
    top_split = F.when(top_split <= 2, 6).otherwise(top_split)
    density = within(each / 600, 0.3, 3.0)
    low_ratio = within(0.12 + 0.05 * density * (1 - F.least(short, F.lit(0.5))), 0.1, 0.35)
    high_ratio = F.least(F.lit(0.6), F.greatest(low_ratio + 0.12 + 0.04 * density, low_ratio + 0.1))
    cap = F.greatest(F.col("max_split") - 1, F.lit(1))
    depth = F.greatest(F.lit(8), F.floor(F.log2(n) + F.log2(f)) + 1).cast("int")
    classes = F.greatest(k, F.lit(2.0))
    by_rows = within(1 / (1 + F.greatest(F.lit(0.0), F.log2(F.greatest(n, F.lit(2.0))) - 10) / 2.5), 0.25, 1.15)
    rare = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 100 / classes - low) / (100 / classes))
    by_features = 0.9 + 0.1 * F.least(F.lit(1.0), F.log2(F.greatest(f, F.lit(2.0))) / 8)
    factor = by_rows * (1 - 0.5 * rare) * by_features
    threshold = within(0.003 * (1 - 1 / classes) * factor, 0.0003, 0.02) if use_gini else within(0.02 * F.log2(classes) * factor, 0.002, 0.2)
    one = one.withColumns({"max_split": top_split, "low_ratio": low_ratio, "high_ratio": high_ratio, "top_depth": depth})
    least_leaf = F.least(F.greatest(F.floor(2 * F.col("low_ratio")).cast("int"), F.lit(1)), cap)
    return one.select(
        "classes", "rows", "metric",
        F.when(each < 200, "k_fold").when(each < 500, "oob").otherwise("valid").alias("validation"),
        F.when(each > 800, 0.9).when(each > 150, 0.8).otherwise(0.75).alias("train_ratio"),
        F.lit(2).alias("least_split"), F.col("max_split").alias("most_split"),
        least_leaf.alias("least_leaf"), F.greatest(least_leaf, F.least(F.ceil(F.col("max_split") * F.col("high_ratio")).cast("int"), cap)).alias("most_leaf"),
        F.when(F.col("top_depth") > 18, F.col("top_depth") - 6).when(F.col("top_depth") > 12, F.col("top_depth") - 4).when(F.col("top_depth") > 8, F.col("top_depth") - 2).otherwise(4).alias("least_depth"),
        F.col("top_depth").alias("most_depth"), threshold.alias("impurity_threshold"),
    )


def top_classes(df: DataFrame, label: str, n: int = 5) -> DataFrame:
    """The n largest classes."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def valid_rows(bins: Column, largest: int) -> Column:
    """Whether every bin of a row is at most the largest there is."""
    return F.forall(bins, lambda b: b.between(0, largest))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Classes, rows, largest over smallest class, share of the rarest, and the metric to train for."""
    counts = df.groupBy(label).agg(F.count("*").alias("k"))
    out = counts.agg(F.count("*").alias("classes"), F.sum("k").alias("rows"), (F.max("k") / F.min("k")).alias("imbalance"), (F.min("k") * 100.0 / F.sum("k")).alias("rarest_percent"))
    metric = F.when(F.col("imbalance") > 10, "RECALL").when(F.col("imbalance") > 3, "F1").when(F.col("imbalance") > 1.5, "PRECISION").otherwise("ACCURACY")
    return out.withColumn("metric", metric)
