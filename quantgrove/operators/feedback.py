"""Feedback on predictions: positional pairing, bounded windows, evictions, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantgrove.sources.shared import written


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Adds a gapless number from 0 in the given order.

    A range sort spreads the rows; each part numbers its own and adds the
    counts of the parts before, so no single task sees all of them. The parts
    are written first: a sort that is run again draws other bounds and merges
    other parts, and the counts of one run do not fit the parts of the next.
    """
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mono", F.monotonically_increasing_id()), "numbered")
    part, own = F.shiftright("__mono", 33), F.col("__mono").bitwiseAND((1 << 33) - 1)
    counts = parts.groupBy(part.alias("__part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # a row per part
    return parts.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, own + F.col("__before")).drop("__mono", "__part", "__before")


def positional_join(predicted: DataFrame, actual: DataFrame, order: str = "pos") -> DataFrame:
    """The i-th prediction with the i-th label, as far as both go; unknown labels (null) drop their pair."""
    return predicted.join(actual, order).where(F.col("actual").isNotNull())


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest n rows: a limit over an order, so only n rows of each task move."""
    return df.orderBy(F.desc(order)).limit(n)


def append_with_eviction(window: DataFrame, new: DataFrame, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows evicted) after adding rows to a window of bounded size."""
    both = window.unionByName(new)
    kept = last_n(both, order, most)
    return kept, both.join(kept.select(order), order, "left_anti")


def timed_out(events: DataFrame, key: str, ts: str, wait_seconds: int) -> DataFrame:
    """Adds ``skipped``: how many waits, by whole seconds, have passed since the row before of the same key."""
    micros = F.unix_micros(ts)
    gap = F.floor((micros - F.lag(micros).over(Window.partitionBy(key).orderBy(ts))) / 1_000_000)
    return events.withColumn("skipped", F.coalesce(F.floor(gap / wait_seconds), F.lit(0)))


def by_ids(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Rows whose id is in a set."""
    return df.join(ids.select(row_id).distinct(), row_id, "left_semi")


def chunk(df: DataFrame, row_id: str, k: int, size: int) -> DataFrame:
    """The k-th chunk of a fixed number of ids; the filter reaches the scan."""
    return df.where(F.col(row_id).between(k * size, (k + 1) * size - 1))


def trim_log(log: DataFrame, order: str, most: int) -> DataFrame:
    """A log over its bound keeps the newest half of the bound."""
    n = log.count()
    return log if n <= most else last_n(log, order, most // 2)


def append_log(spark, path: str, rows: DataFrame, order: str, most: int) -> DataFrame:
    """Append to an inference log on shared storage, trimmed; returns the log.

    The log is written as a new version beside the old one, and the newest
    whole version counts, so a writer that is lost leaves the old one.
    """
    version, log = log_version(spark, path)
    both = rows if log is None else log.unionByName(rows)
    trim_log(both, order, most).write.mode("overwrite").parquet(f"{path}/{version + 1:08d}")
    return log_version(spark, path)[1]


def log_version(spark, path: str) -> tuple[int, DataFrame | None]:
    """(number, rows) of the newest whole version."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")) or []
    found = max((int(s.getPath().getParent().getName()) for s in done), default=-1)
    return (found, spark.read.parquet(f"{path}/{found:08d}")) if found >= 0 else (-1, None)


def last_n_score(log: DataFrame, order: str, n: int, flags, labels: int) -> DataFrame:
    """One row: the score of the newest n logged (predicted, actual) pairs, averaged over labels that occur."""
    from quantgrove.operators import metrics

    known = last_n(log, order, n).where(F.col("actual").between(0, labels - 1) & F.col("predicted").between(0, labels - 1))
    return metrics.macro(metrics.confusion(known), supported_only=True).withColumn("score", metrics.score(None, flags))


def decode_labels(df: DataFrame, dictionary: DataFrame, label_id: str) -> DataFrame:
    """Adds label and success: an id without an entry has a null label and did not succeed."""
    known = dictionary.select(F.col("label_id").alias(label_id), "label")
    return df.join(known, label_id, "left").withColumn("success", F.col("label").isNotNull())
