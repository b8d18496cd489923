"""Concept-drift streams, and distances between a reference and sliding windows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantgrove.functions.arithmetic import uniform
from quantgrove.functions.hashing import add64, let, unsigned_mod


@dataclass(frozen=True)
class DriftOptions:
    boundary: str = "linear"
    kind: str = "gradual"
    rows: int = 10_000
    burn_in: int = 0
    width: int = 1000
    points: int = 4
    magnitude: float = 1.0
    noise: float = 0.0
    labels: int = 2
    features: int = 8
    spread: float = 20.0
    pivot: tuple[float, float] = (0.0, 0.0)
    redundant: int = 0
    shift_features: bool = True
    feature_noise: float = 0.0
    seed: int = 42


def progress(o: DriftOptions, i: Column) -> Column:
    """How far the concept has moved at row i: 0 to 1."""
    at = i - o.burn_in
    if o.kind == "abrupt":
        p = F.lit(1.0)
    elif o.kind == "gradual":
        p = F.least(F.lit(1.0), at / F.lit(float(o.width)))
    elif o.kind == "sudden":
        step = (o.rows - o.burn_in) // o.points
        p = F.least(F.lit(1.0), F.floor(at / step) / F.lit(float(max(1, o.points - 1))))
    elif o.kind == "recurrent":
        cycle = (o.rows - o.burn_in) // o.points
        phase = (at % cycle) / F.lit(float(cycle))
        p = F.when(F.floor(at / cycle) % 2 == 0, phase).otherwise(1 - phase)
    else:
        raise ValueError(o.kind)
    return F.when(i < o.burn_in, 0.0).otherwise(p.cast("double"))


def normal(key: str, salt: int = 0) -> Column:
    """A standard normal number from an integer expression."""
    u = F.greatest(uniform(key, salt), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(key, salt + 1))


def _combine(cell: Column):
    return lambda h: h.bitwiseXOR(add64(add64(add64(cell, F.lit(0x9E3779B9)), F.shiftleft(h, 6)), F.shiftrightunsigned(h, 2)))


def hash_label(values: Sequence[Column], shift: Column, labels: int) -> Column:
    """Class from the combined hash of the values in thousandths, each moved up or down by the shift in turn."""
    mixed = F.lit(0).cast("long")
    for j, v in enumerate(values):
        cell = ((v + shift * (1.0 if j % 2 == 0 else -1.0)) * 1000).cast("long")
        mixed = let(mixed, _combine(cell))
    return unsigned_mod(mixed, labels).cast("int")


def generate(spark: SparkSession, o: DriftOptions) -> DataFrame:
    """idx, x1.., label. Every row is a function of its index: no state, any number of partitions."""
    df = spark.range(o.rows).withColumnRenamed("id", "idx")
    u = [uniform("idx", o.seed + 7 * j) for j in range(4)]
    p = progress(o, F.col("idx"))
    lin = [(u[j] - 0.5) * o.spread for j in (0, 1)]
    features = 2
    if o.boundary == "linear":
        df = df.withColumns({"x1": lin[0], "x2": lin[1], "p_angle": p * o.magnitude * math.pi})
        label = F.when((F.col("x1") - o.pivot[0]) * F.cos(F.col("p_angle")) - (F.col("x2") - o.pivot[1]) * F.sin(F.col("p_angle")) >= 0, 0).otherwise(1)
    elif o.boundary in ("cake", "circular"):
        radius, turn = F.sqrt(u[0]) * (o.spread / 2), u[1] * 2 * math.pi
        df = df.withColumns({"x1": radius * F.cos(turn), "x2": radius * F.sin(turn), "p_angle": p * 30.0 * o.magnitude})
        degrees = F.atan2("x2", "x1") * (180.0 / math.pi)
        degrees = F.when(degrees < 0, degrees + 360.0).otherwise(degrees) + F.col("p_angle")
        label = (F.floor(degrees / (360.0 / o.labels)) % o.labels if o.labels > 2 else F.floor(degrees / 30) % 2).cast("int")
    elif o.boundary == "chocolate":
        df = df.withColumns({"x1": lin[0], "x2": lin[1], "p_angle": p * (math.pi / 2) * o.magnitude})
        x = F.col("x1") * F.cos("p_angle") - F.col("x2") * F.sin("p_angle")
        y = F.col("x1") * F.sin("p_angle") + F.col("x2") * F.cos("p_angle")
        # Squares of side 5 on a turned board; cut toward zero, so those at the axes are twice as wide.
        label = F.pmod((x / 5).cast("int") + (y / 5).cast("int"), F.lit(2))
    elif o.boundary in ("torus", "rolling_torus"):
        radius, turn = F.sqrt(u[0]) * 10, u[1] * 2 * math.pi
        df = df.withColumns({"x1": radius * F.cos(turn) + F.when(u[2] < 0.5, 10).otherwise(-10), "x2": radius * F.sin(turn) + 10, "p_angle": -35.0 + p * 70.0})
        rolling = (F.col("x1") - F.col("p_angle")) * (F.col("x1") - F.col("p_angle")) + (F.col("x2") - 10) * (F.col("x2") - 10) <= 100
        fixed = (F.col("x1") - 10) * (F.col("x1") - 10) + (F.col("x2") - 10) * (F.col("x2") - 10) <= 100
        label = F.when(rolling, fixed.cast("int")).otherwise((~fixed).cast("int"))
    elif o.boundary == "hash":
        features = o.features
        moved = lambda j: p * o.magnitude * 5.0 * (1 if j % 2 == 0 else -1) if o.shift_features else F.lit(0.0)
        df = df.withColumns({f"x{j + 1}": (uniform("idx", o.seed + 11 * j) - 0.5) * 20 + moved(j) for j in range(o.features)} | {"p_angle": p * o.magnitude * 5.0})
        label = hash_label([F.col(f"x{j + 1}") for j in range(o.features)], F.col("p_angle"), o.labels)
    else:
        raise ValueError(o.boundary)
    noisy = uniform("idx", o.seed + 101)
    other = F.floor(uniform("idx", o.seed + 103) * o.labels) if o.boundary in ("cake", "circular", "hash") else 1 - F.col("label")
    df = df.withColumn("label", label.cast("int")).drop("p_angle")
    if o.noise:
        df = df.withColumn("label", F.when(noisy < o.noise, other).otherwise(F.col("label")).cast("int"))
    if o.feature_noise:  # after the label is known
        df = df.withColumns({f"x{j + 1}": F.col(f"x{j + 1}") * (1 + normal("idx", o.seed + 201 + 2 * j) * o.feature_noise) for j in range(features)})
    names = [f"x{j + 1}" for j in range(features + o.redundant)]
    return df.withColumns({f"x{features + j + 1}": (uniform("idx", o.seed + 301 + j) - 0.5) * 20 for j in range(o.redundant)}).select("idx", *names, "label")


def write_stream_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """The stream in order of its index as text: header x1.., label, a fixed number of decimals."""
    names = [c for c in df.columns if c not in ("idx", "label")]
    cells = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) for c in names]
    df.repartitionByRange("idx").sortWithinPartitions("idx").select(*cells, "label").write.mode("overwrite").option("header", "true").csv(path)


def stream_file_name(o: DriftOptions) -> str:
    """What the file is called: boundary and kind, then what was added."""
    return f"{o.boundary}_{o.kind}" + ("_noise" if o.noise or o.feature_noise else "") + ("_redundant" if o.redundant else "") + ".csv"


# --- windows over an ordered stream ----------------------------------------


def sliding(df: DataFrame, index: str, size: int, step: int) -> DataFrame:
    """Each row once per window (``start``) that holds it; windows are [start, start + size)."""
    first = F.greatest(F.lit(0), (F.floor((F.col(index) - size) / step) + 1) * step)
    last = F.floor(F.col(index) / step) * step
    return df.withColumn("start", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))))


def windows(df: DataFrame, index: str, size: int, step: int, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """start, keys, n and sums over each window: rows are summed by blocks first, and only blocks are given to every window.

    A block is the greatest common measure of size and step.
    """
    block = math.gcd(size, step)
    blocks = df.groupBy((F.floor(F.col(index) / block) * block).cast("long").alias("__block"), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    spread = sliding(blocks, "__block", size, step)
    return spread.groupBy("start", *keys).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])


def centroid_drift(df: DataFrame, index: str, features: Sequence[str], reference: int, size: int, step: int) -> DataFrame:
    """start, distance of the window's centroid to that of the first ``reference`` rows."""
    ref = df.where(F.col(index) < reference).agg(*[F.avg(f).alias(f) for f in features]).first()
    each = windows(df, index, size, step, [], {f"s{i}": F.col(f).cast("double") for i, f in enumerate(features)}).where(F.col("n") == size)
    total = sum(((F.col(f"s{i}") / size - F.lit(ref[f])) * (F.col(f"s{i}") / size - F.lit(ref[f])) for i, f in enumerate(features)), F.lit(0.0))
    return each.select("start", F.sqrt(total).alias("distance"))


def cell_of(value: Column, low: float, high: float, cells: int) -> Column:
    return F.least(F.greatest(F.floor((value - low) / ((high - low) / cells)), F.lit(0)), F.lit(cells - 1)).cast("int")


def hellinger_drift(df: DataFrame, index: str, features: str | Sequence[str], reference: int, size: int, step: int, cells: int = 20) -> DataFrame:
    """start, Hellinger distance of the window's histogram to the reference's, over the common range; the mean over features."""
    features = [features] if isinstance(features, str) else list(features)
    ends = df.agg(*[F.struct(F.min(f).alias("low"), F.max(f).alias("high")).alias(f) for f in features]).first()
    bounds = [(ends[f]["low"], ends[f]["high"]) if ends[f]["low"] is not None and ends[f]["high"] > ends[f]["low"] else (0.0, 1.0) for f in features]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), cell_of(F.col(f), *bounds[i], cells).alias("cell")) for i, f in enumerate(features)])).alias("fc")
    tall = df.select(index, each).select(index, "fc.f", "fc.cell")
    ref = tall.where(F.col(index) < reference).groupBy("f", "cell").agg((F.count("*") / reference).alias("p"))  # features x cells rows
    win = windows(tall, index, size, step, ["f", "cell"], {})
    total = win.groupBy("start", "f").agg(F.sum("n").alias("k")).where(F.col("k") == size).select("start", "f")
    joined = win.join(total, ["start", "f"], "left_semi").join(ref, ["f", "cell"])
    overlap = joined.groupBy("start", "f").agg(F.sum(F.sqrt(F.col("p") * F.col("n") / size)).alias("bc"))
    one = total.join(overlap, ["start", "f"], "left").select("start", F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("bc", F.lit(0.0)))).alias("d"))
    return one.groupBy("start").agg(F.avg("d").alias("distance"))


#: Rows of a reference window that are sent to every task at most.
MOST_REFERENCE = 1 << 20


def area_between(a, b) -> float:
    """Area between the step functions of two samples (sorted numpy arrays): their 1-Wasserstein distance."""
    import numpy as np

    values = np.sort(np.concatenate([a, b]))
    at = values[:-1]
    gap = np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)
    return float(np.sum(np.abs(gap) * np.diff(values)))


def wasserstein_drift(df: DataFrame, index: str, features: str | Sequence[str], reference: int, size: int, step: int) -> DataFrame:
    """start, 1-Wasserstein distance of the window's values to the reference's, the mean over features.

    Nulls count as 0. A window's values are gathered in one row, ``size`` of
    them at most; the reference's go to every task, so their number is bounded.
    """
    import numpy as np
    import pyarrow as pa

    features = [features] if isinstance(features, str) else list(features)
    if reference > MOST_REFERENCE:
        raise ValueError(f"a reference window has at most {MOST_REFERENCE} rows")
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    first = df.where(F.col(index) < reference).select(*[value(f).alias(f"v{i}") for i, f in enumerate(features)]).toArrow()
    refs = [np.sort(first[f"v{i}"].to_numpy()) for i in range(len(features))]
    names = [f"v{i}" for i in range(len(features))]
    rows = sliding(df.select(index, *[value(f).alias(n) for n, f in zip(names, features)]), index, size, step)
    gathered = rows.groupBy("start").agg(F.count("*").alias("n"), *[F.collect_list(n).alias(n) for n in names]).where(F.col("n") == size).select("start", *names)

    def run(batches):
        for b in batches:
            mean = np.zeros(len(b))
            for i, ref in enumerate(refs):
                column = b.column(i + 1)
                mean += [area_between(np.sort(x.values.to_numpy()), ref) for x in column]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean / len(refs))], names=["start", "distance"])

    return gathered.mapInArrow(run, "start long, distance double")


def label_share(df: DataFrame, index: str, label: str, size: int, step: int) -> DataFrame:
    """start, label, share of each label in each full window."""
    counts = windows(df, index, size, step, [label], {})
    n = F.sum("n").over(Window.partitionBy("start"))  # a row per label
    return counts.withColumn("k", n).where(F.col("k") == size).select("start", label, (F.col("n") / F.col("k")).alias("share"))


#: Blocks of rows that one task orders at a time in a trailing window.
SEGMENT = 1 << 14


def trailing_accuracy(df: DataFrame, index: str, correct: str, window: int, every: int, key: str | None = None, start: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Accuracy of the last ``window`` rows, at every ``every``-th row once there are enough.

    Rows are summed by blocks of ``every`` first. Blocks are ordered by
    segments; each segment also gets the last blocks of the one before it, so
    no task orders the whole stream.
    """
    if window % every:
        raise ValueError("the window must be a multiple of the step")
    block = F.floor((F.col(index) - start) / every)
    keys = [key] if key else []
    blocks = df.where(F.col(index) >= start).groupBy(*keys, block.cast("long").alias("block")).agg(F.sum(F.col(correct).cast("long")).alias("k"), F.count("*").alias("n"))
    m = window // every
    segment = max(segment, 2 * m)
    home = F.floor(F.col("block") / segment)
    both = F.when(F.col("block") % segment >= segment - (m - 1), F.array(home, home + 1)).otherwise(F.array(home)) if m > 1 else F.array(home)
    w = Window.partitionBy(*keys, "segment").orderBy("block").rowsBetween(-(m - 1), 0)
    out = blocks.withColumn("segment", F.explode(both)).withColumns({"hits": F.sum("k").over(w), "seen": F.sum("n").over(w)})
    out = out.where((F.col("segment") == home) & (F.col("seen") == window))
    return out.select(*keys, ((F.col("block") + 1) * every + start - 1).alias("at"), (F.col("hits") / window).alias("accuracy"))


def fading_scores(df: DataFrame, keys: Sequence[str], order: str, correct: str, fade: float = 0.99) -> DataFrame:
    """s <- s f + c (1 - f) over each key's rows, in closed form."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    nth = F.row_number().over(w) - 1
    return df.withColumn("__age", nth).groupBy(*keys).agg(F.sum(F.col(correct).cast("double") * (1 - fade) * F.pow(F.lit(fade), F.col("__age"))).alias("score"), F.count("*").alias("n"))
