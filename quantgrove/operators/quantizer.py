"""Feature quantisers: learnt from column statistics, applied as column expressions.

Fitting takes two aggregations over the values of the wide table and no shuffle of rows:
statistics, then quantiles of the clipped values. The result is a small Python
object (a rule per feature), so applying it compiles to comparisons with
literals that stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that share one aggregate, so that its generated code stays small.
CHUNK = 16
#: Kinds of feature: full discrete range, discrete dictionary, continuous.
FULL, DICTIONARY, CONTINUOUS = "DF", "DC", "CU"
TINY = 1e-6


@dataclass(frozen=True)
class Rule:
    feature: str
    kind: str
    low: float
    high: float
    mean: float
    sd: float
    edges: tuple[float, ...] = ()
    values: tuple[float, ...] = ()


@dataclass(frozen=True)
class Quantizer:
    bits: int
    rules: tuple[Rule, ...]
    z: float | None = 3.0

    @property
    def groups(self) -> int:
        return 1 << self.bits

    def rule(self, feature: str) -> Rule:
        return next(r for r in self.rules if r.feature == feature)

    def save(self, spark, path: str) -> None:
        """A row per feature, in order, and the settings beside each."""
        rows = [(i, *asdict(r).values(), self.bits, self.z) for i, r in enumerate(self.rules)]
        ddl = "i int, feature string, kind string, low double, high double, mean double, sd double, edges array<double>, `values` array<double>, bits int, z double"
        spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else float(v) if j in (3, 4, 5, 6) else v for j, v in enumerate(r)) for r in rows], ddl).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Quantizer:
        rows = spark.read.parquet(path).orderBy("i").collect()
        if not rows:
            raise ValueError(f"{path} holds no quantiser")
        rules = tuple(Rule(r["feature"], r["kind"], r["low"], r["high"], r["mean"], r["sd"], tuple(r["edges"]), tuple(r["values"])) for r in rows)
        return Quantizer(rows[0]["bits"], rules, rows[0]["z"])

    def with_rule(self, rule: Rule) -> Quantizer:
        return replace(self, rules=tuple(rule if r.feature == rule.feature else r for r in self.rules))


def number(cell: Column) -> Column:
    """A cell as a number: what cannot be read is 0.0."""
    return F.coalesce(cell.try_cast("double"), F.lit(0.0))


def clip(value: Column, mean: float, sd: float, z: float = 3.0) -> Column:
    """Within z standard deviations of the mean; left alone where there is no spread."""
    return F.greatest(F.least(value, F.lit(mean + z * sd)), F.lit(mean - z * sd)) if sd > TINY else value


def tall(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """(i, v): a row for each value, numbered by column. Only the columns named are read, and sums are partial in each task."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("v")) for i, c in enumerate(columns)])).alias("s")).select("s.*")


def _cells(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]


def _stats(values: DataFrame, *more: Column) -> DataFrame:
    return values.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), *more)


def feature_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per feature: n, mean, population sd, min, max; one pass."""
    name = F.element_at(F.lit(list(features)), F.col("i") + 1)
    return _stats(tall(df, _cells(features))).select(name.alias("feature"), "n", "mean", "sd", "low", "high")


def _aggregate(df: DataFrame, aggs: dict[str, Column]) -> dict:
    """First row of named aggregates, a chunk at a time."""
    names, out = list(aggs), {}
    for i in range(0, len(names), CHUNK):
        some = names[i : i + CHUNK]
        out |= df.agg(*[aggs[k].alias(k) for k in some]).first().asDict()
    return out


def quantile_edges(values: Column, groups: int, exact: bool = True, accuracy: int = 100_000) -> Column:
    """K-1 edges at b(n-1)/K by linear interpolation; ``exact=False`` takes a mergeable sketch instead."""
    at = [b / groups for b in range(1, groups)]
    return F.percentile(values, at) if exact else F.percentile_approx(values, at, accuracy)


#: Cells that an interval is cut into at each pass; rows from which exact quantiles are found by such passes.
CELLS, REFINE_ROWS = 4096, 5_000_000


def refined_edges(df: DataFrame, columns: dict[str, Column], groups: int, cells: int = CELLS) -> dict[str, list[float]]:
    """The same exact edges for tables of any size: no task ever holds more than the cells.

    Each pass counts every interval that holds a wanted rank in ``cells`` cells
    of equal width, with the least and largest value of each; the cell that
    holds the rank is the next interval. A rank is found when its cell has one
    value only. Values are finite and not null.
    """
    ends = _aggregate(df, {k: F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")) for k, c in columns.items()})
    marks = {k: [b * (ends[k]["n"] - 1) / groups for b in range(1, groups)] for k in columns if ends[k]["n"]}
    found: dict[tuple[str, int], float] = {}
    # (column, rank) -> (low, high, rows below low)
    open_ = {(k, r): (ends[k]["low"], ends[k]["high"], 0) for k in marks for m in marks[k] for r in (int(m), min(int(m) + 1, ends[k]["n"] - 1))}
    while open_:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                found[key] = low
                del open_[key]
        spans = sorted({(k, *v) for (k, _), v in open_.items()})
        if not spans:
            break
        each = []
        for i, (k, low, high, _) in enumerate(spans):
            c, width = columns[k], (high - low) / cells
            cell = F.least(F.floor((c - F.lit(low)) / F.lit(width)), F.lit(cells - 1)).cast("int") if width > 0 else F.lit(0)
            each.append(F.when(c.between(low, high), F.struct(F.lit(i).alias("span"), cell.alias("cell"), c.alias("v"))))
        tall = df.select(F.explode(F.array_compact(F.array(*each))).alias("s")).select("s.*")
        counted = tall.groupBy("span", "cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        by: dict[int, list] = {}
        for r in counted.collect():  # spans x cells at most
            by.setdefault(r["span"], []).append((r["cell"], r["n"], r["low"], r["high"]))
        for key, (low, high, below) in list(open_.items()):
            at = below
            for _, n, a, z in sorted(by[spans.index((key[0], low, high, below))]):
                if key[1] < at + n:
                    open_[key] = (a, z, at)
                    break
                at += n
    out = {}
    for k, ms in marks.items():
        out[k] = []
        for m in ms:
            lo, hi = found[(k, int(m))], found[(k, min(int(m) + 1, ends[k]["n"] - 1))]
            out[k].append(lo + (m - int(m)) * (hi - lo))
    return out


def settle_edges(edges: Sequence[float], low: float, high: float, groups: int) -> tuple[float, ...]:
    """Equal-width edges where all quantiles coincide though the values spread."""
    if edges and all(abs(e - edges[0]) <= TINY for e in edges) and high - low > TINY:
        return tuple(low + b * ((high - low) / groups) for b in range(1, groups))
    return tuple(edges)


def few_values(values: DataFrame, about: dict[int, int], most: int) -> dict[int, tuple[float, ...]]:
    """Sorted distinct values of the columns that have at most ``most``.

    ``about`` is a sketch's count for each column: sets are gathered only where
    it is small, so no set grows with the rows.
    """
    small = [i for i, n in about.items() if n <= 2 * most + 8]
    if not small:
        return {}
    sets = values.where(F.col("i").isin(small)).groupBy("i").agg(F.collect_set("v").alias("s")).collect()
    return {r["i"]: tuple(sorted(r["s"])) for r in sets if len(r["s"]) <= most}


def fit(df: DataFrame, features: Sequence[str], bits: int = 2, z: float | None = 3.0, exact: bool = True, refine_rows: int = REFINE_ROWS) -> Quantizer:
    """Learn a rule for every feature.

    Discreteness is judged on raw values to decide on clipping, and on clipped
    values to decide on the kind of rule. Two passes do, and one more where a
    feature has few values. Exact edges of a table with more than
    ``refine_rows`` rows are found by passes of bounded memory.
    """
    groups, cells = 1 << bits, _cells(features)
    about = F.approx_count_distinct("v", 0.02).alias("about")
    values = tall(df, cells)
    stats = {r["i"]: r for r in _stats(values, about).collect()}
    if not stats:  # an empty table: nothing is known
        return Quantizer(bits, tuple(Rule(f, DICTIONARY, 0.0, 0.0, 0.0, 0.0) for f in features), z)
    known = few_values(values, {i: r["about"] for i, r in stats.items()}, groups)
    wide = [i for i in range(len(features)) if i not in known]
    clipped = {i: cells[i] if z is None else clip(cells[i], stats[i]["mean"], stats[i]["sd"], z) for i in wide}
    found, edges_of = {}, {}
    if wide:
        refine = exact and stats[0]["n"] > refine_rows
        inner = tall(df, [clipped[i] for i in wide])
        after = inner.groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high"), about, *([] if refine else [quantile_edges(F.col("v"), groups, exact).alias("edges")])).collect()
        found = {wide[r["i"]]: r for r in after}
        known |= {wide[k]: v for k, v in few_values(inner, {r["i"]: r["about"] for r in after}, groups).items()}
        wide = [i for i in wide if i not in known]
        edges_of = {int(k): v for k, v in refined_edges(df, {str(i): clipped[i] for i in wide}, groups).items()} if refine else {i: found[i]["edges"] for i in wide}
    rules = []
    for i, f in enumerate(features):
        mean, sd = stats[i]["mean"], stats[i]["sd"]
        if i in known:
            v = known[i]
            full = len(v) == groups and [int(x) for x in v] == list(range(groups))
            rules.append(Rule(f, FULL if full else DICTIONARY, min(v), max(v), mean, sd, values=v))
        else:
            low, high = found[i]["low"], found[i]["high"]
            rules.append(Rule(f, CONTINUOUS, low, high, mean, sd, edges=settle_edges(edges_of[i], low, high, groups)))
    return Quantizer(bits, tuple(rules), z)


# --- applying -------------------------------------------------------------


def bin_of(rule: Rule, groups: int, z: float | None, value: Column) -> Column:
    """Bin of a value: number of edges up to it, truncated value, or nearest dictionary entry (the lower one on ties)."""
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    if rule.kind == CONTINUOUS:
        if z is not None:
            value = clip(value, rule.mean, rule.sd, z)
        out = F.lit(0)
        for e in rule.edges:
            out = out + (value >= F.lit(float(e))).cast("int")
        return out
    if rule.kind == FULL:
        return F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(groups - 1))
    # Between neighbours of a sorted dictionary the nearer one is told by their midpoint.
    out = F.lit(0)
    for i, (a, b) in enumerate(zip(rule.values, rule.values[1:])):
        out = F.when(value - F.lit(float(a)) > F.lit(float(b)) - value, F.lit(i + 1)).otherwise(out)
    return out


def bins(quantizer: Quantizer, df: DataFrame, prefix: str = "bin_") -> DataFrame:
    """The table with a bin column per feature."""
    return df.withColumns({f"{prefix}{i}": bin_of(r, quantizer.groups, quantizer.z, F.col(r.feature)) for i, r in enumerate(quantizer.rules)})


def fixed_point(rule: Rule, value: Column) -> Column:
    """Bin by edges stored as 16-bit fixed point above the minimum: the compatible mode, saturating on wide ranges."""
    span = rule.high - rule.low
    scale = max(1, int(65535 / span)) if span > 0 else 1
    edges = [min(65535, int(min(65535.0, max(0.0, e - rule.low) * scale) + 0.5)) for e in rule.edges]
    scaled = F.floor((value - F.lit(rule.low)) * F.lit(float(scale)))
    out = F.lit(0)
    for e in edges:
        out = out + (scaled >= F.lit(e)).cast("int")
    return out


def signal_of(rule: Rule, groups: int, z: float | None, value: Column) -> Column:
    """The bin, or below 0 / at least K by as many bins as the value lies outside the learnt range."""
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    if z is not None:
        value = clip(value, rule.mean, rule.sd, z)
    width = (rule.high - rule.low) / groups
    if rule.kind == CONTINUOUS and width > 0:
        below, above = F.ceil((F.lit(rule.low) - value) / width), F.ceil((value - F.lit(rule.high)) / width)
    else:
        below = above = F.lit(1)
    inside = bin_of(rule, groups, None, value)
    return F.when(value < rule.low, -below).when(value > rule.high, F.lit(groups - 1) + above).otherwise(inside).cast("int")


def first_drift(quantizer: Quantizer, df: DataFrame) -> DataFrame:
    """The table with the first feature out of range and its value (nulls where there is none)."""
    found = F.lit(None).cast("struct<feature:int,value:double>")
    for i in reversed(range(len(quantizer.rules))):
        r = quantizer.rules[i]
        s = signal_of(r, quantizer.groups, quantizer.z, F.col(r.feature))
        found = F.when((s < 0) | (s >= quantizer.groups), F.struct(F.lit(i).alias("feature"), F.col(r.feature).cast("double").alias("value"))).otherwise(found)
    return df.withColumn("drift", found)


# --- adapting -------------------------------------------------------------


def bounds(low: float, high: float, edges: Sequence[float], group: int) -> tuple[float, float]:
    marks = [low, *edges, high]
    return marks[group], marks[group + 1]


def expand(rule: Rule, low: float, high: float, groups: int) -> tuple[Rule, list[int]]:
    """Widen a rule to a new range; returns it and the new bin of every old one.

    Edges keep their place as fractions of the range. An old bin goes to the
    new bin that it overlaps most (the lowest on ties); one without width goes
    to the first that holds it.
    """
    low, high = min(low, rule.low), max(high, rule.high)
    if rule.kind != CONTINUOUS:
        return replace(rule, low=low, high=high), list(range(groups))
    old, span = rule.high - rule.low, high - low
    if old > 1e-9 and span > 1e-9:
        edges = tuple(low + min(1.0, max(0.0, (e - rule.low) / old)) * span for e in rule.edges)
    elif span > 1e-9:
        edges = tuple(low + (i + 1) / groups * span for i in range(len(rule.edges)))
    else:
        edges = tuple(low for _ in rule.edges)
    to = []
    for g in range(groups):
        a, b = bounds(rule.low, rule.high, rule.edges, g)
        if b <= a:
            to.append(next((k for k in range(groups) if bounds(low, high, edges, k)[0] <= a <= bounds(low, high, edges, k)[1]), 0))
            continue
        overlaps = [max(0.0, min(b, y) - max(a, x)) for x, y in (bounds(low, high, edges, k) for k in range(groups))]
        to.append(overlaps.index(max(overlaps)))
    return replace(rule, low=low, high=high, edges=edges), to


def shrink(rule: Rule, counts: Sequence[int], groups: int, most: int = 2) -> tuple[Rule, list[int]]:
    """Drop up to ``most`` empty bins at either end; returns the rule and the new bin of every old one."""
    same = list(range(groups))
    if rule.kind != CONTINUOUS:
        return rule, same
    low = next((i for i in range(most) if counts[i]), most)
    high = next((i for i in range(most) if counts[groups - 1 - i]), most)
    if not low and not high or low + high >= groups:
        return rule, same
    new_low = rule.edges[low - 1] if low else rule.low
    kept = groups - 1 - high
    new_high = rule.edges[kept] if high else rule.high
    if new_high <= new_low + 1e-9:
        return rule, same
    keep = [e for i, e in enumerate(rule.edges) if low <= i <= len(rule.edges) - high - 1]
    edges = tuple(keep + [new_high] * (len(rule.edges) - len(keep)))
    return replace(rule, low=new_low, high=new_high, edges=edges), [min(max(g - low, 0), kept) for g in range(groups)]


def remap(bin_column: Column, to: Sequence[int]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in to]), bin_column + 1)


def remap_rows(df: DataFrame, maps: dict[str, Sequence[int]]) -> DataFrame:
    """Stored bins under a changed quantiser: a view, so every later read sees the new bins and nothing is written."""
    return df.withColumns({c: remap(F.col(c), to).cast("int") for c, to in maps.items()})


def adapt(quantizer: Quantizer, df: DataFrame) -> tuple[Quantizer, dict[int, list[int]]]:
    """Widen every rule whose range the new rows leave, values clipped as the rules say; returns the maps by feature number.

    One aggregate over the new rows, with a row's worth of results.
    """
    values = {}
    for r in quantizer.rules:
        c = F.coalesce(F.col(r.feature).cast("double"), F.lit(0.0))
        values[r.feature] = clip(c, r.mean, r.sd, quantizer.z) if quantizer.z is not None else c
    ends = _aggregate(df, {k: F.struct(F.min(c).alias("low"), F.max(c).alias("high")) for k, c in values.items()})
    maps = {}
    for i, r in enumerate(quantizer.rules):
        low, high = ends[r.feature]["low"], ends[r.feature]["high"]
        if low is not None and (low < r.low or high > r.high):
            rule, maps[i] = expand(r, low, high, quantizer.groups)
            quantizer = quantizer.with_rule(rule)
    return quantizer, maps
