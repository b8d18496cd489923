"""Gradient-boosted trees on bins: softmax over classes, one tree per class and round.

Histograms of gradient and hessian sums play the part that class counts play
for single trees; scores are expressions over bins, so a round reads the table
once per level and stores nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoostOptions:
    rounds: int = 10
    depth: int = 3
    rate: float = 0.3
    ridge: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0


@dataclass
class Booster:
    labels: int
    options: BoostOptions
    #: (round, class) -> {node: (feature, at_most) or weight}
    trees: dict[tuple[int, int], dict[int, tuple | float]] = field(default_factory=dict)

    def tree_sql(self, key: tuple[int, int], bins: Sequence[str]) -> str:
        nodes = self.trees[key]

        def walk(i: int) -> str:
            n = nodes[i]
            if isinstance(n, tuple):
                return f"CASE WHEN {bins[n[0]]} <= {n[1]} THEN {walk(2 * i + 1)} ELSE {walk(2 * i + 2)} END"
            return f"cast({float(n)!r} as double)"

        return walk(0)

    def scores(self, bins: Sequence[str]) -> list[Column]:
        out = []
        for k in range(self.labels):
            terms = [f"{self.options.rate!r}e0 * {self.tree_sql(t, bins)}" for t in self.trees if t[1] == k]
            out.append(F.expr(" + ".join(["0e0", *terms])))
        return out

    def predict(self, df: DataFrame, bins: Sequence[str]) -> DataFrame:
        s = self.scores(bins)
        best = F.greatest(*[F.struct(x.alias("s"), F.lit(-k).alias("k")) for k, x in enumerate(s)])
        return df.withColumn("predicted", -best["k"])


def gradients(scores: Sequence[Column], label: Column, k: int) -> tuple[Column, Column]:
    """(g, h) of class k: softmax probability less the indicator, and p(1-p) of at least 1e-6."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    exps = [F.exp(s - top) for s in scores]
    p = exps[k] / sum(exps[1:], exps[0])
    return p - (label == k).cast("double"), F.greatest(p * (1 - p), F.lit(1e-6))


def histogram(df: DataFrame, bins: Sequence[str], g: Column, h: Column, node: Column) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(b).cast("int").alias("bin")) for i, b in enumerate(bins)])).alias("fb")
    return df.select(node.cast("long").alias("node"), g.alias("g"), h.alias("h"), each).groupBy("node", "fb.feature", "fb.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def gain(gl, hl, g, h, ridge: float, gamma: float):
    """Half of what the two leaves' scores exceed the parent's by, less gamma."""
    return 0.5 * (gl * gl / (hl + ridge) + (g - gl) * (g - gl) / (h - hl + ridge) - g * g / (h + ridge)) - gamma


def split_gains(cells: DataFrame, groups: int, options: BoostOptions = BoostOptions()) -> DataFrame:
    """node, feature, at_most, gain, gl, hl, g, h of every threshold, from a histogram; as large as the model's shape."""
    run = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    keys = cells.select("node", "feature").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    full = keys.join(cells, ["node", "feature", "bin"], "left").fillna(0.0, ["g", "h"])
    t = full.select("node", "feature", F.col("bin").alias("at_most"), F.sum("g").over(run).alias("gl"), F.sum("h").over(run).alias("hl"), F.sum("g").over(whole).alias("g"), F.sum("h").over(whole).alias("h")).where(F.col("at_most") < groups - 1)
    return t.withColumn("gain", gain(F.col("gl"), F.col("hl"), F.col("g"), F.col("h"), options.ridge, options.gamma))


def best_splits(gains: DataFrame, options: BoostOptions = BoostOptions()) -> DataFrame:
    """The best threshold of each node whose sides weigh enough and whose gain exceeds gamma once more."""
    heavy = (F.col("hl") >= options.min_child_weight) & (F.col("h") - F.col("hl") >= options.min_child_weight) & (F.col("gain") > options.gamma)
    order = F.struct(F.round("gain", 9).alias("x"), (-F.col("feature")).alias("f"), (-F.col("at_most")).alias("b"))
    best = F.max(F.struct(order.alias("o"), "feature", "at_most")).alias("s")
    return gains.where(heavy).groupBy("node").agg(best).select("node", "s.feature", "s.at_most")


def train(df: DataFrame, bins: Sequence[str], labels: int, groups: int, options: BoostOptions = BoostOptions()) -> Booster:
    """One pass over the rows per level; one row per open node reaches the driver."""
    o, model = options, Booster(labels, options)
    for r in range(o.rounds):
        for k in range(labels):
            g, h = gradients(model.scores(bins), F.col("label"), k)
            nodes: dict[int, tuple | float] = {}
            for depth in range(o.depth + 1):
                cells = histogram(df, bins, g, h, _node_of(nodes, bins)).where("node >= 0").persist()
                totals = cells.where("feature = 0").groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
                best = {x["node"]: (x["feature"], x["at_most"]) for x in best_splits(split_gains(cells, groups, o), o).collect()} if depth < o.depth and totals else {}
                cells.unpersist()
                if not totals:
                    break
                for x in totals:
                    nodes[x["node"]] = best.get(x["node"]) or -x["g"] / (x["h"] + o.ridge)
            model.trees[(r, k)] = nodes  # later classes of the round see it
    return model


def evaluate(model: Booster, df: DataFrame, bins: Sequence[str]) -> DataFrame:
    """One row: rows, how many are right, accuracy."""
    return model.predict(df, bins).agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("right")).withColumn("accuracy", F.col("right") / F.greatest(F.col("n"), F.lit(1)))


def save(model: Booster, spark, path: str) -> None:
    """A row per node, with the options beside it."""
    rows = [(r, k, i, *(n if isinstance(n, tuple) else (-1, -1)), None if isinstance(n, tuple) else float(n)) for (r, k), nodes in model.trees.items() for i, n in nodes.items()]
    df = spark.createDataFrame(rows, "round int, class int, node long, feature int, at_most int, weight double")
    df.withColumn("options", F.lit(json.dumps(asdict(model.options)))).withColumn("labels", F.lit(model.labels)).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Booster:
    rows = spark.read.parquet(path).orderBy("round", "class", "node").collect()
    if not rows:
        raise ValueError(f"{path} holds no booster")
    model = Booster(rows[0]["labels"], BoostOptions(**json.loads(rows[0]["options"])))
    for r in rows:
        model.trees.setdefault((r["round"], r["class"]), {})[r["node"]] = (r["feature"], r["at_most"]) if r["feature"] >= 0 else r["weight"]
    return model


def _node_of(nodes: dict, bins: Sequence[str]) -> Column:
    """Where a row stands: an open node, or -1 in a finished leaf."""

    def walk(i: int) -> Column:
        n = nodes.get(i)
        if n is None:
            return F.lit(i)
        if isinstance(n, tuple):
            return F.when(F.col(bins[n[0]]) <= n[1], walk(2 * i + 1)).otherwise(walk(2 * i + 2))
        return F.lit(-1)

    return walk(0)
