"""Decision trees and random forests on bins, grown level by level from distributed histograms.

One aggregate per level serves all trees: counts by (tree, node, feature, bin,
label). Its size is set by the model's shape, not by the rows, so choosing the
splits of a level on its result is cheap. Rows find their node through one
broadcast join per level with the split table; nothing of the rows is stored
between levels.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



@dataclass(frozen=True)
class TreeOptions:
    trees: int = 20
    criterion: str = "gini"
    min_split: int = 2
    min_leaf: int = 1
    max_depth: int = 8
    max_nodes: int = 262_144
    threshold: float = 0.01
    seed: int = 37
    bootstrap: bool = True


@dataclass(frozen=True)
class Node:
    tree_id: int
    node: int
    depth: int
    label: int
    feature: int = -1
    at_most: int = -1

    @property
    def is_leaf(self) -> bool:
        return self.feature < 0


@dataclass
class Forest:
    """Nodes by tree; children of node i are 2i+1 and 2i+2."""

    nodes: list[Node]
    options: TreeOptions = field(default_factory=TreeOptions)

    def trees(self) -> dict[int, dict[int, Node]]:
        out: dict[int, dict[int, Node]] = {}
        for n in self.nodes:
            out.setdefault(n.tree_id, {})[n.node] = n
        return out

    def tree_sql(self, tree_id: int, bins: Sequence[str]) -> str:
        """The tree as nested CASE expressions over bin columns, as text: one parse, however many nodes."""
        nodes = self.trees()[tree_id]

        def walk(i: int) -> str:
            n = nodes[i]
            if n.is_leaf or 2 * i + 1 not in nodes:
                return str(n.label)
            return f"CASE WHEN {bins[n.feature]} <= {n.at_most} THEN {walk(2 * i + 1)} ELSE {walk(2 * i + 2)} END"

        return walk(0)

    def predict(self, df: DataFrame, bins: Sequence[str], labels: int, abstain_below: float = 0.0) -> DataFrame:
        """Adds predicted, votes, total, consensus; all inside generated code, no join and no shuffle."""
        votes = ", ".join(self.tree_sql(t, bins) for t in sorted(self.trees()))
        df = df.withColumn("__votes", F.expr(f"array({votes})"))
        best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(labels - 1)), lambda k: F.struct(F.size(F.filter("__votes", lambda v: v == k)).alias("c"), (-k).alias("k"))))
        df = df.withColumn("__best", best).withColumn("votes", F.col("__best.c")).withColumn("total", F.size("__votes"))
        df = df.withColumn("consensus", F.col("votes") / F.col("total"))
        return df.withColumn("predicted", F.when(F.col("consensus") >= abstain_below, -F.col("__best.k"))).drop("__votes", "__best")

    def save(self, spark, path: str) -> None:
        rows = [tuple(asdict(n).values()) for n in self.nodes]
        spark.createDataFrame(rows, "tree_id int, node long, depth int, label int, feature int, at_most int").withColumn("options", F.lit(json.dumps(asdict(self.options)))).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> Forest:
        rows = spark.read.parquet(path).orderBy("tree_id", "node").collect()
        options = TreeOptions(**json.loads(rows[0]["options"])) if rows else TreeOptions()
        return Forest([Node(r["tree_id"], r["node"], r["depth"], r["label"], r["feature"], r["at_most"]) for r in rows], options)


def impurity(counts: Column, total: Column, criterion: str) -> Column:
    """Of an array of class counts."""
    share = lambda c: c / total
    if criterion == "entropy":
        return -F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return 1 - F.aggregate(counts, F.lit(0.0), lambda a, c: a + share(c) * share(c))


def histogram(rows: DataFrame, bins: Sequence[str] | str, keys: Sequence[str], label: str = "label", weight: str | None = None) -> DataFrame:
    """keys, feature, bin, label, w: the rows are combined in each task before anything moves.

    ``bins`` names the columns, or one column that holds them as an array.
    """
    each = F.posexplode(F.col(bins) if isinstance(bins, str) else F.array(*[F.col(b).cast("int") for b in bins])).alias("feature", "bin")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return rows.select(*keys, F.col(label).alias("label"), w.alias("w"), each).groupBy(*keys, "feature", "bin", "label").agg(F.sum("w").alias("w"))


def split_gains(hist: DataFrame, keys: Sequence[str], groups: int, criterion: str = "gini") -> DataFrame:
    """keys, feature, at_most, gain, n_left, n_right of every possible threshold, from a histogram."""
    # Cells of a threshold are filled in by its own array: a row per (keys, feature, label) holds the weights by bin.
    by_label = hist.groupBy(*keys, "feature", "label").agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("m"))
    sides = by_label.select(*keys, "feature", "label", F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("w"))
    each = sides.select(*keys, "feature", "label", F.posexplode(F.slice("w", 1, groups - 1)).alias("at_most", "own"), "w")
    sided = each.select(*keys, "feature", "at_most", "label", F.aggregate(F.slice("w", F.lit(1), F.col("at_most") + 1), F.lit(0.0), lambda a, x: a + x).alias("left"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("all"))
    sorted_ = F.array_sort(F.collect_list(F.struct("label", "left", "all")))  # a fixed order of labels, so that sums are the same in every run
    table = sided.groupBy(*keys, "feature", "at_most").agg(sorted_.alias("c"), F.sum("left").alias("n_left"), F.sum(F.col("all") - F.col("left")).alias("n_right"))
    table = table.where((F.col("n_left") > 0) & (F.col("n_right") > 0))
    n, ls, al = F.col("n_left") + F.col("n_right"), F.col("c.left"), F.col("c.all")
    rs = F.transform("c", lambda x: x["all"] - x["left"])
    gain = impurity(al, n, criterion) - F.col("n_left") / n * impurity(ls, F.col("n_left"), criterion) - F.col("n_right") / n * impurity(rs, F.col("n_right"), criterion)
    return table.select(*keys, "feature", "at_most", gain.alias("gain"), "n_left", "n_right")


def best_splits(gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best threshold of each node: the largest gain (equal within 1e-12), then the first feature, then the lowest bin."""
    order = F.struct(F.round("gain", 12).alias("g"), (-F.col("feature")).alias("f"), (-F.col("at_most")).alias("b"))
    best = F.max(F.struct(order.alias("o"), F.struct("feature", "at_most", "gain", "n_left", "n_right").alias("s"))).alias("best")
    return gains.groupBy(*keys).agg(best).select(*keys, "best.s.*")


def majorities(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, most, label of each node: its weight, the largest class's, and the lowest label that has it."""
    one = hist.where("feature = 0").groupBy(*keys, "label").agg(F.sum("w").alias("w"))
    top = F.max(F.struct("w", (-F.col("label")).alias("l")))
    return one.groupBy(*keys).agg(F.sum("w").alias("n"), top.alias("t")).select(*keys, "n", F.col("t.w").alias("most"), (-F.col("t.l")).alias("label"))


def gain_floor(n: float, o: TreeOptions) -> float:
    """The gain that a split must exceed falls with the node's size, down to 1e-4."""
    return max(1e-4, o.threshold / (1 + math.log2(n + 1))) if n > o.min_split else o.threshold


def gain_floor_column(n: Column, threshold: float, min_split: int) -> Column:
    return F.when(n > min_split, F.greatest(F.lit(1e-4), threshold / (1 + F.log2(n + 1)))).otherwise(F.lit(threshold))


#: Levels that are grown between two writes of the rows' nodes, where a folder is given.
WRITE_EVERY = 4


def grow(rows: DataFrame, bins: Sequence[str], labels: int, groups: int, options: TreeOptions = TreeOptions(), label: str = "label", folder: str | None = None) -> Forest:
    """Grow all trees together. ``rows`` holds tree_id, weight, label and bins.

    A level is one aggregate over the rows; gains, the best split and the
    majority of each node are worked out from it, and only one row per open
    node reaches the driver. With ``folder`` (on shared storage) the rows'
    nodes are written every few levels, so deep trees don't recompute them.
    """
    from quantgrove.operators.sampling import feature_subset

    spark, o, nodes = rows.sparkSession, options, []
    base = rows.select("tree_id", "weight", F.col(label).alias("label"), F.array(*[F.col(b).cast("int") for b in bins]).alias("bins"), F.lit(0).cast("long").alias("node"))
    k = max(1, int(math.sqrt(len(bins)))) if o.trees > 1 else len(bins)
    count = dict.fromkeys(range(o.trees), 1)
    keys = ["tree_id", "node"]
    for depth in range(o.max_depth):
        hist = histogram(base, "bins", keys, "label", "weight").persist()  # by the model's shape; a lost block is worked out anew
        tops = majorities(hist, keys)
        if depth < o.max_depth - 1:
            seen = hist if k == len(bins) else hist.join(feature_subset(len(bins), hist.select(*keys).distinct(), k, o.seed), [*keys, "feature"])
            tops = tops.join(best_splits(split_gains(seen, keys, groups, o.criterion), keys), keys, "left")
        else:
            tops = tops.withColumn("gain", F.lit(None).cast("double"))
        tops = {(r["tree_id"], r["node"]): r for r in tops.collect()}
        hist.unpersist()
        if not tops:
            break
        splits = []
        for (t, i), top in sorted(tops.items()):
            n = top["n"]
            cut = top["gain"] is not None and top["most"] < n and n >= o.min_split and count[t] + 2 <= o.max_nodes
            if not cut or top["gain"] <= gain_floor(n, o) or min(top["n_left"], top["n_right"]) < o.min_leaf:
                nodes.append(Node(t, i, depth, top["label"]))
            else:
                nodes.append(Node(t, i, depth, top["label"], top["feature"], top["at_most"]))
                count[t] += 2
                splits.append((t, i, top["feature"], top["at_most"]))
        if not splits:
            break
        table = spark.createDataFrame(splits, "tree_id int, node long, feature int, at_most int")
        value = F.element_at("bins", F.col("feature") + 1)
        # A level's splits: trees x nodes of a level, bounded by the options.
        base = base.join(F.broadcast(table), keys).withColumn("node", F.when(value <= F.col("at_most"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)).drop("feature", "at_most")
        if folder and depth % WRITE_EVERY == WRITE_EVERY - 1:
            base.write.mode("overwrite").parquet(f"{folder}/level-{depth}")
            base = spark.read.parquet(f"{folder}/level-{depth}")
    return Forest(nodes, o)


def train_forest(df: DataFrame, row_id: str, bins: Sequence[str], labels: int, groups: int, options: TreeOptions = TreeOptions(), folder: str | None = None) -> Forest:
    """Bagged forest (Poisson weights from the row's id), or one tree on all rows."""
    from quantgrove.operators.sampling import poisson_bags

    if options.trees == 1 or not options.bootstrap:
        rows = df.withColumn("weight", F.lit(1)).withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(options.trees - 1))))
    else:
        rows = poisson_bags(df, row_id, options.trees, options.seed)
    return grow(rows.select(row_id, "tree_id", "weight", "label", *bins), bins, labels, groups, options, folder=folder)


def out_of_bag_votes(forest: Forest, df: DataFrame, row_id: str, bins: Sequence[str], min_share: float = 0.15) -> DataFrame:
    """Predictions of each row by the trees that did not see it; rows with too few such trees are left out."""
    from quantgrove.functions.arithmetic import uniform_sql

    o = forest.options
    each = ", ".join(f"CASE WHEN {uniform_sql(f'{row_id} * 131 + {t} * 7919', o.seed)} < 0.36787944117144233e0 THEN {forest.tree_sql(t, bins)} END" for t in sorted(forest.trees()))
    votes = F.expr(f"array_compact(array({each}))")
    voted = df.withColumn("v", votes).where(F.size("v") >= math.ceil(min_share * o.trees))
    kinds = F.array_distinct("v")
    best = F.array_max(F.transform(kinds, lambda k: F.struct(F.size(F.filter("v", lambda x: x == k)).alias("c"), (-k).alias("k"))))
    return voted.withColumn("__b", best).select(row_id, F.col("label").alias("actual"), (-F.col("__b.k")).alias("predicted"), (F.col("__b.c") / F.size("v")).alias("consensus"))


def validation_votes(forest: Forest, df: DataFrame, bins: Sequence[str], labels: int) -> DataFrame:
    """actual, predicted, consensus of rows that no tree has seen: all trees vote."""
    return forest.predict(df, bins, labels).select(F.col("label").alias("actual"), "predicted", "consensus")


def cross_validate(df: DataFrame, row_id: str, bins: Sequence[str], labels: int, groups: int, options: TreeOptions = TreeOptions(), k: int = 4) -> DataFrame:
    """fold, accuracy, n: each fold is judged by a forest that was trained on the others."""
    from quantgrove.operators.sampling import folds

    dealt, out = folds(df, row_id, k, options.seed).persist(), None
    for i in range(k):
        forest = train_forest(dealt.where(F.col("fold") != i), row_id, bins, labels, groups, options)
        one = validation_votes(forest, dealt.where(F.col("fold") == i), bins, labels).agg(F.lit(i).alias("fold"), F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def grid_search(df: DataFrame, row_id: str, bins: Sequence[str], labels: int, groups: int, grid: Sequence[TreeOptions]) -> tuple[TreeOptions, float]:
    """The first strictly best of the candidates by out-of-bag accuracy (validation for a single tree is the caller's)."""
    best = (grid[0], -1.0)
    for o in grid:
        forest = train_forest(df, row_id, bins, labels, groups, o)
        got = out_of_bag_votes(forest, df, row_id, bins).agg(F.avg((F.col("actual") == F.col("predicted")).cast("double"))).first()[0] or 0.0
        if got > best[1]:
            best = (o, got)
    return best


def shape(forest: Forest, spark) -> DataFrame:
    """Nodes, leaves and depth of every tree."""
    rows = [(n.tree_id, n.depth, n.is_leaf) for n in forest.nodes]
    return spark.createDataFrame(rows, "tree_id int, depth int, leaf boolean").groupBy("tree_id").agg(F.count("*").alias("nodes"), F.count_if("leaf").alias("leaves"), F.max("depth").alias("depth"))


def forest_shape(forest: Forest, spark) -> DataFrame:
    """One row: nodes of all trees, of the largest, least and most depth."""
    return shape(forest, spark).agg(F.sum("nodes").alias("total_nodes"), F.max("nodes").alias("max_nodes"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


# --- what leaves say ---------------------------------------------------------


def leaf_sql(nodes: dict[int, Node], bins: Sequence[str]) -> str:
    """Number of the leaf that a row falls into, as nested CASE expressions."""

    def walk(i: int) -> str:
        n = nodes[i]
        if n.is_leaf or 2 * i + 1 not in nodes:
            return f"{i}L"
        return f"CASE WHEN {bins[n.feature]} <= {n.at_most} THEN {walk(2 * i + 1)} ELSE {walk(2 * i + 2)} END"

    return walk(0)


def leaves(forest: Forest, df: DataFrame, bins: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep, tree_id, leaf: a row for each tree that a row of the table goes down."""
    each = ", ".join(f"named_struct('tree_id', {t}, 'leaf', {leaf_sql(nodes, bins)})" for t, nodes in sorted(forest.trees().items()))
    return df.select(*keep, F.explode(F.expr(f"array({each})")).alias("x")).select(*keep, "x.tree_id", "x.leaf")


def leaf_counts(forest: Forest, df: DataFrame, bins: Sequence[str], label: str = "label") -> DataFrame:
    """tree_id, leaf, label, n of labelled rows: partial sums, then as many rows as leaves times labels."""
    return leaves(forest, df, bins, [label]).groupBy("tree_id", "leaf", F.col(label).alias("label")).agg(F.count("*").alias("n"))


def adapt_leaves(forest: Forest, counts: DataFrame) -> Forest:
    """Leaves take the majority of the labels that came to them, their own label counted once; the lowest wins ties."""
    seen: dict[tuple[int, int], dict[int, int]] = {}
    for r in counts.collect():  # by the model's shape
        seen.setdefault((r["tree_id"], r["leaf"]), {})[r["label"]] = r["n"]
    nodes = []
    for n in forest.nodes:
        got = dict(seen.get((n.tree_id, n.node), {}))
        if got and n.is_leaf:
            got[n.label] = got.get(n.label, 0) + 1
            n = replace(n, label=max(got, key=lambda k: (got[k], -k)))
        nodes.append(n)
    return Forest(nodes, forest.options)


def tree_scores(forest: Forest, df: DataFrame, order: str, bins: Sequence[str], label: str = "label", fade: float = 0.999, start: float = 1.0) -> DataFrame:
    """tree_id, score after the rows in order: s <- s fade + right (1 - fade), in closed form.

    Rows are numbered from the newest once; a row of age a weighs fade^a for
    every tree, so the sum needs no order.
    """
    from quantgrove.operators.feedback import numbered

    aged = numbered(df.select(order, F.col(label).alias("label"), *bins), [order], "__place")
    n = df.count()
    votes = ", ".join(f"named_struct('tree_id', {t}, 'vote', {forest.tree_sql(t, bins)})" for t in sorted(forest.trees()))
    each = aged.select("label", (n - 1 - F.col("__place")).alias("age"), F.explode(F.expr(f"array({votes})")).alias("x"))
    hit = (F.col("x.vote") == F.col("label")).cast("double") * (1 - fade) * F.pow(F.lit(fade), F.col("age"))
    return each.groupBy("x.tree_id").agg((F.sum(hit) + start * fade**n).alias("score"))


def worst_tree(scores: DataFrame, behind: float = 0.15, below: float = 0.7) -> DataFrame:
    """tree_id, score, average of the tree with the lowest score, where it is far behind the average and poor; else no row."""
    one = scores.agg(F.min(F.struct("score", "tree_id")).alias("w"), F.avg("score").alias("average"))
    return one.where((F.col("w.score") < F.col("average") - behind) & (F.col("w.score") < below)).select("w.tree_id", "w.score", "average")


def replace_worst(forest: Forest, scores: dict[int, float], buffer: DataFrame, order: str, bins: Sequence[str], labels: int, groups: int, least: int = 500, share: float = 0.7) -> tuple[Forest, dict[int, float]]:
    """Replace a tree that fell behind by one grown on the newest rows, if that does better on the last part of them.

    The candidate learns from the older ``share`` of the buffer and both are
    judged on the rest; a better one is grown again on all of it and starts at
    the average score. Otherwise the old tree's score moves half way there.
    """
    from quantgrove.operators.feedback import numbered

    spark = buffer.sparkSession
    found = worst_tree(spark.createDataFrame(sorted(scores.items()), "tree_id int, score double")).collect()
    n = buffer.count()
    if not found or n < least:
        return forest, scores
    t, average = found[0]["tree_id"], found[0]["average"]
    rows = numbered(buffer.select(order, "label", *bins), [order], "__place").withColumn("tree_id", F.lit(t)).withColumn("weight", F.lit(1))
    cut, one = int(n * share), replace(forest.options, trees=1, bootstrap=False)

    def grown(df: DataFrame) -> Forest:
        made = grow(df.withColumn("tree_id", F.lit(0)), bins, labels, groups, one)
        return Forest([replace(x, tree_id=t) for x in made.nodes], forest.options)

    new, old = grown(rows.where(F.col("__place") < cut)), Forest([x for x in forest.nodes if x.tree_id == t], forest.options)
    right = [F.avg((F.expr(m.tree_sql(t, bins)) == F.col("label")).cast("double")) for m in (old, new)]
    before, after = rows.where(F.col("__place") >= cut).agg(*[r.alias(f"r{i}") for i, r in enumerate(right)]).first()
    if after > before:
        kept = [x for x in forest.nodes if x.tree_id != t]
        return Forest(kept + grown(rows).nodes, forest.options), scores | {t: average}
    return forest, scores | {t: (scores[t] + average) / 2}


# --- compact form ------------------------------------------------------------


def compact(forest: Forest, spark) -> DataFrame:
    """tree_id, node, kind, at, rank, left, right, label, feature, at_most: nodes by kind, numbered apart.

    A branch is ``internal`` where its children are of one kind and ``mixed``
    otherwise. ``at`` numbers leaves and branches, each in order of the nodes;
    ``rank`` is how many mixed branches come before it; children are given by
    their own numbers.
    """
    rows = [(n.tree_id, n.node, n.label, n.feature, n.at_most, n.is_leaf) for n in forest.nodes]
    df = spark.createDataFrame(rows, "tree_id int, node long, label int, feature int, at_most int, leaf boolean")
    number = F.row_number().over(Window.partitionBy("tree_id", "leaf").orderBy("node")) - 1  # within one tree
    df = df.withColumn("at", number)
    child = df.select("tree_id", F.col("node").alias("c"), F.col("at").alias("c_at"), F.col("leaf").alias("c_leaf"))
    side = lambda d, k: child.select("tree_id", ((F.col("c") - k) / 2).cast("long").alias("node"), F.col("c_at").alias(d), F.col("c_leaf").alias(f"{d}_leaf")).where((F.col("c") - k) % 2 == 0).where(F.col("c") > 0)
    both = df.join(side("left", 1), ["tree_id", "node"], "left").join(side("right", 2), ["tree_id", "node"], "left")
    kind = F.when(F.col("leaf"), "leaf").when(F.col("left_leaf") == F.col("right_leaf"), "internal").otherwise("mixed")
    before = Window.partitionBy("tree_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("kind", kind).withColumn("rank", F.coalesce(F.count_if(F.col("kind") == "mixed").over(before), F.lit(0)))
    return out.select("tree_id", "node", "kind", "at", "rank", "left", "right", "label", "feature", "at_most")


def layout(forest: Forest, features: int, labels: int, groups: int) -> dict[str, int]:
    """Bits of each field of the packed form, from the largest number that it holds."""
    width = lambda top: max(1, int(top).bit_length())
    per = [len(t) for t in forest.trees().values()] or [1]
    return {"feature": width(features - 1), "label": width(labels - 1), "threshold": width(groups - 1), "child": width(max(per) - 1)}
