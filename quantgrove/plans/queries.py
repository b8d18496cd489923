"""Registered queries over the engine's operators, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrove.functions.arithmetic import bits_required, draw_sql, pack_bits, uniform_sql, unpack_bits
from quantgrove.operators import boosting, drift, feedback, idset, images, metrics, quantizer, reports, sampling, trees
from quantgrove.sources import csv
from quantgrove.sources.shared import scratch, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a learning table: row_id, label, four features."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_returnflag").alias("label"), *FEATURES)


def each(template: str, names=FEATURES) -> str:
    return " UNION ALL ".join(template.format(f=f, i=i) for i, f in enumerate(names))


# --- statistics and quantisers ---------------------------------------------

STATS = each("SELECT '{f}' AS feature, count(*) AS n, avg({f}) AS mean, stddev_pop({f}) AS sd, min({f}) AS low, max({f}) AS high FROM lineitem")


@query(f"SELECT feature, n, round(mean, 4) AS mean, round(sd, 4) AS sd, low, high FROM ({STATS})")
def feature_stats(spark, sf_dir):
    s = quantizer.feature_stats(table(spark, sf_dir, "lineitem"), FEATURES)
    return s.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query(each("SELECT '{f}' AS feature, unnest([1, 2, 3]) AS edge_no, round(unnest(quantile_cont({f}, [0.25, 0.5, 0.75])), 4) AS edge FROM lineitem"))
def quantile_edges(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    got = df.agg(*[quantizer.quantile_edges(F.col(f), 4).alias(f) for f in FEATURES])
    return got.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("e")) for f in FEATURES])).alias("s")).select("s.feature", F.posexplode("s.e").alias("i", "edge")).select("feature", (F.col("i") + 1).alias("edge_no"), F.round("edge", 4).alias("edge"))


CLIPPED = each("SELECT '{f}' AS feature, {f} AS v, greatest(least({f}, m + 2 * s), m - 2 * s) AS c FROM lineitem, (SELECT avg({f}) AS m, stddev_pop({f}) AS s FROM lineitem)")


@query(f"SELECT feature, count(*) FILTER (v <> c) AS clipped, round(min(c), 4) AS low, round(max(c), 4) AS high, round(avg(c), 4) AS mean FROM ({CLIPPED}) GROUP BY feature")
def clip_outliers_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    stats = {r["feature"]: r for r in quantizer.feature_stats(df, FEATURES).collect()}
    aggs = []
    for f in FEATURES:
        c = quantizer.clip(F.col(f), stats[f]["mean"], stats[f]["sd"], 2.0)
        aggs.append(F.struct(F.lit(f).alias("feature"), F.count_if(F.col(f) != c).alias("clipped"), F.round(F.min(c), 4).alias("low"), F.round(F.max(c), 4).alias("high"), F.round(F.avg(c), 4).alias("mean")).alias(f))
    return df.agg(*aggs).select(F.explode(F.array(*FEATURES)).alias("s")).select("s.*")


BOUNDED = "SELECT " + ", ".join(f"avg({f}) AS m{i}, stddev_pop({f}) AS s{i}" for i, f in enumerate(FEATURES)) + " FROM lineitem"
CLIP_ALL = "SELECT l_orderkey * 8 + l_linenumber AS row_id, l_returnflag AS label, " + ", ".join(f"greatest(least({f}, m{i} + 3 * s{i}), m{i} - 3 * s{i}) AS c{i}" for i, f in enumerate(FEATURES)) + f" FROM lineitem, ({BOUNDED})"
EDGES = "SELECT " + ", ".join(f"quantile_cont(c{i}, [0.25, 0.5, 0.75]) AS e{i}" for i in range(4)) + " FROM c"
BINS = f"c AS ({CLIP_ALL}), e AS ({EDGES}), b AS (SELECT row_id, label, " + ", ".join(f"cast((c{i} >= e{i}[1])::int + (c{i} >= e{i}[2])::int + (c{i} >= e{i}[3])::int AS int) AS bin_{i}" for i in range(4)) + " FROM c, e)"


def _quantizer(spark: SparkSession, sf_dir: str) -> quantizer.Quantizer:
    return quantizer.fit(table(spark, sf_dir, "lineitem"), FEATURES, bits=2)


def binned(spark, sf_dir) -> DataFrame:
    return quantizer.bins(_quantizer(spark, sf_dir), items(spark, sf_dir)).select("row_id", "label", *[f"bin_{i}" for i in range(4)])


@query(f"WITH {BINS} SELECT * FROM b")
def quantize_bins(spark, sf_dir):
    return binned(spark, sf_dir)


@query("""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders),
x AS (SELECT lo, greatest(1, trunc(65535 / (hi - lo))) AS k, list_transform(e, lambda v: trunc(least(65535.0, (v - lo) * greatest(1, trunc(65535 / (hi - lo)))) + 0.5)) AS g FROM s)
SELECT cast((floor((o_totalprice - lo) * k) >= g[1])::int + (floor((o_totalprice - lo) * k) >= g[2])::int + (floor((o_totalprice - lo) * k) >= g[3])::int AS int) AS bin, count(*) AS n FROM orders, x GROUP BY 1
""")
def quantize_fixed16(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rule = quantizer.fit(df, ["o_totalprice"], bits=2, z=None).rules[0]
    return df.groupBy(quantizer.fixed_point(rule, F.col("o_totalprice")).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT cast(p_size AS double) AS value, cast(dense_rank() OVER (ORDER BY p_size) - 1 AS int) AS bin, count(*) AS n FROM part GROUP BY p_size UNION ALL SELECT cast(l_linenumber AS double), cast(dense_rank() OVER (ORDER BY l_linenumber) - 1 AS int), count(*) FROM lineitem GROUP BY l_linenumber")
def discrete_dictionary(spark, sf_dir):
    out = []
    for name, column, bits in (("part", "p_size", 6), ("lineitem", "l_linenumber", 3)):
        df = table(spark, sf_dir, name).select(F.col(column).cast("double").alias("value"))
        q = quantizer.fit(df, ["value"], bits=bits)
        out.append(quantizer.bins(q, df).groupBy("value", F.col("bin_0").alias("bin")).agg(F.count("*").alias("n")))
    return out[0].union(out[1])


@query("SELECT c_mktsegment AS label, count(*) AS rows, cast(row_number() OVER (ORDER BY c_mktsegment) - 1 AS int) AS label_id FROM customer GROUP BY 1")
def label_dictionary(spark, sf_dir):
    return csv.label_dictionary(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("""
WITH d AS (SELECT c_mktsegment AS l, count(*) AS k, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM customer GROUP BY 1)
SELECT 'quantization_coefficient' AS parameter, CAST(2 AS BIGINT) AS value UNION ALL SELECT 'num_features', 1 UNION ALL SELECT 'num_samples', cast(sum(k) AS BIGINT) FROM d UNION ALL SELECT 'num_labels', count(*) FROM d
UNION ALL SELECT 'samples_label_' || i, k FROM d
""")
def dataset_params(spark, sf_dir):
    return csv.dataset_params(table(spark, sf_dir, "customer"), "c_mktsegment", 1, 2)


@query("""
WITH d AS (SELECT c_mktsegment AS label, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM customer WHERE c_mktsegment < 'H' GROUP BY 1)
SELECT c_custkey, cast(coalesce(i, 0) AS int) AS label_id FROM customer LEFT JOIN d ON c_mktsegment = label
""")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    known = csv.label_dictionary(df.where("c_mktsegment < 'H'"), "c_mktsegment")
    return csv.encode(df, known, "c_mktsegment").select("c_custkey", "label_id")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, string_split(line, ',') AS c FROM l)
SELECT doc_id, count(*) AS kept FROM c WHERE len(c) - (CASE WHEN len(c) > 1 AND trim(c[-1], ' ') = '' THEN 1 ELSE 0 END) = 3 GROUP BY doc_id
""")
def malformed_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return csv.keep_well_formed(lines, 3).groupBy("doc_id").agg(F.count("*").alias("kept"))


# --- windows of rows ---------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def fifo_last_n(spark, sf_dir):
    return feedback.last_n(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 1000)


@query("WITH k AS (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500) SELECT event_type, count(*) AS evicted FROM events WHERE event_id NOT IN (SELECT event_id FROM k) GROUP BY 1")
def fifo_evicted_labels(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    _, gone = feedback.append_with_eviction(df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1"), "event_id", 500)
    return gone.groupBy("event_type").agg(F.count("*").alias("evicted"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) GROUP BY 1")
def load_id_set(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return feedback.by_ids(table(spark, sf_dir, "lineitem").select("l_orderkey"), wanted, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 3000 AND 3999")
def load_chunk(spark, sf_dir):
    return feedback.chunk(table(spark, sf_dir, "orders"), "o_orderkey", 3, 1000).select("o_orderkey", "o_custkey")


# --- bits ----------------------------------------------------------------------


@query(f"WITH {BINS} SELECT row_id, cast(bin_0 + bin_1 * 4 + bin_2 * 16 + bin_3 * 64 AS BIGINT) AS word FROM b")
def pack_bits_rows(spark, sf_dir):
    return binned(spark, sf_dir).select("row_id", pack_bits([F.col(f"bin_{i}") for i in range(4)], 2).alias("word"))


@query(f"WITH {BINS} SELECT bin_0, bin_1, bin_2, bin_3, count(*) AS n FROM b GROUP BY ALL")
def unpack_bits_rows(spark, sf_dir):
    word = pack_bits([F.col(f"bin_{i}") for i in range(4)], 2)
    parts = unpack_bits(F.col("word"), 2, 4)
    return binned(spark, sf_dir).select(word.alias("word")).select(*[p.cast("int").alias(f"bin_{i}") for i, p in enumerate(parts)]).groupBy("bin_0", "bin_1", "bin_2", "bin_3").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, cast(greatest(1, length(bin(o_orderkey))) AS int) AS bits FROM orders")
def bits_required_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", bits_required(F.col("o_orderkey")).alias("bits"))


@query(f"WITH {BINS} SELECT count(*) AS rows, count(*) FILTER (bin_0 <= 2 AND bin_1 <= 2 AND bin_2 <= 2 AND bin_3 <= 2) AS valid FROM b")
def row_validity(spark, sf_dir):
    return binned(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(metrics.valid_rows(F.array(*[f"bin_{i}" for i in range(4)]), 2)).alias("valid"))


# --- sampling --------------------------------------------------------------------

DRAW = draw_sql("doc_id")


@query(f"""
WITH r AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY {DRAW} % 64, {DRAW}, doc_id) AS nth FROM labels)
SELECT doc_id, quality, CASE WHEN nth <= greatest(floor(n * 0.7), 1) THEN 'train' WHEN nth <= greatest(floor(n * 0.7), 1) + greatest(floor(n * 0.15), 1) THEN 'valid' ELSE 'test' END AS part FROM r
""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", "quality", "part")


def placed(name: str, key: str) -> str:
    """SQL of a table's rows in order of their draw: ``pos`` from 1, and their number n."""
    d = draw_sql(key)
    return f"SELECT *, row_number() OVER (ORDER BY {d} % 1024, {d}, {key}) AS pos, count(*) OVER () AS n FROM {name}"


@query(f"SELECT CASE WHEN pos <= floor(n * 0.7e0) THEN 'train' WHEN pos <= floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'test' ELSE 'valid' END AS part, count(*) AS n, cast(sum(o_orderkey) AS BIGINT) AS ids FROM ({placed('orders', 'o_orderkey')}) GROUP BY 1")
def random_split(spark, sf_dir):
    return sampling.random_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


BAGS = f"bags AS (SELECT cast(id % 5 AS int) AS tree_id, cast(floor({uniform_sql('id')} * n) AS BIGINT) AS row, count(*) AS weight FROM (SELECT unnest(range(5 * n)) AS id, n FROM (SELECT count(*) AS n FROM embeddings)) GROUP BY ALL)"


@query(f"WITH {BAGS} SELECT tree_id, row, least(weight, 7) AS weight FROM bags")
def bootstrap_bags(spark, sf_dir):
    return sampling.bootstrap(table(spark, sf_dir, "embeddings").count(), 5, spark, cap=7)


@query(f"WITH {BAGS} SELECT t AS tree_id, vec_id AS row FROM embeddings, (SELECT unnest(range(5))::int AS t) WHERE NOT EXISTS (SELECT 1 FROM bags WHERE tree_id = t AND row = vec_id)")
def oob_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"))
    return sampling.out_of_bag(rows, sampling.bootstrap(rows.count(), 5, spark), 5)


FOLDED = f"f AS (SELECT doc_id, quality, cast(least(floor((pos - 1) / greatest(floor(n / 4), 1)), 3) AS int) AS fold FROM ({placed('labels', 'doc_id')}))"


@query(f"WITH {FOLDED} SELECT fold, quality, count(*) AS n FROM f GROUP BY ALL")
def kfold_counts(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "labels"), "doc_id").groupBy("fold", "quality").agg(F.count("*").alias("n"))


@query(f"WITH {FOLDED} SELECT doc_id FROM f WHERE fold <> 1")
def kfold_complement(spark, sf_dir):
    df = sampling.folds(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return df.select("doc_id").join(df.where("fold = 1").select("doc_id"), "doc_id", "left_anti")


NODE_DRAW = draw_sql("tree_id * 100003 + node * 1009 + feature * 17")


@query(f"SELECT tree_id, node, feature FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node ORDER BY {NODE_DRAW}, feature) AS r FROM (SELECT unnest(range(10))::int AS tree_id), (SELECT unnest(range(16)) AS node), (SELECT unnest(range(64))::int AS feature)) WHERE r <= 8")
def feature_subsets(spark, sf_dir):
    nodes = spark.range(16).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("tree_id"))
    return sampling.feature_subset(64, nodes, 8)


# --- id multisets -----------------------------------------------------------------

SETS = "a AS (SELECT l_orderkey AS id, least(count(*), 3) AS ca FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS id, least(count(*), 3) AS cb FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)"


def _sets(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return idset.multiset(df.where("l_returnflag = 'R'"), "l_orderkey", 3), idset.multiset(df.where("l_discount > 0.05"), "l_orderkey", 3)


@query(f"WITH {SETS} SELECT id, greatest(coalesce(ca, 0), coalesce(cb, 0)) AS cnt FROM a FULL JOIN b USING (id)")
def idset_union(spark, sf_dir):
    return idset.union(*_sets(spark, sf_dir))


@query(f"WITH {SETS} SELECT id, least(ca, cb) AS cnt FROM a JOIN b USING (id)")
def idset_intersect(spark, sf_dir):
    return idset.intersect(*_sets(spark, sf_dir))


@query(f"WITH {SETS} SELECT id, least(coalesce(ca, 0) + (cb IS NOT NULL)::int, 3) AS cnt FROM a FULL JOIN b USING (id)")
def idset_plus(spark, sf_dir):
    return idset.plus(*_sets(spark, sf_dir), 3)


@query(f"WITH {SETS} SELECT id, ca AS cnt FROM a WHERE id NOT IN (SELECT id FROM b)")
def idset_minus(spark, sf_dir):
    return idset.minus(*_sets(spark, sf_dir))


@query(f"WITH {SETS}, o AS (SELECT count(*) AS k FROM a LEFT JOIN b USING (id) WHERE ca > coalesce(cb, 0)) SELECT k = 0 AS subset, k AS exceeding FROM o")
def idset_subset(spark, sf_dir):
    return idset.is_subset(*_sets(spark, sf_dir))


@query(f"WITH {SETS} SELECT count(*) = 0 AS equal FROM a FULL JOIN b USING (id) WHERE ca IS DISTINCT FROM cb")
def idset_equal(spark, sf_dir):
    return idset.is_equal(*_sets(spark, sf_dir))


@query(f"WITH {SETS} SELECT cast(sum(ca) AS BIGINT) AS size, count(*) AS unique_size, min(id) AS low, max(id) AS high FROM a")
def idset_summary(spark, sf_dir):
    return idset.summary(_sets(spark, sf_dir)[0])


# --- trees ---------------------------------------------------------------------------

LONG_BINS = "h0 AS (" + " UNION ALL ".join(f"SELECT {i} AS feature, bin_{i} AS bin, label, count(*) AS w FROM b GROUP BY ALL" for i in range(4)) + ")"


@query(f"WITH {BINS}, {LONG_BINS} SELECT cast(feature AS int) AS feature, bin, label, cast(w AS double) AS w FROM h0")
def split_histogram(spark, sf_dir):
    return trees.histogram(binned(spark, sf_dir), [f"bin_{i}" for i in range(4)], [])


def _gain_sql(imp: str) -> str:
    side = "sum({x}) OVER (PARTITION BY feature, t)"
    return f"""WITH {BINS}, {LONG_BINS}, s AS (SELECT feature, t, label, cast(sum(w) FILTER (bin <= t) AS double) AS l, cast(sum(w) AS double) AS a FROM h0, (SELECT unnest([0, 1, 2]) AS t) GROUP BY ALL),
s2 AS (SELECT feature, t, label, coalesce(l, 0) AS l, a, a - coalesce(l, 0) AS r FROM s), n AS (SELECT *, {side.format(x="l")} AS nl, {side.format(x="r")} AS nr, {side.format(x="a")} AS na FROM s2),
g AS (SELECT feature, t, max(nl) AS nl, max(nr) AS nr, {imp.format(x="a", n="na")} AS ia, {imp.format(x="l", n="nl")} AS il, {imp.format(x="r", n="nr")} AS ir FROM n WHERE nl > 0 AND nr > 0 GROUP BY feature, t)
SELECT cast(feature AS int) AS feature, cast(t AS int) AS at_most, round(ia - nl / (nl + nr) * il - nr / (nl + nr) * ir, 6) AS gain, nl AS n_left, nr AS n_right FROM g"""


def _gains(spark, sf_dir, criterion):
    hist = trees.histogram(binned(spark, sf_dir), [f"bin_{i}" for i in range(4)], [])
    return trees.split_gains(hist, [], 4, criterion).withColumn("gain", F.round("gain", 6))


@query(_gain_sql("1 - sum(({x} / {n}) * ({x} / {n}))"))
def root_split_gain_gini(spark, sf_dir):
    return _gains(spark, sf_dir, "gini")


@query(_gain_sql("-sum(CASE WHEN {x} > 0 THEN {x} / {n} * log2({x} / {n}) ELSE 0 END)"))
def root_split_gain_entropy(spark, sf_dir):
    return _gains(spark, sf_dir, "entropy")


@query(f"""
WITH {BINS}, x AS (SELECT *, CASE WHEN label = 'A' THEN 0 WHEN label = 'N' THEN 1 ELSE 2 END AS k FROM b), gh AS (SELECT *, 1.0 / 3 - (k = 0)::int AS g, 2.0 / 9 AS h FROM x),
c AS ({" UNION ALL ".join(f"SELECT {i} AS feature, t, sum(g) FILTER (bin_{i} <= t) AS gl, sum(h) FILTER (bin_{i} <= t) AS hl, sum(g) AS g, sum(h) AS h FROM gh, (SELECT unnest([0, 1, 2]) AS t) GROUP BY t" for i in range(4))})
SELECT cast(feature AS int) AS feature, cast(t AS int) AS at_most, round(0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)), 4) AS gain FROM c
""".replace("c AS (SELECT 0 AS", "cc AS (SELECT 0 AS").replace("FROM c\n", "FROM cc\n"))
def boost_root_gain(spark, sf_dir):
    df = binned(spark, sf_dir).withColumn("label", F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2))
    g, h = boosting.gradients([F.lit(0.0)] * 3, F.col("label"), 0)
    gains = boosting.split_gains(boosting.histogram(df, [f"bin_{i}" for i in range(4)], g, h, F.lit(0)), 4)
    return gains.select("feature", "at_most", F.round("gain", 4).alias("gain"))


def vectors(spark, sf_dir) -> tuple[DataFrame, list[str], int]:
    """embeddings as bins: vec_id, label, one bin column a feature."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
    q = quantizer.fit(df, [f"f{i}" for i in range(64)], bits=2)
    names = [f"bin_{i}" for i in range(64)]
    # Every level of every tree reads the bins again.
    return written(quantizer.bins(q, df).select("vec_id", "label", *names), "bins"), names, 10


@query()
def forest_predict(spark, sf_dir):
    df, names, labels = vectors(spark, sf_dir)
    forest = trees.train_forest(df, "vec_id", names, labels, 4, trees.TreeOptions(trees=10, max_depth=6))
    return forest.predict(df, names, labels).select("vec_id", "label", "predicted", "consensus")


@query()
def forest_out_of_bag(spark, sf_dir):
    df, names, labels = vectors(spark, sf_dir)
    forest = trees.train_forest(df, "vec_id", names, labels, 4, trees.TreeOptions(trees=10, max_depth=6))
    return metrics.per_label(metrics.confusion(trees.out_of_bag_votes(forest, df, "vec_id", names)))


@query()
def boost_predict(spark, sf_dir):
    df = binned(spark, sf_dir).withColumn("label", F.when(F.col("label") == "A", 0).when(F.col("label") == "N", 1).otherwise(2))
    names = [f"bin_{i}" for i in range(4)]
    model = boosting.train(df, names, 3, 4, boosting.BoostOptions(rounds=2, depth=2))
    return model.predict(df, names).groupBy("label", "predicted").agg(F.count("*").alias("n"))


# --- metrics ------------------------------------------------------------------------------

PREDICTED = "p AS (SELECT quality AS actual, CASE WHEN doc_id % 7 < 5 THEN 1 ELSE 0 END AS predicted, (doc_id * 37 % 21) / 20.0e0 AS consensus FROM labels)"
CONFUSION = f"WITH {PREDICTED}, t AS (SELECT l AS label, count(*) FILTER (actual = l AND predicted = l) AS tp, count(*) FILTER (actual <> l AND predicted = l) AS fp, count(*) FILTER (actual = l AND predicted <> l) AS fn FROM p, (SELECT unnest([0, 1]) AS l) GROUP BY 1), m AS (SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall FROM t), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"


def predictions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("actual"), F.when(F.col("doc_id") % 7 < 5, 1).otherwise(0).alias("predicted"), ((F.col("doc_id") * 37 % 21) / F.lit(20.0)).alias("consensus"))


@query(f"{CONFUSION} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def confusion_metrics(spark, sf_dir):
    t = metrics.per_label(metrics.confusion(predictions(spark, sf_dir)))
    return t.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"{CONFUSION} SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f")
def macro_scores(spark, sf_dir):
    m = metrics.macro(metrics.confusion(predictions(spark, sf_dir)))
    return m.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


SWEEP = f"""WITH {PREDICTED}, th AS (SELECT DISTINCT consensus AS threshold FROM p UNION SELECT 0.0e0 UNION SELECT 1.0e0),
s AS (SELECT threshold, count(*) AS n, count(*) FILTER (consensus >= threshold) AS answered, count(*) FILTER (consensus >= threshold AND actual = predicted) AS tp FROM th, p GROUP BY 1),
m AS (SELECT *, answered - tp AS fp, n - tp AS fn, CASE WHEN answered > 0 THEN tp / answered ELSE 0 END AS precision, tp / n AS recall, answered / n AS coverage FROM s),
z AS (SELECT *, CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END AS f05 FROM m)"""


@query(f"{SWEEP} SELECT round(threshold, 6) AS threshold, n, answered, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coverage, 6) AS coverage, round(f05, 6) AS score FROM z")
def abstention_sweep(spark, sf_dir):
    s = metrics.threshold_sweep(predictions(spark, sf_dir), metrics.Metric.PRECISION)
    return s.select(F.round("threshold", 6).alias("threshold"), "n", "answered", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "coverage", "score")])


@query(f"{SWEEP} SELECT round(threshold, 6) AS threshold, round(f05, 6) AS score, round(coverage, 6) AS coverage FROM z ORDER BY round(f05, 6) DESC, round(coverage, 6) DESC, threshold LIMIT 1")
def objective_score(spark, sf_dir):
    best = metrics.best_threshold(metrics.threshold_sweep(predictions(spark, sf_dir), metrics.Metric.PRECISION))
    return best.select(*[F.round(c, 6).alias(c) for c in ("threshold", "score", "coverage")])


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL), r AS (SELECT *, sum(k) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_type) AS i FROM c)
SELECT user_id, event_type AS label, k AS votes, cast(total AS BIGINT) AS total, round(k / total, 6) AS consensus FROM r WHERE i = 1
""")
def vote_majority(spark, sf_dir):
    m = metrics.majority(table(spark, sf_dir, "events"), "user_id", "event_type")
    return m.withColumn("consensus", F.round("consensus", 6))


@query("""
WITH c AS (SELECT o_orderpriority, count(*) AS k FROM orders GROUP BY 1), s AS (SELECT count(*) AS classes, cast(sum(k) AS BIGINT) AS rows, max(k) / min(k) AS imbalance, min(k) * 100.0e0 / sum(k) AS rarest FROM c)
SELECT classes, rows, round(imbalance, 6) AS imbalance, round(rarest, 6) AS rarest_percent, CASE WHEN imbalance > 10 THEN 'RECALL' WHEN imbalance > 3 THEN 'F1' WHEN imbalance > 1.5 THEN 'PRECISION' ELSE 'ACCURACY' END AS metric FROM s
""")
def imbalance_autoconfig(spark, sf_dir):
    m = metrics.imbalance(table(spark, sf_dir, "orders"), "o_orderpriority")
    return m.withColumns({"imbalance": F.round("imbalance", 6), "rarest_percent": F.round("rarest_percent", 6)})


# --- adaptation ----------------------------------------------------------------------------

OLD = "o AS (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM events WHERE value < 60)"


def _events_rule(spark, sf_dir) -> quantizer.Rule:
    return quantizer.fit(table(spark, sf_dir, "events").where("value < 60"), ["value"], bits=2, z=None).rules[0]


@query(f"""
WITH {OLD} SELECT cast(CASE WHEN value > hi THEN 3 + ceil((value - hi) / ((hi - lo) / 4)) WHEN value < lo THEN -ceil((lo - value) / ((hi - lo) / 4)) ELSE (value >= e[1])::int + (value >= e[2])::int + (value >= e[3])::int END AS int) AS signal, count(*) AS n FROM events, o GROUP BY 1
""")
def drift_signal(spark, sf_dir):
    rule = _events_rule(spark, sf_dir)
    return table(spark, sf_dir, "events").groupBy(quantizer.signal_of(rule, 4, None, F.col("value")).alias("signal")).agg(F.count("*").alias("n"))


@query(f"WITH {OLD} SELECT event_id, cast(0 AS int) AS feature, value FROM events, o WHERE value > hi OR value < lo")
def first_drift_feature(spark, sf_dir):
    q = quantizer.Quantizer(2, (_events_rule(spark, sf_dir),), None)
    return quantizer.first_drift(q, table(spark, sf_dir, "events")).where("drift is not null").select("event_id", "drift.feature", "drift.value")


@query(f"""
WITH {OLD}, n AS (SELECT least(o.lo, min(value)) AS nlo, greatest(o.hi, max(value)) AS nhi, o.lo, o.hi, o.e FROM events, o GROUP BY o.lo, o.hi, o.e),
b AS (SELECT *, list_concat([lo], e, [hi]) AS om, list_concat([nlo], list_transform(e, lambda x: nlo + (x - lo) / (hi - lo) * (nhi - nlo)), [nhi]) AS nm FROM n),
p AS (SELECT i AS old_bin, j AS new_bin, greatest(0, least(om[i + 2], nm[j + 2]) - greatest(om[i + 1], nm[j + 1])) AS overlap FROM b, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j))
SELECT cast(old_bin AS int) AS old_bin, cast(arg_max(new_bin, overlap * 1000000 - new_bin * 1e-9) AS int) AS new_bin FROM p GROUP BY old_bin
""")
def bin_remap_expand(spark, sf_dir):
    rule = _events_rule(spark, sf_dir)
    low, high = table(spark, sf_dir, "events").agg(F.min("value"), F.max("value")).first()
    _, to = quantizer.expand(rule, low, high, 4)
    return spark.createDataFrame(list(enumerate(to)), "old_bin int, new_bin int")


@query(f"""
WITH {OLD}, b AS (SELECT (value >= e[1])::int + (value >= e[2])::int + (value >= e[3])::int AS bin FROM events, o WHERE value < e[2]), c AS (SELECT i, count(bin) AS k FROM (SELECT unnest(range(4)) AS i) LEFT JOIN b ON bin = i GROUP BY i),
s AS (SELECT least(2, (SELECT count(*) FROM c WHERE i >= 0 AND i < coalesce((SELECT min(i) FROM c WHERE k > 0), 4))) AS low, least(2, (SELECT count(*) FROM c WHERE i > (SELECT max(i) FROM c WHERE k > 0))) AS high)
SELECT cast(i AS int) AS old_bin, cast(least(greatest(i - low, 0), 3 - high) AS int) AS new_bin FROM c, s
""")
def bin_shrink(spark, sf_dir):
    rule = _events_rule(spark, sf_dir)
    df = table(spark, sf_dir, "events").where(F.col("value") < rule.edges[1])
    counts = {r["bin"]: r["n"] for r in df.groupBy(quantizer.bin_of(rule, 4, None, F.col("value")).alias("bin")).agg(F.count("*").alias("n")).collect()}
    _, to = quantizer.shrink(rule, [counts.get(i, 0) for i in range(4)], 4)
    return spark.createDataFrame(list(enumerate(to)), "old_bin int, new_bin int")


# --- ordered streams ---------------------------------------------------------------------------


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id AS predicted FROM events WHERE event_type = 'view'), a AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, CASE WHEN user_id % 10 <> 0 THEN event_id END AS actual FROM events WHERE event_type = 'click')
SELECT pos, predicted, actual FROM p JOIN a USING (pos) WHERE actual IS NOT NULL
""")
def positional_feedback_join(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    p = feedback.numbered(df.where("event_type = 'view'"), ["event_id"]).select("pos", F.col("event_id").alias("predicted"))
    a = feedback.numbered(df.where("event_type = 'click'"), ["event_id"]).select("pos", F.when(F.col("user_id") % 10 != 0, F.col("event_id")).alias("actual"))
    return feedback.positional_join(p, a)


IDX = "i AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value, user_id % 100 AS u, event_type, user_id FROM events)"


def ordered(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 100).alias("u"), "event_type", "user_id")
    return feedback.numbered(df, ["event_id"], "idx")


@query(f"WITH {IDX}, t AS (SELECT idx, avg((value >= 50)::int) OVER (ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS accuracy FROM i) SELECT idx AS at, round(accuracy, 6) AS accuracy FROM t WHERE idx >= 99 AND (idx + 1) % 10 = 0")
def trailing_accuracy(spark, sf_dir):
    t = drift.trailing_accuracy(ordered(spark, sf_dir).withColumn("c", F.col("value") >= 50), "idx", "c", 100, 10)
    return t.withColumn("accuracy", F.round("accuracy", 6))


WINDOWS = f"{IDX}, w AS (SELECT s AS start FROM (SELECT unnest(range(0, (SELECT count(*) FROM i) - 499, 250)) AS s)), x AS (SELECT start, i.* FROM w JOIN i ON idx >= start AND idx < start + 500)"


@query(f"WITH {WINDOWS} SELECT start, event_type, round(count(*) / 500, 6) AS share FROM x GROUP BY ALL")
def window_label_share(spark, sf_dir):
    return drift.label_share(ordered(spark, sf_dir), "idx", "event_type", 500, 250).withColumn("share", F.round("share", 6))


@query(f"WITH {WINDOWS}, r AS (SELECT avg(value) AS v, avg(u) AS u FROM i WHERE idx < 500), m AS (SELECT start, avg(value) AS v, avg(u) AS u FROM x GROUP BY 1) SELECT start, round(sqrt((m.v - r.v) * (m.v - r.v) + (m.u - r.u) * (m.u - r.u)), 6) AS distance FROM m, r")
def centroid_drift(spark, sf_dir):
    return drift.centroid_drift(ordered(spark, sf_dir), "idx", ["value", "u"], 500, 500, 250).withColumn("distance", F.round("distance", 6))


CELL = "least(greatest(floor((value - lo) / ((hi - lo) / 20)), 0), 19)"


@query(f"""
WITH {WINDOWS}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM i), r AS (SELECT {CELL} AS cell, count(*) / 500 AS p FROM i, b WHERE idx < 500 GROUP BY 1), q AS (SELECT start, {CELL} AS cell, count(*) / 500 AS q FROM x, b GROUP BY ALL)
SELECT w.start, round(sqrt(greatest(0, 1 - coalesce(sum(sqrt(p * q)), 0))), 5) AS distance FROM w LEFT JOIN q ON w.start = q.start LEFT JOIN r USING (cell) GROUP BY 1
""")
def hellinger_drift(spark, sf_dir):
    return drift.hellinger_drift(ordered(spark, sf_dir), "idx", "value", 500, 500, 250).withColumn("distance", F.round("distance", 5))


@query(f"""
WITH {WINDOWS}, u AS (SELECT start, value AS v, 1 AS a, 0 AS b FROM x UNION ALL SELECT start, value, 0, 1 FROM w, i WHERE idx < 500), g AS (SELECT start, v, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL),
s AS (SELECT start, lead(v) OVER o - v AS gap, abs(sum(a) OVER o / 500 - sum(b) OVER o / 500) AS d FROM g WINDOW o AS (PARTITION BY start ORDER BY v)) SELECT start, round(sum(coalesce(gap * d, 0)), 6) AS distance FROM s GROUP BY 1
""")
def wasserstein_drift(spark, sf_dir):
    return drift.wasserstein_drift(ordered(spark, sf_dir), "idx", "value", 500, 500, 250).withColumn("distance", F.round("distance", 6))


@query("WITH a AS (SELECT user_id, (value >= 50)::int AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age FROM events) SELECT user_id, round(sum(c * 0.01 * pow(0.99, age)), 6) AS score, count(*) AS n FROM a GROUP BY 1")
def fading_scores(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("c", F.col("value") >= 50)
    return drift.fading_scores(df, ["user_id"], "event_id", "c").withColumn("score", F.round("score", 6))


@query("WITH g AS (SELECT event_id, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000000) AS gap FROM events) SELECT coalesce(floor(gap / 3600), 0)::BIGINT AS skipped, count(*) AS n FROM g GROUP BY 1")
def feedback_timeouts(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return feedback.timed_out(df, "user_id", "ts", 3600).groupBy("skipped").agg(F.count("*").alias("n"))


# --- images ---------------------------------------------------------------------------------------

PIXELS = "p AS (SELECT vec_id, y, x, embedding[y * 8 + x + 1]::double AS v FROM embeddings, (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x))"


def _long(spark, sf_dir, f, digits: int = 5) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", f(F.col("embedding")).alias("a"))
    return df.select("vec_id", F.posexplode("a").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", digits).alias("v"))


#: Embeddings as 8-bit pictures of 8 x 8.
LEVEL = "cast(least(greatest(floor(({v} + 1) * 127.5e0), 0), 255) as int)"
GREY = f"q AS (SELECT vec_id, y, x, {LEVEL.format(v='v')} AS g FROM p)"


def pictures(spark, sf_dir) -> DataFrame:
    """vec_id, label, image: 64 grey pixels."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")).alias("image"))


def _pixels(spark, sf_dir, f) -> DataFrame:
    df = pictures(spark, sf_dir).select("vec_id", f(F.col("image")).alias("a"))
    return df.select("vec_id", F.posexplode("a").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("int").alias("v"))


@query(f"WITH {PIXELS}, {GREY} SELECT vec_id, ty * 3 + tx AS i, g AS v FROM q JOIN (SELECT unnest(range(3)) AS ty) ON y = ty * 8 // 3 JOIN (SELECT unnest(range(3)) AS tx) ON x = tx * 8 // 3")
def resize_nearest(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda a: images.resize_nearest(a, 8, 8, 3, 3))


@query(f"WITH {PIXELS}, {GREY} SELECT vec_id, ty * 4 + tx AS i, cast(sum(g) // count(*) AS int) AS v FROM q JOIN (SELECT unnest(range(4)) AS ty) ON y BETWEEN ty * 2 AND least((ty + 1) * 2, 7) JOIN (SELECT unnest(range(4)) AS tx) ON x BETWEEN tx * 2 AND least((tx + 1) * 2, 7) GROUP BY ALL")
def resize_area(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda a: images.resize_area(a, 8, 8, 4, 4))


@query(f"""
WITH {PIXELS}, {GREY}, g AS (SELECT ty, tx, ty * 8 / 5.0e0 AS fy, tx * 8 / 5.0e0 AS fx FROM (SELECT unnest(range(5)) AS ty), (SELECT unnest(range(5)) AS tx)), c AS (SELECT *, floor(fy)::int AS y0, floor(fx)::int AS x0, least(floor(fy)::int + 1, 7) AS y1, least(floor(fx)::int + 1, 7) AS x1, fy - floor(fy) AS dy, fx - floor(fx) AS dx FROM g)
SELECT a.vec_id, ty * 5 + tx AS i, cast(floor(a.g * ((1 - dx) * (1 - dy)) + b.g * (dx * (1 - dy)) + d.g * ((1 - dx) * dy) + e.g * (dx * dy) + 1e-6) AS int) AS v
FROM c JOIN q a ON a.y = y0 AND a.x = x0 JOIN q b ON b.vec_id = a.vec_id AND b.y = y0 AND b.x = x1 JOIN q d ON d.vec_id = a.vec_id AND d.y = y1 AND d.x = x0 JOIN q e ON e.vec_id = a.vec_id AND e.y = y1 AND e.x = x1
""")
def resize_bilinear(spark, sf_dir):
    return _pixels(spark, sf_dir, lambda a: images.resize_bilinear(a, 8, 8, 5, 5))


HOG = f"""WITH {PIXELS}, d AS (SELECT vec_id, y, x, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - lag(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS gx, lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) - lag(v) OVER (PARTITION BY vec_id, x ORDER BY y) AS gy FROM p),
m AS (SELECT vec_id, y // 4 AS cy, x // 4 AS cx, sqrt(gx * gx + gy * gy) AS m, CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + 2 * pi() ELSE atan2(gy, gx) END AS a FROM d WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6),
h AS (SELECT vec_id, (cy * 2 + cx) * 4 + o AS i, sum(m) FILTER (least(floor(a / (pi() / 2)), 3) = o) AS v FROM m, (SELECT unnest(range(4)) AS o) GROUP BY ALL)"""


@query(f"{HOG} SELECT vec_id, i, round(coalesce(v, 0), 5) AS v FROM h")
def hog_cells(spark, sf_dir):
    return _long(spark, sf_dir, lambda a: images.cell_histograms(a, 8, 8))


@query(f"{HOG} SELECT vec_id, i, round(coalesce(v, 0) / (sqrt(sum(coalesce(v, 0) * coalesce(v, 0)) OVER (PARTITION BY vec_id)) + 1e-6), 5) AS v FROM h")
def hog_blocks(spark, sf_dir):
    return _long(spark, sf_dir, lambda a: images.hog(a, 8, 8))


@query("SELECT l_orderkey, l_linenumber, cast((77 * (l_partkey % 256) + 150 * (l_suppkey % 256) + 29 * (l_orderkey % 256)) >> 8 AS BIGINT) AS grey FROM lineitem")
def grayscale_rgb(spark, sf_dir):
    c = [F.col(x) % 256 for x in ("l_partkey", "l_suppkey", "l_orderkey")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", images.grey_rgb888(*c).cast("long").alias("grey"))


# --- drift streams -----------------------------------------------------------------------------------


def _draws(seed: int = 42) -> str:
    return ", ".join(f"{uniform_sql('idx', seed + 7 * j)} AS u{j}" for j in range(4))


GRADUAL = "CASE WHEN idx < 1000 THEN 0.0e0 ELSE least(1.0e0, (idx - 1000) / 2000.0e0) END"
UNIFORMS = f"u AS (SELECT idx, {GRADUAL} AS p, {_draws()} FROM (SELECT unnest(range(6000)) AS idx))"


def _stream(spark, boundary):
    o = drift.DriftOptions(boundary=boundary, rows=6000, burn_in=1000, width=2000)
    return drift.generate(spark, o).select("idx", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"), "label")


@query(f"WITH {UNIFORMS}, x AS (SELECT idx, p, (u0 - 0.5) * 20 AS x1, (u1 - 0.5) * 20 AS x2 FROM u) SELECT idx, round(x1, 6) AS x1, round(x2, 6) AS x2, cast(CASE WHEN x1 * cos(p * pi()) - x2 * sin(p * pi()) >= 0 THEN 0 ELSE 1 END AS int) AS label FROM x")
def drift_generator_linear(spark, sf_dir):
    return _stream(spark, "linear")


@query(f"WITH {UNIFORMS}, x AS (SELECT idx, p, sqrt(u0) * 10 * cos(u1 * 2 * pi()) AS x1, sqrt(u0) * 10 * sin(u1 * 2 * pi()) AS x2 FROM u), a AS (SELECT *, atan2(x2, x1) * (180.0e0 / pi()) AS d FROM x) SELECT idx, round(x1, 6) AS x1, round(x2, 6) AS x2, cast(floor((CASE WHEN d < 0 THEN d + 360 ELSE d END + p * 30) / 30) % 2 AS int) AS label FROM a")
def drift_generator_cake(spark, sf_dir):
    return _stream(spark, "cake")


@query(f"WITH {UNIFORMS}, x AS (SELECT idx, p * (pi() / 2) AS a, (u0 - 0.5) * 20 AS x1, (u1 - 0.5) * 20 AS x2 FROM u) SELECT idx, round(x1, 6) AS x1, round(x2, 6) AS x2, cast((trunc((x1 * cos(a) - x2 * sin(a)) / 5) + trunc((x1 * sin(a) + x2 * cos(a)) / 5) + 100) % 2 AS int) AS label FROM x")
def drift_generator_chocolate(spark, sf_dir):
    return _stream(spark, "chocolate")


@query(f"WITH {UNIFORMS}, x AS (SELECT idx, -35 + p * 70 AS c, sqrt(u0) * 10 * cos(u1 * 2 * pi()) + CASE WHEN u2 < 0.5 THEN 10 ELSE -10 END AS x1, sqrt(u0) * 10 * sin(u1 * 2 * pi()) + 10 AS x2 FROM u), t AS (SELECT *, (x1 - c) * (x1 - c) + (x2 - 10) * (x2 - 10) <= 100 AS r, (x1 - 10) * (x1 - 10) + (x2 - 10) * (x2 - 10) <= 100 AS f FROM x) SELECT idx, round(x1, 6) AS x1, round(x2, 6) AS x2, cast(CASE WHEN r THEN f::int ELSE 1 - f::int END AS int) AS label FROM t")
def drift_generator_torus(spark, sf_dir):
    return _stream(spark, "torus")


@query("""
SELECT idx, round(CASE WHEN idx < 1000 THEN 0.0e0 ELSE least(1.0e0, (idx - 1000) / 2000.0e0) END, 6) AS gradual, CASE WHEN idx < 1000 THEN 0.0e0 ELSE 1.0e0 END AS abrupt, round(CASE WHEN idx < 1000 THEN 0.0e0 ELSE least(1.0e0, ((idx - 1000) // 1250) / 3.0e0) END, 6) AS sudden,
round(CASE WHEN idx < 1000 THEN 0.0e0 WHEN ((idx - 1000) // 1250) % 2 = 0 THEN ((idx - 1000) % 1250) / 1250.0e0 ELSE 1 - ((idx - 1000) % 1250) / 1250.0e0 END, 6) AS recurrent FROM (SELECT unnest(range(6000)) AS idx)
""")
def drift_progress(spark, sf_dir):
    kinds = {k: drift.DriftOptions(kind=k, rows=6000, burn_in=1000, width=2000) for k in ("gradual", "abrupt", "sudden", "recurrent")}
    return spark.range(6000).withColumnRenamed("id", "idx").select("idx", *[F.round(drift.progress(o, F.col("idx")), 6).alias(k) for k, o in kinds.items()])


# --- reports -------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT l_returnflag AS l, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem GROUP BY 1), i AS (SELECT avg(sqrt((a.q - b.q) * (a.q - b.q) + (a.t - b.t) * (a.t - b.t))) AS inter FROM c a, c b WHERE a.l < b.l),
w AS (SELECT avg(sqrt((l_quantity - q) * (l_quantity - q) + (l_tax - t) * (l_tax - t))) AS intra FROM lineitem JOIN c ON l = l_returnflag) SELECT round(inter, 6) AS inter, round(intra, 6) AS intra, round(inter / intra, 6) AS score FROM i, w
""")
def separation_score(spark, sf_dir):
    s = reports.separation(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])
    return s.select(*[F.round(c, 6).alias(c) for c in ("inter", "intra", "score")])


@query("SELECT count(*) AS rows, cast(sum(3 + length(cast(l_linenumber AS varchar)) + length(cast(l_partkey AS varchar)) + length(cast(l_suppkey AS varchar))) AS BIGINT) AS text_bytes, 6 + count(*) * 2 AS packed_bytes FROM lineitem")
def compression_ratio(spark, sf_dir):
    return reports.compression(table(spark, sf_dir, "lineitem"), ["l_linenumber", "l_partkey", "l_suppkey"], 2)


@query("SELECT a, b, CASE WHEN least(a, b) >= 90 THEN 'recommended' WHEN least(a, b) >= 80 THEN 'acceptable' WHEN greatest(a, b) >= 70 THEN 'trade-off' ELSE 'original' END AS verdict FROM (SELECT unnest(range(50, 101, 5)) AS a), (SELECT unnest(range(50, 101, 5)) AS b)")
def retention_verdict(spark, sf_dir):
    a = spark.range(50, 101, 5).withColumnRenamed("id", "a").withColumn("b", F.explode(F.sequence(F.lit(50), F.lit(100), F.lit(5)))).withColumn("b", F.col("b").cast("long"))
    return a.withColumn("verdict", reports.verdict(F.col("a"), F.col("b")))


@query("""
WITH s AS (SELECT var_pop(l_quantity) AS a, var_pop(l_extendedprice / 1000) AS b, covar_pop(l_quantity, l_extendedprice / 1000) AS c FROM lineitem), e AS (SELECT (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS x, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS y FROM s)
SELECT 1 AS axis, round(x / (x + y), 6) AS share FROM e UNION ALL SELECT 2, round(y / (x + y), 6) FROM e
""")
def explained_variance(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("p"))
    shares = reports.explained_variance(df, ["l_quantity", "p"])
    return spark.createDataFrame([(i + 1, round(s, 6)) for i, s in enumerate(shares)], "axis int, share double")


GRID = "g AS (SELECT 2 + id % 9 AS min_split, 1 AS min_leaf, 10 AS max_depth, 400 - 17 * (2 + id % 9) + (id * 31 % 13) AS max_nodes FROM (SELECT unnest(range(200)) AS id))"


@query(f"WITH {GRID} SELECT round(regr_intercept(max_nodes, min_split), 3) AS intercept, round(regr_slope(max_nodes, min_split), 3) AS min_split, 0.0e0 AS min_leaf, 0.0e0 AS max_depth FROM g")
def node_regression(spark, sf_dir):
    g = spark.range(200).selectExpr("2 + id % 9 as min_split", "1 as min_leaf", "10 as max_depth", "400 - 17 * (2 + id % 9) + (id * 31 % 13) as max_nodes")
    return reports.node_regression(g).select(*[F.round(c, 3).alias(c) for c in ("intercept", "min_split", "min_leaf", "max_depth")])


@query("SELECT r, round(CASE WHEN r / 1000.0e0 > 1.75 OR r / 1000.0e0 < 0.5 THEN 120.0e0 ELSE 200 * least(greatest(r / 1000.0e0, 0.75), 1.35) END, 6) AS nodes FROM (SELECT unnest(range(100, 3000, 100)) AS r)")
def node_estimate_guard(spark, sf_dir):
    return spark.range(100, 3000, 100).withColumnRenamed("id", "r").withColumn("nodes", F.round(reports.guarded_estimate(F.lit(200.0), F.lit(120.0), F.col("r"), F.lit(1000.0)), 6))


@query("SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, label LIMIT 5")
def top_classes(spark, sf_dir):
    return metrics.top_classes(table(spark, sf_dir, "orders"), "o_orderpriority")


# --- streaming -------------------------------------------------------------------------------------------


def _run_stream(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    out = scratch(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/log").trigger(availableNow=True)
    if mode == "complete":  # the file sink only appends: here each batch replaces the rows of the one before
        spark.createDataFrame([], stream.schema).write.parquet(f"{out}/rows")
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/rows")).start().awaitTermination()
    else:
        writer.format("parquet").start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(f"WITH {BINS}, x AS (SELECT bin_0, bin_1, count(*) AS n FROM b GROUP BY ALL) SELECT * FROM x")
def streaming_quantize(spark, sf_dir):
    """The quantiser over a file stream gives the batch's bins."""
    path = f"{sf_dir}/lineitem.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[l]ineitem.parquet")
    got = quantizer.bins(_quantizer(spark, sf_dir), stream).select("bin_0", "bin_1")
    return _run_stream(got, spark).groupBy("bin_0", "bin_1").agg(F.count("*").alias("n"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumns({"ts": F.col("ts").cast("timestamp"), "actual": (F.col("value") >= 50).cast("int"), "predicted": (F.col("user_id") % 2).cast("int")})


@query("""
WITH e AS (SELECT epoch_us(ts) AS u, ((value >= 50) = (user_id % 2 = 1))::int AS hit FROM events), w AS (SELECT (u // 1800000000 - k) * 1800000000 AS s, hit FROM e, (SELECT unnest([0, 1]) AS k))
SELECT s AS start, round(avg(hit), 6) AS accuracy, count(*) AS n FROM w GROUP BY 1
""")
def streaming_windowed_accuracy(spark, sf_dir):
    """The input ends, so every window is written, also those that the watermark has not passed."""
    from quantgrove.streaming import jobs

    got = jobs.windowed_accuracy(event_stream(spark, sf_dir), "ts", "1 hour", "30 minutes", "10 minutes")
    return _run_stream(got.select(F.unix_micros("window.start").alias("start"), F.round("accuracy", 6).alias("accuracy"), "n"), spark, "complete")
