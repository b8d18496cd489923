import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrove.operators import boosting, drift, feedback, idset, images, metrics, reports, sampling, trees
from quantgrove.sources import config, csv, packed


def test_trees_learn_and_compiled_prediction_matches_a_walk(spark):
    rows = [(i, int((i % 4 >= 2) != (i // 4 % 4 >= 2)), i % 4, i // 4 % 4) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, label int, b0 int, b1 int")
    forest = trees.train_forest(df, "id", ["b0", "b1"], 2, 4, trees.TreeOptions(trees=1, max_depth=5, threshold=0.0))
    got = forest.predict(df, ["b0", "b1"], 2).collect()
    nodes = forest.trees()[0]

    def walk(b, i=0):
        n = nodes[i]
        return n.label if n.is_leaf else walk(b, 2 * i + 1 if b[n.feature] <= n.at_most else 2 * i + 2)

    assert all(r["predicted"] == walk((r["b0"], r["b1"])) for r in got)


def test_known_best_split(spark):
    rows = [(0, 0, 0, 1), (1, 0, 1, 0), (2, 1, 2, 1), (3, 1, 3, 0)]
    df = spark.createDataFrame(rows, "id long, label int, b0 int, b1 int")
    for criterion, best in (("gini", 0.5), ("entropy", 1.0)):
        g = trees.split_gains(trees.histogram(df, ["b0", "b1"], []), [], 4, criterion).orderBy(F.desc("gain")).first()
        assert (g["feature"], g["at_most"]) == (0, 1) and abs(g["gain"] - best) < 1e-9
    stump = trees.train_forest(df, "id", ["b0", "b1"], 2, 4, trees.TreeOptions(trees=1, min_leaf=3))
    assert len(stump.nodes) == 1  # the best split leaves two rows a side


def test_forest_votes_save_and_out_of_bag(spark, tmp_path):
    rows = [(i, int(i % 8 >= 4), i % 8, (i * 5) % 8) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, b0 int, b1 int")
    forest = trees.train_forest(df, "id", ["b0", "b1"], 2, 8, trees.TreeOptions(trees=7, max_depth=4))
    got = forest.predict(df, ["b0", "b1"], 2)
    assert got.where("label = predicted").count() > 380 and got.where("total <> 7").count() == 0
    forest.save(spark, str(tmp_path / "f"))
    again = trees.Forest.load(spark, str(tmp_path / "f"))
    assert sorted(again.nodes, key=str) == sorted(forest.nodes, key=str)
    oob = trees.out_of_bag_votes(forest, df, "id", ["b0", "b1"])
    assert 0 < oob.count() <= 400 and oob.where("actual = predicted").count() / oob.count() > 0.9


def test_booster_learns(spark):
    rows = [(i, int(i % 8 >= 4) + int(i % 8 >= 6), i % 8) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, label int, b0 int")
    model = boosting.train(df, ["b0"], 3, 8, boosting.BoostOptions(rounds=2, depth=2))
    assert model.predict(df, ["b0"]).where("label = predicted").count() == 160


@pytest.mark.parametrize("cap", [1, 3, 7])
def test_multisets_against_counters(spark, cap):
    from collections import Counter

    a, b = [1, 1, 1, 2, 3, 3, 9], [1, 3, 3, 3, 4, 9]
    fa, fb = (idset.multiset(spark.createDataFrame([(x,) for x in xs], "id long"), "id", cap) for xs in (a, b))
    ca, cb = ({k: min(v, cap) for k, v in Counter(x).items()} for x in (a, b))
    table = lambda df: {r["id"]: r["cnt"] for r in df.collect()}
    assert table(idset.union(fa, fb)) == {k: max(ca.get(k, 0), cb.get(k, 0)) for k in ca | cb}
    assert table(idset.intersect(fa, fb)) == {k: min(ca[k], cb[k]) for k in ca if k in cb}
    assert table(idset.plus(fa, fb, cap)) == {k: min(cap, ca.get(k, 0) + (k in cb)) for k in ca | cb}
    assert table(idset.minus(fa, fb)) == {k: v for k, v in ca.items() if k not in cb}
    assert idset.is_subset(fa, fb).first()["subset"] == all(v <= cb.get(k, 0) for k, v in ca.items())


def test_votes_ties_and_abstention(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "row long, label string")
    got = {r["row"]: (r["label"], r["consensus"]) for r in metrics.majority(df, "row", "label").collect()}
    assert got == {1: ("a", 0.5), 2: ("c", 1.0)}
    t = spark.createDataFrame([(1, 1, 0.2), (1, 0, 0.9), (0, 0, 0.9)], "actual int, predicted int, consensus double")
    at = {round(r["threshold"], 2): r for r in metrics.threshold_sweep(t).collect()}
    assert (at[0.0]["tp"], at[0.0]["fp"], at[0.9]["tp"], at[0.9]["fn"], at[1.0]["answered"]) == (2, 1, 1, 2, 0)
    assert metrics.macro(metrics.confusion(t)).first()["accuracy"] == pytest.approx(2 / 3)


def test_numbering_is_gapless_over_parts(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "k")
    got = feedback.numbered(df, ["k"]).where("pos <> k").count()
    assert got == 0


def test_bags_and_folds(spark):
    bags = sampling.bootstrap(50, 3, spark)
    assert {r["tree_id"]: r["n"] for r in bags.groupBy("tree_id").agg(F.sum("weight").alias("n")).collect()} == {0: 50, 1: 50, 2: 50}
    assert sampling.bootstrap(200, 2, spark, cap=2).agg(F.max("weight")).first()[0] <= 2
    rows = spark.range(50).withColumnRenamed("id", "row")
    assert sampling.out_of_bag(rows, bags, 3).count() == 150 - bags.count()


def test_images(spark):
    df = spark.createDataFrame([([0.0] * 4 + [10.0] * 4,) * 1], "r array<double>").select(F.flatten(F.array_repeat("r", 8)).alias("image"))
    cells = images.cell_histograms(F.col("image"), 8, 8)
    got = df.select(cells.alias("c")).first()["c"]
    assert got[0] > 0 and got[1:4] == [0, 0, 0]  # a vertical edge points along x
    hog = df.select(images.hog(F.col("image"), 8, 8).alias("h")).first()["h"]
    assert len(hog) == 16 and abs(sum(v * v for v in hog) - 1) < 1e-4
    assert df.select(images.resize_nearest(F.col("image"), 8, 8, 2, 2).alias("x")).first()["x"] == [0, 10, 0, 10]


@pytest.mark.parametrize("boundary", ["linear", "cake", "chocolate", "torus", "hash"])
@pytest.mark.parametrize("kind", ["abrupt", "gradual", "sudden", "recurrent"])
def test_drift_streams(spark, boundary, kind):
    df = drift.generate(spark, drift.DriftOptions(boundary=boundary, kind=kind, rows=200, burn_in=40, width=80, noise=0.1, redundant=1))
    assert df.count() == 200 and {r["label"] for r in df.select("label").distinct().collect()} <= {0, 1}


def test_packed_files(spark, tmp_path):
    rows = [(i, i % 3, *[(i * (k + 1)) % 8 for k in range(5)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label int, a int, b int, c int, d int, e int").orderBy("id")
    path = str(tmp_path / "x.bin")
    assert packed.write(df, path, "label", list("abcde"), 3) == 500
    got = packed.read(spark, path, 3, chunk_rows=128).orderBy("row_id").collect()
    assert [(r["label"], *r["bins"]) for r in got] == [r[1:] for r in rows]
    labels, bins = np.array([7], np.uint8), np.array([[9, 0, 3]])
    assert packed.decode(packed.encode(labels, bins, 3), 3, 3)[1].tolist() == [[7, 0, 3]]  # saturates


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("target,a,b\n1, 2.5,x\n\n0,3\n1,4,5,\n0,1,2,3\n")
    got = csv.read(spark, str(path), header=True).collect()
    assert [tuple(r) for r in got] == [("1", 2.5, 0.0), ("1", 4.0, 5.0)]
    assert csv.has_header(["t", "a", "b"], ["1", "2", "3"]) and not csv.has_header(["1", "2", "3"], ["1", "2", "3"])
    known = spark.createDataFrame([("b", 0), ("d", 1)], "label string, label_id int")
    more = csv.extend_dictionary(known, spark.createDataFrame([("c",), ("a",), ("b",)], "l string"), "l")
    assert {r["label"]: r["label_id"] for r in more.collect()} == {"b": 0, "d": 1, "a": 2, "c": 3}


def test_config():
    text = '{"forest": {"num_trees": {"value": 7}, "seed": {"value": 3, "status": "disabled"}}, "bits": 2}'
    assert config.load(text, num_trees=20, seed=37, bits=1, other=5) == {"num_trees": 7, "seed": 37, "bits": 2, "other": 5}


def test_fifo(spark):
    kept, gone = feedback.append_with_eviction(spark.range(5), spark.range(5, 8), "id", 4)
    assert sorted(r["id"] for r in kept.collect()) == [4, 5, 6, 7] and gone.count() == 4


def test_node_regression_recovers_a_plane(spark):
    rows = [(s, l, d, 5 + 2 * s - 3 * l + 7 * d) for s in (2, 4, 6) for l in (1, 2) for d in (5, 9)]
    got = reports.node_regression(spark.createDataFrame(rows, "min_split int, min_leaf int, max_depth int, max_nodes int")).first()
    assert [round(x, 4) for x in got] == [5, 2, -3, 7]


def test_resizing_by_hand(spark):
    """8 pixels to 5: places 0, 1.6, 3.2, 4.8, 6.4; 8 to 4 by area: three pixels at a time, two at the end."""
    df = spark.createDataFrame([([0, 10, 20, 30, 40, 50, 60, 70],)], "a array<int>")
    got = df.select(images.resize_bilinear(F.col("a"), 8, 1, 5, 1).alias("b"), images.resize_area(F.col("a"), 8, 1, 4, 1).alias("c"), images.resize_nearest(F.col("a"), 8, 1, 5, 1).alias("d")).first()
    assert got["b"] == [0, 16, 32, 48, 64] and got["c"] == [10, 30, 50, 65] and got["d"] == [0, 10, 30, 40, 60]


def test_chocolate_by_hand(spark):
    """Squares of side 5, cut toward zero: (-4, 3) and (4, 3) are in one square, (6, 3) in the next."""
    o = drift.DriftOptions(boundary="chocolate", rows=400, burn_in=400)
    for r in drift.generate(spark, o).collect():
        assert r["label"] == (int(r["x1"] / 5) + int(r["x2"] / 5)) % 2
    assert drift.generate(spark, drift.DriftOptions(boundary="cake", labels=6, noise=0.5, rows=500)).where("label not between 0 and 5").count() == 0
    wide = drift.generate(spark, drift.DriftOptions(redundant=2, rows=50))
    assert wide.columns == ["idx", "x1", "x2", "x3", "x4", "label"] and abs(wide.corr("x1", "x3")) < 0.5


def test_refined_quantiles_are_exact(spark):
    from quantgrove.operators import quantizer

    rng = np.random.default_rng(5)
    cases = {"even": rng.normal(size=900), "ties": rng.integers(0, 3, 900).astype(float), "heavy": np.exp(rng.normal(size=900) * 9), "one": np.full(900, 2.5)}
    df = spark.createDataFrame(list(zip(*map(np.ndarray.tolist, cases.values()))), ", ".join(f"{k} double" for k in cases))
    for groups, cells in ((4, 4096), (8, 5)):
        quantizer_cells, quantizer.CELLS = quantizer.CELLS, cells
        try:
            got = quantizer.refined_edges(df, {k: F.col(k) for k in cases}, groups)
        finally:
            quantizer.CELLS = quantizer_cells
        for k, v in cases.items():
            assert np.allclose(got[k], np.quantile(v, np.arange(1, groups) / groups)), (k, groups)
    a, b = quantizer.fit(df, ["even", "heavy"], 3), quantizer.fit(df, ["even", "heavy"], 3, refine_rows=10)
    assert all(np.allclose(x.edges, y.edges) for x, y in zip(a.rules, b.rules))


def test_splits_and_bags_have_exact_sizes(spark):
    df = spark.range(1003)
    got = {r["part"]: r["count"] for r in sampling.random_split(df, "id").groupBy("part").count().collect()}
    assert got == {"train": 702, "test": 150, "valid": 151}
    assert {r["part"]: r["count"] for r in sampling.random_split(df, "id", validate=False).groupBy("part").count().collect()} == {"train": 702, "test": 301}
    assert sorted(r["count"] for r in sampling.folds(df, "id", 4).groupBy("fold").count().collect()) == [250, 250, 250, 253]
    bags = sampling.bootstrap(1003, 3, spark, replacement=False).groupBy("tree_id").agg(F.count("*").alias("n"), F.count_distinct("row").alias("d")).collect()
    assert [(r["n"], r["d"]) for r in bags] == [(633, 633)] * 3
    assert sampling.random_split(df.limit(0), "id").count() == 0


def test_bags_are_told_apart(spark):
    bags = sampling.unique_bags(40, 4, spark)
    assert bags.groupBy("tree_id").agg(F.sum("weight").alias("n")).where("n <> 40").count() == 0
    assert idset.fingerprint(bags).select("bag_hash").distinct().count() == 4
    # Two rows allow three bags only: the fourth tree's draws repeat one until they are patched.
    few = sampling.unique_bags(2, 4, spark)
    assert few.select("tree_id").distinct().count() == 4 and few.where("row not in (0, 1)").count() == 0


def test_header_of_each_file_goes_once(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.csv").write_text("name,size\na,1\nname,size\nb,3abc\n\nc\nd,x,\n")
    got = csv.read(spark, str(tmp_path), header=True)
    assert sorted(map(tuple, got.collect())) == sorted([("a", 1.0), ("name", 0.0), ("b", 3.0), ("d", 0.0)] * 2)
    assert csv.has_header(["a", "b"], ["x", "2"]) and not csv.has_header(["1", "2"], ["x", "2"])


def test_packed_files_split_and_join(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 5).cast("int").alias("label"), *[(F.col("id") * (i + 3) % 8).cast("int").alias(f"b{i}") for i in range(5)])
    assert packed.write(df, str(tmp_path / "p"), "label", [f"b{i}" for i in range(5)], 3, ["id"], 90) == 1000
    listed = packed.files_of(str(tmp_path / "p"))
    assert sum(n for _, n, _ in listed) == 1000 and max(n for _, n, _ in listed) <= 90
    got = packed.read(spark, str(tmp_path / "p"), 3, 64).collect()
    want = {r["id"]: (r["label"], [r[f"b{i}"] for i in range(5)]) for r in df.collect()}
    assert {r["row_id"]: (r["label"], r["bins"]) for r in got} == want
    with open(listed[0][0], "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another size"):
        packed.read(spark, str(tmp_path / "p"), 3).collect()


def test_worst_tree_is_replaced_by_a_better_one(spark):
    rows = [(i, int(i % 4 >= 2), i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, b0 int")
    bad = trees.Forest([trees.Node(0, 0, 0, 0, 0, 1), trees.Node(0, 1, 1, 0), trees.Node(0, 2, 1, 1), trees.Node(1, 0, 0, 0, 0, 1), trees.Node(1, 1, 1, 1), trees.Node(1, 2, 1, 0)], trees.TreeOptions(trees=2, threshold=0.0))
    scores = {r["tree_id"]: r["score"] for r in trees.tree_scores(bad, df, "id", ["b0"], fade=0.99).collect()}
    assert scores[0] > 0.99 and scores[1] < 0.1
    new, after = trees.replace_worst(bad, scores, df, "id", ["b0"], 2, 4)
    assert new.predict(df, ["b0"], 2).where("label <> predicted").count() == 0 and abs(after[1] - sum(scores.values()) / 2) < 1e-9
    assert trees.replace_worst(bad, {0: 0.9, 1: 0.89}, df, "id", ["b0"], 2, 4)[1] == {0: 0.9, 1: 0.89}
    flipped = trees.adapt_leaves(bad, trees.leaf_counts(bad, df, ["b0"]))
    assert flipped.predict(df, ["b0"], 2).where("label <> predicted").count() == 0


def test_cross_validation_and_grid(spark):
    df = spark.createDataFrame([(i, int(i % 8 >= 4), i % 8) for i in range(240)], "id long, label int, b0 int")
    o = trees.TreeOptions(trees=3, max_depth=3, threshold=0.0)
    folds_ = trees.cross_validate(df, "id", ["b0"], 2, 8, o).collect()
    assert [r["n"] for r in sorted(folds_, key=lambda r: r["fold"])] == [60] * 4 and all(r["accuracy"] > 0.95 for r in folds_)
    best, score = trees.grid_search(df, "id", ["b0"], 2, 8, [trees.TreeOptions(trees=3, max_depth=1), o, trees.TreeOptions(trees=3, max_depth=4, threshold=0.0)])
    assert best == o and score > 0.95


def test_labels_must_fit_a_byte(spark):
    with pytest.raises(ValueError, match="300 labels"):
        csv.check_labels(csv.label_dictionary(spark.range(300).select(F.col("id").cast("string").alias("l")), "l"))


def test_pictures_of_other_sizes_and_broken_files_are_left_out(spark, tmp_path):
    from quantgrove.sources import images as folders

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.png").write_bytes(folders.png(np.arange(12).reshape(3, 4)))
    (tmp_path / "a" / "two.png").write_bytes(folders.png(np.zeros((2, 2, 3), int) + [10, 20, 30]))
    (tmp_path / "a" / "three.jpg").write_bytes(b"no picture")
    got = {r["path"].rpartition("/")[2]: r for r in folders.read_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.png", "two.png"} and got["one.png"]["image"] == list(range(12)) and got["two.png"]["image"] == [(77 * 10 + 150 * 20 + 29 * 30) >> 8] * 4
    assert [r["class"] for r in folders.read_images(spark, str(tmp_path), 4, 3).collect()] == ["a"]
    with pytest.raises(ValueError):
        images.check_config(10, 10, "rgb888", 7, 8)


def test_trailing_accuracy_across_segments(spark):
    df = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 7 < 3).alias("c"))
    whole = drift.trailing_accuracy(df, "idx", "c", 50, 10).orderBy("at").collect()
    cut = drift.trailing_accuracy(df, "idx", "c", 50, 10, segment=10).orderBy("at").collect()
    assert whole == cut and len(whole) == 96


def test_a_full_queue_is_flushed(spark, tmp_path):
    from quantgrove.streaming import jobs

    rows = [("u", i, "prediction", i) for i in range(5)] + [("u", 9, "label", 1)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "user string, seq long, kind string, value int").write.parquet(src)
    out = str(tmp_path / "out")
    stream = spark.readStream.schema("user string, seq long, kind string, value int").parquet(src)
    jobs.pair_feedback(stream, "user", 3).writeStream.format("parquet").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out).awaitTermination()
    assert {(r["predicted"], r["actual"]) for r in spark.read.parquet(out).collect()} == {(0, None), (1, None), (2, None), (3, None), (4, 1)}
