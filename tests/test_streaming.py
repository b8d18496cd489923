import pandas as pd
from pyspark.sql import functions as F

from quantgrove.operators import quantizer, trees
from quantgrove.streaming import jobs


def run(stream, spark, tmp_path, name):
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_scoring_a_stream_equals_the_batch(spark, sf, tmp_path):
    src = str(tmp_path / "in")
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_tax", F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("label"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    df.write.parquet(src)
    q = quantizer.fit(df, ["l_quantity", "l_tax"], 2)
    binned = quantizer.bins(q, df)
    forest = trees.train_forest(binned, "id", ["bin_0", "bin_1"], 2, 4, trees.TreeOptions(trees=3, max_depth=3))
    got = run(jobs.score_stream(jobs.event_stream(spark, src, df.schema), q, forest, 2).select("id", "predicted"), spark, tmp_path, "scored")
    want = forest.predict(binned, ["bin_0", "bin_1"], 2).select("id", "predicted")
    assert got.exceptAll(want).count() == 0 and got.count() == df.count()


def test_feedback_is_paired_by_position(spark, tmp_path):
    rows = [("u", 1, "prediction", 5), ("u", 2, "prediction", 6), ("u", 3, "label", 5), ("u", 4, "label", None), ("u", 5, "label", 9), ("v", 6, "label", 1), ("v", 7, "prediction", 1)]
    src = str(tmp_path / "in")
    spark.createDataFrame(pd.DataFrame(rows, columns=["user", "seq", "kind", "value"]), "user string, seq long, kind string, value double").write.parquet(src)
    stream = spark.readStream.schema("user string, seq long, kind string, value double").parquet(src)
    got = run(jobs.pair_feedback(stream, "user"), spark, tmp_path, "pairs").collect()
    assert sorted(tuple(r) for r in got) == [("u", 5, 5)]  # a label without a prediction before it is dropped


def test_adaptation_keeps_a_bounded_window(spark, tmp_path):
    seen = []
    step = jobs.adapt_each_batch(str(tmp_path / "w"), "id", 5, lambda df, n: seen.append(sorted(r["id"] for r in df.collect())))
    for n in range(3):
        step(spark.range(n * 3, n * 3 + 3), n)
    assert seen == [[0, 1, 2], [1, 2, 3, 4, 5], [4, 5, 6, 7, 8]]


def test_prequential_retrains_after_drift(spark):
    df = spark.range(600).select(F.col("id").alias("idx"), F.lit(0.0).alias("x"), F.when(F.col("id") < 300, 0).otherwise(1).alias("label"))

    def train(part):
        top = part.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"]
        return lambda rows: rows.withColumn("predicted", F.lit(top))

    out = jobs.prequential(spark, df, "idx", ["x"], 2, train, 100, 50, 100, 0.6, 100, 100)
    assert any(o["retrained"] for o in out) and out[-1]["accuracy"] == 1.0
