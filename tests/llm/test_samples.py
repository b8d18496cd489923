"""Bounded samples at sizes around their bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrove.llm import quality, toxicity, urls
from quantgrove.llm.common import sample_by_hash

MOST = 400


@pytest.mark.parametrize("n", [0, 1, MOST - 1, MOST, MOST + 1, MOST + 249, MOST + 250, MOST + 251, MOST * 3 // 2, MOST * 3])
def test_sample_is_exact(spark, n):
    df = spark.range(n)
    got = [r[0] for r in sample_by_hash(df, "id", MOST).collect()]
    want = [r[0] for r in df.orderBy(F.xxhash64("id"), "id").limit(MOST).collect()]
    assert got == want and len(got) == min(n, MOST)


@pytest.mark.parametrize("n", [20_000, 20_001, 20_002, 25_000, 30_000, 30_001, 60_000])
def test_default_bound_of_urls(spark, n):
    assert sample_by_hash(spark.range(n), "id", urls.MOST).count() == min(n, urls.MOST)


@pytest.mark.parametrize("n", [MOST - 1, MOST, MOST + 1, MOST * 3 // 2, MOST * 3])
def test_classifiers_learn_at_any_size(spark, n):
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        bad = bool(rng.random() < 0.4)
        plain = " ".join(f"w{rng.integers(50)}" for _ in range(12))
        rows.append((i, f"{plain} vile hateful slur" if bad else f"{plain} kind.\nGood line of prose here.", int(not bad), int(bad), f"https://{'cheap-casino' if bad else 'www'}.example{i}.com/a/{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int, url string")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")
    for got, column in ((toxicity.score(docs, toxicity.fit(docs, labels, MOST // 2, MOST)), "toxic"), (quality.score(docs, quality.fit(docs, labels, MOST)), "quality")):
        right = got.join(labels, "doc_id").where(F.col("predicted") == F.col(column)).count()
        assert right / n > 0.95, (column, right, n)
    trees = urls.fit(urls.labelled_by_terms(df), MOST)
    judged = urls.judge(df.withColumnRenamed("doc_id", "page_id"), trees).join(labels.withColumnRenamed("doc_id", "page_id"), "page_id")
    assert judged.where((F.col("verdict") == "block") == (F.col("toxic") == 1)).count() / n > 0.95
