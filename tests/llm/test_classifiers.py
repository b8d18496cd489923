"""Toxicity, quality and URL operators: held-out accuracy and awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrove.llm import common, quality, toxicity, urls

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def accuracy(got, labels, column):
    return got.join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).agg(F.avg((F.col("predicted") == F.col(column)).cast("double")), F.min("score"), F.max("score")).first()


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels = tables
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    got = accuracy(scored, labels, "toxic")
    assert got[0] > 0.97 and 0 <= got[1] <= got[2] <= 1
    held = scored.join(labels, "doc_id").where(common.held_out(F.col("doc_id")))
    right, toxic, said = (held.where(c).count() for c in ("toxic = 1 and predicted = 1", "toxic = 1", "predicted = 1 and toxic is not null"))
    assert right / toxic >= 0.88 and right / said >= 0.95


def test_quality_on_the_held_out_fold(tables):
    docs, labels = tables
    assert accuracy(quality.score(docs, quality.fit(docs, labels)), labels, "quality")[0] > 0.97


def test_held_out_labels_are_not_learnt(tables):
    docs, labels = tables
    docs = docs.limit(1500)
    flipped = labels.withColumn("toxic", F.when(common.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.bias == b.bias and a.weights == b.weights


@pytest.mark.parametrize("share", [0.25, 0.3, 0.4])
def test_many_toxic_texts_are_told_from_clean_ones(tables, share):
    docs, labels = tables
    rows = docs.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").where("toxic is not null").dropDuplicates(["text"]).select("doc_id", "text", "toxic")
    found = rows.groupBy("toxic").count().orderBy("toxic").collect()
    clean = int(found[1]["count"] * (1 - share) / share)
    rows = common.sample_by_hash(rows.where("toxic = 0"), "doc_id", clean).union(rows.where("toxic = 1"))
    rows = rows.checkpoint()
    assert abs(rows.agg(F.avg("toxic")).first()[0] - share) < 0.01
    got = toxicity.score(rows, toxicity.fit(rows, rows)).join(rows.select("doc_id", "toxic"), "doc_id").where(common.held_out(F.col("doc_id")))
    right = {r["toxic"]: r["right"] for r in got.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right")).collect()}
    assert right[1] > 0.75 and right[0] > 0.95


def test_risk_stays_above_zero_and_finds_the_words():
    rng = np.random.default_rng(1)
    plain = lambda: rng.integers(1000, 60_000, 30).tolist()
    positives = [[*plain(), int(rng.integers(0, 5))] for _ in range(300)]
    unlabelled = [[*plain(), int(rng.integers(0, 5))] if rng.random() < 0.1 else plain() for _ in range(3000)]
    m = toxicity.train(positives, unlabelled, 0.1)
    assert set(range(5)) <= set(m.weights) and all(m.weights[i] > 1 for i in range(5))
    assert 1 / (1 + np.exp(-m.bias)) < 0.1


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    pairs = rng.normal(size=(2, 2))
    lengths = np.array([3, 1, 4])
    scores = rng.normal(size=lengths.sum())
    good, expected, _ = quality.marginals(scores, lengths, pairs, True)
    at, want, total = 0, [], np.zeros((2, 2))
    for n in lengths:
        s, z, m, e = scores[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(s[i] * y[i] for i in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            z += p
            m += p * np.array(y)
            for a, b in zip(y, y[1:]):
                e[a, b] += p
        want += (m / z).tolist()
        total += e / z
        at += n
    assert np.allclose(good, want) and np.allclose(expected, total)


@pytest.mark.parametrize("module", [toxicity, quality], ids=["toxicity", "quality"])
@pytest.mark.parametrize("table", ["odd", "clashing", "none"])
def test_awkward_rows(spark, request, module, table):
    docs = request.getfixturevalue(table)
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (3, 1, None), (None, 1, 1), (7, None, 1), (10, 0, 0), (17, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        got = module.score(docs, module.fit(docs, marks))
        assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    keep = module.keep_clean if module is toxicity else module.keep_good
    kept = keep(docs, module.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() <= docs.count()


RULED = [
    ("https://a.Example.ORG/es/x", "block", "example.org/es/"), ("http://example.org/en/123?q=/es/", "block", "example.org/en/1"), ("http://example.org/en/2", "allow", "org/"), ("http://x.org", None, None),
    ("http://b.c.com/fr/", "allow", "com/fr/"), ("http://com/de/a#x", "block", "com/de/"), ("http://xcom/de/a", None, None), ("http://notexample.org/es/", "allow", "org/"), ("ftp://h.org?x=/", None, None), (None, None, None), ("no scheme", None, None), ("", None, None),
]


def test_rules_and_defined_results(spark):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, (u, _, _) in enumerate(RULED)], "page_id long, url string, rule int, host string").select("page_id", "url", "rule", "host")
    got = {r["page_id"]: r for r in urls.judge(pages.select("page_id", "url"), urls.Trees()).collect()}
    assert len(got) == len(RULED)
    for i, (u, verdict, rule) in enumerate(RULED):
        assert got[i]["rule"] == rule and got[i]["verdict"] == (verdict or "allow"), u
    assert got[0]["host"] == "a.example.org" and got[8]["path"] == "" and got[9]["host"] == "" and got[1]["path"] == "/en/123"


def test_trees_fit_what_they_can_see(spark):
    rows = [(f"http://{'a' * (i % 9 + 1)}-{i}.net/p{i}?" + "&".join(f"k{j}=1" for j in range(i % 7)), int(i % 7 > 3)) for i in range(600)]
    model = urls.fit(spark.createDataFrame(rows, "url string, label int"))
    got = urls.judge(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string"), model).collect()
    assert sum((r["verdict"] == "block") == bool(rows[r["page_id"]][1]) for r in got) > 590
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.fit(spark.createDataFrame([], "url string, label int"))).count() == 0


def test_clean_urls_without_a_rule_are_let_through(spark):
    pages = spark.read.parquet(f"{BIG}/pages.parquet").select("page_id", "url")
    got = urls.judge(pages, urls.fit(urls.labelled_by_terms(pages))).where("rule is null")
    term = F.col("host").rlike(rf"(^|[.-])({'|'.join(urls.TERMS)})([.-]|$)")
    shares = {r["term"]: r["blocked"] for r in got.groupBy(term.alias("term")).agg(F.avg((F.col("verdict") == "block").cast("double")).alias("blocked")).collect()}
    assert shares[False] < 0.02 and shares[True] > 0.95


def test_lines_of_other_scripts_are_letters():
    own = quality.measures("これは文章です。数字は１２３。")[0][0]
    assert own[1] > 0.1 and own[4] == 0 and own[2] > 0.1  # digits, other signs, sentence marks
    assert quality.measures("слово за словом")[0][0][4] == 0


def test_boosting_lowers_the_loss_each_round():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    base, made = urls.boost(x, y, trees=40)
    losses = []
    for k in (0, 5, 20, 40):
        m = urls.Trees(base, made[:k]).margin(x)
        losses.append(float(np.mean(np.logaddexp(0, m) - y * m)))
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.3
