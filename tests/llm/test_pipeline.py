"""The stages against their operators, on small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantgrove.llm import jaccard, quality, toxicity
from quantgrove.llm.queries import queries


def test_stages_chain_and_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf)
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns and 0 < kept.count() < before.count()
        assert kept.exceptAll(before).count() == 0
        gone = before.select("doc_id").exceptAll(kept.select("doc_id"))
        if name in ("toxicity", "quality"):
            module = {"toxicity": toxicity, "quality": quality}[name]
            scores = module.score(before, module.fit(before, labels))
            reject = scores.where("predicted = 1" if name == "toxicity" else "predicted = 0").select("doc_id")
            assert sorted(r[0] for r in gone.collect()) == sorted(r[0] for r in reject.collect())
        else:
            groups = jaccard.near_copies(before).select("component_id").distinct().count()
            assert kept.count() == groups and jaccard.near_copies(kept).select("component_id").distinct().count() == groups
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))


def _run(spark, tmp_path, docs):
    """The whole pipeline over a folder of its own."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (3, 1, None), (None, 1, 1), (7, None, 1), (10, 0, 0), (17, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


@pytest.mark.parametrize("table", ["odd", "clashing", "none"])
def test_awkward_tables_go_through(spark, request, tmp_path, table):
    docs = request.getfixturevalue(table)
    got = _run(spark, tmp_path, docs)
    kept, known = {r["doc_id"] for r in got.select("doc_id").collect()}, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert kept <= known and (table != "none" or not kept)


def test_reserved_column_names_go_through(spark, odd, tmp_path):
    docs = odd.withColumns({c: F.lit(1) for c in ("__cid", "__low", "__nth", "keep_cid", "doc", "part")})
    assert _run(spark, tmp_path, docs).count() >= 0
