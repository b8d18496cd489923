"""From raw documents to packed training sequences: toxicity, quality, near copies, packing.

Defined results: null texts count as empty, null ids are carried along and not
learnt from, repeated rows are judged each until near copies go; columns
beyond doc_id and text, whatever their names, stay as they are up to the last
stage; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantgrove.llm import jaccard, packing, quality, toxicity
from quantgrove.llm.common import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go: equal texts together, all stay without toxic labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: equal texts together, an empty text is one empty line."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; all without words stay."""
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains, packed into token sequences, a row per piece; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_copies", keep_one), ("packing", pack)]

#: No stage can be said in SQL: two are trained classifiers, one follows similarity links, one packs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
