"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrove.llm import chat, fingerprints, jaccard, media, packing, quality, sentencepieces, token_store, toxicity, urls
from quantgrove.llm.common import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every text and of its edited text, with both likenesses. A null text is empty; repeated rows are fingerprinted each."""
    return fingerprints.fingerprint(_read(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey picture in archives, read back by byte ranges. A null text gives 64 zero bytes."""
    listed = media.store(_read(spark, sf_dir, "documents"), media.folder_for(spark))
    return media.features(media.load(spark, listed))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ranked ids in token files, in order of doc_id, read back. A null text is its end id alone."""
    files = token_store.write(_read(spark, sf_dir, "documents"), token_store.folder_for(spark))
    return token_store.read(files).drop("ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence. A null text is its end id alone."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by the positive-unlabelled classifier. An empty text scores the bias; without toxic labels all score 0."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every URL. A null URL has empty host and path and the trees' verdict."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.fit(urls.labelled_by_terms(pages)))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document. A document without words is alone."""
    return jaccard.near_copies(_read(spark, sf_dir, "documents"))


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by best path over pieces, and what they decode to. A null text has no ids."""
    return sentencepieces.encode_decode(_read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by the line model. An empty text is one empty line; without labels of both kinds all score alike."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the example formatted, and what is read back. A null text or role is empty."""
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.example(spark))
    return chat.digest(chat.format_conversations(rows))


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprints, op2_media, op3_token_files, op4_packing, op5_toxicity, op6_url_filter, op7_jaccard_join, op8_sentencepieces, op9_quality, op10_chat)}


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS r0,
    regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS x
  FROM t
), f AS (
  SELECT *, regexp_replace(regexp_replace(r0, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS r FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(3 + length(r) + 1 + length(x) + 4) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_chat": OP10_SQL}
