"""From raw documents to token ids: five stages, each over all that the one before kept.

toxicity drops documents that score at the threshold or above; exact dedup keeps the largest doc_id of equal texts;
near-dedup keeps one document of each group of similar ones; mixing repeats and cuts documents so that sources come
near their target weights; SentencePiece turns what is left into ids. All but the last return the columns of
documents.

Cases: null texts count as empty (equal to each other and to empty ones), and a document without words is left out by
mixing, as nothing can be taken of it. Of equal texts a row without doc_id never stays beside one with it; rows without
doc_id are no near duplicates of any. Repeated rows count as equal texts. Ties of scores, sizes or hashes are broken by
doc_id and text, so reruns agree. Very long texts pass whole. Other columns are kept, whatever their names, but n_chars
follows a text that mixing cuts. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radiopos.llm import common, exact_dedup, mixing, pieces, simhash
from radiopos.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.clean(docs, toxic.model_for(docs, common.table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.Codec.load())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("sentencepiece", tokens)]

#: No SQL: a trained model, fingerprints and ids are beyond it; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
