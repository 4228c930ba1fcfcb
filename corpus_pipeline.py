"""A corpus pipeline over the table ``documents``: five stages, each written
as Parquet and read again as the next one's documents.

Every stage works on all that the one before kept: toxic documents go, one
document of each group of near copies stays, personal data is generalised,
each document comes in as many copies as the mix asks for, and the texts are
encoded as subword ids (the last stage; its rows are the documents with their
ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentspark.llm import mixing, near_join, privacy, subwords, toxicity
from intentspark.llm.common import written
from intentspark.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. The model is fitted on
    the labelled ones among ``docs``. A null or empty text has no offending
    sentence and stays; repeated rows are judged alike."""
    model = toxicity.fit(spark, docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.filter(F.col("tox_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest doc_id."""
    return near_join.keep_one(docs)


def generalise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; n_chars follows the changed text."""
    clean = privacy.sanitise(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint"))) \
        if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; with 0 copies it goes."""
    return mixing.repeat_documents(docs)


def encode_subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their subword ids."""
    return subwords.encode(docs, "text", "doc_id", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", generalise_personal_data),
    ("mixing", mix_sources),
    ("subwords", encode_subwords),
]

#: The stages need a trained model and a tokenizer's file, which SQL can't
#: express; tests/llm holds run() against the brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
