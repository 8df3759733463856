"""The cleaning pipeline over documents: toxicity, exact dedup, near-dedup, personal data, packing.

Each stage gets what its predecessor kept, in the columns of documents, and its decisions take effect:
rows are dropped or texts changed. The last stage gives the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, minhash, packing, pii, shared, toxicity


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids; a null doc_id counts as a value."""
    name = "_kept_doc_id"
    while name in docs.columns:
        name += "_"
    return docs.join(ids.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is trained on the labelled documents among docs."""
    model = toxicity.train(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return _kept(docs, exact_dedup.exact_dedup(docs, keep="largest").where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return _kept(docs, minhash.near_dedup(docs).where("kept"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; all documents stay."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: Two stages (a trained classifier, a learned span classifier) have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again by the next."""
    folder = shared.shared_dir(spark)
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
