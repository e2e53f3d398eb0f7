"""A corpus pipeline: toxicity, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, all but the last
with the columns of documents. run() writes each stage's rows to the shared folder
and reads them again as the next one's, and deletes those of the stage before.

Null texts, keys, languages and sources pass every stage that doesn't reject them: a
null or empty text isn't toxic but has no language, so it goes there. Repeated rows
are rows until the third stage, where one stays. Ties are those of the operators.
Empty tables give an empty result, and columns of documents beyond COLUMNS are left
out at the start, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm import jaccard_join, language_id, packing, pii, toxicity
from sheafspark.llm.common import Tables, read_table
from sheafspark.llm.queries import language_model, network, toxicity_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic."""
    return toxicity.score(docs, toxicity_model(spark, sf_dir), COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model is fitted on the whole table's labelled rows."""
    model = language_model(read_table(spark, sf_dir, "documents"))
    return language_id.identify(docs, model, COLUMNS).filter("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id, once where its row is repeated; documents without words are all kept."""
    return jaccard_join.representatives(docs).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind."""
    found = pii.detect(docs, network(), ("doc_id", "lang", "source"))
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the trained stages; tests hold run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs, last = Tables(spark), read_table(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES:
        docs = tables.cut(stage(spark, docs, sf_dir))
        if last is not None:
            tables.drop(last)
        last = docs
    return docs
