"""The corpus pipeline: documents to packed sequences, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, the last
the packed token ids themselves. ``run`` writes every stage as Parquet into the shared folder that the cluster names in
spark.checkpoint.dir, and removes what a stage read, and its checkpoints, once its result is written.

Defined cases, stage by stage, for rows that are in ``documents`` whatever the other columns hold (they are carried along):
- quality classifier: null and blank texts have the classifier's bias as score, and go where that is under the threshold;
  without labels every score is 0.5 and every document goes.
- language id: null texts and texts without a letter go; without any known language all go.
- near duplicates: equal texts (null as empty) and near copies leave the row of the least id, null ids last.
- source mix: a row without words stays once; others as often as drawn, at most three times; a null source is one of its own.
- packing: a null or empty text is its closing id alone; repeated rows are packed as often as they occur.
An empty table, or one of which a stage keeps nothing, gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import langid, mixing, near_dups, packing, quality
from veilspan.llm.common import shared_folder, spread, table
from veilspan.sources import lineage

#: A language is taken as found from this score on; below, a document is rejected like one without letters.
LEAST_LANGUAGE_SCORE = 0.3


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, gives a score of at least quality.THRESHOLD."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, out="_veil_score").where(F.col("_veil_score") >= quality.THRESHOLD).drop("_veil_score")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others (no letter, or a score below LEAST_LANGUAGE_SCORE) go."""
    found = langid.with_language(docs, langid.fit(docs), out="_veil_language")
    known = (F.col("_veil_language.lang_pred") != langid.UNDETERMINED) & (F.col("_veil_language.score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).drop("_veil_language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id."""
    return near_dups.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of at most packing.CAPACITY tokens in order
    (``packing.sequences`` joins and pads them)."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", classify_quality),
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, tokenizer and hashed draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spread(table(spark, sf_dir, "documents"))
    for number, (_, stage) in enumerate(STAGES):
        since = lineage.mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        lineage.give_up(spark, since)
        if number:
            lineage.remove(spark, f"{folder}/{number - 1}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
