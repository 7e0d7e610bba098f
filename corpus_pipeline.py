"""From raw documents to token ids: a pipeline of five operators of ``tagwise.llm``.

Every stage takes and, but for the last, returns the columns of ``documents``. What a stage drops or changes is gone for
the next: the classifier's rejects, all but one of each group of near duplicates, the secrets in the texts (replaced by a
placeholder), and what exceeds the target weights of domains and languages. The last stage gives each text as piece ids
and as decoded from them.

Null texts and ids, empty and very long texts and repeated rows pass through every stage as its operator's module says: a
null text counts as empty, and of equal texts one stays. Columns beside those of ``documents`` are carried along under their
names. An empty table gives an empty result.

The stages have no SQL form, as a trained model and piece merges take part; the tests compare them with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagwise.llm import mixing, quality_classifier, secrets, sentencepiece_bpe, simhash, vocabularies
from tagwise.llm.common import stored, table

#: Share of the tokens that reach the mixing stage to be kept, each document at most once.
KEPT_SHARE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, share=KEPT_SHARE, max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.recoded(docs, sentencepiece_bpe.Pieces(vocabularies.PIECES))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
