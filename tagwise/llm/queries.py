"""The registered queries of this subpackage: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagwise.llm import mixing, sql, vocabularies
from tagwise.llm.chat_format import formatted_conversations
from tagwise.llm.collocations import collocations
from tagwise.llm.common import table
from tagwise.llm.digests import fingerprints
from tagwise.llm.quality_classifier import quality_scores
from tagwise.llm.quality_rules import quality_rules
from tagwise.llm.secrets import BASE, RULES, secret_spans
from tagwise.llm.sentencepiece_bpe import Pieces, round_trips
from tagwise.llm.sharding import shard_by_bytes
from tagwise.llm.simhash import near_duplicates
from tagwise.llm.spelling import spelling_groups
from tagwise.llm.token_files import token_digests, write_ids
from tagwise.llm.toxicity import toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": lambda spark, d: near_duplicates(table(spark, d, "documents")),
        "op2_quality_rules": lambda spark, d: quality_rules(table(spark, d, "documents")),
        "op3_mixing": lambda spark, d: mixing.mixture(table(spark, d, "documents")),
        "op4_sentencepiece": lambda spark, d: round_trips(table(spark, d, "documents"), Pieces(vocabularies.PIECES)),
        "op5_sharding": lambda spark, d: shard_by_bytes(table(spark, d, "documents")),
        "op6_quality_classifier": lambda spark, d: quality_scores(
            table(spark, d, "documents"), table(spark, d, "labels")
        ),
        "op7_chat_format": lambda spark, d: formatted_conversations(table(spark, d, "conversations")),
        "op8_toxicity": lambda spark, d: toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op9_fingerprints": lambda spark, d: fingerprints(table(spark, d, "documents")),
        "op10_secret_scans": lambda spark, d: secret_spans(table(spark, d, "documents")),
        "op11_collocations": lambda spark, d: collocations(table(spark, d, "documents")),
        "op12_token_files": lambda spark, d: token_digests(write_ids(table(spark, d, "documents"), vocabularies.WORDS)),
        "op13_spelling_variants": lambda spark, d: spelling_groups(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": sql.QUALITY_RULES,
        "op3_mixing": sql.mixing(mixing.WEIGHTS, mixing.BUDGET_SHARE, mixing.MAX_EPOCHS, mixing.SEED),
        "op5_sharding": sql.SHARDING,
        "op7_chat_format": sql.CHAT_FORMAT,
        "op10_secret_scans": sql.secrets(RULES, BASE),
        "op11_collocations": sql.COLLOCATIONS,
        "op13_spelling_variants": sql.SPELLING,
    }
