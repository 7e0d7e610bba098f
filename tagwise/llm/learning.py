"""Training samples and folds, common to the operators that learn from ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a missing id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled documents outside the held-out fold, drawn by a seeded hash.

    Rows whose hash is far beyond the share that is wanted are left out first, so that the final choice, which is made in
    one task, sees little more than ``max_rows`` rows however many there are.
    """
    usable = (
        labels.select("doc_id", F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .withColumn("draw", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)))
    )
    share = min(1.0, 1.2 * (max_rows + 100) / max(1, usable.count()))
    chosen = (
        usable.where(F.col("draw") < int(share * (1 << 40))).orderBy("draw", "doc_id", "label").limit(max_rows)
        .select("doc_id", "label")
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")  # at most max_rows small rows


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
