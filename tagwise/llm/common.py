"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed values of the contracts: white space that separates words.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below ``spark.checkpoint.dir``, which the driver and all executors see.

    Only a local master, as in tests, may leave it unset; it then gets a temporary folder. Elsewhere that is an error, as
    every executor would write to a disk of its own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tagwise-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there ever after.

    A lost executor costs no more than the unfinished tasks behind it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body and its inner lambdas use it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def hex_bits(digest: Column) -> Column:
    """The first 60 bits of a hexadecimal digest, as a number."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds few texts and what it makes of them at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def broadcast_if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A stored table of short rows with a broadcast hint, if it has no more than so many; else left to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
