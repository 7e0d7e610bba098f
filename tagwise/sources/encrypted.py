"""Rows that travel encrypted: each as one AES-CBC ciphertext (16-byte IV first), sealed and opened by Spark itself.

A sealed table has the ciphertext in ``content`` and the number of its key in ``key_no``. Keys are a table of their own,
``key_no, key``, that is joined to the rows; so a table can hold rows of several keys, as after a change of keys, and an
old key can be dropped from the table of keys without touching the rows of the others.
"""

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _cbc() -> list[Column]:
    return [F.lit("CBC"), F.lit("PKCS")]


def _key() -> Column:
    """The joined key; rows whose key is not in the table are an error."""
    number = F.coalesce(F.col("key_no").cast("string"), F.lit("null"))
    return F.coalesce("key", F.raise_error(F.concat(F.lit("no key "), number)))


def key_table(spark: SparkSession, keys: dict[int, bytes]) -> DataFrame:
    """``key_no, key``; a local table of known size, so that Spark's own size check makes its join a broadcast."""
    schema = pa.schema([("key_no", pa.int32()), ("key", pa.binary())])
    return spark.createDataFrame(pa.table({"key_no": list(keys), "key": list(keys.values())}, schema=schema))


def sealed(df: DataFrame, keys: DataFrame, key_no: Column | None = None) -> DataFrame:
    """``key_no, content``: every row as encrypted JSON, under the key of that number (0 unless given)."""
    row = F.to_json(F.struct(*df.columns))
    numbered = df.select((F.lit(0) if key_no is None else key_no).cast("int").alias("key_no"), row.alias("row"))
    content = F.aes_encrypt("row", _key(), *_cbc())
    return numbered.join(keys, "key_no", "left").select("key_no", content.alias("content"))


def unsealed(df: DataFrame, keys: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of ``content``; a wrong key fails, and so does a row whose key is not in the table.

    Keys stand in their table only, never in a query plan, unless that table is a literal one: then set
    ``spark.sql.redaction.string.regex`` where plans are logged.
    """
    plain = F.aes_decrypt("content", _key(), *_cbc()).cast("string")
    opened = df.join(keys, "key_no", "left").select(F.from_json(plain, schema).alias("row"))
    return opened.select("row.*")


def read_sealed(spark: SparkSession, path: str, keys: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the sealed Parquet table at ``path``."""
    return unsealed(spark.read.parquet(path), keys, schema)


def stage_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below ``spark.checkpoint.dir``, which only a local master may
    leave unset."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tagwise-")
    return f"{shared}/sealed-{uuid.uuid4()}"


def ingest(
    spark: SparkSession,
    path: str,
    keys: DataFrame,
    schema: T.StructType,
    out: str,
    partition_by: tuple[str, ...] = ("country", "date"),
) -> None:
    """Open the sealed Parquet table at ``path`` into plain Parquet at ``out``, partitioned by those of ``partition_by``
    that it has. Only partitions with new rows are replaced, so a new day leaves the history as it is.

    Rows are rebalanced on the partition columns before the write: few files per partition, while a hot partition is
    still split over several tasks.
    """
    rows = read_sealed(spark, path, keys, schema)
    partitions = [c for c in partition_by if c in schema.names]
    if partitions:
        rows = rows.hint("rebalance", *partitions)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(out)
