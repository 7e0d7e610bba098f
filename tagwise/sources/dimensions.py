"""VAT and exchange-rate tables, one row per country."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagwise import model


def _per_country(spark: SparkSession, column: str, values: dict[str, float]) -> DataFrame:
    # From Arrow this becomes a local relation of known size, so Spark's own size check makes the join a broadcast.
    table = pa.table(
        {"country": list(values), column: [float(v) for v in values.values()]},
        schema=pa.schema([("country", pa.string()), (column, pa.float64())]),
    )
    return spark.createDataFrame(table)


def vat_table(spark: SparkSession, channel: str) -> DataFrame:
    """``country, vat`` for ``channel`` "catalog" or "marketplace"."""
    return _per_country(spark, "vat", model.VAT[channel])


def fx_table(spark: SparkSession, channel: str, overrides: dict[str, float] | None = None) -> DataFrame:
    """``country, rate`` in local units per euro; ``overrides`` replaces or adds rates."""
    return _per_country(spark, "rate", {**model.FX[channel], **(overrides or {})})
