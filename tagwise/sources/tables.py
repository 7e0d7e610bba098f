"""Typed reads of the price tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tagwise import model


def normalise(df: DataFrame, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Project ``df`` to ``schema`` with its types. Columns in ``optional`` may be absent and are then left out.

    A cast to the type the file already has is dropped by the optimizer, so filters still reach the scan.
    """
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            for f in schema
            if f.name in df.columns or f.name not in optional
        ]
    )


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date"))


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path), model.OFFERS)


def read_list_prices(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path), model.LIST_PRICES)


def read_catalog_offers(spark: SparkSession, path: str) -> DataFrame:
    return with_year(normalise(spark.read.parquet(path), model.CATALOG_OFFERS))


def read_supply_prices(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path), model.SUPPLY_PRICES)


def read_market_offers(spark: SparkSession, path: str) -> DataFrame:
    return with_year(normalise(spark.read.parquet(path), model.MARKET_OFFERS))


def read_platform_prices(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.parquet(path), model.PLATFORM_PRICES, optional=("hnp", "subcategory", "family"))
