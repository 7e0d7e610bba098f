"""Left joins with the price dimensions.

The sides are not hinted: Spark broadcasts a dimension whose size it knows to be under its threshold, otherwise it
sort-merges and adaptive execution splits the partitions of a hot article.
"""

from pyspark.sql import DataFrame, functions as F


def with_list_price(offers: DataFrame, list_prices: DataFrame, extra: tuple[str, ...] = ("product",)) -> DataFrame:
    dim = list_prices.select("article", "year", F.col("price").alias("list_price"), *extra)
    return offers.join(dim, ["article", "year"], "left")


def with_product(df: DataFrame, list_prices: DataFrame) -> DataFrame:
    """The article's name in the year of the row: one name, so no row is repeated."""
    names = list_prices.groupBy("article", "year").agg(F.min("product").alias("product"))
    return df.withColumn("year", F.year("date")).join(names, ["article", "year"], "left")


def with_supply_price(df: DataFrame, supply: DataFrame) -> DataFrame:
    dim = supply.select("article", "year", "product", F.col("price").alias("ancor"))
    return df.join(dim, ["article", "year"], "left")


def with_platform_price(df: DataFrame, platform: DataFrame) -> DataFrame:
    return df.join(platform.select("article", F.col("amz_price").alias("amazon")), "article", "left")


def with_vat(df: DataFrame, vat: DataFrame) -> DataFrame:
    return df.join(vat, "country", "left")
