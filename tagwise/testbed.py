"""The price tables as views over the TPC-H-like tables, for the registered queries, the benchmark and the tests.

Thirty parts make an article and forty-two ship days a scrape day, so that an article has several offers a day at
every scale; all rows of the tables are used. Nations map to markets. Prices are stepped by ten so that ties occur, and
null prices, missing list prices, repeated offers, and a country without VAT are built in.
"""

from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tagwise import model
from tagwise.sources import dimensions
from tagwise.sources.tables import normalise, with_year

PARTS_PER_ARTICLE = 30
DAYS_PER_SCRAPE = 42
# Fixed values. Catalogue country by half the nation key (the last has no VAT row), and price level in local currency.
CATALOG_COUNTRIES = ("de", "be", "cz", "fr", "it", "sk", "ro", "es", "pl", "hu", "dk", "se", "uk")
PRICE_LEVEL = {"cz": 25.0, "ro": 5.0, "pl": 4.5, "hu": 400.0, "dk": 7.0, "se": 11.0}
MARKET_COUNTRIES = ("de", "uk", "fr", "it", "se", "es", "pl")


def _article(part_key: str) -> Column:
    return F.floor(F.col(part_key) / PARTS_PER_ARTICLE).cast("int")


def _scrape_day() -> Column:
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return F.date_add(F.lit("2023-12-01").cast("date"), F.floor(days / DAYS_PER_SCRAPE).cast("int"))


@cache
def _schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema from the file footer, read once per session."""
    return spark.read.parquet(path).schema


@dataclass(frozen=True)
class Testbed:
    spark: SparkSession
    sf_dir: str

    __test__ = False

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        return self.spark.read.schema(_schema(self.spark, path)).parquet(path)

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))

    @cached_property
    def all_offers(self) -> DataFrame:
        """Offers of every country."""
        nation = F.col("s_nationkey")
        stepped = F.floor(F.col("l_extendedprice") / 1000) * 10 + 9.5
        returned = F.col("l_returnflag") == "R"
        rows = self._lines.select(
            _scrape_day().alias("date"),
            _article("l_partkey").alias("article"),
            F.concat(F.lit("shop_"), F.right(F.col("l_suppkey").cast("string"), F.lit(1))).alias("shop"),
            F.when(nation < 9, "de").when(nation < 17, "fr").otherwise("uk").alias("country"),
            F.when(~((F.col("l_linenumber") == 7) & returned), stepped).alias("price"),
            F.when(~returned, stepped + F.round(F.col("l_tax") * 100)).alias("price_delivery"),
        )
        return normalise(rows, model.OFFERS)

    @cached_property
    def _articles(self) -> DataFrame:
        """One row per article: names and attributes of its first part, the highest price of its parts."""
        part = self.table("part")
        first = {c: F.min_by(c, "p_partkey").alias(c) for c in ("p_name", "p_type", "p_brand", "p_size")}
        return part.groupBy(_article("p_partkey").alias("article")).agg(
            *first.values(), F.max("p_retailprice").alias("retail")
        )

    @cached_property
    def list_prices(self) -> DataFrame:
        """Two years; articles of the smallest sizes have left the list in 2024."""
        years = F.when(F.col("p_size") <= 4, F.array(F.lit(2023))).otherwise(F.array(F.lit(2023), F.lit(2024)))
        rows = self._articles.withColumn("year", F.explode(years)).select(
            "article",
            "year",
            F.col("p_name").alias("product"),
            F.when(F.col("year") == 2024, F.col("retail") * 1.05).otherwise(F.col("retail")).alias("price"),
            F.col("p_type").alias("subcategory"),
            F.col("p_brand").alias("family"),
        )
        return normalise(rows, model.LIST_PRICES)

    @cached_property
    def supply_prices(self) -> DataFrame:
        return normalise(self.list_prices.withColumn("price", F.col("price") * 0.3), model.SUPPLY_PRICES)

    @cached_property
    def platform_prices(self) -> DataFrame:
        rows = self._articles.select(
            "article",
            (F.col("retail") * 0.4).alias("amz_price"),
            F.col("retail").alias("hnp"),
            F.col("p_type").alias("subcategory"),
            F.col("p_brand").alias("family"),
        )
        return normalise(rows, model.PLATFORM_PRICES)

    @cached_property
    def catalog_offers(self) -> DataFrame:
        country = F.element_at(
            F.array(*[F.lit(c) for c in CATALOG_COUNTRIES]), F.floor(F.col("s_nationkey") / 2).cast("int") + 1
        )
        level = F.lit(1.0)
        for code, factor in PRICE_LEVEL.items():
            level = F.when(F.col("country") == code, factor).otherwise(level)
        rows = self._lines.withColumn("country", country).select(
            _scrape_day().alias("date"),
            _article("l_partkey").alias("article"),
            "country",
            (F.col("l_extendedprice") / 100 * level).alias("price"),
            F.round(F.col("l_discount") * 100).alias("discount"),
            F.col("l_quantity").alias("stock"),
        )
        return with_year(normalise(rows, model.CATALOG_OFFERS))

    @cached_property
    def market_offers(self) -> DataFrame:
        rows = self.catalog_offers.filter(F.col("country").isin(*MARKET_COUNTRIES))
        return with_year(normalise(rows, model.MARKET_OFFERS))

    def vat(self, channel: str) -> DataFrame:
        return dimensions.vat_table(self.spark, channel)

    def fx(self, channel: str) -> DataFrame:
        return dimensions.fx_table(self.spark, channel)
