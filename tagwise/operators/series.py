"""Daily price series and table freshness."""

from pyspark.sql import Column, DataFrame, functions as F

from tagwise.functions.measures import round_even
from tagwise.operators.slicing import market_keys


def _lowest(measure: str) -> Column:
    """Lowest price with its shop; a missing price counts as lowest, ties go to the first shop in the alphabet."""
    return F.min(F.struct(F.col(measure).alias("min_price"), F.col("shop").alias("min_price_shop")))


def _mean(measure: str) -> Column:
    return round_even(F.avg(measure), 1)


def daily_min(offers: DataFrame, measure: str = "price", skip_unpriced: bool = False) -> DataFrame:
    keys = market_keys(offers, "article", "date")
    if skip_unpriced:
        offers = offers.filter(F.col(measure).isNotNull())
    return offers.groupBy(*keys).agg(_lowest(measure).alias("m")).select(*keys, "m.min_price", "m.min_price_shop")


def daily_mean(offers: DataFrame, measure: str = "price") -> DataFrame:
    return offers.groupBy(*market_keys(offers, "article", "date")).agg(_mean(measure).alias("mean_price"))


def daily_min_mean(offers: DataFrame, measure: str = "price") -> DataFrame:
    """Both daily lines from one aggregation."""
    keys = market_keys(offers, "article", "date")
    both = offers.groupBy(*keys).agg(_lowest(measure).alias("m"), _mean(measure).alias("mean_price"))
    return both.select(*keys, "m.min_price", "m.min_price_shop", "mean_price")


def date_range(df: DataFrame) -> DataFrame:
    """``first_date, last_date`` a report can be asked for."""
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def freshness(offers: DataFrame, country: str) -> DataFrame:
    """``last_date`` over all countries and ``n_shops`` of one; offers without a shop name count as one more shop."""
    here = F.col("country") == country
    named = F.count_distinct(F.when(here, F.col("shop")))
    unnamed = F.coalesce(F.max(F.when(here & F.col("shop").isNull(), 1)), F.lit(0))
    return offers.agg(F.max("date").alias("last_date"), (named + unnamed).alias("n_shops"))
