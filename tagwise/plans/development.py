"""Price development of every article: chosen shops, daily minimum, daily mean."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagwise.operators.series import daily_min_mean
from tagwise.operators.slicing import default_shops, market_keys


def shop_series(
    offers: DataFrame,
    shops: list[str] | None = None,
    measure: str = "price",
    preferred: Sequence[str] = (),
) -> DataFrame:
    """``article, date, shop, value`` of the given shops, or of each article's default shops by ``preferred``."""
    if shops is None:
        keys = market_keys(offers, "article", "shop")
        offers = offers.join(default_shops(offers, preferred).select(*keys), keys, "left_semi")
    else:
        offers = offers.filter(F.col("shop").isin(*shops))
    return offers.select(*market_keys(offers, "article", "date"), "shop", F.col(measure).alias("value"))


def min_line(daily: DataFrame) -> DataFrame:
    """The daily minimum as a series, with the shop that has it."""
    return daily.select(
        *market_keys(daily, "article", "date"),
        F.lit("min").alias("series"),
        F.col("min_price").alias("value"),
        F.col("min_price_shop").alias("shop"),
    )


def mean_line(daily: DataFrame) -> DataFrame:
    """The daily mean as a series, without a shop."""
    return daily.select(
        *market_keys(daily, "article", "date"),
        F.lit("mean").alias("series"),
        F.col("mean_price").alias("value"),
        F.lit(None).cast("string").alias("shop"),
    )


def _point(series: str, value: Column, shop: Column) -> Column:
    return F.struct(F.lit(series).alias("series"), value.alias("value"), shop.alias("shop"))


def price_development(
    offers: DataFrame,
    shops: list[str] | None = None,
    measure: str = "price",
    preferred: Sequence[str] = (),
) -> DataFrame:
    """``article, date, series, value, shop``: one series per chosen shop, plus ``min`` (with the shop that has it) and
    ``mean``, which are taken over all shops of the article.
    """
    keys = market_keys(offers, "article", "date")
    lines = F.array(
        _point("min", F.col("min_price"), F.col("min_price_shop")),
        _point("mean", F.col("mean_price"), F.lit(None).cast("string")),
    )
    overall = daily_min_mean(offers, measure).select(*keys, F.inline(lines))
    chosen = shop_series(offers, shops, measure, preferred).withColumn("series", F.col("shop"))
    return chosen.select(*overall.columns).unionByName(overall)
