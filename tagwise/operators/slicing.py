"""Cutting offers to a market, a day, a window or a set of snapshot days, and looking up articles and shops."""

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise import model

Day = datetime.date | str | Column | None
Dates = Sequence[datetime.date | str]


def market_keys(df: DataFrame, *keys: str) -> list[str]:
    """``keys``, and ``country`` where the frame still holds several markets. As the least selective it comes last, so
    that sorts within a task compare the numbers first.
    """
    return list(keys) + (["country"] if "country" in df.columns else [])


def latest_date(df: DataFrame) -> Column:
    """The last date of the frame, as a scalar subquery inside the plan."""
    return df.select(F.max("date")).scalar()


def report_day(df: DataFrame, date: Day = None) -> Column:
    """The given day, or the last date of the frame."""
    if date is None:
        return latest_date(df)
    return date if isinstance(date, Column) else F.lit(date).cast("date")


def market_slice(offers: DataFrame, country: str | None = None) -> DataFrame:
    """Offers of one market without the ``country`` column (all markets, with it, for None), plus ``year``."""
    if country is not None:
        offers = offers.filter(F.col("country") == country).drop("country")
    return offers.withColumn("year", F.year("date"))


def on_date(df: DataFrame, date: Day = None) -> DataFrame:
    return df.filter(F.col("date") == report_day(df, date))


def recent(df: DataFrame, days: int, anchor: Day = None) -> DataFrame:
    """Rows from ``days`` days before the anchor on, that day included and without an upper bound."""
    return df.filter(F.col("date") >= F.date_sub(report_day(df, anchor), days))


def snapshots(df: DataFrame, date: Day = None, dates: Dates | None = None) -> DataFrame:
    """Rows of the report day and of 1, 7 and 30 days before, labelled ``d0, d1, d7, d30``.

    ``dates`` gives four days of the caller's choice in that order; a day chosen twice gets the first of its labels.
    """
    if dates is not None:
        days = [report_day(df, day) for day in dates]
    else:
        anchor = report_day(df, date)
        days = [F.date_sub(anchor, back) if back else anchor for back in model.LOOK_BACK.values()]
    label = F.lit(None).cast("string")
    for name, day in reversed(list(zip(model.LOOK_BACK, days))):
        label = F.when(F.col("date") == day, name).otherwise(label)
    return df.filter(F.col("date").isin(*days)).withColumn("label", label)


def assortment(
    offers: DataFrame, names: DataFrame, one_name: bool = False, by_market: bool = False
) -> DataFrame:
    """``article, product`` of every offered article: all its names, or with ``one_name`` the first in the alphabet; with
    ``by_market`` for every country apart.
    """
    articles = offers.select(*(market_keys(offers, "article") if by_market else ["article"])).distinct()
    if one_name:
        named = names.groupBy("article").agg(F.min("product").alias("product"))
    else:
        named = names.select("article", "product").distinct()
    return articles.join(named, "article", "left")


def resolve(assorted: DataFrame, by: str) -> DataFrame:
    """One ``article, product`` row per article (first name) or per product name (smallest article), and per country if
    the assortment has it.
    """
    if by not in ("article", "product"):
        raise ValueError(f"by must be 'article' or 'product', not {by!r}")
    other = "product" if by == "article" else "article"
    return assorted.filter(F.col(by).isNotNull()).groupBy(*market_keys(assorted, by)).agg(F.min(other).alias(other))


def shops(offers: DataFrame) -> DataFrame:
    market = market_keys(offers)
    return offers.select(*market, "shop").distinct().orderBy(*market, "shop")


def countries(offers: DataFrame) -> DataFrame:
    return offers.select("country").distinct().orderBy("country")


def default_shops(offers: DataFrame, preferred: Sequence[str], n: int = 2) -> DataFrame:
    """Per article the first ``n`` of the ``preferred`` shops it is offered by, else the first shop in the alphabet.

    Equal offers are merged by hash before the text minimum, which has to sort; then one value per preferred shop is
    aggregated.
    """
    keys = market_keys(offers, "article")
    offers = offers.select(*keys, "shop").distinct()
    flags = [F.max(F.when(F.col("shop") == shop, F.lit(shop))).alias(f"p{i}") for i, shop in enumerate(preferred)]
    per_article = offers.groupBy(*keys).agg(F.min("shop").alias("fallback"), *flags)
    present = F.slice(F.array_compact(F.array(*[F.col(f"p{i}") for i in range(len(preferred))])), 1, n)
    chosen = F.when(F.size(present) > 0, present).otherwise(F.array_compact(F.array("fallback")))
    return per_article.select(*keys, F.posexplode(chosen).alias("position", "shop")).withColumn(
        "position", F.col("position") + 1
    )


def country_index(df: DataFrame) -> Column:
    """Position of the row's country among the countries of its article, from 0; for one-day frames, where an article
    has a row per country.
    """
    return F.dense_rank().over(Window.partitionBy("article").orderBy("country")) - 1
