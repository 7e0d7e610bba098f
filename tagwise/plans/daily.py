"""Reports over many days from the daily state instead of the offers; equal to those over the offers themselves."""

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tagwise.functions.measures import round_even
from tagwise.operators import ranking, series, slicing
from tagwise.operators.slicing import Day, market_keys
from tagwise.plans import development


def _offers(state: DataFrame, most: int | None = None, skip_unpriced: bool = False) -> DataFrame:
    """The offers that the state stands for as ``article, date, shop, price``; of each row the ``most`` cheapest."""
    levels = F.col("levels")
    if skip_unpriced:
        levels = F.filter(levels, lambda x: x["value"].isNotNull())
    if most is not None:
        levels = F.slice(levels, 1, most)
    times = lambda n: n if most is None else F.least(n, F.lit(most))
    each = F.flatten(F.transform(levels, lambda x: F.array_repeat(x["value"], times(x["n"]).cast("int"))))
    if most is not None:
        each = F.slice(each, 1, most)
    return state.select(*market_keys(state, "article", "date"), "shop", F.explode(each).alias("price"))


def _lowest(skip_unpriced: bool) -> Column:
    """A row's lowest price; a missing one counts as lowest unless skipped."""
    first = F.col("levels")[0]["value"]
    return F.coalesce(first, F.try_element_at("levels", F.lit(2))["value"]) if skip_unpriced else first


def daily_min(state: DataFrame, skip_unpriced: bool = False) -> DataFrame:
    rows = state.filter(F.col("n_priced") > 0) if skip_unpriced else state
    return series.daily_min(rows.withColumn("price", _lowest(skip_unpriced)))


def daily_mean(state: DataFrame) -> DataFrame:
    keys = market_keys(state, "article", "date")
    mean = F.try_divide(F.sum("total"), F.sum("n_priced"))
    return state.groupBy(*keys).agg(round_even(mean, 1).alias("mean_price"))


def leaders(
    state: DataFrame, days: int = 10, depth: int = 3, n: int = 5, skip_unpriced: bool = False, date: Day = None
) -> DataFrame:
    """As ``ranking.leaders``: the ``depth`` cheapest offers of a cell are among the ``depth`` cheapest of each shop."""
    recent = slicing.recent(state, days, date)
    return ranking.leaders(
        _offers(recent, depth, skip_unpriced), days=days, depth=depth, n=n, skip_unpriced=skip_unpriced, date=date
    )


def default_shops(state: DataFrame, preferred: Sequence[str], n: int = 2) -> DataFrame:
    return slicing.default_shops(state, preferred, n)


def price_development(state: DataFrame, shops: list[str] | None = None, preferred: Sequence[str] = ()) -> DataFrame:
    """As ``development.price_development``; only the rows of the chosen shops become offers again."""
    keys = market_keys(state, "article", "date")
    if shops is None:
        of_article = market_keys(state, "article", "shop")
        chosen = state.join(slicing.default_shops(state, preferred).select(*of_article), of_article, "left_semi")
    else:
        chosen = state.filter(F.col("shop").isin(*shops))
    lines = _offers(chosen).select(*keys, F.col("shop").alias("series"), F.col("price").alias("value"), "shop")
    cheapest, mean = daily_min(state), daily_mean(state)
    return lines.unionByName(development.min_line(cheapest)).unionByName(development.mean_line(mean))


def freshness(state: DataFrame, country: str, date: datetime.date | None = None) -> DataFrame:
    """As ``series.freshness``."""
    return series.freshness(state if date is None else state.filter(F.col("date") <= F.lit(date)), country)
