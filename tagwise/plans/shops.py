"""Two or more shops side by side on a day."""

from pyspark.sql import DataFrame, functions as F

from tagwise.functions import display, measures
from tagwise.operators import matrices, ranking
from tagwise.operators.enrich import with_list_price
from tagwise.operators.slicing import Day, market_keys, on_date, report_day


def rank_lists(
    offers: DataFrame,
    list_prices: DataFrame,
    shops: list[str] | None = None,
    date: Day = None,
    measure: str = "price",
    ranks: int = 2,
) -> DataFrame:
    """The products of the shops at rank 1 up to ``ranks``, as display text with their rank; for a single shop in list
    order, over several without an order.

    Ranks are taken among all shops of the market; only offers up to the last wanted rank meet the list prices.
    """
    disc = measures.discount_of(measure)
    ranked = ranking.price_rank(on_date(offers, date), measure, max_rank=ranks)
    if shops is not None:
        ranked = ranked.filter(F.col("shop").isin(*shops))
    listed = measures.with_discounts(with_list_price(ranked, list_prices))
    if shops is not None and len(shops) == 1:
        listed = listed.orderBy(*market_keys(offers), "rank", *ranking.list_order(measure))
    return listed.select(
        *market_keys(offers, "shop"),
        "rank",
        display.fmt_article("article").alias("article"),
        "product",
        display.fmt_price(measure).alias(measure),
        display.fmt_percent(disc).alias(disc),
    )


def shop_report(
    offers: DataFrame,
    list_prices: DataFrame,
    shops: list[str],
    date: Day = None,
    measure: str = "price",
    bins: int = 10,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """The frames of the shop duel: ``rank_counts``, ``rank_lists``, ``histogram``, ``change_counts``."""
    day = on_date(offers, date)
    compared = with_list_price(offers.filter(F.col("shop").isin(*shops)), list_prices)
    day_compared = measures.with_discounts(
        with_list_price(day.filter(F.col("shop").isin(*shops)), list_prices)
    )
    return {
        "rank_counts": ranking.rank_counts(ranking.price_rank(day, measure), shops),
        "rank_lists": rank_lists(offers, list_prices, shops, date, measure),
        "histogram": matrices.discount_histogram(day_compared, bins=bins, measure=measure),
        "change_counts": matrices.price_change_counts(
            compared, report_day(offers, date), measure, strict=strict
        ),
    }
