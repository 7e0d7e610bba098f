"""Where a shop is cheapest and its rivals are clearly dearer."""

from pyspark.sql import DataFrame, functions as F

from tagwise.operators.enrich import with_product
from tagwise.operators.ranking import prefixed, price_rank
from tagwise.operators.slicing import Day, market_keys, on_date


def near_cheapest(offers: DataFrame, depth: int = 1, measure: str = "price") -> DataFrame:
    """One row per shop of a (date, article) cell whose lowest price has a rank up to ``depth + 1``, with that rank."""
    return (
        price_rank(offers, measure, max_rank=depth + 1)
        .groupBy(*market_keys(offers, "article", "date"), "shop")
        .agg(F.min(measure).alias(measure), F.min("rank").alias("rank"))
    )


def rivals_of(near: DataFrame, base_shop: str) -> DataFrame:
    """The rows of the cells in which ``base_shop`` has rank 1."""
    cell = market_keys(near, "article", "date")
    led = near.filter((F.col("shop") == base_shop) & (F.col("rank") == 1)).select(*cell)
    return near.join(led, cell, "left_semi")


def min_price_gaps(
    offers: DataFrame,
    list_prices: DataFrame,
    date: Day = None,
    base_shop: str | None = None,
    min_diff: float = 10.0,
    depth: int = 1,
    measure: str = "price",
    only_qualifying: bool = False,
) -> DataFrame:
    """``base_shop, article, product, base_price, shop, price, diff`` for the articles on which the base shop (any shop
    for None) has rank 1 and some rival of rank up to ``depth + 1`` is at least ``min_diff`` dearer.

    All such rivals of a qualifying article are listed, also those under the threshold, unless ``only_qualifying``.
    For one base shop, articles come by largest gap and rivals by gap; over all shops the rows have no order.
    """
    if min_diff <= 0:
        raise ValueError("min_diff must be positive")
    cell = market_keys(offers, "article", "date")
    near = near_cheapest(on_date(offers, date), depth, measure)
    wide = (
        near.groupBy(*cell)
        .agg(F.min(measure).alias("base_price"), (F.max(measure) - F.min(measure)).alias("largest"))
        .filter(F.col("largest") >= min_diff)
    )
    # In a cell with a gap at most depth offers hold rank 1, as the next rank is within depth + 1.
    bases = near.filter(F.col("rank") == 1).select(*cell, F.col("shop").alias("base_shop"))
    if base_shop is not None:
        bases = bases.filter(F.col("base_shop") == base_shop)
    in_wide, same_wide = prefixed(wide, "wide_", cell)
    led, same = prefixed(
        bases.join(in_wide, same_wide).select(*cell, "base_shop", "base_price", "largest"), "base_", cell
    )
    rivals = (
        near.join(led, [*same, F.col("shop") != F.col("base_shop")])
        .select(*near.columns, "base_shop", "base_price", "largest")
        .withColumn("diff", F.col(measure) - F.col("base_price"))
    )
    if only_qualifying:
        rivals = rivals.filter(F.col("diff") >= min_diff)
    named = with_product(rivals, list_prices)
    if base_shop is not None:
        named = named.orderBy(F.col("largest").desc(), "diff", *market_keys(offers, "article", "shop"))
    return named.select(
        *market_keys(offers),
        "base_shop",
        "article",
        "product",
        "base_price",
        "shop",
        F.col(measure).alias("price"),
        "diff",
    )
