"""Price ranks inside a (date, article) cell and what follows from them."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise.functions.display import fmt_decimal, fmt_percent
from tagwise.functions.measures import discount_of, with_surplus
from tagwise.operators.slicing import Day, market_keys, on_date, recent

def price_levels(offers: DataFrame, measure: str = "price", max_rank: int | None = None) -> DataFrame:
    """Distinct prices of every (date, article) cell with their ``rank`` and number of offers ``n``.

    Equal prices are counted before the shuffle, and the window sees one row per distinct price. Prices are quoted to
    the cent, so a cell of any number of offers has no more rows than cents between its lowest and highest price.
    """
    cell = market_keys(offers, "article", "date")
    levels = offers.filter(F.col(measure).isNotNull()).groupBy(*cell, measure).agg(F.count("*").alias("n"))
    by_price = Window.partitionBy(*cell).orderBy(measure)
    if max_rank is not None:
        # A price of rank r is among the r lowest distinct prices.
        levels = levels.withColumn("_level", F.row_number().over(by_price)).filter(F.col("_level") <= max_rank)
    cheaper = F.sum("n").over(by_price.rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.select(*cell, measure, "n", (F.coalesce(cheaper, F.lit(0)) + 1).alias("rank"))
    return levels if max_rank is None else levels.filter(F.col("rank") <= max_rank)


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with its keys renamed, and the condition that they equal the unprefixed ones (null equals null)."""
    renamed = df.withColumnsRenamed({key: prefix + key for key in keys})
    return renamed, [F.col(key).eqNullSafe(F.col(prefix + key)) for key in keys]


def price_rank(offers: DataFrame, measure: str = "price", max_rank: int | None = None) -> DataFrame:
    """Add ``rank``: 1 + the number of cheaper offers of the article on the date; null without a price. With
    ``max_rank`` only offers up to that rank are returned.

    Offers join the ranks of their cell's distinct prices. So a cell of any size is spread over its prices, and the skew
    join splits a single price with many offers. A hash of the keys leads them, so that the join sorts by one number and
    compares the keys themselves only where it is equal.
    """
    keys = market_keys(offers, "article", "date") + [measure]
    levels, same = prefixed(price_levels(offers, measure, max_rank).drop("n"), "level_", keys)
    lead = F.xxhash64(*keys) == F.xxhash64(*(f"level_{key}" for key in keys))
    ranked = offers.join(levels, [lead, *same], "left" if max_rank is None else "inner")
    return ranked.select(*offers.columns, "rank")


def rank_counts(ranked: DataFrame, shops: list[str] | None = None, n: int = 4) -> DataFrame:
    """``shop, rank, count``: how often a shop holds a rank; its first ``n`` ranks that occur."""
    if shops is not None:
        ranked = ranked.filter(F.col("shop").isin(*shops))
    owner = market_keys(ranked, "shop")
    counts = ranked.filter(F.col("rank").isNotNull()).groupBy(*owner, "rank").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy(*owner).orderBy("rank"))
    return counts.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def list_order(measure: str) -> list[Column]:
    """Deepest discount first, then product name, then article."""
    return [F.col(discount_of(measure)).desc_nulls_last(), F.col("product").asc_nulls_last(), F.col("article").asc()]


def rank_list(ranked: DataFrame, measure: str = "price", shop: str | None = None, k: int = 1) -> DataFrame:
    """Products offered at rank ``k``: those of a shop, deepest discount first, or of all shops without an order."""
    disc = discount_of(measure)
    rows = ranked.filter(F.col("rank") == k)
    if shop is not None:
        rows = rows.filter(F.col("shop") == shop).orderBy(*list_order(measure))
    return rows.select(*market_keys(ranked, "shop", "article"), "product", measure, disc)


def top_discounts(
    df: DataFrame, date: Day = None, measure: str = "price", n: int = 12, skip_unlisted: bool = False
) -> DataFrame:
    """Per article the ``n`` offers of the day with the deepest discount, their surplus over the cheapest of them,
    and discount and price as text. Offers without a discount come first unless ``skip_unlisted``.
    """
    disc = discount_of(measure)
    day = on_date(df, date)
    if skip_unlisted:
        day = day.filter(F.col(disc).isNotNull())
    cell = market_keys(df, "article", "date")
    place = F.row_number().over(
        Window.partitionBy(*cell).orderBy(F.col(disc).desc_nulls_first(), "shop", "price", "price_delivery")
    )
    top = day.withColumn("_place", place).filter(F.col("_place") <= n)
    return with_surplus(top, measure, cell).select(
        *cell,
        "shop",
        "price",
        "price_delivery",
        "list_price",
        F.col(disc).alias("disc"),
        "surplus",
        fmt_percent(disc, comma=False).alias("disc_label"),
        fmt_decimal(measure).alias("price_label"),
    )


def leaders(
    offers: DataFrame,
    measure: str = "price",
    days: int = 10,
    depth: int = 3,
    n: int = 5,
    skip_unpriced: bool = False,
    date: Day = None,
) -> DataFrame:
    """``shop, count``: the ``n`` shops most often among the ``depth`` cheapest offers of an article and day, over the
    last ``days`` days up to ``date`` or to the last of the frame. Offers without a price sort first, as cheapest, unless ``skip_unpriced``.
    """
    cell = market_keys(offers, "article", "date")
    rows = recent(offers, days, date)
    if skip_unpriced:
        rows = rows.filter(F.col(measure).isNotNull())
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(measure).asc_nulls_first(), "shop"))
    cheapest = rows.withColumn("_place", place).filter(F.col("_place") <= depth)
    owner = market_keys(offers, "shop")
    counts = cheapest.groupBy(*owner).agg(F.count("*").alias("count"))
    order = [F.col("count").desc(), F.col("shop")]
    if owner == ["shop"]:
        return counts.orderBy(*order).limit(n)
    best = F.row_number().over(Window.partitionBy("country").orderBy(*order))
    return counts.withColumn("_place", best).filter(F.col("_place") <= n).drop("_place").orderBy("country", *order)


def leader_text(top: DataFrame) -> DataFrame:
    """The few leader rows as one line of shop names, best first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "shop")))
    return top.groupBy(*market_keys(top)).agg(F.array_join(F.transform(ordered, lambda x: x["shop"]), ", ").alias("shops"))
