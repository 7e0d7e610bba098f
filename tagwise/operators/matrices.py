"""Shop by date and shop by shop price matrices."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise import model
from tagwise.functions.measures import discount_of
from tagwise.operators.slicing import Dates, Day, market_keys, snapshots


def _at(label: str, value: str) -> Column:
    return F.when(F.col("label") == label, F.col(value))


def price_matrix(
    df: DataFrame,
    date: Day = None,
    dates: Dates | None = None,
    measure: str = "price",
    n: int = 10,
) -> DataFrame:
    """Per article ``shop, d30, d7, d1, d0``: lowest price of the shop on each snapshot day, the ``n`` cheapest shops.

    Shops are ordered by the latest day that has any price for the article, missing prices last. Ordering by the days
    from late to early does that without a second pass, as a day without prices leaves the order to the next one.
    """
    labels = list(model.LOOK_BACK)
    late_first = labels
    if dates is not None:
        late_first = [label for _, label in sorted(zip(map(str, dates), labels), key=lambda x: x[0], reverse=True)]
    article = market_keys(df, "article")
    cells = (
        snapshots(df, date, dates).groupBy(*article, "shop").agg(*[F.min(_at(d, measure)).alias(d) for d in labels])
    )
    place = F.row_number().over(
        Window.partitionBy(*article).orderBy(*[F.col(d).asc_nulls_last() for d in late_first], "shop")
    )
    return (
        cells.withColumn("_place", place).filter(F.col("_place") <= n).select(*article, "shop", *reversed(labels))
    )


def _change_cells(offers: DataFrame, date: Day, measure: str, key: str) -> DataFrame:
    labels = list(model.LOOK_BACK)
    return (
        snapshots(offers, date)
        .groupBy(*market_keys(offers, "shop"), key)
        .agg(
            *[F.min(_at(d, measure)).alias(d) for d in labels],
            *[F.count(_at(d, "label")).alias(f"rows_{d}") for d in labels],
        )
        .withColumns({f"diff_{d[1:]}d": F.col(d) - F.col("d0") for d in labels[1:]})
    )


def price_change_matrix(
    offers: DataFrame, date: Day = None, measure: str = "price", key: str = "product"
) -> DataFrame:
    """Per shop and product: price on the day and how much higher it was 1, 7 and 30 days before.

    Articles sharing a name (or having none) share a row, unless ``key`` is "article".
    """
    return _change_cells(offers, date, measure, key).select(
        *market_keys(offers, "shop"), key, "diff_30d", "diff_7d", "diff_1d", "d0"
    )


def price_change_counts(
    offers: DataFrame, date: Day = None, measure: str = "price", key: str = "product", strict: bool = False
) -> DataFrame:
    """Per shop the number of products whose price fell (``n_drops``) or rose (``n_rises``) since 1, 7, 30 days before.

    A day without offers gives zeros for that day; with ``strict`` one such day gives zeros for all.
    """
    periods = ("1d", "7d", "30d")
    complete = F.lit(True)
    if strict:
        for label in model.LOOK_BACK:
            complete = complete & (F.sum(f"rows_{label}") > 0)
    counts = []
    for period in periods:
        diff = F.col(f"diff_{period}")
        for name, moved in (("n_drops", diff > 0), ("n_rises", diff < 0)):
            counts.append(F.when(complete, F.count_if(moved)).otherwise(F.lit(0)).alias(f"{name}_{period}"))
    return _change_cells(offers, date, measure, key).groupBy(*market_keys(offers, "shop")).agg(*counts)


def discount_histogram(
    df: DataFrame,
    shops: list[str] | None = None,
    bins: int = 10,
    lo: float | None = None,
    hi: float | None = None,
    measure: str = "price",
) -> DataFrame:
    """``shop, bin, bin_lo, bin_hi, count`` of discounts in equal bins over the shops' joint range (or ``lo..hi``).

    Equal discounts of a shop are counted first; the range, a scalar subquery, and the bins both come from these counts,
    whose exchange is made once. The top edge belongs to the last bin. Values outside a given range are not counted.
    """
    if shops is not None:
        df = df.filter(F.col("shop").isin(*shops))
    owner = market_keys(df, "shop")
    disc = F.col("disc")
    inside = disc.isNotNull()
    if lo is not None:
        inside = inside & (disc >= float(lo))
    if hi is not None:
        inside = inside & (disc <= float(hi))
    counts = (
        df.select(*owner, F.col(discount_of(measure)).alias("disc")).filter(inside)
        .groupBy(*owner, "disc").agg(F.count("*").alias("n"))
    )
    if lo is None or hi is None:
        # the number of rows is not used; without it the subquery's counts would be pruned and be others than the bins'
        span = counts.select(F.struct(F.min(disc).alias("lo"), F.max(disc).alias("hi"), F.sum("n").alias("rows"))).scalar()
    low = F.lit(float(lo)) if lo is not None else span["lo"]
    high = F.lit(float(hi)) if hi is not None else span["hi"]
    place = F.floor((disc - low) / F.nullif(high - low, F.lit(0.0)) * bins) + 1
    binned = (
        counts.select(*owner, "n", F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("int").alias("bin"))
        .groupBy(*owner, "bin")
        .agg(F.sum("n").alias("count"))
    )
    width = (high - low) / bins
    return binned.withColumns({"bin_lo": low + (F.col("bin") - 1) * width, "bin_hi": low + F.col("bin") * width})


def competitor_prices(near: DataFrame, measure: str = "price") -> DataFrame:
    """``article, product, prices``: the lowest price of each shop as a map, whatever shops there are.

    A map is as large as the number of shops near the cheapest of the article. Offers without a shop's name are left out,
    as a matrix has no column for them.
    """
    keys = [*market_keys(near, "article"), "product"]
    lowest = near.groupBy(*keys, "shop").agg(F.min(measure).alias("price"))
    named = F.filter(F.collect_list(F.struct("shop", "price")), lambda x: x["shop"].isNotNull())
    return lowest.groupBy(*keys).agg(F.map_from_entries(named).alias("prices"))


def competitor_matrix(near: DataFrame, base_shop: str, shops: list[str], measure: str = "price") -> DataFrame:
    """``article, product``, the base shop and the other ``shops`` as columns, lowest price of each."""
    columns = [base_shop, *(shop for shop in shops if shop != base_shop)]
    keys = [*market_keys(near, "article"), "product"]
    return competitor_prices(near, measure).select(
        *keys, *[F.try_element_at("prices", F.lit(shop)).alias(shop) for shop in columns]
    )


def unpivot_competitors(prices: DataFrame, base_shop: str) -> DataFrame:
    """``competitor_prices`` as ``article, product, base_price, shop, price`` rows of the other shops, without missing
    prices."""
    keys = market_keys(prices, "article", "product")
    base = F.try_element_at("prices", F.lit(base_shop)).alias("base_price")
    rows = prices.select(*keys, base, F.explode("prices").alias("shop", "price"))
    return rows.filter((F.col("shop") != base_shop) & F.col("price").isNotNull())
