"""Calculated price columns: discounts, euro prices, net prices, margins."""

from pyspark.sql import Column, DataFrame, Window, functions as F

MEASURES = {"price": "disc1", "price_delivery": "disc2"}


def discount_of(measure: str) -> str:
    """Name of the discount column that belongs to a price column."""
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {sorted(MEASURES)}, not {measure!r}")
    return MEASURES[measure]


def round_even(value: Column, digits: int) -> Column:
    """Round the scaled double to the nearest integer, halves to even."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def with_discounts(df: DataFrame) -> DataFrame:
    """``disc1`` and ``disc2``: share below list price of the price and of the delivered price.

    A zero list price gives null rather than minus infinity.
    """
    return df.withColumns(
        {disc: 1 - F.try_divide(F.col(measure), F.col("list_price")) for measure, disc in MEASURES.items()}
    )


def to_eur(df: DataFrame, fx: DataFrame) -> DataFrame:
    """Add ``price_eur``: the price over the country's rate, in cents; unchanged where the country has no rate."""
    rate = F.col("rate")
    return (
        df.join(fx, "country", "left")
        .withColumn(
            "price_eur",
            F.when(rate.isNull(), F.col("price")).otherwise(round_even(F.try_divide(F.col("price"), rate), 2)),
        )
        .drop("rate")
    )


def _net(price: Column) -> Column:
    return F.try_divide(price, 1 + F.col("vat"))


def net_price(df: DataFrame) -> DataFrame:
    return df.withColumn("price_net", round_even(_net(F.col("price_eur")), 2))


def with_margin(df: DataFrame, cost: str, rounded_net: bool = True) -> DataFrame:
    """``margin`` over the net price: the rounded ``price_net`` (charts) or the exact quotient (reports)."""
    net = F.col("price_net") if rounded_net else _net(F.col("price_eur"))
    return df.withColumn("margin", round_even(1 - F.try_divide(F.col(cost), net), 4))


def with_discounted(df: DataFrame, cost: str = "ancor") -> DataFrame:
    """Prices after the percent ``discount``. ``margin_disc`` is taken over the gross discounted price."""
    keep = 1 - F.col("discount") / 100
    return df.withColumns(
        {
            "price_disc": round_even(F.col("price_eur") * keep, 2),
            "price_net_disc": round_even(F.col("price_net") * keep, 2),
        }
    ).withColumn("margin_disc", round_even(1 - F.try_divide(F.col(cost), F.col("price_disc")), 4))


def margin_band(low: float, high: float, margin: str = "margin") -> Column:
    """"low" under ``low`` percent, "high" over ``high`` percent, else "mid" (also on the edges and for null)."""
    percent = F.col(margin) * 100
    return F.when(percent < low, "low").when(percent > high, "high").otherwise("mid")


def with_surplus(df: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """``surplus`` over the lowest price of the rows with the same keys; meant for a frame cut to a few rows per key."""
    lowest = F.min(measure).over(Window.partitionBy(*keys))
    return df.withColumn("surplus", F.col(measure) - lowest)
