"""Exact numbers of distinct shops over any days, from bitmaps per day that are merged by OR.

Shops get numbers once, in a table that only grows. A day's shops are bits, in blocks of as many as Spark's bitmaps hold,
so a day has a few short rows per market however many offers it has; the shops of many days are the OR of those rows, and
their number is the number of bits. Adding up daily counts could not tell a shop that comes every day from a new one.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagwise.operators.slicing import market_keys


#: Groups in which new shops are numbered side by side.
GROUPS = 64


def _numbered(shops: DataFrame, above: Column) -> DataFrame:
    """Gapless numbers from ``above`` on: a place within each of ``GROUPS`` groups, after the shops of the groups before."""
    grouped = shops.withColumn("group", F.pmod(F.xxhash64("shop"), F.lit(GROUPS)))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # at most GROUPS short rows
    bases = grouped.groupBy("group").agg(F.count("*").alias("n")).select(
        "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    place = F.row_number().over(Window.partitionBy("group").orderBy("shop")) - 1
    placed = grouped.withColumn("place", place).join(F.broadcast(bases), "group")
    return placed.select("shop", (above + F.col("base") + F.col("place")).alias("number"))


def shop_numbers(offers: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``shop, number`` of all shops with a name: the ``known`` ones as they are, and the next numbers for new ones.

    Keep the result: it is the ``known`` of the next day.
    """
    shops = offers.select("shop").filter(F.col("shop").isNotNull()).distinct()
    if known is None:
        return _numbered(shops, F.lit(1).cast("long"))  # blocks of bits begin at 1
    fresh = shops.join(known.select("shop"), "shop", "left_anti")
    above = known.select(F.coalesce(F.max("number") + 1, F.lit(1).cast("long"))).scalar()
    return known.select("shop", "number").unionByName(_numbered(fresh, above))


def shop_days(offers: DataFrame, numbers: DataFrame) -> DataFrame:
    """``date, block, bits, unnamed``, and ``country``: the shops of each day; ``unnamed`` tells of offers without a shop's
    name. Shops without a number are an error, so that none is lost."""
    keys = market_keys(offers, "date")
    seen = offers.select(*keys, "shop").distinct().join(numbers, "shop", "left")
    missing = F.concat(F.lit("no number for shop "), F.col("shop"))
    number = F.when(F.col("shop").isNotNull() & F.col("number").isNull(), F.raise_error(missing)).otherwise(F.col("number"))
    placed = seen.withColumn("number", number).select(
        *keys,
        F.coalesce(F.bitmap_bucket_number("number"), F.lit(-1)).alias("block"),  # one block of its own without a name
        F.bitmap_bit_position("number").alias("bit"),
    )
    return placed.groupBy(*keys, "block").agg(
        F.bitmap_construct_agg(F.coalesce("bit", F.lit(0))).alias("bits"), (F.col("block") == -1).alias("unnamed")
    )


def freshness(days: DataFrame, country: str) -> DataFrame:
    """As ``series.freshness``, over the days that ``days`` has."""
    here = days.filter(F.col("country") == country)
    merged = here.groupBy("block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    n_shops = merged.select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return days.agg(F.max("date").alias("last_date")).withColumn("n_shops", n_shops)
