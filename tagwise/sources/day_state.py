"""Daily state of the offers: what the reports over many days need of each, made once when a day is delivered.

A row per market, article, shop and measure of a day holds its distinct prices in ascending order, a missing one first,
each with its number of offers, and the count and sum of those with a price. Days are partitions of their own: a new,
repeated or late day is aggregated alone and replaces its partition, and no other day is read or written. Rows of
different days, and of different markets, never need to be merged; a report adds up or compares what it reads.

A row's prices are as many as one shop quotes for one article on one day, whatever the number of offers. Null shops,
articles and countries are kept as keys of their own; offers without a date belong to no day and are left out.
"""

import datetime
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagwise.sources import metadata
from tagwise.sources.tables import read_offers

MEASURES = ("price", "price_delivery")
KEYS = ("date", "country", "article", "shop", "measure")


def day_state(offers: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """The state of the offers' days. Equal prices are counted before the shuffle; both steps share one exchange only if
    Spark finds it cheaper, as the second merges no more than a shop's prices."""
    stacked = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    priced = offers.filter(F.col("date").isNotNull()).select(*KEYS[:-1], F.inline(stacked))
    levels = priced.groupBy(*KEYS, "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    return levels.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias("levels"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_priced"),
        F.sum(F.col("value") * F.col("n")).alias("total"),
    )


def refresh(offers: DataFrame, path: str, measures: tuple[str, ...] = MEASURES) -> None:
    """Write the state of the days of ``offers``, which must be whole days; other days at ``path`` stay.

    Rows are rebalanced on the day, so a large one is split over tasks, and sorted, so that a scan of one measure or
    market skips the rest.
    """
    rows = day_state(offers, measures).hint("rebalance", "date").sortWithinPartitions("measure", "country", "article")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def refresh_days(
    spark: SparkSession,
    offers_path: str,
    path: str,
    days: Iterable[datetime.date],
    measures: tuple[str, ...] = MEASURES,
) -> None:
    """``refresh`` from a table that is partitioned by date, of which only the given days are read."""
    chosen = list(days)
    if chosen:
        refresh(read_offers(spark, offers_path).filter(F.col("date").isin(chosen)), path, measures)


def pending_days(spark: SparkSession, offers_path: str, path: str) -> list[datetime.date]:
    """Days of the offers that the state does not have yet; both sides are told by the tables' folders alone."""
    try:
        done = set(metadata.dates(spark, path))
    except Exception as error:  # the first refresh of all
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        done = set()
    return [day for day in metadata.dates(spark, offers_path) if day not in done]


def read_state(
    spark: SparkSession, path: str, measure: str = "price", since: datetime.date | None = None, country: str | None = None
) -> DataFrame:
    """The state of one measure, of the days from ``since`` on and of one market (then without ``country``) or all."""
    rows = spark.read.parquet(path).filter(F.col("measure") == measure).drop("measure")
    if since is not None:
        rows = rows.filter(F.col("date") >= F.lit(since))
    return rows if country is None else rows.filter(F.col("country") == country).drop("country")
