"""What a stored table's metadata tells: its last date and its dates, without reading a row of data.

For a partition column the answer comes from the listing of the folders, which Spark has made to read the table. For
another column of type date it comes from the statistics in the footers of the Parquet files, which tasks read side by
side. Both are rewrites of Spark's own optimizer that are off by default; they are switched on for the one small query and
switched back, so that other queries are planned as before.
"""

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Spark's settings that answer from folders and from footers.
FROM_FOLDERS = {"spark.sql.optimizer.metadataOnly": "true"}
FROM_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _stored(spark: SparkSession, path: str, country: str | None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if country is None else table.filter(F.col("country") == country)


def last_date(
    spark: SparkSession, path: str, column: str = "date", country: str | None = None, partitioned: bool = True
) -> datetime.date | None:
    """The last date of the table at ``path``; None if it has none.

    With ``partitioned`` the column has to be a partition column, and so does ``country`` if one is given. Without it the
    column must be stored as a date, and there is no choice of a country, as footers do not know it.
    """
    if not partitioned and country is not None:
        raise ValueError("footers tell the last date of the whole table only")
    with settings(spark, FROM_FOLDERS if partitioned else FROM_FOOTERS):
        return _stored(spark, path, country).agg(F.max(column).alias("last_date")).first()["last_date"]


def dates(spark: SparkSession, path: str, column: str = "date", country: str | None = None) -> list[datetime.date]:
    """The dates of a partitioned table in ascending order; as many as it has day partitions."""
    with settings(spark, FROM_FOLDERS):
        found = _stored(spark, path, country).select(column).distinct().collect()
    return sorted(row[column] for row in found if row[column] is not None)
