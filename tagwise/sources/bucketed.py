"""Price tables bucketed by article, which join without moving either side.

A table is written once into a fixed number of buckets by the hash of the article, each file sorted by it. Offers and
price lists with the same number of buckets then meet bucket by bucket: the exchange that a join by article and year
would make of the offers, every day and for every report, is made once, when they are written. Joins by more columns than
the article count as met by it only with ``JOIN_SETTINGS``.

A bucket is one task. Where one article has a large share of all offers its bucket takes as long as that share, and
nothing splits it; read such tables with ``plain``, and the adaptive skew join takes over.
"""

from pyspark.sql import DataFrame, SparkSession

#: Partitioning by a part of the join's keys is enough on both sides.
JOIN_SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def write_bucketed(df: DataFrame, name: str, buckets: int, partition_by: tuple[str, ...] = ()) -> None:
    """Save ``df`` as the table ``name`` of the session's catalog, replacing it.

    Rows are dealt to the buckets' tasks before the write, so that there is one file per bucket (and partition) and not
    one per task and bucket.
    """
    writer = df.repartition(buckets, "article").write.mode("overwrite").bucketBy(buckets, "article").sortBy("article")
    (writer.partitionBy(*partition_by) if partition_by else writer).format("parquet").saveAsTable(name)


def plain(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows without its buckets, for joins in which one article is crowded."""
    located = spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()["data_type"]
    return spark.read.schema(spark.table(name).schema).parquet(located)
