"""Small hand-made tables."""

import datetime

from pyspark.sql import types as T

from tagwise import model

D0 = datetime.date(2024, 1, 15)


def back(days: int) -> datetime.date:
    return D0 - datetime.timedelta(days=days)


def _with_year(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("year", T.IntegerType())])


def offers(spark, rows, country=None):
    """Rows of (date, article, shop, price, price_delivery); with ``country`` all of that country."""
    filled = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
    if country is None:
        schema = T.StructType([f for f in model.OFFERS if f.name != "country"])
        return spark.createDataFrame([r + (r[0].year,) for r in filled], _with_year(schema))
    return spark.createDataFrame([(*r[:3], country, *r[3:], r[0].year) for r in filled], _with_year(model.OFFERS))


def list_prices(spark, rows):
    """Rows of (article, year, product, price)."""
    return spark.createDataFrame([(*r, None, None) for r in rows], model.LIST_PRICES)


def catalog(spark, rows):
    """Rows of (date, article, country, price, discount, stock)."""
    return spark.createDataFrame([(*r, r[0].year) for r in rows], _with_year(model.CATALOG_OFFERS))


def supply(spark, rows):
    return spark.createDataFrame(rows, model.SUPPLY_PRICES)


def market(spark, rows):
    """Rows of (date, article, country, price)."""
    return spark.createDataFrame([(*r, r[0].year) for r in rows], _with_year(model.MARKET_OFFERS))


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
