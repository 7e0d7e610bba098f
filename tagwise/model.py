"""Table schemas and fixed business values."""

from pyspark.sql import types as T


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


OFFERS = _schema(
    date=T.DateType(),
    article=T.IntegerType(),
    shop=T.StringType(),
    country=T.StringType(),
    price=T.DoubleType(),
    price_delivery=T.DoubleType(),
)
LIST_PRICES = _schema(
    article=T.IntegerType(),
    year=T.IntegerType(),
    product=T.StringType(),
    price=T.DoubleType(),
    subcategory=T.StringType(),
    family=T.StringType(),
)
CATALOG_OFFERS = _schema(
    date=T.DateType(),
    article=T.IntegerType(),
    country=T.StringType(),
    price=T.DoubleType(),
    discount=T.DoubleType(),
    stock=T.IntegerType(),
)
SUPPLY_PRICES = _schema(
    article=T.IntegerType(),
    year=T.IntegerType(),
    product=T.StringType(),
    price=T.DoubleType(),
)
MARKET_OFFERS = _schema(
    date=T.DateType(),
    article=T.IntegerType(),
    country=T.StringType(),
    price=T.DoubleType(),
)
PLATFORM_PRICES = _schema(
    article=T.IntegerType(),
    amz_price=T.DoubleType(),
    hnp=T.DoubleType(),
    subcategory=T.StringType(),
    family=T.StringType(),
)

# Fixed values. VAT by country.
VAT = {
    "catalog": {
        "de": 0.19, "be": 0.21, "cz": 0.21, "fr": 0.2, "it": 0.22, "sk": 0.23,
        "ro": 0.19, "es": 0.21, "pl": 0.23, "hu": 0.27, "dk": 0.25, "se": 0.25,
    },
    "marketplace": {"de": 0.19, "uk": 0.2, "fr": 0.2, "it": 0.22, "se": 0.25, "es": 0.21, "pl": 0.23},
}
# Fixed values. Local currency units per euro; a country that is not listed already quotes in euro.
FX = {
    "catalog": {"cz": 25.2, "ro": 4.98, "pl": 4.26, "hu": 410.0, "dk": 7.5, "se": 10.7},
    "marketplace": {"uk": 0.855, "se": 11.6, "pl": 4.29},
}
# Fixed values. Margin bands (percent) and the default of the low-margin report (percent).
MARGIN_BANDS = {"catalog": (45.0, 70.0), "marketplace": (15.0, 30.0)}
LOW_MARGIN = {"catalog": 40.0, "marketplace": 20.0}
# Fixed values. Countries a retailer chart starts with.
CHART_COUNTRIES = ("cz", "de", "es", "sk")
# Fixed values. Snapshot roles: days before the report date.
LOOK_BACK = {"d0": 0, "d1": 1, "d7": 7, "d30": 30}
