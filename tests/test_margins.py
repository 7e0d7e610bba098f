import pytest
from tagwise.functions import measures
from tagwise.operators.dedupe import first_per_key
from tagwise.plans import margins
from tagwise.sources.dimensions import fx_table, vat_table
from tests.frames import D0, back, catalog, list_prices, market, supply, tuples


@pytest.fixture(scope="module")
def dims(spark):
    return fx_table(spark, "catalog"), vat_table(spark, "catalog")


def test_dimension_tables(spark):
    assert dict(tuples(fx_table(spark, "marketplace", {"uk": 0.9}), "country", "rate")) == {
        "uk": 0.9,
        "se": 11.6,
        "pl": 4.29,
    }
    assert vat_table(spark, "catalog").count() == 12
    assert vat_table(spark, "marketplace").count() == 7


def test_euro_and_net_prices(spark, dims):
    df = catalog(
        spark,
        [
            (D0, 1, "cz", 252.0, 0.0, 1),
            (D0, 2, "de", 11.905, 0.0, 1),
            (D0, 3, "xx", 7.123, 0.0, 1),
            (D0, 4, "hu", None, 0.0, 1),
        ],
    )
    assert tuples(margins.in_euro(df, *dims), "article", "price_eur", "price_net") == [
        (1, 10.0, 8.26),
        (2, 11.905, 10.0),
        (3, 7.123, None),
        (4, None, None),
    ]


def test_halves_round_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (2.5,)], "x double")
    assert [r[0] for r in df.select(measures.round_even(df.x, 2)).collect()] == [0.12, 0.38, -0.12, 2.5]


def test_zero_prices_give_no_margin(spark):
    df = spark.createDataFrame([(0.0, 5.0, 0.0)], "price_net double, ancor double, price_disc double")
    assert measures.with_margin(df, "ancor").first().margin is None


def test_bands_are_strict(spark):
    df = spark.createDataFrame([(m,) for m in (0.4499, 0.45, 0.7, 0.7001, None)], "margin double")
    found = [r[0] for r in df.select(measures.margin_band(45.0, 70.0)).collect()]
    assert found == ["low", "mid", "mid", "high", "mid"]


def comparison(spark, dims):
    offers = catalog(
        spark,
        [
            (D0, 1, "de", 119.0, 10.0, 7),
            (D0, 1, "de", 125.0, 10.0, 7),
            (D0, 1, "de", None, 10.0, 7),
            (D0, 1, "cz", 2520.0, 0.0, 3),
            (back(30), 1, "de", 119.0, None, 7),
            (back(3), 1, "de", 1.0, 0.0, 7),
            (D0, 2, "uk", 10.0, 5.0, 1),
        ],
    )
    cost = supply(spark, [(1, 2024, "p", 40.0), (1, 2024, "q", 50.0), (1, 2023, "p", 20.0)])
    return margins.country_comparison(offers, cost, *dims)


def test_country_comparison(spark, dims):
    found = comparison(spark, dims)
    assert tuples(found, "article", "country", "date", "price_eur", "price_net", "ancor", "margin") == [
        (1, "cz", D0, 100.0, 82.64, 40.0, 0.516),
        (1, "de", back(30), 119.0, 100.0, 20.0, 0.8),
        (1, "de", D0, 119.0, 100.0, 40.0, 0.6),
        (2, "uk", D0, 10.0, None, None, None),
    ]
    row = found.filter("country = 'de' and discount is not null").first()
    assert (row.price_disc, row.price_net_disc, row.margin_disc) == (107.1, 90.0, 0.6265)


def test_latest_margins(spark, dims):
    found = margins.latest_margins(comparison(spark, dims), D0, "catalog")
    assert tuples(found, "article", "country", "margin_label", "band", "country_id", "discount_label") == [
        (1, "cz", "51.6%", "mid", 0, "0% || 100.0 €"),
        (1, "de", "60.0%", "mid", 1, "10% || 107.1 €"),
        (2, "uk", None, "mid", 0, "5% || 9.5 €"),
    ]


def test_marketplace_comparison_merges_equal_rows_only(spark):
    offers = market(spark, [(D0, 1, "uk", 85.5), (D0, 1, "uk", 85.5), (D0, 1, "uk", 95.5), (D0, 2, "de", 1.0)])
    platform = spark.createDataFrame([(1, 50.0)], "article int, amz_price double")
    found = margins.marketplace_comparison(
        offers,
        list_prices(spark, [(1, 2024, "p", 99.0)]),
        platform,
        fx_table(spark, "marketplace"),
        vat_table(spark, "marketplace"),
    )
    assert tuples(found, "article", "product", "price_eur", "price_net", "margin") == [
        (1, "p", 100.0, 83.33, 0.4),
        (1, "p", 111.7, 93.08, 0.4628),
        (2, None, 1.0, 0.84, None),
    ]


def test_series_reach_back_thirty_days_without_an_upper_bound(spark, dims):
    df = catalog(spark, [(back(n), 1, c, 25.2, 0.0, n) for n in (0, 1, 31, 32) for c in ("de", "cz", "fr")])
    assert tuples(margins.stock_series(df, date=back(1)), "date", "stock") == [(back(31), 31), (back(1), 1), (D0, 0)]
    found = margins.country_series(df, dims[0])
    assert set(tuples(found, "country", "price_eur")) == {("cz", 1.0), ("de", 25.2)}
    assert found.count() == 4


def test_low_margin_catalog(spark, dims):
    df = catalog(
        spark,
        [
            (D0, 1, "de", 119.0, 5.0, 1),
            (D0, 1, "de", 130.0, 5.0, 1),
            (D0, 2, "de", 119.0, 5.0, 1),
            (D0, 3, "de", 119.0, 5.0, 1),
            (D0, 4, "uk", 119.0, 5.0, 1),
            (D0, 5, "de", 119.0, 5.0, 1),
            (back(1), 1, "de", 1.0, 5.0, 1),
        ],
    )
    cost = supply(spark, [(i, 2024, f"p{i}", c) for i, c in ((1, 80.0), (2, 60.0), (4, 99.0), (5, 90.0))])
    found = margins.low_margin_catalog(df, cost, *dims, country="de")
    assert [(r.country, r.article, r.price, r.margin_pct_text) for r in found.collect()] == [
        ("de", "5", 119.0, "10.0%"),
        ("de", "1", 119.0, "20.0%"),
    ]
    counts = margins.low_margin_counts(found, df, 40.0)
    assert tuples(counts, "country", "date", "max_margin", "n_products") == [("de", D0, 40.0, 2), ("uk", D0, 40.0, 0)]
    everywhere = margins.low_margin_catalog(df, cost, *dims)
    assert tuples(everywhere, *found.columns) == tuples(found, *found.columns)
    assert margins.low_margin_catalog(df, cost, *dims, country="fr").count() == 0


def test_low_margin_market_keeps_repeats(spark):
    # K14; K9 is the decimal comma.
    offers = market(spark, [(D0, 1, "de", 119.0), (D0, 1, "de", 119.0), (D0, 1, "fr", 1200.0)])
    platform = spark.createDataFrame([(1, 90.0)], "article int, amz_price double")
    dims = fx_table(spark, "marketplace"), vat_table(spark, "marketplace")
    names = list_prices(spark, [(1, 2024, "p", 99.0)])
    found = margins.low_margin_market(offers, names, platform, *dims)
    assert tuples(found, "country", "product", "amazon", "price_eur", "margin_pct_text") == [
        ("de", "p", 90.0, "119.0", "10.0%")
    ] * 2
    assert margins.low_margin_market(offers, names, platform, *dims, decimal_comma=True).first().price_eur == "119,0"


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (1, 2, "a"), (2, None, "z")], "k int, a int, b string")
    assert tuples(first_per_key(df, ["k"], ["a", "b"]), "k", "b") == [(1, "a"), (2, "z")]
