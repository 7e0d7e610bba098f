import random

from tagwise.operators import series
from tagwise.plans import development
from tests.frames import D0, back, offers, tuples

ROWS = [
    (D0, 1, "b", 5.0, 9.0),
    (D0, 1, "a", 5.0, None),
    (D0, 1, "c", 6.25, 8.0),
    (back(1), 1, "a", None, None),
    (back(1), 1, "c", 2.0, 3.0),
]


def test_daily_min_breaks_ties_and_takes_a_missing_price_as_lowest(spark):
    # K1.
    df = offers(spark, ROWS)
    assert tuples(series.daily_min(df), "date", "min_price", "min_price_shop") == [
        (back(1), None, "a"),
        (D0, 5.0, "a"),
    ]
    assert tuples(series.daily_min(df, "price_delivery", skip_unpriced=True), "min_price", "min_price_shop") == [
        (3.0, "c"),
        (8.0, "c"),
    ]


def test_daily_mean_ignores_missing_prices_and_rounds_to_one_digit(spark):
    assert tuples(series.daily_mean(offers(spark, ROWS)), "date", "mean_price") == [(back(1), 2.0), (D0, 5.4)]
    assert tuples(series.daily_mean(offers(spark, [(D0, 1, "a", None)])), "mean_price") == [(None,)]


def test_min_is_not_above_mean(spark):
    rng = random.Random(5)
    df = offers(spark, [(D0, rng.randrange(9), f"s{rng.randrange(5)}", float(rng.randrange(1, 99))) for _ in range(99)])
    both = series.daily_min_mean(df).collect()
    assert both and all(r.min_price <= r.mean_price for r in both)


def test_freshness_counts_a_missing_shop_name(spark):
    # K5 (date over all countries), K22.
    here = offers(spark, [(back(1), 1, s, 1.0) for s in ("a", "a", None)], "de")
    df = here.unionByName(offers(spark, [(D0, 1, "z", 1.0)], "fr"))
    assert tuple(series.freshness(df, "de").first()) == (D0, 2)
    assert tuple(series.freshness(df, "fr").first()) == (D0, 1)
    assert tuple(series.freshness(df, "uk").first()) == (D0, 0)


def test_price_development_lines_are_over_all_shops(spark):
    df = offers(spark, [(D0, 1, "a", 4.0), (D0, 1, "b", 2.0), (D0, 1, "c", 3.0)])
    assert tuples(development.price_development(df, ["a"]), "series", "value", "shop") == [
        ("a", 4.0, "a"),
        ("mean", 3.0, None),
        ("min", 2.0, "b"),
    ]


def test_price_development_starts_with_default_shops_per_article(spark):
    df = offers(spark, [(D0, 1, "zz", 4.0), (D0, 1, "b", 2.0), (D0, 2, "y", 3.0), (D0, 2, "x", 3.0)])
    lines = development.price_development(df, preferred=["zz"]).filter("series not in ('min', 'mean')")
    assert tuples(lines, "article", "series") == [(1, "zz"), (2, "x")]
    lines = development.price_development(df).filter("series not in ('min', 'mean')")
    assert tuples(lines, "article", "series") == [(1, "b"), (2, "x")]
