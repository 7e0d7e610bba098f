"""Distinct shops by bitmaps against counting them."""

import random

import pytest
from pyspark.sql import functions as F

from tagwise.operators import series
from tagwise.sources import shop_bits
from tests.frames import D0, back, offers, tuples


def day(spark, when, shops, country):
    return offers(spark, [(when, i % 3, shop, 1.0) for i, shop in enumerate(shops)], country)


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(4)
    names = [f"s{i}" for i in range(200)]
    found = [
        day(spark, back(k), rng.choices([*names, None] if country == "de" else names, k=150), country)
        for k in range(4)
        for country in ("de", "fr")
    ]
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every


def test_any_days_give_the_number_of_shops(spark, days):
    state = shop_bits.shop_days(days, shop_bits.shop_numbers(days).cache()).cache()
    assert state.count() <= 4 * 2 * 2  # a block of numbers a day and market, and one for offers without a shop
    for country in ("de", "fr", "uk"):
        for since in range(4):
            some = F.col("date") >= F.lit(back(since))
            expected = series.freshness(days.filter(some), country)
            assert tuples(shop_bits.freshness(state.filter(some), country), "last_date", "n_shops") == tuples(
                expected, "last_date", "n_shops"
            )


def test_states_of_single_days_are_merged(spark, days):
    numbers, state = None, None
    for k in (2, 0, 3, 1):  # in any order, with new shops on each
        delivered = days.filter(F.col("date") == F.lit(back(k)))
        grown = shop_bits.shop_numbers(delivered, numbers).collect()  # as if stored for the next day
        numbers = spark.createDataFrame(grown, "shop string, number long")
        added = shop_bits.shop_days(delivered, numbers)
        state = added if state is None else state.unionByName(added)
    assert sorted(r.number for r in numbers.collect()) == list(range(1, numbers.count() + 1))
    assert numbers.count() == days.select("shop").dropna().distinct().count()
    for country in ("de", "fr"):
        assert shop_bits.freshness(state, country).first() == series.freshness(days, country).first()


def test_a_shop_without_a_number_is_an_error(spark, days):
    numbers = shop_bits.shop_numbers(days.filter("country = 'xx'"))
    with pytest.raises(Exception, match="no number for shop"):
        shop_bits.shop_days(days, numbers).collect()


def test_no_offers(spark):
    none = offers(spark, [], "de")
    state = shop_bits.shop_days(none, shop_bits.shop_numbers(none))
    assert tuples(shop_bits.freshness(state, "de"), "last_date", "n_shops") == [(None, 0)]
    one = day(spark, D0, [None], "de")
    state = shop_bits.shop_days(one, shop_bits.shop_numbers(one))
    assert tuples(shop_bits.freshness(state, "de"), "last_date", "n_shops") == [(D0, 1)]
