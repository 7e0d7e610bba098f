import datetime

import pytest

from tagwise.operators import slicing
from tests.frames import D0, back, list_prices, offers, tuples


def test_market_slice_cuts_country_and_adds_year(spark):
    both = offers(spark, [(D0, 1, "a", 5.0)], "de").unionByName(offers(spark, [(back(30), 1, "a", 5.0)], "fr"))
    one = slicing.market_slice(both.drop("year"), "fr")
    assert "country" not in one.columns
    assert tuples(one, "article", "year") == [(1, 2023)]
    assert slicing.market_slice(both.drop("year")).count() == 2


def test_recent_is_inclusive_and_open_ended(spark):
    df = offers(spark, [(back(n), 1, "a", 1.0) for n in (0, 1, 10, 11)])
    assert set(tuples(slicing.recent(df, 10), "date")) == {(back(10),), (back(1),), (back(0),)}
    assert slicing.recent(df, 10, back(1)).count() == 4


def test_snapshots_label_by_offset(spark):
    df = offers(spark, [(back(n), 1, "a", 1.0) for n in (0, 1, 2, 7, 29, 30)])
    found = dict(tuples(slicing.snapshots(df), "label", "date"))
    assert found == {"d0": back(0), "d1": back(1), "d7": back(7), "d30": back(30)}


def test_snapshots_of_chosen_days_keep_a_repeated_day_once(spark):
    df = offers(spark, [(back(n), 1, "a", 1.0) for n in (0, 2)])
    chosen = slicing.snapshots(df, dates=(D0, D0, back(2), "2020-01-01"))
    assert tuples(chosen, "label", "date") == [("d0", D0), ("d7", back(2))]


def test_assortment_lists_every_name_and_resolve_picks_one(spark):
    df = offers(spark, [(D0, 1, "a", 1.0), (D0, 1, "b", 1.0), (D0, 2, "a", 1.0), (D0, 3, "a", 1.0)])
    names = list_prices(spark, [(1, 2023, "x", 1.0), (1, 2024, "x", 1.0), (1, 2024, "w", 1.0), (2, 2024, "x", 1.0)])
    pairs = slicing.assortment(df, names)
    assert tuples(pairs, "article", "product") == [(1, "w"), (1, "x"), (2, "x"), (3, None)]
    one = slicing.assortment(df, names, one_name=True)
    assert tuples(one, "article", "product") == [(1, "w"), (2, "x"), (3, None)]
    assert tuples(slicing.resolve(pairs, "article"), "article", "product") == [(1, "w"), (2, "x"), (3, None)]
    assert tuples(slicing.resolve(pairs, "product"), "product", "article") == [("w", 1), ("x", 1)]
    with pytest.raises(ValueError):
        slicing.resolve(pairs, "shop")


@pytest.mark.parametrize(
    ("present", "expected"),
    [
        (["third", "second", "first", "abc"], [(1, "first"), (2, "second")]),
        (["zzz", "third"], [(1, "third")]),
        (["zzz", "bbb"], [(1, "bbb")]),
        ([None], []),
    ],
)
def test_default_shops(spark, present, expected):
    df = offers(spark, [(D0, 1, shop, 1.0) for shop in present])
    assert tuples(slicing.default_shops(df, ["first", "second", "third"]), "position", "shop") == expected


def test_shop_and_country_lists_are_sorted(spark):
    df = offers(spark, [(D0, 1, s, 1.0) for s in ("b", "a", "b")], "fr")
    assert [r.shop for r in slicing.shops(df).collect()] == ["a", "b"]
    assert [r.country for r in slicing.countries(df).collect()] == ["fr"]


def test_report_day_takes_dates_and_text(spark):
    df = offers(spark, [(D0, 1, "a", 1.0), (back(1), 1, "a", 1.0)])
    assert slicing.on_date(df, "2024-01-14").count() == 1
    assert slicing.on_date(df, datetime.date(2024, 1, 15)).count() == 1
    assert tuples(slicing.on_date(df), "date") == [(D0,)]
