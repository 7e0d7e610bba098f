import random

import pytest
from pyspark.sql import functions as F

from tagwise.functions import measures
from tagwise.operators import enrich, ranking
from tests.frames import D0, back, list_prices, offers, tuples


def brute_rank(rows):
    """Rank of every (date, article, shop, price) row among the priced rows of its date and article."""
    out = []
    for date, article, shop, price in rows:
        peers = [p for d, a, _, p in rows if (d, a) == (date, article) and p is not None]
        out.append((date, article, shop, price, None if price is None else 1 + sum(p < price for p in peers)))
    return sorted(out, key=repr)


def random_rows(seed, n=300):
    rng = random.Random(seed)
    return [
        (back(rng.randrange(2)), rng.randrange(4), f"s{rng.randrange(12)}", rng.choice([None, *map(float, range(1, 25))]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_price_rank_matches_brute_force(spark, seed):
    rows = random_rows(seed)
    df = offers(spark, rows)
    expected = brute_rank(rows)
    top = [r for r in expected if r[4] is not None and r[4] <= 3]
    assert tuples(ranking.price_rank(df), "date", "article", "shop", "price", "rank") == expected
    assert tuples(ranking.price_rank(df, max_rank=3), "date", "article", "shop", "price", "rank") == top


def test_ties_share_a_rank_and_a_missing_price_has_none(spark):
    # K3.
    df = offers(spark, [(D0, 1, "a", 5.0), (D0, 1, "b", 5.0), (D0, 1, "c", 7.0), (D0, 1, "d", None)])
    assert tuples(ranking.price_rank(df), "shop", "rank") == [("a", 1), ("b", 1), ("c", 3), ("d", None)]
    assert tuples(ranking.price_rank(df, max_rank=2), "shop", "rank") == [("a", 1), ("b", 1)]


def test_offers_without_article_stay_and_are_ranked_together(spark):
    df = offers(spark, [(D0, None, "a", 5.0), (D0, None, "b", 7.0), (D0, 1, "a", 1.0)])
    found = ranking.price_rank(df)
    assert tuples(found, "article", "shop", "rank") == [(1, "a", 1), (None, "a", 1), (None, "b", 2)]


def test_countries_are_ranked_apart(spark):
    df = offers(spark, [(D0, 1, "a", 5.0)], "de").unionByName(offers(spark, [(D0, 1, "b", 9.0)], "fr"))
    assert tuples(ranking.price_rank(df), "country", "rank") == [("de", 1), ("fr", 1)]


def test_rank_counts_keep_the_first_ranks_that_occur(spark):
    ranks = [("a", r) for r in (2, 2, 5, 6, 7, 9, None)] + [("b", 1)]
    ranked = spark.createDataFrame(ranks, "shop string, rank long")
    assert tuples(ranking.rank_counts(ranked, ["a"]), "shop", "rank", "count") == [
        ("a", 2, 2),
        ("a", 5, 1),
        ("a", 6, 1),
        ("a", 7, 1),
    ]


def test_rank_counts_add_up_to_priced_offers(spark):
    rows = random_rows(3)
    counted = ranking.rank_counts(ranking.price_rank(offers(spark, rows)), n=1000)
    assert counted.agg(F.sum("count")).first()[0] == sum(r[3] is not None for r in rows)


def test_rank_list_order_and_missing_discount(spark):
    df = offers(spark, [(D0, i, "a", 10.0) for i in (1, 2, 3)] + [(D0, 4, "b", 1.0), (D0, 4, "a", 2.0)])
    names = list_prices(spark, [(1, 2024, "n1", 20.0), (2, 2024, "n2", 40.0)])
    ranked = ranking.price_rank(measures.with_discounts(enrich.with_list_price(df, names)))
    rows = ranking.rank_list(ranked, shop="a").collect()
    assert [(r.article, r.disc1) for r in rows] == [(2, 0.75), (1, 0.5), (3, None)]
    assert ranking.rank_list(ranked, shop="c").count() == 0
    assert [r.article for r in ranking.rank_list(ranked, shop="a", k=2).collect()] == [4]


def listed(spark):
    rows = [(D0, 1, f"s{i:02d}", 100.0 - i, 110.0 - i) for i in range(14)] + [(D0, 2, "x", 5.0), (D0, 3, "x", 8.0, 9.0)]
    names = list_prices(spark, [(1, 2024, "p", 200.0), (3, 2024, "zero", 0.0)])
    return measures.with_discounts(enrich.with_list_price(offers(spark, rows), names))


def test_top_discounts(spark):
    top = ranking.top_discounts(listed(spark))
    first = [r for r in top.collect() if r.article == 1]
    assert len(first) == 12
    assert {r.shop for r in first} == {f"s{i:02d}" for i in range(2, 14)}
    cheapest = next(r for r in first if r.shop == "s13")
    assert (cheapest.surplus, cheapest.disc_label) == (0.0, "56.5%")
    assert max(r.surplus for r in first) == 11.0
    # Articles without a usable list price stay, unless they are to be skipped.
    assert tuples(top.filter("article > 1"), "article", "disc", "disc_label") == [(2, None, None), (3, None, None)]
    assert ranking.top_discounts(listed(spark), skip_unlisted=True).filter("article > 1").count() == 0


def test_offers_without_discount_come_first(spark):
    # K2.
    rows = [(D0, 1, f"s{i:02d}", 10.0 + i) for i in range(12)] + [(D0, 1, "null", None)]
    df = measures.with_discounts(
        enrich.with_list_price(offers(spark, rows), list_prices(spark, [(1, 2024, "p", 100.0)]))
    )
    shops = {r.shop for r in ranking.top_discounts(df).collect()}
    assert "null" in shops and "s11" not in shops


def test_leaders_count_rows_not_shops(spark):
    rows = [(D0, 1, "a", 1.0), (D0, 1, "a", 1.0), (D0, 1, "b", 2.0), (D0, 1, "c", 3.0), (back(11), 1, "c", 1.0)]
    assert [tuple(r) for r in ranking.leaders(offers(spark, rows)).collect()] == [("a", 2), ("b", 1)]


def test_leaders_put_missing_prices_first_unless_skipped(spark):
    # K1.
    rows = [(D0, 1, "a", 1.0), (D0, 1, "b", None), (D0, 1, "c", 3.0), (D0, 1, "d", 4.0)]
    assert tuples(ranking.leaders(offers(spark, rows)), "shop") == [("a",), ("b",), ("c",)]
    assert tuples(ranking.leaders(offers(spark, rows), skip_unpriced=True), "shop") == [("a",), ("c",), ("d",)]


def test_leader_text(spark):
    top = spark.createDataFrame([("b", 2), ("c", 5), ("a", 2)], "shop string, count long")
    assert ranking.leader_text(top).first().shops == "c, a, b"
