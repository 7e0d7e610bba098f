import random

import pytest

from tagwise.operators import matrices
from tagwise.plans import headroom
from tests.frames import D0, list_prices, offers, tuples


def names(spark):
    return list_prices(spark, [(1, 2024, "p1", 1.0), (2, 2024, "p2", 1.0)])


def brute_gaps(rows, min_diff, depth, base_shop=None, only_qualifying=False):
    """(base_shop, article, base_price, shop, price, diff) from the definition, one article and base shop at a time."""
    out = []
    for article in {r[1] for r in rows}:
        cell = [(s, p) for _, a, s, p in rows if a == article and p is not None]
        rank = {p: 1 + sum(q < p for _, q in cell) for _, p in cell}
        near = {}
        for shop, price in cell:
            if rank[price] <= depth + 1:
                near[shop] = min(price, near.get(shop, price))
        for base, base_price in near.items():
            if rank[base_price] != 1 or base_shop not in (None, base):
                continue
            gaps = [(base, article, base_price, s, p, p - base_price) for s, p in near.items() if s != base]
            if any(g[5] >= min_diff for g in gaps):
                out += [g for g in gaps if not only_qualifying or g[5] >= min_diff]
    return sorted(out, key=repr)


COLUMNS = ("base_shop", "article", "base_price", "shop", "price", "diff")


@pytest.mark.parametrize("depth", [1, 2, 4])
@pytest.mark.parametrize("base_shop", [None, "s1"])
def test_gaps_match_brute_force(spark, depth, base_shop):
    rng = random.Random(depth)
    rows = [
        (D0, rng.randrange(30), f"s{rng.randrange(6)}", rng.choice([None, *map(float, range(10, 40, 3))]))
        for _ in range(200)
    ]
    for only in (False, True):
        found = headroom.min_price_gaps(
            offers(spark, rows), names(spark), None, base_shop, 6.0, depth, only_qualifying=only
        )
        assert tuples(found, *COLUMNS) == brute_gaps(rows, 6.0, depth, base_shop, only)


def test_gap_equal_to_the_threshold_counts(spark):
    df = offers(spark, [(D0, 1, "a", 10.0), (D0, 1, "b", 20.0), (D0, 2, "a", 10.0), (D0, 2, "b", 19.99)])
    found = headroom.min_price_gaps(df, names(spark))
    assert tuples(found, "base_shop", "article", "product", "shop", "diff") == [("a", 1, "p1", "b", 10.0)]


def test_tied_rival_and_small_gaps_of_a_qualifying_article_are_listed(spark):
    # K20 (empty result), K21.
    rows = [(D0, 1, "a", 10.0), (D0, 1, "b", 10.0), (D0, 1, "c", 12.0), (D0, 1, "d", 40.0), (D0, 2, "a", 5.0)]
    found = headroom.min_price_gaps(offers(spark, rows), names(spark), base_shop="a", depth=3)
    assert [(r.shop, r.diff) for r in found.collect()] == [("b", 0.0), ("c", 2.0), ("d", 30.0)]
    # With depth 1 the tie already fills the ranks; nothing qualifies, and the schema stays whole.
    empty = headroom.min_price_gaps(offers(spark, rows), names(spark), base_shop="a")
    assert empty.columns == ["base_shop", "article", "product", "base_price", "shop", "price", "diff"]
    assert empty.count() == 0


def test_order_is_by_largest_gap_then_gap(spark):
    rows = [(D0, 1, "a", 10.0), (D0, 1, "b", 25.0), (D0, 2, "a", 10.0), (D0, 2, "b", 12.0), (D0, 2, "c", 50.0)]
    found = headroom.min_price_gaps(offers(spark, rows), names(spark), base_shop="a", depth=2).collect()
    assert [(r.article, r.shop) for r in found] == [(2, "b"), (2, "c"), (1, "b")]


def test_a_name_listed_twice_does_not_repeat_rivals(spark):
    twice = list_prices(spark, [(1, 2024, "p1", 1.0), (1, 2024, "p0", 2.0)])
    df = offers(spark, [(D0, 1, "a", 10.0), (D0, 1, "b", 30.0)])
    assert tuples(headroom.min_price_gaps(df, twice), "product", "shop") == [("p0", "b")]


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        headroom.min_price_gaps(offers(spark, [(D0, 1, "a", 1.0)]), names(spark), min_diff=0)


def test_countries_are_kept_apart(spark):
    df = offers(spark, [(D0, 1, "a", 10.0), (D0, 1, "b", 30.0)], "de").unionByName(
        offers(spark, [(D0, 1, "a", 40.0), (D0, 1, "b", 20.0)], "fr")
    )
    found = headroom.min_price_gaps(df, names(spark))
    assert tuples(found, "country", "base_shop", "diff") == [("de", "a", 20.0), ("fr", "b", 20.0)]


def test_matrix_and_back_equals_the_report(spark):
    rng = random.Random(8)
    shops = [f"s{i}" for i in range(5)]
    rows = [(D0, rng.randrange(40), rng.choice(shops), float(rng.randrange(1, 60))) for _ in range(150)]
    df = offers(spark, rows)
    near = headroom.rivals_of(headroom.near_cheapest(df, depth=2), "s0")
    product = near.selectExpr("*", "cast(null as string) as product")
    matrix = matrices.competitor_matrix(product, "s0", shops)
    assert matrix.columns == ["article", "product", "s0", "s1", "s2", "s3", "s4"]
    long = matrices.unpivot_competitors(matrices.competitor_prices(product), "s0").selectExpr("*", "price - base_price as diff")
    widest = long.groupBy("article").agg({"diff": "max"}).filter("`max(diff)` >= 10").select("article")
    report = headroom.min_price_gaps(df, names(spark), base_shop="s0", depth=2)
    columns = ("article", "base_price", "shop", "price", "diff")
    assert tuples(report, *columns) == tuples(long.join(widest, "article"), *columns) != []
