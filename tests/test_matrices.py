import pytest
from pyspark.sql import functions as F

from tagwise.functions import measures
from tagwise.operators import enrich, matrices, slicing
from tagwise.testbed import Testbed
from tests.frames import D0, back, list_prices, offers, tuples


def test_price_matrix_takes_the_lowest_price_of_a_cell(spark):
    rows = [(D0, 1, "a", 5.0), (D0, 1, "a", 4.0), (back(1), 1, "a", 6.0), (back(30), 1, "b", 2.0), (back(2), 1, "c", 1.0)]
    assert tuples(matrices.price_matrix(offers(spark, rows)), "shop", "d30", "d7", "d1", "d0") == [
        ("a", None, None, 6.0, 4.0),
        ("b", 2.0, None, None, None),
    ]


def test_price_matrix_keeps_the_cheapest_shops_of_the_latest_day_with_prices(spark):
    # K8. Article 2 has no price on the day itself, so the day before decides.
    rows = [(D0, 1, f"s{i:02d}", float(i)) for i in range(12)] + [(back(1), 1, "s11", 0.5)]
    rows += [(back(1), 2, f"s{i:02d}", float(20 - i)) for i in range(12)]
    found = matrices.price_matrix(offers(spark, rows))
    assert tuples(found.filter("article = 1"), "shop") == [(f"s{i:02d}",) for i in range(10)]
    assert tuples(found.filter("article = 2"), "shop") == [(f"s{i:02d}",) for i in range(2, 12)]


def test_price_matrix_orders_chosen_days_by_date(spark):
    rows = [(back(9), 1, "a", 1.0), (back(9), 1, "b", 2.0), (back(3), 1, "a", 9.0), (back(3), 1, "b", 8.0)]
    chosen = (back(9), str(back(3)), back(4), back(5))
    found = matrices.price_matrix(offers(spark, rows), dates=chosen, n=1)
    assert tuples(found, "shop", "d0", "d1") == [("b", 2.0, 8.0)]


def changes(spark):
    rows = [
        (D0, 1, "a", 10.0),
        (back(1), 1, "a", 12.0),
        (back(7), 1, "a", 10.0),
        (back(30), 1, "a", 8.0),
        (D0, 2, "a", 5.0),
        (back(1), 2, "a", 4.0),
        (D0, 3, "a", None),
        (back(1), 3, "a", 4.0),
        (D0, 1, "b", 9.0),
        (back(1), 1, "b", 9.5),
    ]
    names = list_prices(spark, [(i, y, f"p{i}", 20.0) for i in (1, 2, 3) for y in (2023, 2024)])
    return enrich.with_list_price(offers(spark, rows), names)


def test_price_change_matrix(spark):
    found = matrices.price_change_matrix(changes(spark))
    assert tuples(found, "shop", "product", "diff_30d", "diff_7d", "diff_1d", "d0") == [
        ("a", "p1", -2.0, 0.0, 2.0, 10.0),
        ("a", "p2", None, None, -1.0, 5.0),
        ("a", "p3", None, None, None, None),
        ("b", "p1", None, None, 0.5, 9.0),
    ]


def test_price_change_counts_name_by_meaning(spark):
    # K6 (names), K7 (strict).
    counts = {r.shop: r.asDict() for r in matrices.price_change_counts(changes(spark)).collect()}
    assert (counts["a"]["n_drops_1d"], counts["a"]["n_rises_1d"]) == (1, 1)
    assert (counts["a"]["n_drops_7d"], counts["a"]["n_rises_7d"]) == (0, 0)
    assert (counts["a"]["n_drops_30d"], counts["a"]["n_rises_30d"]) == (0, 1)
    assert counts["b"]["n_drops_1d"] == 1
    strict = {r.shop: r.n_drops_1d for r in matrices.price_change_counts(changes(spark), strict=True).collect()}
    assert strict == {"a": 1, "b": 0}


def test_drops_rises_and_unchanged_add_up(spark, sf_dir):
    bed = Testbed(spark, sf_dir)
    listed = enrich.with_list_price(slicing.market_slice(bed.all_offers, "de"), bed.list_prices)
    matrix = matrices.price_change_matrix(listed)
    both = {r.shop: r.n for r in matrix.groupBy("shop").agg(F.count("diff_7d").alias("n")).collect()}
    same = {r.shop: r.n for r in matrix.groupBy("shop").agg(F.count_if(F.col("diff_7d") == 0).alias("n")).collect()}
    counts = matrices.price_change_counts(listed).collect()
    assert {r.shop: r.n_drops_7d + r.n_rises_7d + same[r.shop] for r in counts} == both


def test_changes_by_name_merge_articles_and_by_article_do_not(spark):
    # K26.
    df = offers(spark, [(D0, 1, "a", 3.0), (D0, 2, "a", 4.0), (back(1), 2, "a", 1.0)])
    named = df.withColumn("product", F.lit(None).cast("string"))
    assert tuples(matrices.price_change_matrix(named), "d0", "diff_1d") == [(3.0, -2.0)]
    assert tuples(matrices.price_change_matrix(named, key="article"), "article", "diff_1d") == [(1, None), (2, -3.0)]


def discounts(spark, values):
    return spark.createDataFrame([("a", float(v)) if v is not None else ("a", None) for v in values], "shop string, disc1 double")


def test_histogram_puts_the_top_edge_into_the_last_bin(spark):
    found = matrices.discount_histogram(discounts(spark, [0.0, 0.05, 0.5, 1.0, 1.0, None]))
    assert tuples(found, "bin", "count") == [(1, 2), (10, 2), (6, 1)]
    last = found.filter("bin = 10").first()
    assert (last.bin_lo, last.bin_hi) == (pytest.approx(0.9), pytest.approx(1.0))


def test_histogram_of_equal_values_has_one_bin(spark):
    assert tuples(matrices.discount_histogram(discounts(spark, [0.3, 0.3])), "bin", "bin_lo", "count") == [(1, 0.3, 2)]


def test_histogram_with_a_given_range(spark):
    found = matrices.discount_histogram(discounts(spark, [-1.0, 0.1, 0.9]), bins=2, lo=0.0, hi=1.0)
    assert tuples(found, "bin", "bin_lo", "bin_hi", "count") == [(1, 0.0, 0.5, 1), (2, 0.5, 1.0, 1)]


def test_histogram_counts_shops_apart_over_their_joint_range(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 9.0)], "shop string, disc1 double")
    assert tuples(matrices.discount_histogram(df, ["a", "b"]), "shop", "bin") == [("a", 1), ("b", 10)]


def test_discounts_of_missing_and_zero_list_prices(spark):
    # K25.
    df = offers(spark, [(D0, 1, "a", 5.0, 6.0), (D0, 2, "a", 5.0, None), (D0, 3, "a", 5.0, 6.0)])
    names = list_prices(spark, [(1, 2024, "p", 10.0), (2, 2024, "z", 0.0), (3, 2023, "old", 10.0)])
    found = measures.with_discounts(enrich.with_list_price(df, names))
    assert tuples(found, "article", "disc1", "disc2") == [(1, 0.5, 0.4), (2, None, None), (3, None, None)]
    with pytest.raises(ValueError):
        measures.discount_of("discount")
