"""Shapes of the physical plans, and behaviour under one crowded key."""

import re

import pytest
from pyspark.sql import Window, functions as F

import __spark_entry__ as registry
from tagwise import model
from tagwise.functions import measures
from tagwise.operators import dedupe, enrich, ranking, slicing
from tagwise.plans import headroom, shops
from tagwise.sources.dimensions import fx_table, vat_table
from tagwise.testbed import Testbed
from tests.frames import D0, list_prices, offers, tuples

PYTHON_NODES = r"ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroups|PythonUDF"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan after adaptive execution, without the initial one."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", registry._QUERIES)
def test_no_cross_join_and_no_python(name, spark, sf_dir):
    plan = physical(registry.queries()[name](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(PYTHON_NODES, plan)
    # A window without keys would gather all rows in one task.
    assert "windowspecdefinition(specifiedwindowframe" not in plan


@pytest.mark.parametrize(
    "name",
    ["leaders_price", "leaders_delivery", "top_discounts", "price_matrix", "first_per_key", "rank_counts", "min_price_gaps"],
)
def test_top_k_is_cut_before_the_shuffle(name, spark, sf_dir):
    plan = physical(registry.queries()[name](spark, sf_dir))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_rate_tables_are_broadcast_by_their_known_size(spark, sf_dir):
    bed = Testbed(spark, sf_dir)
    lines = bed.catalog_offers
    df = enrich.with_vat(measures.to_eur(lines, fx_table(spark, "catalog")), vat_table(spark, "catalog"))
    assert physical(df).count("BroadcastHashJoin [country") == 2


def test_reports_read_only_the_columns_they_need(spark, sf_dir):
    plan = physical(ranking.leaders(slicing.market_slice(Testbed(spark, sf_dir).all_offers, "de")))
    line_scans = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_" in s]
    assert line_scans and not any("l_tax" in s or "l_discount" in s or "l_quantity" in s for s in line_scans)


@pytest.fixture
def skew_conf(spark):
    """Sort-merge joins only, and skew limits small enough for test data."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def crowded(spark, n=60_000):
    """Half of all offers are of one article on one day, and most of those at one price."""
    i = F.col("id")
    hot = i < n // 2
    return spark.range(0, n, 1, 16).select(
        F.lit(D0).alias("date"),
        F.when(hot, 0).otherwise(i % 500 + 1).cast("int").alias("article"),
        F.concat(F.lit("shop_"), (i % 997).cast("string")).alias("shop"),
        F.when(hot & (i % 10 > 0), 50.0).otherwise((i * 7919 % 90).cast("double") + 10).alias("price"),
        (F.rand(7) * 100).alias("price_delivery"),
        F.lit(2024).alias("year"),
    )


def test_crowded_price_is_split_in_the_rank_join(spark, skew_conf):
    df = crowded(spark)
    ranked = ranking.price_rank(df)
    assert "skew=true" in final_plan(ranked)
    by_price = Window.partitionBy("date", "article").orderBy("price")
    wrong = ranked.join(
        df.withColumn("expected", F.rank().over(by_price)).select("article", "shop", "price", "expected").distinct(),
        ["article", "shop", "price"],
    ).filter("rank != expected")
    assert ranked.count() == df.count()
    assert wrong.count() == 0


def test_rank_has_one_plan_without_hints(spark, sf_dir):
    plan = physical(registry.queries()["price_rank"](spark, sf_dir))
    assert "Union" not in plan
    assert plan.split("== Initial Plan ==")[0].count("Window [") <= 1


def test_latest_margins_take_the_day_from_the_raw_table(spark, sf_dir):
    # the catalogue's windows are the choice among repeated rows and the position of the country
    for name, windows in (("latest_margins", 2), ("latest_margins_market", 0)):
        plan = final_plan(registry.queries()[name](spark, sf_dir))
        assert len(re.findall(r"Window \[", plan)) == windows
        assert len(set(re.findall(r"Subquery subquery#\d+", plan))) == 1


def test_crowded_article_is_split_in_the_list_price_join(spark, skew_conf):
    names = list_prices(spark, [(i, 2024, f"p{i}", 100.0) for i in range(501)])
    joined = enrich.with_list_price(crowded(spark), names)
    assert "skew=true" in final_plan(joined)
    assert joined.filter("list_price is null").count() == 0


def test_crowded_key_keeps_one_row(spark):
    df = crowded(spark)
    found = dedupe.first_per_key(df, ["date", "article"], ["price", "shop", "price_delivery"])
    assert found.count() == 501
    assert tuples(found.filter("article = 0"), "price") == [(df.filter("article = 0").agg(F.min("price")).first()[0],)]


def test_levels_window_sees_distinct_prices_only(spark):
    df = crowded(spark)
    levels = ranking.price_levels(df.filter("article = 0"))
    assert levels.count() == df.filter("article = 0").select("price").distinct().count() <= 90
    assert levels.agg(F.sum("n")).first()[0] == df.filter("article = 0").count()


def test_gaps_of_a_crowded_article(spark):
    # 30,000 offers of one article tie for second place behind one shop.
    tied = spark.range(30_000).selectExpr(
        f"date'{D0}' as date", "1 as article", "concat('s', id) as shop", "90D as price", "90D as price_delivery", "2024 as year"
    )
    df = tied.unionByName(offers(spark, [(D0, 1, "lead", 50.0, 50.0)]).select(*tied.columns))
    found = headroom.min_price_gaps(df, list_prices(spark, [(1, 2024, "p", 1.0)]))
    assert found.count() == 30_000
    assert tuples(found.select("base_shop", "diff").distinct(), "base_shop", "diff") == [("lead", 40.0)]


def test_gaps_of_a_crowded_article_are_joined_in_parts(spark, skew_conf):
    tied = spark.range(0, 60_000, 1, 16).selectExpr(
        f"date'{D0}' as date", "cast(if(id < 30000, 1, id) as int) as article", "concat('s', id) as shop",
        "90D as price", "90D as price_delivery", "2024 as year",
    )
    lead = spark.range(1).selectExpr(
        f"date'{D0}' as date", "1 as article", "'lead' as shop", "50D as price", "50D as price_delivery", "2024 as year"
    )
    found = headroom.min_price_gaps(tied.unionByName(lead), list_prices(spark, [(1, 2024, "p", 1.0)]))
    assert "skew=true" in final_plan(found)
    assert found.count() == 30_000


def test_shop_report_frames(spark, sf_dir):
    bed = Testbed(spark, sf_dir)
    german = slicing.market_slice(bed.all_offers, "de")
    report = shops.shop_report(german, bed.list_prices, ["shop_1", "shop_2"])
    assert set(report) == {"rank_counts", "rank_lists", "histogram", "change_counts"}
    for frame in report.values():
        assert {r.shop for r in frame.select("shop").distinct().collect()} == {"shop_1", "shop_2"}
    counts = registry.queries()["price_change_counts"](spark, sf_dir).filter("shop in ('shop_1', 'shop_2')")
    columns = sorted(counts.columns)
    assert tuples(report["change_counts"], *columns) == tuples(counts, *columns)
    ranks = registry.queries()["rank_counts"](spark, sf_dir).filter("shop in ('shop_1', 'shop_2')")
    assert tuples(report["rank_counts"], "shop", "rank", "count") == tuples(ranks, "shop", "rank", "count")


def test_testbed_tables_have_the_declared_schemas(spark, sf_dir):
    bed = Testbed(spark, sf_dir)
    for frame, schema in (
        (bed.all_offers, model.OFFERS),
        (bed.list_prices, model.LIST_PRICES),
        (bed.supply_prices, model.SUPPLY_PRICES),
        (bed.platform_prices, model.PLATFORM_PRICES),
        (bed.catalog_offers.drop("year"), model.CATALOG_OFFERS),
        (bed.market_offers.drop("year"), model.MARKET_OFFERS),
    ):
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in schema]


@pytest.mark.parametrize("name", ["discount_histogram", "discount_histogram_all"])
def test_histogram_counts_once(name, spark, sf_dir):
    plan = final_plan(registry.queries()[name](spark, sf_dir))
    assert re.search(r"ReusedExchange \[(country#\d+, )?shop", plan)  # the counts of the range are those of the bins
