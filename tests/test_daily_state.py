"""Reports from the daily state against those over all offers, and what is read for them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tagwise.operators import ranking, series, slicing
from tagwise.plans import daily, development
from tagwise.sources import day_state, metadata, tables
from tests.frames import D0, back, offers, tuples

SHOPS = ["a", "b", "c", None, "d"]


def some_day(spark, day, seed, n=120):
    """Offers of three markets with ties, repeats, missing prices, shops and articles; all prices are exact in binary."""
    rng = random.Random(f"{day} {seed}")
    rows = [
        (day, rng.choice([1, 2, 3, None]), rng.choice(SHOPS), rng.choice([None, 2.5, 3.0, 3.25, 4.0, 9.5]), rng.choice([None, 5.0, 5.5]))
        for _ in range(n)
    ]
    parts = [offers(spark, rows[i::3], country) for i, country in enumerate(("de", "fr", "uk"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """A table of offers and its state after days were added, repeated with other rows, and delivered late."""
    folder = tmp_path_factory.mktemp("days")
    path, state = str(folder / "offers"), str(folder / "state")

    def deliver(days, seed):
        for day in days:
            rows = some_day(spark, day, seed).drop("year")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country", "date").parquet(path)

    deliver([back(40), back(3), back(2)], 1)
    assert day_state.pending_days(spark, path, state) == [back(40), back(3), back(2)]
    day_state.refresh_days(spark, path, state, day_state.pending_days(spark, path, state))
    deliver([back(1), D0], 1)
    day_state.refresh_days(spark, path, state, day_state.pending_days(spark, path, state))
    deliver([back(2)], 2)
    day_state.refresh_days(spark, path, state, [back(2)])
    deliver([back(7)], 1)
    assert day_state.pending_days(spark, path, state) == [back(7)]
    day_state.refresh_days(spark, path, state, [back(7)])
    assert day_state.pending_days(spark, path, state) == []
    return path, state


def rows_of(df):
    return df.columns, sorted(map(str, df.collect()))


@pytest.mark.parametrize("measure", day_state.MEASURES)
@pytest.mark.parametrize("country", [None, "fr"])
def test_reports_equal_those_over_all_offers(spark, history, measure, country):
    path, stored = history
    every = tables.read_offers(spark, path)
    full = every if country is None else every.filter(F.col("country") == country).drop("country")
    state = day_state.read_state(spark, stored, measure, country=country)
    for skip in (False, True):
        assert rows_of(daily.daily_min(state, skip)) == rows_of(series.daily_min(full, measure, skip))
        for days, depth in ((10, 3), (2, 1), (100, 40)):
            found = daily.leaders(state, days, depth, skip_unpriced=skip)
            assert rows_of(found) == rows_of(ranking.leaders(full, measure, days, depth, skip_unpriced=skip))
    assert rows_of(daily.daily_mean(state)) == rows_of(series.daily_mean(full, measure))
    assert rows_of(daily.default_shops(state, ("d", "b"))) == rows_of(slicing.default_shops(full, ("d", "b")))
    for shops in (None, ["a", "c"]):
        found = daily.price_development(state, shops, ("d", "b"))
        assert rows_of(found) == rows_of(development.price_development(full, shops, measure, ("d", "b")))
    if country is None:
        assert rows_of(daily.freshness(state, "de")) == rows_of(series.freshness(full, "de"))


def test_state_equals_a_full_recomputation(spark, history):
    path, stored = history
    again = day_state.day_state(tables.read_offers(spark, path))
    columns = sorted(again.columns)
    assert rows_of(spark.read.parquet(stored).select(columns)) == rows_of(again.select(columns))


def scan_metric(df, name):
    """Sum of a metric over the scans of a plan that has run, also those behind the stages of adaptive execution."""

    def total(plan):
        kind = plan.getClass().getSimpleName()
        if kind.startswith("AdaptiveSparkPlan"):
            return total(plan.executedPlan())
        if "QueryStage" in kind:
            return total(plan.plan())
        leaves = plan.collectLeaves()
        inner = [leaves.apply(i) for i in range(leaves.length())]
        if len(inner) == 1 and "Scan" in inner[0].getClass().getSimpleName():
            metric = inner[0].metrics().get(name)
            return metric.get().value() if metric.isDefined() else 0
        return sum(total(x) for x in inner if not x.equals(plan))

    return total(df._jdf.queryExecution().executedPlan())


def test_a_refresh_reads_its_days_only(spark, history):
    path, _ = history
    delivered = tables.read_offers(spark, path).filter(F.col("date").isin([back(1), D0]))
    found = day_state.day_state(delivered)
    found.collect()
    assert scan_metric(found, "numPartitions") == 2 * 3  # of two days, each in three markets


def test_a_refresh_leaves_other_days_alone(spark, history, tmp_path):
    path, _ = history
    state = str(tmp_path / "state")
    day_state.refresh_days(spark, path, state, [back(1), D0])
    files = {f for f in spark.read.parquet(state).inputFiles() if str(D0) in f}
    day_state.refresh_days(spark, path, state, [back(1)])
    assert files == {f for f in spark.read.parquet(state).inputFiles() if str(D0) in f}
    day_state.refresh_days(spark, path, state, [])
    assert metadata.dates(spark, state) == [back(1), D0]


def test_a_report_reads_the_days_and_the_measure_it_needs(spark, history):
    _, stored = history
    last = metadata.last_date(spark, stored)
    state = day_state.read_state(spark, stored, "price", since=last - datetime.timedelta(days=10))
    found = daily.leaders(state, date=last)
    found.collect()
    assert scan_metric(found, "numPartitions") == 5
    assert "EqualTo(measure,price)" in found._jdf.queryExecution().executedPlan().toString()


def test_last_date_of_partitions_and_of_footers(spark, history, tmp_path):
    path, _ = history
    before = {k: spark.conf.get(k, None) for k in (*metadata.FROM_FOLDERS, *metadata.FROM_FOOTERS)}
    assert metadata.last_date(spark, path) == metadata.last_date(spark, path, country="uk") == D0
    assert metadata.last_date(spark, path, country="xx") is None
    plain = str(tmp_path / "plain")
    some_day(spark, back(5), 1).unionByName(some_day(spark, back(9), 1)).write.parquet(plain)
    assert metadata.last_date(spark, plain, partitioned=False) == back(5)
    with pytest.raises(ValueError):
        metadata.last_date(spark, plain, country="de", partitioned=False)
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_last_date_reads_no_rows(spark, history, tmp_path):
    path, _ = history
    with metadata.settings(spark, metadata.FROM_FOLDERS):
        df = spark.read.parquet(path).filter("country = 'de'").agg(F.max("date"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "FileScan" not in plan
    plain = str(tmp_path / "plain")
    some_day(spark, D0, 1, n=3000).repartition(3).write.parquet(plain)
    with metadata.settings(spark, metadata.FROM_FOOTERS):
        df = spark.read.parquet(plain).agg(F.max("date"))
        assert df.first()[0] == D0
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [MAX(date)]" in plan
        df.collect()
        assert scan_metric(df, "numOutputRows") == 3  # one per file


def test_reports_take_the_day(spark, history):
    path, _ = history
    full = tables.read_offers(spark, path)
    day = metadata.last_date(spark, path)
    assert rows_of(slicing.on_date(full, day)) == rows_of(slicing.on_date(full))
    assert tuples(ranking.leaders(full, date=day), "country", "shop", "count") == tuples(ranking.leaders(full), "country", "shop", "count")
