import datetime

import pytest
from pyspark.sql import functions as F

from tagwise import model
from tagwise.operators import slicing
from tagwise.sources import encrypted, tables
from tests.frames import D0, back, offers, tuples

KEY = b"0123456789abcdef0123456789abcdef"
OTHER = b"fedcba9876543210"


@pytest.fixture(scope="module")
def keys(spark):
    return encrypted.key_table(spark, {0: KEY, 7: OTHER})


def some_offers(spark, day: datetime.date, country: str, n: int):
    return offers(spark, [(day, i, f"s{i % 3}", float(i), None) for i in range(n)], country).drop("year")


@pytest.fixture(scope="module")
def ingested(spark, keys, tmp_path_factory):
    source, out = str(tmp_path_factory.mktemp("sealed") / "offers"), str(tmp_path_factory.mktemp("plain") / "offers")
    for day, country, n in [(D0, "de", 40), (back(1), "de", 30), (D0, "fr", 20)]:
        rows = some_offers(spark, day, country, n)
        number = F.lit(7) if country == "fr" else F.col("article") % 2 * 7
        encrypted.sealed(rows, keys, number).write.mode("append").parquet(source)
    assert {r.key_no for r in spark.read.parquet(source).select("key_no").distinct().collect()} == {0, 7}
    encrypted.ingest(spark, source, keys, model.OFFERS, out)
    return out


def test_ingest_round_trip(spark, ingested):
    df = tables.read_offers(spark, ingested)
    assert df.schema.simpleString() == model.OFFERS.simpleString()
    assert tuples(df.groupBy("country", "date").count(), "country", "date", "count") == [
        ("de", back(1), 30),
        ("de", D0, 40),
        ("fr", D0, 20),
    ]
    assert df.filter("country = 'fr' and article = 7").first().price == 7.0


def test_layout_is_iv_then_cbc_blocks_with_pkcs_padding(spark):
    # AES-128-CBC example of NIST SP 800-38A, first block, followed by its padding block.
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    iv = bytes.fromhex("000102030405060708090a0b0c0d0e0f")
    blocks = bytes.fromhex("7649abac8119b246cee98e9b12e9197d8964e0b149c10b7b682e6e39aaeb731c")
    df = spark.createDataFrame([(bytearray(iv + blocks),)], "content binary")
    plain = df.select(F.aes_decrypt("content", F.lit(key), F.lit("CBC"), F.lit("PKCS"))).first()[0]
    assert bytes(plain).hex() == "6bc1bee22e409f96e93d7e117393172a"


def test_wrong_and_missing_keys_fail(spark, keys):
    sealed = encrypted.sealed(some_offers(spark, D0, "de", 2), keys)
    for other in ({0: KEY[::-1]}, {7: KEY}):
        with pytest.raises(Exception):
            encrypted.unsealed(sealed, encrypted.key_table(spark, other), model.OFFERS).collect()
    with pytest.raises(Exception, match="no key 3"):
        encrypted.sealed(some_offers(spark, D0, "de", 2), keys, F.lit(3)).collect()


def test_rows_of_two_keys_open_together(spark, keys, tmp_path):
    rows = some_offers(spark, D0, "de", 9)
    path = str(tmp_path / "mixed")
    encrypted.sealed(rows, keys, F.col("article") % 2 * 7).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.columns == ["key_no", "content"] and stored.groupBy("key_no").count().count() == 2
    found = encrypted.read_sealed(spark, path, keys, model.OFFERS)
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.select(model.OFFERS.names).collect()))
    alone = encrypted.unsealed(stored.filter("key_no = 7"), encrypted.key_table(spark, {7: OTHER}), model.OFFERS)
    assert tuples(alone, "article") == [(1,), (3,), (5,), (7,)]


def test_a_new_day_leaves_the_history(spark, keys, tmp_path):
    out = str(tmp_path / "plain")
    for i, (day, n) in enumerate([(back(1), 3), (D0, 5), (D0, 4)]):
        source = str(tmp_path / f"sealed{i}")
        encrypted.sealed(some_offers(spark, day, "de", n), keys).write.parquet(source)
        encrypted.ingest(spark, source, keys, model.OFFERS, out)
    counts = tables.read_offers(spark, out).groupBy("date").count()
    assert tuples(counts, "date", "count") == [(back(1), 3), (D0, 4)]


def test_market_and_date_prune_partitions(spark, ingested):
    day = slicing.on_date(slicing.market_slice(tables.read_offers(spark, ingested), "de"), D0)
    plan = day._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].splitlines()[0]
    assert "country" in filters and "date" in filters
    assert day.count() == 40


def test_latest_date_prunes_partitions_at_run_time(spark, ingested):
    day = slicing.on_date(slicing.market_slice(tables.read_offers(spark, ingested), "de"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan[plan.index("PartitionFilters") :].splitlines()[0].split("PushedFilters")[0]
    assert tuples(day.groupBy("date").count(), "date", "count") == [(D0, 40)]


def test_price_filters_and_columns_reach_the_scan(spark, ingested):
    df = tables.read_offers(spark, ingested).filter("price > 5").select("shop")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(price,5.0)" in plan
    assert "ReadSchema: struct<shop:string,price:double>" in plan


def test_readers_cast_keys_and_add_the_year(spark, tmp_path):
    spark.createDataFrame(
        [("7", "2024-01-15 10:00:00", "de", 5)], "article string, date string, country string, price int"
    ).write.parquet(str(tmp_path / "m"))
    row = tables.read_market_offers(spark, str(tmp_path / "m")).first()
    assert (row.article, row.date, row.price, row.year) == (7, D0, 5.0, 2024)
    spark.createDataFrame([(1, 2.0)], "article long, amz_price double").write.parquet(str(tmp_path / "p"))
    assert tables.read_platform_prices(spark, str(tmp_path / "p")).columns == ["article", "amz_price"]
    spark.createDataFrame([(1, "x", 2.0, 2024)], "article long, product string, price double, year long").write.parquet(
        str(tmp_path / "s")
    )
    assert tables.read_supply_prices(spark, str(tmp_path / "s")).dtypes[1] == ("year", "int")


def test_reads_of_plain_offers(spark, tmp_path):
    offers(spark, [(D0, 1, "a", 2.0)], "de").write.parquet(str(tmp_path / "o"))
    assert tables.read_offers(spark, str(tmp_path / "o")).columns == model.OFFERS.names
