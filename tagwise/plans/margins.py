"""Euro prices, margins and stock of one retailer or marketplace over its countries."""

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tagwise import model
from tagwise.functions import display, measures
from tagwise.operators.dedupe import first_per_key
from tagwise.operators.enrich import with_list_price, with_platform_price, with_supply_price, with_vat
from tagwise.operators.slicing import Dates, Day, country_index, on_date, recent, snapshots


def in_euro(offers: DataFrame, fx: DataFrame, vat: DataFrame) -> DataFrame:
    """Add ``price_eur``, ``vat`` and ``price_net``."""
    return measures.net_price(with_vat(measures.to_eur(offers, fx), vat))


def _one_offer(catalog: DataFrame) -> DataFrame:
    """The catalogue holds one offer per article, country and date; of repeated rows the cheapest priced one is kept."""
    order = [F.col("price").asc_nulls_last(), "discount", "stock"]
    return first_per_key(catalog, ["article", "date", "country"], order)


def _one_cost(supply: DataFrame) -> DataFrame:
    return first_per_key(supply, ["article", "year"], [F.col("price").asc_nulls_last(), "product"])


def country_comparison(
    catalog: DataFrame,
    supply: DataFrame,
    fx: DataFrame,
    vat: DataFrame,
    date: Day = None,
    dates: Dates | None = None,
) -> DataFrame:
    """Every article and country on the four snapshot days, with euro price, margin and discounted price.

    Repeated catalogue rows are dropped before the joins, so that the joins see one row per key.
    """
    offers = _one_offer(snapshots(catalog, date, dates).drop("label"))
    costed = with_supply_price(in_euro(offers, fx, vat), _one_cost(supply))
    return measures.with_discounted(measures.with_margin(costed, "ancor")).select(
        "article",
        "country",
        "date",
        "product",
        "stock",
        "discount",
        "price_eur",
        "price_net",
        "ancor",
        "margin",
        "price_disc",
        "price_net_disc",
        "margin_disc",
    )


def marketplace_comparison(
    market: DataFrame,
    list_prices: DataFrame,
    platform: DataFrame,
    fx: DataFrame,
    vat: DataFrame,
    date: Day = None,
    dates: Dates | None = None,
) -> DataFrame:
    """The same for the marketplace, against its platform price. Equal rows are merged, other repeats are kept."""
    offers = in_euro(snapshots(market, date, dates), fx, vat)
    costed = with_platform_price(with_list_price(offers, list_prices), platform)
    return (
        measures.with_margin(costed, "amazon")
        .select(
            "article", "country", "date", "product", "list_price", "price_eur", "price_net", "amazon", "margin"
        )
        .distinct()
    )


def latest_margins(comparison: DataFrame, day: datetime.date | str | Column, channel: str) -> DataFrame:
    """One day of a comparison with the margin in percent, its band by the channel's limits and the price as text; for
    the catalogue, which has one row per article and country, also the chart position of the country and the discount
    label.

    For the last day, take ``slicing.latest_date`` of the raw offers: that of the comparison would compute it twice.
    """
    day = on_date(comparison, day)
    columns = {
        "margin_pct": F.col("margin") * 100,
        "margin_label": display.fmt_percent("margin", comma=False),
        "band": measures.margin_band(*model.MARGIN_BANDS[channel]),
        "price_label": display.fmt_decimal("price_eur"),
    }
    if "price_disc" in comparison.columns:
        columns["country_id"] = country_index(day)
        columns["discount_label"] = display.fmt_label("discount", "price_disc")
    return day.withColumns(columns)


def stock_series(catalog: DataFrame, country: str = "de", date: Day = None) -> DataFrame:
    """``article, date, stock`` of the home country since 30 days before the report day."""
    return recent(catalog, 30, date).filter(F.col("country") == country).select("article", "date", "stock")


def country_series(
    catalog: DataFrame,
    fx: DataFrame,
    countries: tuple[str, ...] = model.CHART_COUNTRIES,
    date: Day = None,
) -> DataFrame:
    """``article, country, date, price_eur`` of the chosen countries since 30 days before the report day."""
    rows = recent(catalog, 30, date).filter(F.col("country").isin(*countries))
    return measures.to_eur(rows, fx).select("article", "country", "date", "price_eur")


def _report(costed: DataFrame, max_margin: float, country: str | None, *ties: str) -> DataFrame:
    """Rows under the threshold with their text columns; lowest margin first if cut to one country."""
    rows = costed.filter(F.col("margin") < max_margin / 100)
    if country is not None:
        rows = rows.orderBy("margin", "article", *ties)
    return rows.withColumns(
        {"article": display.fmt_article("article"), "margin_pct_text": display.fmt_percent("margin", comma=False)}
    )


def low_margin_catalog(
    catalog: DataFrame,
    supply: DataFrame,
    fx: DataFrame,
    vat: DataFrame,
    country: str | None = None,
    date: Day = None,
    max_margin: float = model.LOW_MARGIN["catalog"],
) -> DataFrame:
    """Products of the day under the margin threshold: one country's, lowest margin first, or all countries' as a table
    without an order, which saves a global sort.

    The margin is taken over the unrounded net price; products without one are left out.
    """
    day = on_date(catalog, date)
    if country is not None:
        day = day.filter(F.col("country") == country)
    offers = with_vat(measures.to_eur(_one_offer(day), fx), vat)
    costed = measures.with_margin(with_supply_price(offers, _one_cost(supply)), "ancor", rounded_net=False)
    return _report(costed, max_margin, country).select(
        "country", "article", "price", "discount", "stock", "product", "margin_pct_text"
    )


def low_margin_market(
    market: DataFrame,
    list_prices: DataFrame,
    platform: DataFrame,
    fx: DataFrame,
    vat: DataFrame,
    country: str | None = None,
    date: Day = None,
    max_margin: float = model.LOW_MARGIN["marketplace"],
    decimal_comma: bool = False,
) -> DataFrame:
    """The marketplace form of the report; repeated offers stay."""
    day = on_date(market, date)
    if country is not None:
        day = day.filter(F.col("country") == country)
    named = with_list_price(with_vat(measures.to_eur(day, fx), vat), list_prices)
    costed = measures.with_margin(with_platform_price(named, platform), "amazon", rounded_net=False)
    return _report(costed, max_margin, country, "price", "product").select(
        "country",
        "article",
        "price",
        "product",
        "amazon",
        display.fmt_decimal("price_eur", 1, decimal_comma).alias("price_eur"),
        "margin_pct_text",
    )


def low_margin_counts(report: DataFrame, offers: DataFrame, max_margin: float, date: Day = None) -> DataFrame:
    """``country, date, max_margin, n_products`` of a low-margin report: its products per country that has ``offers`` on
    the day, also where there are none.
    """
    day = on_date(offers, date).groupBy("country").agg(F.first("date").alias("date"))
    found = report.groupBy("country").agg(F.count("*").alias("n_products"))
    return day.join(found, "country", "left").select(
        "country",
        "date",
        F.lit(float(max_margin)).alias("max_margin"),
        F.coalesce("n_products", F.lit(0)).alias("n_products"),
    )
