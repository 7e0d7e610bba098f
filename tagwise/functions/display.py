"""Text columns for tables and chart labels, all from Spark's own string functions."""

from pyspark.sql import Column, functions as F

from tagwise.functions.measures import round_even


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_even(value, digits))


def fmt_article(article: str) -> Column:
    return F.col(article).cast("string")


def fmt_price(price: str) -> Column:
    """Decimal comma, at most ten decimals and at least one, no exponent, no thousands separator."""
    digits = F.rtrim(F.format_string("%.10f", F.col(price)), F.lit("0"))
    whole = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.col(price).isNotNull(), F.translate(whole, ".", ","))


def fmt_percent(share: str, comma: bool = True) -> Column:
    """One decimal. With ``comma`` a null reads ``0,0%``; without, it stays null."""
    if comma:
        return F.concat(F.translate(_fixed(F.coalesce(F.col(share) * 100, F.lit(0.0)), 1), ".", ","), F.lit("%"))
    return F.when(F.col(share).isNotNull(), F.concat(_fixed(F.col(share) * 100, 1), F.lit("%")))


def fmt_label(discount: str, price: str) -> Column:
    """Whole-percent discount and price with one decimal, as in ``10% || 12.3 €``; null if either is null."""
    return F.when(
        F.col(discount).isNotNull() & F.col(price).isNotNull(),
        F.concat(_fixed(F.col(discount), 0), F.lit("% || "), _fixed(F.col(price), 1), F.lit(" €")),
    )


def fmt_decimal(value: str, digits: int = 1, decimal_comma: bool = False) -> Column:
    """The rounded number as text, with all its decimals and without an exponent; null stays null."""
    text = F.when(F.col(value).isNotNull(), _fixed(F.col(value), digits))
    return F.translate(text, ".", ",") if decimal_comma else text


def fmt_date(date: str | Column, short: bool = False) -> Column:
    """``dd.MM.yyyy``, or day and month name."""
    return F.date_format(date, "dd MMM" if short else "dd.MM.yyyy")
