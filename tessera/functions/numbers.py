"""Amounts, costs, delays and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: US dollars to one unit's worth of a currency. Fixed values.
PER_DOLLAR = {"USD": 1.0, "KZT": 470.17, "UZS": 11970.68}
#: Dollars for a million tokens read and written. Fixed values.
READ_PRICE, WRITE_PRICE = 0.15, 0.60


def amount(text: Column) -> Column:
    """Commas group thousands: ``1,234.5`` is 1234.5."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def amount_with_comma(text: Column) -> Column:
    """The first comma is the decimal mark: ``1234,5`` is 1234.5."""
    pointed = F.regexp_replace(F.regexp_replace(text, r"[^0-9.,\-]", ""), r"^([^,]*),", "$1.")
    return F.regexp_replace(pointed, ",", "").try_cast("double")


def currency(text: Column) -> Column:
    """By sign or name, first rule first; USD if none holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.rlike("usd|us\\$|\\$|dollar"), "USD")
        .when(low.rlike("eur|€|euro"), "EUR")
        .when(low.rlike("kzt|₸|tenge|тенге"), "KZT")
        .when(low.rlike("uzs|sum|сум"), "UZS")
        .when(low.rlike("rub|₽|руб"), "RUB")
        .otherwise("USD")
    )


def in_dollars(value: Column, code: Column) -> Column:
    """By the fixed rates, to cents; null for a negative amount or another currency."""
    out = F.lit(None).cast("double")
    for name, rate in PER_DOLLAR.items():
        out = F.when(code == name, F.round(value / F.lit(rate), 2)).otherwise(out)
    return F.when(value >= 0, out)


def token_cost(read: Column, written: Column) -> Column:
    return read / F.lit(1e6) * F.lit(READ_PRICE) + written / F.lit(1e6) * F.lit(WRITE_PRICE)


def backoff(attempt: Column, base: int = 5, most: int = 300) -> Column:
    """min(most, base * 2 ** (attempt - 1)) seconds."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))


def poll_delay(failures: Column) -> Column:
    """min(10000, 1800 * 2 ** min(failures, 3)) milliseconds."""
    return F.least(F.lit(10000.0), F.lit(1800.0) * F.pow(F.lit(2.0), F.least(failures, F.lit(3))))


def confidence(value: Column) -> Column:
    """Shares in (0, 1] as percent, then rounded and kept within 0 and 100; null and NaN are 0."""
    scaled = F.when((value > 0) & (value <= 1), value * 100).otherwise(value)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.nanvl(F.coalesce(scaled, F.lit(0.0)), F.lit(0.0))))).cast("int")


def ratio(a: Column, b: Column, digits: int = 2) -> Column:
    """a / b to some digits, 0 where b is 0."""
    return F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))
