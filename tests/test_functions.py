import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, numbers, text, urls
from tessera.operators import listing


@pytest.fixture(scope="module")
def value(spark):
    def of(expression, **columns):
        row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items())) if columns else spark.range(1)
        return row.select(expression.alias("x")).first()[0]

    return of


@pytest.mark.parametrize(
    ("raw", "want"),
    [('["Climate","climate"," Risk "]', ["Climate", "Risk"]), ("{carbon;Water,carbon}", ["carbon", "Water"]), ('"a", b', ["a", "b"]), ("", []), ("[]", [])],
)
def test_keyword_list(value, raw, want):
    assert value(text.keyword_list(F.col("t")), t=raw) == want


def test_text(value):
    t = F.col("t")
    assert value(text.word_count(t), t="  a  b\nc ") == 3 and value(text.word_count(F.lit(None).cast("string"))) == 0
    assert value(text.has_phrase(t, F.lit("oil & gas")), t="The Oil and Gas sector") is True
    assert value(text.has_phrase(t, F.lit("gas")), t="gasoline") is False
    assert value(text.has_sequence(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bc")))) is True
    assert value(text.without_controls(t), t="a\x00b\tc\x07") == "ab\tc"
    assert value(text.fewer_newlines(t), t="a\n\n\n\nb") == "a\n\nb"
    assert value(text.escape_html(t), t="<a href='x'>&</a>") == "&lt;a href=&#39;x&#39;&gt;&amp;&lt;/a&gt;"
    assert value(text.slug(t), t=" Hello, World! ") == "hello-world"
    assert value(text.sheet_name(t), t="a/b:c" + "x" * 40) == "a b c" + "x" * 26
    assert value(text.colour_index(t), t="ab") == (97 * 31 + 98) % 8
    assert value(text.needs_translation(t), t="Привет это длинный русский текст") is True
    assert value(text.needs_translation(t), t="English text") is False
    assert value(text.key_label(t), t="buyerName_TOTAL_id") == "BuyerName total ID"
    assert value(text.key_label(t), t="title-of_ru") == "Title of (RU)" and value(text.key_label(t), t="_ru") == "RU" and value(text.key_label(t), t="") == ""
    assert value(text.display_name(F.lit(" "), F.lit(None), F.lit("ann@x.org"))) == "ann"
    assert value(text.display_name(F.lit(None), F.lit(None), F.lit(None))) == "User"
    assert value(text.unique_strings(F.array(*map(F.lit, [" a", "b", "a", ""])))) == ["a", "b"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://WWW.Example.com/Path/?utm_source=x&b=1#top", "https://example.com/Path/?b=1"),
        ("http://a.org/", "http://a.org"), ("ftp://a.org/x", None), ("https://user:pw@a.org/x", None), ("not a url", None),
    ],
)
def test_approval_form(value, raw, want):
    assert value(urls.approval_form(F.col("u")), u=raw) == want


def test_urls(value):
    u = F.col("u")
    assert value(urls.dedup_key(u), u="https://A.org/x?utm_source=1&b=2#f") == "https://a.org/x?b=2"
    assert value(urls.https_links(u), u="see https://a.org/(x), https://b.org; end") == ["https://a.org/(x)", "https://b.org"]
    assert value(urls.without_double(u), u="https://a.org/events/events/5") == "https://a.org/events/5"


def test_ranges():
    sunday, saturday = dt.date(2024, 3, 10), dt.date(2024, 3, 9)
    assert dates.named_range("this-week", sunday) == (sunday, sunday + dt.timedelta(7))
    assert dates.named_range("this-week", saturday) == (saturday, saturday + dt.timedelta(1))
    assert dates.named_range("this-month", dt.date(2024, 2, 5))[1] == dt.date(2024, 2, 29)
    with pytest.raises(ValueError):
        dates.named_range("some day", sunday)


def test_dates(value):
    now = F.expr("timestamp_ntz '2024-03-10 06:00:00'")
    at = lambda s: F.expr(f"timestamp_ntz '{s}'")
    assert value(dates.event_status(at("2024-03-11 05:00:00"), F.lit(None), now)) == "Tomorrow"
    assert value(dates.event_status(at("2024-03-10 05:00:00"), at("2024-03-10 09:00:00"), now)) == "Live"
    assert value(dates.event_status(at("2024-03-14 05:00:00"), F.lit(None), now)) == "In 4 days"
    assert value(dates.deadline_bucket(at("2024-03-10 10:00:00"), now)) == "Today"
    assert value(dates.deadline_bucket(at("2024-03-11 03:00:00"), now)) == "21h left"
    assert value(dates.time_ago(at("2024-03-10 04:00:00"), now)) == "2h ago"
    assert value(dates.iso_date(F.lit("2024"), now)) is None and value(dates.iso_date(F.lit("2024-03-20"), now)) is None
    assert value(dates.iso_date(F.lit("2024-03-09"), now)) == dt.date(2024, 3, 9)
    assert value(dates.range_text(at("2024-03-05 00:00:00"), at("2024-03-07 00:00:00"))) == "5 - 7 Mar 2024"
    assert value(dates.latest_year(F.lit("in 1985, 2019 and 2050, page 12019"), 2024)) == 2019
    assert value(dates.seconds_to_midnight(now)) == 64800
    assert value(dates.previous_week(now)[0]) == dt.date(2024, 2, 26)


def test_numbers(value):
    assert value(numbers.amount(F.lit("$1,234.50"))) == 1234.5
    assert value(numbers.amount_with_comma(F.lit("1234,50"))) == 1234.5
    assert [value(numbers.backoff(F.lit(n))) for n in (1, 2, 9)] == [5, 10, 300]
    assert [value(numbers.poll_delay(F.lit(n))) for n in (0, 2, 9)] == [1800, 7200, 10000]
    assert [value(numbers.confidence(F.lit(x).cast("double"))) for x in (0.85, 85.4, 1.0, 250.0, -3.0, float("nan"), None)] == [85, 85, 100, 100, 0, 0, 0]
    assert value(numbers.in_dollars(F.lit(470.17), F.lit("KZT"))) == 1.0 and value(numbers.in_dollars(F.lit(-1.0), F.lit("USD"))) is None
    assert value(numbers.currency(F.lit("100 тенге"))) == "KZT" and value(numbers.currency(F.lit("100"))) == "USD"


def test_pages_and_cursors():
    assert listing.page_facts(0, 1, 10) == {"pages": 1, "start": 0, "end": 0}
    assert listing.page_facts(25, 3, 10) == {"pages": 3, "start": 21, "end": 25}
    assert listing.clamp_page("x", "900") == (1, 100) and listing.clamp_page("-3", "0") == (1, 1)
    at = (dt.datetime(2024, 1, 2, 3), 77)
    assert listing.read_cursor(listing.cursor_of(*at)) == at and listing.read_cursor(None) is None
    for bad in ("x" * 600, "!!!", "e30"):
        with pytest.raises(ValueError):
            listing.read_cursor(bad)
