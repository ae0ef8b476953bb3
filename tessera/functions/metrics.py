"""Quantities in claims and evidence: extraction, one form for equal ones, grounding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names. Fixed values.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Ways to write a currency and a scale. Fixed values.
CURRENCY = {"us$": "usd", "usd": "usd", "$": "usd", "€": "eur", "eur": "eur", "£": "gbp", "gbp": "gbp", "aed": "aed", "sar": "sar", "kzt": "kzt"}
SCALE = {"bn": "billion", "billion": "billion", "mn": "million", "mln": "million", "million": "million", "trillion": "trillion", "thousand": "thousand"}

_MONTH = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_TOKEN = re.compile(
    rf"""
    (?P<iso>\b\d{{4}}-\d{{2}}-\d{{2}}\b)
    | (?P<day>\b\d{{1,2}})\s+(?P<month>{_MONTH})\.?,?\s+(?P<year>\d{{4}})\b
    | \b(?P<month2>{_MONTH})\.?\s+(?P<day2>\d{{1,2}}),?\s+(?P<year2>\d{{4}})\b
    | (?:\bfy\s?)?(?<!\d)(?P<from>(?:19|20)\d\d)\s?(?P<dash>[-/–—])\s?(?P<to>(?:(?:19|20)\d\d|\d\d))(?![\d-])
    | (?P<money>us\$|usd|eur|gbp|aed|sar|kzt|[$€£])\s?(?P<sum>{_NUMBER})(?:\s?(?P<scale>{"|".join(SCALE)})\b)?
    | (?P<percent>{_NUMBER})\s?(?:%|percent\b|per\s+cent\b)
    | (?P<ratio>\b\d+\s?:\s?\d+\b)
    | (?P<scaled>{_NUMBER})\s?(?P<unit>{"|".join(SCALE)}|gw|mw|kwh|mt|kt|tco2e|tonnes|km|basis\s+points|bps)\b
    | (?P<number>(?<![\w.]){_NUMBER}(?![\w]))
    """,
    re.VERBOSE | re.IGNORECASE,
)


_DIGIT = re.compile(r"\d")
#: Letters before a quantity's first digit at most (september), then a full stop and blanks.
_BEFORE = 9


def _quantities(text: str) -> Iterator[re.Match]:
    """The matches of _TOKEN in order; as each has a digit, only places that lead up to one are tried."""
    at = 0
    while digit := _DIGIT.search(text, at):
        first = start = digit.start()
        while start > at and text[start - 1].isspace():
            start -= 1
        start = max(at, start - _BEFORE - 1)
        m = next((m for k in range(start, first + 1) if (m := _TOKEN.match(text, k))), None)
        if m:
            yield m
        at = m.end() if m else first + 1


def _plain(number: str) -> str:
    number = number.replace(",", "")
    return number.rstrip("0").rstrip(".") if "." in number else number


def metric_tokens(text: str | None) -> list[str]:
    """Each quantity once, in one form: 2026-07-13, usd 50 million, 50%, 2028, 4:1, 3 gw.

    A range of years is its two years, also if the second has two digits (1999-00 reaches 2000);
    a hyphen before a month's number is a month of a year.
    """
    out: dict[str, None] = {}
    for m in _quantities(unicodedata.normalize("NFKC", text or "")):
        g = m.groupdict()
        if g["iso"]:
            found = [g["iso"]]
        elif g["month"] or g["month2"]:
            month = next(i for i, name in enumerate(MONTHS, 1) if name.startswith((g["month"] or g["month2"]).lower()[:3]))
            found = [f"{g['year'] or g['year2']}-{month:02d}-{int(g['day'] or g['day2']):02d}"]
        elif g["from"]:
            first, last = int(g["from"]), g["to"]
            if len(last) == 2 and g["dash"] == "-" and 1 <= int(last) <= 12:
                found = [f"{first}-{last}"]
            else:
                end = int(last) if len(last) == 4 else first - first % 100 + int(last)
                found = [str(first), str(end if end >= first else end + 100)]
        elif g["money"]:
            scale = f" {SCALE[g['scale'].lower()]}" if g["scale"] else ""
            found = [f"{CURRENCY[g['money'].lower()]} {_plain(g['sum'])}{scale}"]
        elif g["percent"]:
            found = [f"{_plain(g['percent'])}%"]
        elif g["ratio"]:
            found = [re.sub(r"\s", "", g["ratio"])]
        elif g["scaled"]:
            unit = " ".join(g["unit"].lower().split())
            found = [f"{_plain(g['scaled'])} {SCALE.get(unit, unit)}"]
        else:
            found = [_plain(g["number"])]
        out.update(dict.fromkeys(found))
    return list(out)


@lru_cache(maxsize=1)
def _tokens_udf():
    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(metric_tokens)

    return tokens


def metrics(text: Column) -> Column:
    """metric_tokens of a column, in Arrow batches; none for null."""
    return _tokens_udf()(F.coalesce(text, F.lit("")))


def grounding(claimed: Column, known: Column) -> Column:
    """struct(supported, unsupported): the claimed quantities that the evidence does not have."""
    missing = F.array_except(claimed, known)
    return F.struct((F.size(missing) == 0).alias("supported"), missing.alias("unsupported"))


def years_attributed(clauses: Column) -> Column:
    """The quantities (other than years) that stand in no clause (array of token arrays) with a year."""
    is_year = lambda t: t.rlike(r"^(19|20)\d\d(-\d\d)*$")
    dated = F.flatten(F.filter(clauses, lambda c: F.exists(c, is_year)))
    return F.array_except(F.filter(F.flatten(clauses), lambda t: ~is_year(t)), dated)
