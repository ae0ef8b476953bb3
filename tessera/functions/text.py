"""Text expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(columns: Sequence[Column], term: str) -> Column:
    """Case-insensitive search for ``term`` in any column; null columns hold nothing."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit("")).ilike(f"%{term}%") for c in columns))


def any_keyword(text: Column, keywords: Column) -> Column:
    """Whether the lower-case text holds one of the keywords (array), in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(keywords, lambda k: low.contains(F.lower(k)))


def tokens(text: Column, most: int | None = None) -> Column:
    """Runs of a-z and 0-9 in lower case, the first ``most`` of them."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))
    return F.slice(found, 1, most) if most else found


def has_sequence(haystack: Column, needle: Column) -> Column:
    """Whether the token array ``needle`` stands in ``haystack`` without a gap."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return pad(haystack).contains(pad(needle))


def phrase_form(text: Column) -> Column:
    """Lower case, ``&`` as and, other characters as single spaces, padded."""
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def has_phrase(text: Column, phrase: Column) -> Column:
    return phrase_form(text).contains(phrase_form(phrase))


@lru_cache(maxsize=1)
def _decomposed_udf():
    @F.pandas_udf("string")
    def decomposed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))

    return decomposed


def words_form(text: Column) -> Column:
    """Runs of a-z and 0-9 of the compatibility decomposition in lower case, one space between; marks part words."""
    return F.trim(F.regexp_replace(F.lower(_decomposed_udf()(text)), "[^a-z0-9]+", " "))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def is_scanned(text: Column, fewest: int = 20) -> Column:
    """A page with fewer words than that needs recognition of its image."""
    return word_count(text) < fewest


def collapse(text: Column) -> Column:
    """White space and NUL as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x00]+", " "))


def without_controls(text: Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def without_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]*>", " "))


def fewer_newlines(text: Column) -> Column:
    """Three or more newlines become two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def slug(text: Column, most: int = 48) -> Column:
    """Lower-case words joined by hyphens, cut at ``most`` characters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(plain, 1, most)


def sheet_name(text: Column) -> Column:
    """A workbook's sheet name: without ``[]:*?/\\``, 31 characters at most."""
    return F.substring(F.trim(F.regexp_replace(text, r"[\[\]:*?/\\]", " ")), 1, 31)


def short_id(text: Column, length: int = 12) -> Column:
    """The first digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, length)


def colour_index(text: Column, colours: int = 8) -> Column:
    """h = h * 31 + code, in 32 bits, modulo the number of colours."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.pmod(h, F.lit(colours)).cast("int")


def keyword_list(text: Column) -> Column:
    """Keywords of a JSON array, of ``{a;b}`` or of a list with ``,`` or ``;``.

    Trimmed, unquoted, without empty ones; of spellings that differ in case the first stays.
    """
    parsed = F.from_json(text, "array<string>")
    bare = F.split(F.regexp_replace(text, r"^\s*[\[{]|[\]}]\s*$", ""), "[;,]")
    items = F.coalesce(F.when(F.trim(text).startswith("["), parsed), bare)
    clean = F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"""^["']+|["']+$""", "")), lambda x: x != "")
    return distinct_ignoring_case(clean)


def distinct_ignoring_case(items: Column) -> Column:
    """The first spelling of each item, in order."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        items, empty, lambda seen, x: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(x)), seen).otherwise(F.array_append(seen, x))
    )


def unique_strings(items: Column) -> Column:
    """Trimmed, without empty ones, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def display_name(full: Column, user: Column, mail: Column) -> Column:
    """Full name, else user name, else the mail's local part, else the mail, else User."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(full), some(user), some(F.split_part(mail, F.lit("@"), F.lit(1))), some(mail), F.lit("User"))


def share_of(text: Column, letters: str) -> Column:
    """The share of non-blank characters that the character class holds."""
    solid = F.regexp_count(text, F.lit(r"\S"))
    return F.when(solid > 0, F.regexp_count(text, F.lit(f"[{letters}]")) / solid).otherwise(F.lit(0.0))


def needs_translation(text: Column, fewest: int = 20, share: float = 0.35) -> Column:
    """Arabic or Cyrillic: at least that many characters and that share."""
    letters = r"؀-ۿЀ-ӿ"
    return (F.regexp_count(text, F.lit(f"[{letters}]")) >= fewest) & (share_of(text, letters) >= share)


def clauses(text: Column) -> Column:
    """Sentences and parts between semicolons."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+"), lambda x: F.trim(x)), lambda x: x != "")


#: Endings of keys that name a language, and words of keys in capitals. Fixed values.
LANGUAGE_ENDINGS = {"_ru": "RU", "_kk": "KK", "_kz": "KK", "_uz": "UZ", "_oz": "UZ", "_en": "EN"}
CAPITALS = "id url bin tin iin kpp ogrn esg gri tcfd sasb issb msci cdp ip ftp smtp html json xml csv pdf kz uz ru".split()


def key_label(key: Column) -> Column:
    """A key of a record as words: the first with a capital, the others in lower case, acronyms in capitals, its language behind."""
    ending = rf"(?s)(?<=.)({'|'.join(LANGUAGE_ENDINGS)})\z"
    # Each part is bound once: an expression that is named again would be worked out again.
    shown = lambda w, low, i: F.when(low.isin(CAPITALS), F.upper(w)).when(i == 0, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(low)
    word = lambda w, i: F.transform(F.array(F.lower(w)), lambda low: shown(w, low, i))[0]
    said = lambda bare: F.coalesce(F.nullif(F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("[^-_]+"), F.lit(0)), word), " "), F.lit("")), bare)
    tag = lambda found: F.coalesce(*(F.when(found == e, F.lit(f" ({t})")) for e, t in LANGUAGE_ENDINGS.items()), F.lit(""))
    bare = F.transform(F.array(F.regexp_replace(key, ending, "")), said)[0]
    return F.concat(F.coalesce(bare, F.lit("")), F.coalesce(F.transform(F.array(F.regexp_extract(key, ending, 1)), tag)[0], F.lit("")))
