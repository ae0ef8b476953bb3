"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def approval_form(url: Column) -> Column:
    """The form in which URLs are approved: http(s), no credentials, fragment or utm parameters.

    Host in lower case without ``www.``, with a port other than the scheme's own, path as it is, the
    whole without one slash at the end. Null otherwise.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    query = F.try_parse_url(bare, F.lit("QUERY"))
    kept = F.coalesce(F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("(?i)^utm_")), "&"), F.lit(""))
    path = F.coalesce(F.nullif(F.try_parse_url(bare, F.lit("PATH")), F.lit("")), F.lit("/"))
    scheme, port = F.lower(F.try_parse_url(bare, F.lit("PROTOCOL"))), F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*?:(\d+)(?:[/?]|$)", 1)
    shown = F.when((port == "") | (F.concat(scheme, port).isin("http80", "https443")), "").otherwise(F.concat(F.lit(":"), port))
    form = F.concat(scheme, F.lit("://"), host(bare), shown, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(bare.rlike("(?i)^https?://[^/@?]+(/|[?]|$)"), F.regexp_replace(form, "/$", ""))


def dedup_key(url: Column) -> Column:
    """Lower case, without fragment and the source, medium and campaign parameters."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    bare = F.regexp_replace(bare, r"([?&])utm_(source|medium|campaign)=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\?&+", "?"), "&{2,}", "&"), "[?&]+$", "")


def https_links(text: Column) -> Column:
    """All https URLs in a text; white space, ``;`` and ``,`` end them."""
    return F.regexp_extract_all(text, F.lit(r"(https://[^\s;,]+)"))


def without_double(url: Column, segment: str = "/events/") -> Column:
    """A path segment written twice in a row, once."""
    twice = segment + segment.lstrip("/")
    return F.replace(url, F.lit(twice), F.lit(segment))
