"""One spelling for the sections, countries, sectors and categories of a catalog, and what its texts claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of sections and driver types. Fixed values.
SECTIONS = {
    "Global Drivers": ["global", "global context", "global drivers"],
    "Regulatory Requirements": ["regulatory", "regulatory requirements"],
    "Climate Risks": ["climate risks", "climate risk"],
    "Capital Markets": ["capital markets", "capital market"],
    "Supply Chain": ["supply chain", "supply chains"],
}
DRIVER_TYPES = {"General": ["general"], "Sector-related": ["sector-related", "sector related"], "Country-related": ["country-related", "country related"]}
#: Accepted spellings of countries in scope lists and in requests. Fixed values.
SCOPE_COUNTRIES = {"All": ["all", "global"], "UAE": ["uae", "united arab emirates"], "Saudi Arabia": ["saudi arabia", "ksa", "sa"], "Kazakhstan": ["kazakhstan", "kz"], "Uzbekistan": ["uzbekistan", "uz"]}
COUNTRIES = {"UAE": ["uae", "united arab emirates"], "Saudi Arabia": ["ksa", "saudi", "saudi arabia", "kingdom of saudi arabia"], "Kazakhstan": ["kazakhstan", "republic of kazakhstan"]}
#: Words of a sector, in requests. Fixed values.
SECTORS = {
    "Banking": r"\b(bank|banking|financial|finance|insurance|lending|credit)\b",
    "Construction": r"\b(construction|cement|building materials|contractor|contractors)\b",
    "Real Estate": r"\b(real estate|property|buildings?|reit)\b",
    "Oil & Gas": r"\b(oil|gas|petroleum|lng|upstream|downstream)\b",
}
#: Sector and family of a part of a scope list, the first that fits. Fixed values.
SCOPE_SECTORS = [
    ("All", "All", r"^(all(?: sectors?)?|cross-sector|listed companies|large companies|high-emitting sectors)$"),
    ("Banking", "Financial Services", r"bank|financial|finance|lending|insurance|asset management|wealth management|capital markets?"),
    ("Construction", "Built Environment", r"construction|cement|infrastructure|contractor"),
    ("Real Estate", "Built Environment", r"real estate|property|buildings?|developers?|reit"),
    ("Oil & Gas", "Energy", r"oil\s*(?:&|and)\s*gas|petroleum|upstream|midstream|downstream|lng|fossil fuel"),
]
POWER, OTHER_ENERGY = r"^power\b", r"\benergy\b|power|electricity|utilities|storage|trade\s*&\s*retail"
#: Words of a category of evidence, the first that fits; regulatory ones have their own. Fixed values.
STANDARD = r"\b(standard|criteria|methodology|protocol|science-based|science based)\b"
LEGAL = r"\b(regulation|regulatory|law|mandatory|rule|taxonomy|directive|ets|emissions trading|cbam|carbon border)\b"
POLICY = r"\b(policy|strategy|roadmap|ndc|programme|program|plan)\b"
CATEGORIES = {
    "standard": r"standard|criteria|methodology|protocol|science-based|science based",
    "regulation": r"regulation|regulatory|law|mandatory|requirement|rule|taxonomy|compliance|directive|\bets\b|emissions trading|cbam|carbon border",
    "forecast": r"forecast|projection|outlook|projected|scenario",
    "market-metric": r"market|issuance|finance|financing|capital|investment|premium",
    "policy": r"policy|strategy|ndc|commitment|target|net.zero|phase.out",
    "risk": r"risk|exposure|loss|vulnerability|resilience|adaptation|stranded",
    "evergreen-framework": r"framework|principles|guidance",
}
#: Words of obligations and hard claims, and titles that say nothing. Fixed values.
OBLIGATION = r"(?i)\b(shall|must|required(?:\s+to)?|requires?|mandatory|mandate|mandated)\b"
HARD_CLAIM = r"(?i)\b(must|required|required to|requires|mandated|mandatory|compliance with|aligned with|align with|alignment with)\b"
WEAK_TITLE = r"(?i)^(global esg trends|sustainability trends|investor pressure for sustainability|technological advancements|esg investment growth|esg compliance|sustainable supply chain financing)$"
#: Other names of a country, by what its own name has in it, and of a sector, by a pattern. Fixed values.
COUNTRY_ALIASES = {
    "united arab emirates": ["uae", "united arab emirates", "emirati"],
    "saudi": ["saudi", "saudi arabia", "kingdom of saudi arabia", "ksa"],
    "kazakhstan": ["kazakhstan", "kazakh"],
}
SECTOR_ALIASES = {
    r"\bbank|banking|financial|finance|lending|credit\b": ["banking", "bank", "banks", "financial sector", "financial institutions", "lenders", "credit"],
    "construction|cement|building materials|contractor": ["construction", "contractors", "building", "buildings", "cement"],
    "real estate|property|buildings?|reit": ["real estate", "property", "buildings"],
    "oil|gas|petroleum|lng|upstream|downstream": ["oil", "gas", "oil and gas", "petroleum", "lng"],
}
REGISTRY_SECTOR_ALIASES = {
    r"\b(bank|banking|financial|finance|lending|credit)\b": ["banking", "banks", "financial sector", "financial institutions", "lenders", "credit", "financed emissions"],
    r"\b(construction|cement|building materials|contractor|contractors)\b": ["construction", "contractors", "building", "buildings", "cement"],
    r"\b(real estate|property|buildings?|reit)\b": ["real estate", "property", "buildings", "reit"],
    r"\b(oil|gas|petroleum|lng|upstream|downstream)\b": ["oil", "gas", "oil and gas", "petroleum", "lng", "methane"],
}
#: Words of a sector's name that name no sector. Fixed values.
SECTOR_STOPWORDS = "and business businesses companies company energy for general group industries industry of other sector services the".split()
#: Acronyms that a rewrite must keep. Fixed value.
ACRONYM = r"\b(?:[A-Z]{2,}(?:[-/][A-Z0-9]{1,})*|[A-Z]{1,5}\d+[a-z]?|SBTi|CO2e?|tCO2e)\b"
#: Month names in Russian, by number. Fixed values.
RUSSIAN_MONTHS = ["январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]
#: Keys that may name an item of a list. Fixed values.
TITLE_KEYS = ["label", "name", "name_ru", "title", "title_ru_detail", "number", "display_no", "id", "Id"]


def spelled(text: Column, spellings: dict[str, list[str]]) -> Column:
    """The name under which a spelling is listed, in any case; null for one that is not."""
    low = F.lower(F.trim(text))
    return F.coalesce(*(F.when(low.isin(known), F.lit(name)) for name, known in spellings.items()))


def scopes(text: Column) -> Column:
    """Parts between commas, semicolons and line ends, without a leading "and" and without empty ones."""
    parts = F.transform(F.split(text, r"[,;\n]+"), lambda x: F.regexp_replace(F.trim(x), r"(?i)^and\s+", ""))
    return F.filter(parts, lambda x: x != "")


def scope_countries(text: Column) -> Column:
    """Countries of a scope list, each once; one without a listed spelling stays as it is."""
    return F.array_distinct(F.transform(scopes(text), lambda x: F.coalesce(spelled(x, SCOPE_COUNTRIES), x)))


def _scope_sector(part: Column, which: int) -> Column:
    fits = lambda rule: part.rlike("(?i)" + rule[2]) & (~part.rlike("(?i)" + POWER) if rule[0] == "Oil & Gas" else F.lit(True))
    return F.coalesce(*(F.when(fits(rule), F.lit(rule[which])) for rule in SCOPE_SECTORS))


def scope_sectors(text: Column) -> Column:
    """Sectors of a scope list, each once; one that no rule knows stays as it is."""
    return F.array_distinct(F.transform(scopes(text), lambda x: F.coalesce(_scope_sector(x, 0), x)))


def sector_families(text: Column) -> Column:
    """Families of the sectors of a scope list, each once; ``Other`` if there is none."""
    family = lambda x: F.coalesce(_scope_sector(x, 1), F.when(x.rlike("(?i)" + OTHER_ENERGY), "Energy"))
    found = F.array_distinct(F.filter(F.transform(scopes(text), family), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Other")))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def country(text: Column) -> Column:
    """A supported country by any of its spellings, punctuation apart; else null."""
    return spelled(_plain(text), COUNTRIES)


def _forms(items: Column) -> Column:
    """Names with single spaces between runs of a-z and 0-9, each once."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))), lambda x: x != ""))


def country_aliases(text: Column, canonical: bool = True) -> Column:
    """Names under which a text may mention a country: its own (or the supported one's) and known others."""
    own = F.lower(F.trim(F.coalesce(country(text), text) if canonical else text))
    listed = lambda key: F.when(own.contains(key) | ((own == "uae") & F.lit(key.startswith("united"))), F.array(*map(F.lit, COUNTRY_ALIASES[key]))).otherwise(F.array().cast("array<string>"))
    return F.filter(_forms(F.coalesce(F.concat(F.array(own), *map(listed, COUNTRY_ALIASES)), F.array().cast("array<string>"))), lambda x: F.length(x) > 1)


def _by_pattern(own: Column, known: dict[str, list[str]]) -> Column:
    return F.concat(*(F.when(own.rlike(pattern), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for pattern, names in known.items()))


def sector_aliases(text: Column) -> Column:
    """Names under which a text may mention a sector: its own (or the supported one's), the words of that, known others."""
    own = F.lower(F.trim(F.coalesce(sector(text), text)))
    words = F.filter(F.split(own, "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(SECTOR_STOPWORDS))
    return F.filter(_forms(F.coalesce(F.concat(F.array(own), words, _by_pattern(own, SECTOR_ALIASES)), F.array().cast("array<string>"))), lambda x: F.length(x) > 2)


def registry_sector_aliases(text: Column) -> Column:
    """The same as a registry of sources knows them: the sector's own name and known others."""
    own = F.lower(F.trim(text))
    return F.filter(_forms(F.coalesce(F.concat(F.array(own), _by_pattern(own, REGISTRY_SECTOR_ALIASES)), F.array().cast("array<string>"))), lambda x: F.length(x) > 2)


def sector(text: Column) -> Column:
    """The first supported sector with a word in the text; else null."""
    plain = _plain(text)
    return F.coalesce(*(F.when(plain.rlike(words), F.lit(name)) for name, words in SECTORS.items()))


def category(section: Column, *texts: Column) -> Column:
    """The category of evidence that a driver's texts call for; ``other`` if no word fits."""
    low = F.lower(F.concat_ws(" ", *texts))
    regulatory = F.when(low.rlike(STANDARD) & ~low.rlike(LEGAL), "standard").when(low.rlike(POLICY), "policy").otherwise("regulation")
    usual = F.coalesce(*(F.when(low.rlike(words), F.lit(name)) for name, words in CATEGORIES.items()), F.lit("other"))
    return F.when(section == "Regulatory Requirements", regulatory).otherwise(usual)


def protected(text: Column, metrics: Column) -> Column:
    """Metrics and acronyms that a rewrite must keep, sorted."""
    acronyms = F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0))
    marked = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind + ":"), x))
    return F.array_sort(F.concat(marked("metric", metrics), marked("acronym", acronyms)))


def activity_path(details: Column) -> Column:
    """The first path below one of the two domains in a log line; null without one."""
    return F.nullif(F.regexp_extract(details, r"(?i)/(?:esg|credit)/[^\s)•]+", 0), F.lit(""))


def activity_domain(details: Column) -> Column:
    """The domain of the path, whose name counts in lower case only."""
    path = activity_path(details)
    return F.when(path.startswith("/credit/"), "credit").when(path.startswith("/esg/"), "esg")


def amount_text(value: Column, currency: Column) -> Column:
    """Groups of three digits, at most two decimals, then the currency; a dash for null."""
    shown = F.call_function("format_number", F.round(value, 2), F.lit("#,##0.##"))
    named = F.when(F.coalesce(currency, F.lit("")) != "", F.concat(shown, F.lit(" "), currency)).otherwise(shown)
    return F.coalesce(named, F.lit("—"))


def period_end(text: Column) -> Column:
    """First day of the month that a Russian period names, of its first year; 31 December without a month, null without a year."""
    year, low = F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")), F.lower(text)
    month = reduce(lambda rest, item: F.when(low.contains(item[1]), item[0]).otherwise(rest), reversed(list(enumerate(RUSSIAN_MONTHS, 1))), F.lit(None))
    return F.when(year.isNotNull(), F.make_date(year.cast("int"), F.coalesce(month, F.lit(12)), F.when(month.isNull(), 31).otherwise(1)))


def country_first(urls: Column, words: Column, most: int = 4) -> Column:
    """The first ``most`` different URLs, those with one of the words ahead, else in order."""
    once = F.array_distinct(F.filter(urls, lambda u: u != ""))
    hit = lambda u: F.exists(words, lambda w: F.lower(u).contains(w))
    return F.slice(F.concat(F.filter(once, hit), F.filter(once, lambda u: ~hit(u))), 1, most)


def cleaned(text: Column, most: int) -> Column:
    """White space as single spaces, the first ``most`` characters; null if nothing is left."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most), F.lit(""))


def cleaned_list(items: Column, length: int = 300, most: int = 6) -> Column:
    return F.slice(F.filter(F.transform(items, lambda x: cleaned(x, length)), lambda x: x.isNotNull()), 1, most)


def web_link(url: Column, most: int = 1500) -> Column:
    """An http or https URL, cut; null for others."""
    return F.when(url.rlike(r"(?i)^https?://[^\s/]+"), F.substring(url, 1, most))
