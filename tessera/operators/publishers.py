"""Who publishes a source: identities of labels by groups of aliases, and whether named sources agree with cited ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

#: Publishers by identity: how their labels start, and the names accepted for them. Fixed values.
ALIASES = {
    "unfccc": (["unfccc"], ["unfccc", "united nations framework convention on climate change"]),
    "world-bank": (["world bank"], ["world bank"]),
    "ifrs-foundation": (["ifrs foundation"], ["ifrs foundation"]),
    "iosco": (["iosco"], ["iosco"]),
    "financial-stability-board": (["financial stability board", "fsb"], ["financial stability board", "fsb"]),
    "ngfs": (["network for greening the financial system", "ngfs"], ["network for greening the financial system", "ngfs"]),
    "ghg-protocol": (["ghg protocol"], ["ghg protocol"]),
    "cdp": (["cdp"], ["cdp"]),
    "uae-government": (["uae government"], ["uae government", "government of the uae"]),
    "central-bank-uae": (["central bank of the uae"], ["central bank of the uae", "cbuae"]),
    "dfsa": (["dubai financial services authority"], ["dubai financial services authority", "dfsa"]),
    "adgm": (["abu dhabi global market"], ["abu dhabi global market", "adgm"]),
    "unep-fi": (["unep fi"], ["unep fi", "united nations environment programme finance initiative"]),
    "pcaf": (["pcaf"], ["pcaf"]),
    "basel-committee": (["basel committee"], ["basel committee", "basel committee on banking supervision", "bcbs"]),
    "saudi-central-bank": (["saudi central bank"], ["saudi central bank", "sama"]),
    "saudi-exchange": (["saudi exchange"], ["saudi exchange", "tadawul"]),
    "aifc": (["astana international financial centre"], ["astana international financial centre", "aifc"]),
    "iea": (["iea"], ["iea", "international energy agency"]),
    "globalabc": (["global alliance for buildings and construction"], ["global alliance for buildings and construction", "globalabc"]),
    "worldgbc": (["world green building council"], ["world green building council", "worldgbc"]),
    "ogmp-2": (["oil and gas methane partnership 2 0"], ["oil and gas methane partnership 2 0", "ogmp 2 0"]),
    "sbti": (["science based targets initiative"], ["science based targets initiative", "sbti"]),
}
#: Names that name nobody; also whatever has "research firm" in it. Fixed values.
GENERIC = r"^(source\s*\d*|market research firm|investment research firm|climate research firm|regulatory body|industry body|industry report|consulting firm)$|research firm"
#: Citations with which a draft's own sources may be filled in. Fixed value.
MOST_CITED = 5


def alias_groups(spark) -> DataFrame:
    """ordinal, identity, prefixes, names of ALIASES."""
    rows = [(i, name, list(starts), list(names)) for i, (name, (starts, names)) in enumerate(ALIASES.items())]
    return spark.createDataFrame(rows, "ordinal int, identity string, prefixes array<string>, names array<string>")


def publisher_part(label: Column) -> Column:
    """What stands before the first spaced dash of a label; the whole label if nothing does."""
    first = F.trim(F.regexp_replace(label, r"(?s)\s[-–—]\s.*$", ""))
    return F.when(first != "", first).otherwise(F.trim(label))


def identities(labels: DataFrame, groups: DataFrame) -> DataFrame:
    """label, identity: the first group of aliases whose prefix is the label or its first words, else the label's own publisher.

    ``labels`` has label; ``groups`` ordinal, identity, prefixes, names. A label is spread over its first
    1, 2, ... words, so prefixes are met by equality. Null labels are not there, equal ones once.
    """
    known = labels.select("label").filter("label is not null").distinct()
    form = text.words_form(F.col("label"))
    words = F.split("form", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    spread = known.withColumn("form", form).select("label", F.explode(starts).alias("prefix"))
    listed = groups.select("ordinal", "identity", F.explode("prefixes").alias("prefix"))
    met = spread.join(listed, "prefix").groupBy("label").agg(F.min_by("identity", "ordinal").alias("identity"))
    own = F.concat(F.lit("publisher:"), text.words_form(publisher_part(F.col("label"))))
    return known.join(met, "label", "left").select("label", F.coalesce("identity", own).alias("identity"))


def key_source_issues(drivers: DataFrame, links: DataFrame, groups: DataFrame) -> DataFrame:
    """driver_id, issues: what is wrong with the sources that a draft names (key_sources, array).

    ``links``: driver_id, link (the place of the citation), label (the approved label of the source that
    it cites). A named source is matched to the first cited label that it equals, whose publisher it
    equals, or whose group accepts it; named sources have to be the cited labels, each matched, and
    their identities those of the labels. Null names are empty ones; drivers without links have a row.
    """
    blank = F.trim(F.coalesce("label", F.lit("")))
    cited = links.select("driver_id", "link", blank.alias("label"))
    usable = cited.filter("label != ''").join(identities(cited.filter("label != ''"), groups), "label")
    accepted = usable.join(groups.select("identity", F.explode("names").alias("name")), "identity").select("driver_id", "link", "identity", "name")
    forms = F.array(text.words_form(F.col("label")), text.words_form(publisher_part(F.col("label"))))
    names = usable.select("driver_id", "link", "identity", F.explode(forms).alias("name")).unionByName(accepted)
    first = names.groupBy("driver_id", "name").agg(F.min_by("identity", "link").alias("found"))

    none = F.array().cast("array<string>")
    own = drivers.select("driver_id", F.transform(F.coalesce("key_sources", none), lambda k: F.coalesce(k, F.lit(""))).alias("named"))
    each = own.select("driver_id", F.explode("named").alias("key")).withColumn("name", text.words_form(F.col("key"))).join(first, ["driver_id", "name"], "left")
    each = each.groupBy("driver_id").agg(F.bool_or(F.lower(F.trim("key")).rlike(GENERIC)).alias("generic"), F.bool_or(F.col("found").isNull()).alias("unknown"), F.collect_set("found").alias("found"))
    of_links = cited.groupBy("driver_id").agg(F.bool_or(F.col("label") == "").alias("unlabelled"), F.collect_set(F.nullif("label", F.lit(""))).alias("labels"))
    expected = usable.groupBy("driver_id").agg(F.collect_set("identity").alias("expected"))
    full = own.join(each, "driver_id", "left").join(of_links, "driver_id", "left").join(expected, "driver_id", "left")
    yes, listed = (lambda c: F.coalesce(F.col(c), F.lit(False))), (lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), none))))
    wrong = (listed("named") != listed("labels")) | yes("unknown") | (listed("found") != listed("expected"))
    said = [(yes("generic"), "generic key source label used"), (yes("unlabelled"), "one or more linked sources lack an approved publisher label"), (wrong, "key sources do not exactly match cited approved publisher labels")]
    return full.select("driver_id", F.filter(F.array(*(F.when(test, F.lit(m)) for test, m in said)), lambda x: x.isNotNull()).alias("issues"))


def citation_metadata(drivers: DataFrame, evidence: DataFrame) -> DataFrame:
    """driver_id, key_sources, source_refs: what a draft's links say by themselves, null where they can't.

    ``drivers``: driver_id, source_links; ``evidence``: driver_id, url, source_id, label, direct. All links
    have to be different, in the evidence, direct and labelled, with at most MOST_CITED labels; labels and
    ids come in the order of the links. Of evidence with one URL the greatest source_id counts.
    """
    links = drivers.select("driver_id", F.posexplode("source_links").alias("link", "url"))
    pack = evidence.groupBy("driver_id", "url").agg(F.max_by(F.struct("source_id", "label", "direct"), "source_id").alias("s"))
    met = links.join(pack, ["driver_id", "url"], "left")
    label = F.nullif(F.trim("s.label"), F.lit(""))
    sound = F.coalesce(F.col("s.direct") & label.isNotNull(), F.lit(False))
    order = F.array_sort(F.collect_list(F.struct("link", label.alias("label"), F.col("s.source_id").alias("id"))))
    found = met.groupBy("driver_id").agg(F.bool_and(sound).alias("sound"), (F.count_distinct("url") == F.count("*")).alias("apart"), order.alias("o"))
    labels = F.array_distinct(F.transform("o", lambda x: x.label))
    good = F.col("sound") & F.col("apart") & (F.size(labels) <= MOST_CITED)
    found = found.select("driver_id", F.when(good, labels).alias("key_sources"), F.when(good, F.transform("o", lambda x: x.id)).alias("source_refs"))
    return drivers.select("driver_id").join(found, "driver_id", "left")

