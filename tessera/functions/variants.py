"""Views of raw JSON records of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import evidence
from tessera.functions.catalog import TITLE_KEYS
from tessera.functions.text import key_label
from tessera.session import cut, sent

#: Fields that have places of their own, and titles of nested ones. Fixed values.
SHOWN_ELSEWHERE = ["_documents", "_lots", "title", "buyer_name", "buyer_external_id", "source_url"]
SECTION_TITLES = {
    "detail_fields": "Announcement profile", "_detail": "Tender record", "_parsed_detail": "Parsed embedded detail", "announcement_lots": "Announcement lots", "_announcement_lots": "Announcement lots", "fields": "Criteria forms",
    "qualification_fields": "Qualification forms", "js_fields": "Dynamic criteria", "js_qualification_fields": "Qualification prompts",
}


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_record(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("OBJECT"), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("ARRAY"), F.lit(False))


def is_empty(value: Column) -> Column:
    """Null, blank text, and lists and records without anything in them."""
    text = F.when(_kind(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string")))
    no_items = is_list(value) & (F.size(F.try_variant_get(value, "$", "array<variant>")) == 0)
    return value.isNull() | F.is_variant_null(value) | (_kind(value) == "OBJECT<>") | F.coalesce(no_items, F.lit(False)) | F.coalesce(text == "", F.lit(False))


def _nested(value: Column) -> Column:
    """A record, or a list with a record or list in it."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    deep = F.exists(items, lambda v: F.coalesce(_kind(v).rlike("^(OBJECT|ARRAY)"), F.lit(False)))
    return is_record(value) | (is_list(value) & deep)


def shown(value: Column) -> Column:
    """A scalar as text, anything else as JSON; null for null."""
    scalar = ~is_record(value) & ~is_list(value)
    return F.when(value.isNotNull() & ~F.is_variant_null(value), F.coalesce(F.when(scalar, F.try_variant_get(value, "$", "string")), F.to_json(value)))


def title(field: Column) -> Column:
    return key_label(F.regexp_replace(field, "^_+", ""))


def titled(rows: DataFrame, field: str) -> DataFrame:
    """``rows`` (read twice) with the title of ``field``, null for null; each different field is worded once."""
    names = rows.select(field).distinct().filter(F.col(field).isNotNull())
    return rows.join(sent(names.select(field, title(F.col(field)).alias("title"))), field, "left")


def fields(records: DataFrame, key: str, json: str, *more: str) -> DataFrame:
    """key, ``more`` columns, field and value (variant) of every field of every record; text that is no JSON record has none."""
    parsed = records.select(key, *more, F.try_parse_json(json).alias("_v")).filter(is_record(F.col("_v")))
    return parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(key, *more, F.col("key").alias("field"), "value")


def records_below(records: DataFrame, key: str, json: str, field: str) -> DataFrame:
    """key, place and item (variant) of the records in the list that a record has below ``field``; other items are left out."""
    value = F.try_variant_get(F.try_parse_json(json), f"$['{field}']", "array<variant>")
    listed = records.select(key, F.filter(value, is_record).alias("_items"))
    return listed.select(key, F.posexplode("_items").alias("place", "item"))


def groups(records: DataFrame, key: str, json: str) -> DataFrame:
    """key, bucket, field, label, value of the fields that are shown in groups: scalars and lists of them, not empty."""
    value = F.col("value")
    found = fields(records, key, json).filter(~F.col("field").isin(SHOWN_ELSEWHERE) & ~F.col("field").startswith("__") & ~is_empty(value) & ~_nested(value))
    return found.select(key, evidence.bucket(F.col("field")).alias("bucket"), "field", title(F.col("field")).alias("label"), shown(value).alias("value"))


def sections(records: DataFrame, key: str, json: str, omitted: tuple[str, ...] = ("_documents", "_lots")) -> DataFrame:
    """key, field, title and summary of each nested field: how many fields or items it holds. presented() has its content."""
    value = F.col("value")
    found = fields(records, key, json).filter(~F.col("field").isin(*omitted) & ~is_empty(value) & _nested(value))
    n_fields = F.size(F.try_variant_get(value, "$", "map<string, variant>"))
    n_items = F.size(F.try_variant_get(value, "$", "array<variant>"))
    summary = F.when(is_record(value), F.concat(n_fields.cast("string"), F.lit(" fields"))).otherwise(F.concat(n_items.cast("string"), F.when(n_items == 1, " item").otherwise(" items")))
    named = F.coalesce(*(F.when(F.col("field") == k, F.lit(v)) for k, v in SECTION_TITLES.items()), title(F.col("field")))
    return found.select(key, "field", named.alias("title"), summary.alias("summary"))


def presented(records: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, kind (scalar, scalar_list, mapping, sequence), title and value of every node that is not empty, to any depth.

    A record is a mapping, a list of scalars one node, another list a sequence: its items that are not
    empty are numbered anew, records among them are mappings with a title of theirs, and other items
    scalars, lists as JSON. Level after level until no mapping or sequence is left to open.
    """
    value = F.col("value")
    level = fields(records, key, json).select(key, F.array("field").alias("path"), "field", F.lit(None).cast("string").alias("head"), "value", F.lit(False).alias("in_list"))
    nodes = None
    while True:
        kind = F.when(is_record(value), "mapping").when(~is_list(value) | F.col("in_list"), "scalar").when(_nested(value), "sequence").otherwise("scalar_list")
        level = cut(level.filter(~is_empty(value)).withColumn("kind", kind))
        inner = F.col("kind").isin("mapping", "sequence")
        found = titled(level, "field").select(key, F.array_join("path", "/").alias("path"), "kind", F.coalesce("title", "head").alias("title"), F.when(~inner, shown(value)).alias("value"))
        nodes = found if nodes is None else nodes.unionByName(found)
        above = level.filter(inner).select(key, F.col("path").alias("_path"), F.col("value").alias("_v"))
        if above.isEmpty():
            return nodes
        rows = above.lateralJoin(above.sparkSession.tvf.variant_explode(F.col("_v").outer())).filter(~is_empty(value))
        nth = F.row_number().over(Window.partitionBy(key, "_path").orderBy("pos"))
        named = [F.when(~is_empty(F.try_variant_get(value, f"$.{k}", "variant")), shown(F.try_variant_get(value, f"$.{k}", "variant"))) for k in TITLE_KEYS]
        item = F.concat(F.lit("Item "), nth.cast("string"))
        head = F.when(F.col("key").isNotNull(), F.lit(None)).when(is_record(value), F.coalesce(*named, item)).otherwise(item)
        step = F.when(F.col("key").isNotNull(), F.col("key")).otherwise((nth - 1).cast("string"))
        level = rows.select(key, F.concat("_path", F.array(step)).alias("path"), F.col("key").alias("field"), head.alias("head"), "value", F.col("key").isNull().alias("in_list"))
