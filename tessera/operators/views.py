"""What is shown of a raw record, by a table of fields for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import variants
from tessera.session import cut

#: Names of the sources that are shown by their own fields. Fixed values.
PLAIN_SOURCES = {
    "national_bank": "National Bank of Kazakhstan Procurement Portal", "samruk_kazyna": "Samruk-Kazyna Electronic Procurement Portal", "ets_tender": "ETS-Tender", "uzex_etender": "UZEX e-Tender",
    "xt_xarid": "XT-Xarid Public Procurement", "tendersinfo": "TendersInfo",
}
EYEBROWS = {"goszakup": "Портал государственных закупок", "mitwork": "Eurasian Electronic Portal", "zakup_unified": "Unified Procurement Portal of Kazakhstan", **PLAIN_SOURCES}
#: What stands before a heading. Fixed values.
PREFIXES = {"goszakup": "Просмотр объявления № ", "mitwork": "Закупка № ", "zakup_unified": "Объявление № "}
#: Heading, subtitle and status by source: the first field that is there, even if it is empty. Fixed values.
HEADS = {
    "goszakup": {"heading": ["announcement_number", "announcement_id", "id"], "subtitle": ["announcement_title_ru", "announcement_title"], "status": ["announcement_status", "status_text"]},
    "mitwork": {"heading": ["announcement_number", "data_key"], "subtitle": ["detail_fields.title_ru_detail", "title_ru", "title"], "status": ["detail_fields.status_text_detail", "status_text"]},
    "zakup_unified": {"heading": ["announcement_number", "id"], "subtitle": ["name"], "status": ["status.name"]},
}
#: The same of the plain sources: the first field that is not empty. Fixed values.
PLAIN_HEADS = {
    "heading": ["announcement_number", "number", "display_no", "id", "site_tender_id", "data_key"], "subtitle": ["name", "nameRu", "title", "title_ru", "short_desc"], "status": ["status_name", "status", "advertStatus", "announcement_status"],
}
#: Rows by source, part and label: the first field that is not empty. Fixed values.
ROWS = {
    "goszakup": {
        "cards": {"Номер объявления": ["announcement_number"], "Статус": ["announcement_status", "status_text"], "Сумма закупки": ["total_amount_text", "amount_text"], "Кол-во лотов": ["lot_count_text", "lot_count"]},
        "Общие сведения": {"Способ проведения закупки": ["procurement_method"], "Тип закупки": ["purchase_type"], "Вид предмета закупок": ["subject_type"], "Признаки": ["signs"]},
        "Организатор": {"БИН организатора": ["organizer_bin"], "Организатор": ["organizer_name", "organizer_text"], "Юр. адрес организатора": ["organizer_legal_address"], "E-Mail": ["organizer_email"]},
    },
    "mitwork": {
        "cards": {"Начало приема": ["offer_start_text_detail", "offer_start_text"], "Окончание приема": ["offer_end_text_detail", "offer_end_text"], "Стоимость": ["value_text"], "Лотов": ["lots_label"]},
        "Основные данные": {"Номер закупки": ["announcement_number"], "Внутренний ID": ["data_key"], "Наименование (RU)": ["title_ru_detail", "title_ru"], "Страница закупки": ["detail_url"]},
        "Организатор": {"Организатор": ["organizer_name", "buyer_name"], "БИН/ИИН": ["buyer_bin"], "Карточка организатора": ["organizer_url", "subject_url"]},
    },
    "zakup_unified": {
        "cards": {"Способ закупки": ["purchase_method.name"], "Предмет": ["purchase_subject.name"], "Лоты": ["lot_count", "#lots"], "Код статуса": ["status.code"]},
        "Данные объявления": {"ID объявления": ["id"], "Внешний ID": ["external_id"], "Номер объявления": ["announcement_number"], "Наименование": ["name"]},
        "Организатор": {"Организатор": ["organizer.name"], "БИН/ИИН": ["organizer.iin_bin"], "Тип организации": ["organizer.organization_type"], "Адрес": ["organizer.address"], "ID организатора": ["organizer.id"]},
    },
}
#: Records whose fields are read too, and the one whose fields stand before the record's own. Fixed values.
INNER, MERGED = ["detail_fields", "status", "purchase_method", "purchase_subject", "organizer"], {"mitwork": "detail_fields"}
#: Fields of a plain source in its profile, and in its cards. Fixed values.
PROFILE, CARDS = 28, 4
#: Lists that stand for the lots of a source where one of them has records. Fixed values.
LOTS = {"goszakup": ["announcement_lots", "_announcement_lots"]}


def field_table(spark) -> DataFrame:
    """source, part, place, label, how (``there`` or ``filled``), pos and path: the tables above as rows."""
    rows = []
    for source, parts in HEADS.items():
        rows += [(source, part, 0, part, "there", i, path) for part, paths in parts.items() for i, path in enumerate(paths)]
    for source in PLAIN_SOURCES:
        rows += [(source, part, 0, part, "filled", i, path) for part, paths in PLAIN_HEADS.items() for i, path in enumerate(paths)]
    for source, parts in ROWS.items():
        for part, labels in parts.items():
            how = lambda label: "there" if "#lots" in parts[part][label] else "filled"  # noqa: B023, E731
            rows += [(source, part, n, label, how(label), i, path) for n, (label, paths) in enumerate(labels.items()) for i, path in enumerate(paths)]
    return spark.createDataFrame(rows, "source string, part string, place int, label string, how string, pos int, path string")


def _places(json: str) -> Column:
    """The keys of a record in the order in which they stand."""
    return F.map_keys(F.from_json(json, "map<string,string>"))


def source_views(records: DataFrame, key: str = "id", source: str = "source", json: str = "json") -> DataFrame:
    """key, part, place, label, value: heading, subtitle, status and eyebrow, cards and rows of every record of a known source.

    The table of fields meets the records' fields by (source, path), so a further source is further rows
    of the table. ``there`` takes the first path whose value is not null, ``filled`` the first that is not
    empty. Plain sources show their own scalar fields, in order. Values are text, nested ones JSON.
    Records of other sources and text that is no JSON record are not there.
    """
    spark = records.sparkSession
    known = records.select(key, F.col(source).alias("source"), F.col(json).alias("_json")).filter(F.col("source").isin(*EYEBROWS) & variants.is_record(F.try_parse_json(json)))
    known = cut(known)
    own = cut(variants.fields(known, key, "_json", "source"))
    value = F.col("value")
    inner = own.filter(F.col("field").isin(INNER) & variants.is_record(value)).select(key, "source", F.col("field").alias("_above"), F.col("value").alias("_v"))
    inner = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(key, "source", "_above", F.col("key").alias("field"), "value")
    merged = F.coalesce(*(F.when(F.col("source") == s, F.lit(f)) for s, f in MERGED.items()))
    over = inner.filter(F.col("_above") == merged).select(key, "source", "field", "value", F.lit(0).alias("_first"))
    lots = own.filter("field = '_lots'").groupBy(key).agg(F.sum(F.size(F.filter(F.try_variant_get(value, "$", "array<variant>"), variants.is_record)).cast("long")).alias("count"))
    n_lots = known.join(lots, key, "left").select(key, "source", F.lit("#lots").alias("path"), F.to_variant_object(F.array(F.coalesce("count", F.lit(0)))).alias("value"))
    n_lots = n_lots.withColumn("value", F.try_variant_get(value, "$[0]", "variant"))
    flat = own.withColumn("_first", F.lit(1)).unionByName(over)
    flat = flat.groupBy(key, "source", F.col("field").alias("path")).agg(F.min_by(F.struct("value"), "_first").alias("s")).select(key, "source", "path", "s.value")
    flat = flat.unionByName(inner.select(key, "source", F.concat_ws(".", "_above", "field").alias("path"), "value")).unionByName(n_lots)

    table = field_table(spark)
    met = flat.join(F.broadcast(table), ["source", "path"]).filter(F.when(F.col("how") == "there", value.isNotNull() & ~F.is_variant_null(value)).otherwise(~variants.is_empty(value)))
    got = met.groupBy(key, "part", "place", "label").agg(F.min_by(F.struct(variants.shown(value).alias("text"), variants.is_empty(value).alias("empty")), "pos").alias("s"))
    got = cut(got.select(key, "part", "place", "label", "s.text", "s.empty"))
    heads = ["heading", "subtitle", "status"]
    rows = got.filter(~F.col("part").isin(heads) & ~F.col("empty")).select(key, "part", "place", "label", F.col("text").alias("value"))

    top = known.select(key, "source", F.explode(F.array(*map(F.lit, heads))).alias("part")).join(got.select(key, "part", "text"), [key, "part"], "left")
    plain = F.col("source").isin(*PLAIN_SOURCES)
    prefix = F.coalesce(*(F.when(F.col("source") == s, F.lit(p)) for s, p in PREFIXES.items()), F.lit(""))
    shown = F.when(F.col("part") == "heading", F.concat(prefix, F.coalesce("text", F.when(plain, F.col("source")), F.lit("")))).when(plain, F.coalesce("text", F.lit(""))).otherwise(F.col("text"))
    top = top.select(key, "part", F.lit(0).alias("place"), F.col("part").alias("label"), shown.alias("value"))
    eyebrow = F.coalesce(*(F.when(F.col("source") == s, F.lit(e)) for s, e in EYEBROWS.items()))
    brow = known.select(key, F.lit("eyebrow").alias("part"), F.lit(0).alias("place"), F.lit("eyebrow").alias("label"), eyebrow.alias("value"))

    simple = own.filter(plain & ~F.col("field").startswith("_") & ~variants.is_record(value) & ~variants.is_list(value) & ~variants.is_empty(value)).select(key, "field", variants.shown(value).alias("value"))
    simple = simple.join(known.filter(plain).select(key, _places("_json").alias("_keys")), key).withColumn("_at", F.array_position("_keys", F.col("field")))
    simple = simple.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_at", "field")) - 1).filter(F.col("place") < PROFILE)
    parts = F.when(F.col("place") < CARDS, F.array(F.lit("Source profile"), F.lit("cards"))).otherwise(F.array(F.lit("Source profile")))
    simple = simple.select(key, F.explode(parts).alias("part"), "place", variants.title(F.col("field")).alias("label"), "value")
    return brow.unionByName(top).unionByName(rows).unionByName(simple)


def source_lots(records: DataFrame, key: str = "id", source: str = "source", json: str = "json") -> DataFrame:
    """key, place, item (JSON) of the lots that a record shows: a source's own list if it has records, else those below _lots.

    Of a source's lists the first that is a list counts, whatever is in it.
    """
    own = records.select(key, F.col(source).alias("source"), F.try_parse_json(json).alias("_v"))
    listed = F.lit(None).cast("array<variant>")
    for s, names in LOTS.items():
        for name in reversed(names):
            found = F.try_variant_get("_v", f"$['{name}']", "array<variant>")
            listed = F.when((F.col("source") == s) & found.isNotNull(), found).otherwise(listed)
    first = F.filter(listed, variants.is_record)
    other = F.filter(F.try_variant_get("_v", "$['_lots']", "array<variant>"), variants.is_record)
    items = F.when(F.coalesce(F.size(first), F.lit(0)) > 0, first).otherwise(other)
    return own.select(key, F.posexplode(items).alias("place", "_item")).select(key, "place", F.to_json("_item").alias("item"))
