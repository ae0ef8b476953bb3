import pytest
from pyspark.sql import functions as F

from tessera.functions import catalog, evidence, variants
from tessera.operators import views
from tessera.sources import tables, workbook


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scopes_of_nothing(spark):
    null = F.lit(None).cast("string")
    assert one(spark, catalog.scope_countries(null)) is None
    assert one(spark, catalog.scope_countries(F.lit(" ; ,\n"))) == []
    assert one(spark, catalog.sector_families(F.lit(""))) == ["Other"]
    assert one(spark, catalog.spelled(null, catalog.SECTIONS)) is None


def test_scopes_keep_order_and_unknown_parts(spark):
    assert one(spark, catalog.scope_countries(F.lit("and Oman, KSA;oman\nsa"))) == ["Oman", "Saudi Arabia", "oman"]
    assert one(spark, catalog.scope_sectors(F.lit("Power and LNG, Oil and Gas"))) == ["Power and LNG", "Oil & Gas"]


def test_protected_tokens(spark):
    text = F.lit("The SBTi and ISO14001 ask for CO2e under EU-ETS")
    assert one(spark, catalog.protected(text, F.array(F.lit("40%")))) == ["acronym:CO2e", "acronym:EU-ETS", "acronym:ISO14001", "acronym:SBTi", "metric:40%"]


@pytest.mark.parametrize("value, code, shown", [(1234567.891, "KZT", "1,234,567.89 KZT"), (0.5, "", "0.5"), (-2000.0, None, "-2,000"), (None, "USD", "—")])
def test_amounts(spark, value, code, shown):
    assert one(spark, catalog.amount_text(F.lit(value).cast("double"), F.lit(code).cast("string"))) == shown


def test_links_and_lines(spark):
    assert one(spark, catalog.web_link(F.lit("javascript:x"))) is None
    assert one(spark, catalog.cleaned(F.lit(" \n\t "), 5)) is None
    assert one(spark, catalog.cleaned_list(F.array(*(F.lit(f" a  {i}") for i in range(9)), F.lit(" ")))) == [f"a {i}" for i in range(6)]


def test_json_of_any_shape(spark):
    rows = [
        (1, '{"list":[[1],"",{"id":7,"empty":{}},{"name":" ","a":{"b":[1,{"c":{"d":{"e_ru":[0]}}}]}}],"tags":["a"],"gone":[],"note":" ","detail_fields":{"x":{}},"__hidden":1,"buyer_name":"b","total_sum":null}'),
        (2, "no json"), (3, None), (4, "[1]"), (5, "{}"), (6, "null"),
    ]
    records = spark.createDataFrame(rows, "k int, json string")
    nodes = {(r.k, r.path): (r.kind, r.title, r.value) for r in variants.presented(records, "k", "json").collect()}
    deep = "list/2/a/b/1/c/d/e_ru"
    paths = ["list", "list/0", "list/1", "list/1/id", "list/2", "list/2/a", "list/2/a/b", "list/2/a/b/0", "list/2/a/b/1", "list/2/a/b/1/c", "list/2/a/b/1/c/d", deep, "tags", "detail_fields", "__hidden", "buyer_name"]
    assert set(nodes) == {(1, p) for p in paths}
    assert nodes[1, "list/0"] == ("scalar", "Item 1", "[1]") and nodes[1, "list/1"] == ("mapping", "7", None) and nodes[1, "list/2"] == ("mapping", "Item 3", None)
    assert nodes[1, "tags"] == ("scalar_list", "Tags", '["a"]') and nodes[1, deep] == ("scalar_list", "E (RU)", "[0]") and nodes[1, "list/2/a/b/0"] == ("scalar", "Item 1", "1")
    assert sorted(tuple(r) for r in variants.sections(records, "k", "json").collect()) == [(1, "detail_fields", "Announcement profile", "1 fields"), (1, "list", "List", "4 items")]
    assert [tuple(r) for r in variants.groups(records, "k", "json").collect()] == [(1, "Additional facts", "tags", "Tags", '["a"]')]
    assert variants.records_below(records, "k", "json", "list").count() == 2 and variants.records_below(records, "k", "json", "tags").count() == 0


def test_source_views(spark):
    rows = [
        (1, "goszakup", '{"announcement_number":"","announcement_id":5,"status_text":"open","amount_text":" ","organizer_text":"O","announcement_lots":[1],"_announcement_lots":[{"n":1}],"_lots":[{"n":2}]}'),
        (2, "mitwork", '{"data_key":9,"title_ru":"T","value_text":"1","detail_fields":{"value_text":"","title_ru_detail":null,"offer_start_text":"s"}}'),
        (3, "zakup_unified", '{"id":3,"status":{"name":"N","code":0},"organizer":{"id":8,"address":{"a":1}},"_lots":[{"x":1},2]}'),
        (4, "ets_tender", '{"zeta":1,"_x":2,"alpha_id":"a","empty":"","list":[1],"d":true,"e":1.5,"f":"6"}'),
        (5, "unknown", '{"id":1}'), (6, "goszakup", "no json"), (7, None, "{}"), (8, "tendersinfo", "{}"),
    ]
    records = spark.createDataFrame(rows, "id int, source string, json string")
    got = {}
    for r in views.source_views(records).collect():
        got.setdefault(r.id, {}).setdefault(r.part, []).append((r.place, r.label, r.value))
    one = {k: [x[1:] for x in sorted(v)] for k, v in got[1].items()}
    assert one["heading"] == [("heading", "Просмотр объявления № ")] and one["cards"] == [("Статус", "open")] and one["Организатор"] == [("Организатор", "O")]
    two = {k: [x[1:] for x in sorted(v)] for k, v in got[2].items()}
    assert two["heading"] == [("heading", "Закупка № 9")] and two["subtitle"] == [("subtitle", "T")] and two["cards"] == [("Начало приема", "s")] and two["Основные данные"] == [("Внутренний ID", "9"), ("Наименование (RU)", "T")]
    three = {k: [x[1:] for x in sorted(v)] for k, v in got[3].items()}
    assert three["cards"] == [("Лоты", "1"), ("Код статуса", "0")] and three["status"] == [("status", "N")] and ("Адрес", '{"a":1}') in three["Организатор"]
    four = {k: [x[1:] for x in sorted(v)] for k, v in got[4].items()}
    assert four["cards"] == [("Zeta", "1"), ("Alpha ID", "a"), ("D", "true"), ("E", "1.5")] and len(four["Source profile"]) == 5 and four["heading"] == [("heading", "ets_tender")]
    assert set(got) == {1, 2, 3, 4, 8} and {k: v[0][2] for k, v in got[8].items()} == {"eyebrow": "TendersInfo", "heading": "tendersinfo", "subtitle": "", "status": ""}
    lots = {(r.id, r.place): r.item for r in views.source_lots(records).collect()}
    assert lots == {(1, 0): '{"n":2}', (3, 0): '{"x":1}'}


def test_append_leaves_out_bad_identifiers(spark, tmp_path):
    rows = spark.createDataFrame([("7", "a"), (" 8 ", "b"), ("0", "c"), ("x", "d"), (None, "e"), ("-1", "f")], "user_id string, action string")
    for _ in range(2):
        tables.append_valid(rows, str(tmp_path / "log"), "user_id")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(7, "a"), (7, "a"), (8, "b"), (8, "b")]


def test_pack_of_three_sheets(spark, tmp_path):
    drivers = spark.createDataFrame([(1, "A", 80), (2, "B", None)], "id int, name string, confidence int")
    sources = spark.createDataFrame([(1, "u1"), (2, "u2")], "driver int, url string")
    workbook.write_pack(str(tmp_path / "pack.xlsx"), drivers, sources)
    rows = workbook.read_workbooks(workbook.files(spark, str(tmp_path)))
    first = rows.filter("position = 1").select("cells").first()[0]
    assert first == ["2", "80.0", "1"]


def test_titles_are_worded_once_for_each_field(spark):
    rows = spark.createDataFrame([(1, "_buyer_id"), (2, "_buyer_id"), (3, None), (4, "title_ru")], "id int, field string")
    got = variants.titled(rows, "field")
    assert {r.id: r.title for r in got.collect()} == {1: "Buyer ID", 2: "Buyer ID", 3: None, 4: "Title (RU)"}
    assert "Aggregate [field" in got._jdf.queryExecution().optimizedPlan().toString()


def test_source_views_parse_records_once(spark):
    records = spark.createDataFrame([("a", "mitwork", '{"announcement_number":"7"}')], "id string, source string, json string")
    plan = views.source_views(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 0


def test_bucket_counts(spark):
    rows = [(1, ["url", "buyer_name", "x"]), (1, ["link"]), (2, ["url", "path"]), (None, ["url"]), (3, []), (4, None)]
    got = evidence.bucket_counts(spark.createDataFrame(rows, "id int, keys array<string>"), "id", "keys")
    assert sorted(map(tuple, got.collect())) == [("Additional facts", 1, 1), ("Identity", 1, 1), ("References", 5, 2)]
    assert evidence.bucket_counts(spark.createDataFrame([], "id int, keys array<string>"), "id", "keys").count() == 0
