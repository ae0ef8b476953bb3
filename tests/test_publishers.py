"""Publishers' identities and the agreement of named and cited sources."""

import pytest

from tessera.operators import publishers


@pytest.fixture(scope="module")
def groups(spark):
    return publishers.alias_groups(spark)


def test_identities(spark, groups):
    labels = {
        "UNFCCC": "unfccc", "  unfccc – NDC": "unfccc", "UNFCCCs": "publisher:unfcccs", "FSB - Report": "financial-stability-board", "World Bank: Data": "world-bank", "The World Bank": "publisher:the world bank",
        "Oil & Gas Methane Partnership 2.0": "publisher:oil gas methane partnership 2 0", "Oil and Gas Methane Partnership 2.0 — Guide": "ogmp-2", "A-B - C - D": "publisher:a b", " - x": "publisher:x", "Central Bank of the UAE — Rules": "central-bank-uae",
    }
    rows = spark.createDataFrame([(x,) for x in labels] * 2 + [(None,)], "label string")
    got = [tuple(r) for r in publishers.identities(rows, groups).collect()]
    assert len(got) == len(labels) and dict(got) == labels


@pytest.mark.parametrize(
    "named,cited,issues",
    [
        (["IEA - Outlook"], ["IEA - Outlook"], []),
        (["IEA"], ["IEA - Outlook"], ["match"]),  # the publisher's name matches, but is not the label
        (["IEA - Outlook", "IEA - Data"], ["IEA - Data", "IEA - Outlook", "IEA - Data"], []),
        (["World Bank"], ["World Bank"], []),
        (["Source 2"], ["World Bank"], ["generic", "match"]),
        (["A Research Firm of note"], ["A Research Firm of note"], ["generic"]),
        ([], [], []), (None, ["CDP"], ["match"]), ([None], ["CDP"], ["match"]), (["CDP"], ["CDP", None], ["lack"]), (["CDP", "CDP"], ["CDP"], []), (["CDP"], [], ["match"]),
    ],
)
def test_agreement(spark, groups, named, cited, issues):
    drivers = spark.createDataFrame([(1, named)], "driver_id int, key_sources array<string>")
    links = spark.createDataFrame([(1, i, label) for i, label in enumerate(cited)], "driver_id int, link int, label string")
    got = publishers.key_source_issues(drivers, links, groups).first().issues
    assert len(got) == len(issues) and all(word in issue for word, issue in zip(issues, got))


def test_citation_metadata(spark):
    evidence = [(1, "u1", "S1", "B - x", True), (1, "u2", "S2", "A", True), (1, "u3", "S3", " B - x ", True), (1, "u4", "S4", None, True), (1, "u5", "S5", "C", False), (1, "u6", "S6", "C", None)]
    evidence = [(d, *e[1:]) for d in range(1, 9) for e in evidence]
    links = {1: ["u3", "u2", "u1"], 2: ["u1", "u1"], 3: ["u1", "nowhere"], 4: ["u4"], 5: ["u5"], 6: [], 7: None, 8: ["u6"]}
    got = publishers.citation_metadata(spark.createDataFrame(list(links.items()), "driver_id int, source_links array<string>"), spark.createDataFrame(evidence, "driver_id int, url string, source_id string, label string, direct boolean")).collect()
    assert {r.driver_id: (r.key_sources, r.source_refs) for r in got} == {1: (["B - x", "A"], ["S3", "S2", "S1"]), **{i: (None, None) for i in range(2, 9)}}
