from datetime import datetime

from lawlake.operators import records as r

T = datetime


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_newest_takes_the_greatest_and_leaves_null_keys_out(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 9, "z"), ("b", None, "n")], "k string, n int, v string")
    assert rows(r.newest(df, ["k"], ["n", "v"], ["v"])) == [("a", "y"), ("b", "n")]
    assert rows(r.newest(df.limit(0), ["k"], ["n", "v"], ["v"])) == []


def test_urls_of_several_works_stand_for_none(spark):
    df = spark.createDataFrame([("u", "/a", 1), ("u", "/a", 2), ("w", "/a", 3), ("w", "/b", 4), (None, "/a", 5), ("x", None, 6)], "source_url string, frbr_work_uri string, fetch_id int")
    assert rows(r.works_of_urls(df)) == [("u", "/a", 1), ("w", None, 2)]


PROVISIONS = "id string, version_id string, akn_eid string, akn_wid string, position int, deleted_at timestamp_ntz, n string"
ROWS = [
    ("p1", "v", "part_1", "part_1", 1, None, ""), ("p2", "v", "part_1__sec_2", "sec_2", 2, None, ""), ("p3", "v", "sec_2", "x", 3, T(2024, 1, 1), ""), ("p4", "v", "part_1__chp_1__sec_3", "w", 3, None, ""),
    ("p5", "w", "", None, 1, None, ""), ("p6", None, "sec_1", "sec_1", 1, None, ""), ("p7", "v", "part_1", "part_1", 9, None, ""),
]


def test_ids_of_provisions(spark):
    p = spark.createDataFrame(ROWS, PROVISIONS)
    assert rows(r.eids_of_fragments(p)) == [("v", "part_1", "part_1"), ("v", "sec_2", "sec_2"), ("v", "sec_3", "part_1__chp_1__sec_3")]
    maps = {x.version_id: dict(zip(x.akn_eids, x.ids)) for x in r.provision_ids(p).collect()}
    assert maps["v"] == {"part_1": "p1", "part_1__sec_2": "p2", "sec_2": "p3", "part_1__chp_1__sec_3": "p4"} and maps["w"] == {"": "p5"}
    assert {tuple(x) for x in r.enclosing_units(p).collect()} == {("p1", None), ("p2", "p1"), ("p3", None), ("p4", "p1"), ("p6", None), ("p7", None)}
    assert rows(r.first_rows(p, 2).where("version_id = 'v'")) == [("v", "p1", 1), ("v", "p2", 2)]
    effects = spark.createDataFrame([("e1", "v", " #sec_2 "), ("e2", "v", None), ("e3", "u", "sec_2")], "id string, version_id string, source_akn_wid string")
    assert rows(r.sources_by_wid_or_eid(effects, p)) == [("e1", "p2"), ("e1", "p3")]


def test_languages_and_listings_of_laws(spark):
    schema = "id string, title string, jurisdiction_code string, jurisdiction_id string, doctype string, title_translations map<string,string>, created_at timestamp_ntz, deleted_at timestamp_ntz, language string"
    laws = spark.createDataFrame(
        [("l1", "b", "xa", "j", "act", {"eng": "b"}, T(2024, 1, 1), None, "x"), ("l2", "A", "xa", None, None, None, T(2024, 2, 1), None, "x"), ("l3", None, "xa", "q", "act", {}, None, None, "x"), ("l4", "z", "xa", "j", "act", {}, None, T(2024, 1, 1), "x")], schema
    )
    versions = spark.createDataFrame([("v1", "l1", "deu"), ("v2", "l1", "eng"), ("v3", "l2", None), ("v4", None, "eng")], "id string, law_id string, language string")
    assert rows(r.languages_of_laws(laws, versions)) == [("l1", ["deu", "eng"])]
    assert rows(r.listing_orders(laws)) == [("xa", "l1", 2, 2), ("xa", "l2", 1, 1), ("xa", "l3", 3, 3)]
    assert rows(r.jurisdictions_in_scope(versions, laws)) == [("act", ["xa"])]
    known = spark.createDataFrame([("j", "Xanadu", None, "gregorian", "t")], "id string, name string, family string, calendar string, title string")
    assert rows(r.laws_with_jurisdictions(laws, known)) == [("l1", "b", "Xanadu", None, "gregorian"), ("l2", "A", None, None, None), ("l3", None, None, None, None)]
