from pyspark.sql import functions as F

from lawlake.functions import eids, texts, uris
from lawlake.operators import anchors, documents, resolution, stores

XML = """<a:act xmlns:a="x"><a:meta><a:section eId="no"/></a:meta><a:body><a:part eId="part_1"><a:num>I</a:num><a:section eId="sec_1"><a:num>1.</a:num><a:heading>One</a:heading>
<a:content><a:p>Text <a:ref href="#sec_9">there</a:ref> ends.</a:p></a:content></a:section><a:section eId="sec_4"><a:num>4.</a:num><a:content><a:table eId="t"><a:tr><a:th>H</a:th><a:th>K</a:th></a:tr>
<a:tr><a:td>1</a:td><a:td>2</a:td></a:tr></a:table></a:content></a:section><a:section eId="sec_4"><a:num>4.</a:num></a:section></a:part></a:body></a:act>"""


def test_nodes_checks_and_tables(spark):
    v = spark.createDataFrame([("v1", XML), ("v2", "<act>"), ("v3", None)], "id string, akn_xml string")
    n = documents.nodes(v)
    rows = {r.pos: r for r in n.collect()}
    assert rows[1].quoted and rows[3].heading == "One" and rows[3].text == "Text there ends." and rows[3].num == "1."
    found = {(r.check_name, r.eid) for r in documents.validate(n).collect()}
    assert {("duplicate_number", "sec_4"), ("number_gap", "sec_4"), ("eid_uniqueness", "sec_4"), ("ref_resolution", None), ("missing_container_title", "part_1"), ("section_numbering", "sec_4")} <= found
    scan = {(r.version_id, r.check_name): r.failed for r in documents.structural_scan(v).collect()}
    assert scan["v1", "eid_unique"] is True and scan["v1", "numbering_monotonic_basic_unit"] is True and scan["v1", "akn_parseable"] is False
    assert scan["v2", "akn_parseable"] is True and scan["v3", "akn_parseable"] is None and scan["v3", "eid_unique"] is None
    cells = {(r.row_no, r.column_no): (r.label, r.text) for r in documents.table_rows(n).collect()}
    assert cells == {(2, 1): ("H", "1"), (2, 2): ("K", "2")}
    grades = {r.version_id: r.grade for r in documents.grade(documents.validate(n), v.selectExpr("id AS version_id")).collect()}
    assert grades == {"v1": "blocking", "v2": "clean", "v3": "clean"}


def test_versions_that_were_not_checked_are_ungraded(spark):
    fine = "<act><body><section eId='sec_1'><num>1.</num><heading>A</heading><content><p>words</p></content></section></body></act>"
    v = spark.createDataFrame([("v1", XML), ("v2", "<act>"), ("v3", None), ("v4", "  "), ("v5", fine)], "id string, akn_xml string")
    ids = v.selectExpr("id AS version_id")
    grades = {r.version_id: r.grade for r in documents.grade(documents.validate(documents.nodes(v)), ids, documents.parse_verdicts(v)).collect()}
    assert grades == {"v1": "blocking", "v2": "ungraded", "v3": "ungraded", "v4": "ungraded", "v5": "clean"}


def test_grid_with_spans():
    rows = [[{"text": "a", "colspan": 2}, {"text": "b", "rowspan": 2}], [{"text": "c"}, {"text": "d"}]]
    assert [[c["text"] for c in line] for line in documents.resolve_grid(rows)] == [["a", "a", "b"], ["c", "d", "b"]]
    assert documents.resolve_grid([]) == []


def test_eids(spark):
    df = spark.createDataFrame([("art_5bis2__para_10",), ("sec_2",), ("",), (None,)], "e string")
    r = df.select(eids.parent(df.e).alias("p"), eids.ancestors(df.e).alias("a"), eids.sibling_key(df.e).alias("k"), eids.parts(df.e).alias("x")).collect()
    assert r[0].p == "art_5bis2" and r[0].a == ["art_5bis2", "art_5bis2__para_10"] and r[0].k.n == 10 and r[0].x[1].number == "10"
    assert r[1].p is None and r[2].a == [] and r[3].a is None
    order = [x.e for x in spark.createDataFrame([("art_10",), ("art_9",), ("art_9__para_2",), ("art_9__para_11",)], "e string").orderBy(eids.order_key(F.col("e"))).collect()]
    assert order == ["art_9", "art_9__para_2", "art_9__para_11", "art_10"]


def test_uris(spark):
    df = spark.createDataFrame([("/akn/xb/act/order/2008/536/deu@2010-01-02",), ("/akn/xb/act/1999/1",), ("nonsense",), (None,)], "u string")
    r = df.select(uris.work_parts(F.col("u")).alias("p"), uris.expression_language(F.col("u")).alias("l"), uris.expression_date(F.col("u")).alias("d"), uris.is_citable(F.col("u")).alias("c")).collect()
    assert (r[0].p.doctype, r[0].p.year, r[0].p.number, r[0].l, str(r[0].d)) == ("act/order", 2008, "536", "deu", "2010-01-02")
    assert r[2].p.year is None and r[2].l is None and not r[2].c and not r[3].c
    made = spark.range(1).select(uris.build_work_uri(F.lit("XB"), F.lit("order"), F.lit(None).cast("int"), F.lit("7")).alias("u"), uris.celex_to_work(F.lit("32016R0679")).alias("x")).head()
    assert made.u == "/akn/xb/act/order/0000/7" and made.x == "/akn/eu/act/regulation/2016/679"


def test_texts():
    assert texts.tokenise("The Ferries ２０", "eng") == ["the", "ferr", "20"]
    assert texts.tokenise(None) == [] and texts.tokenise("Straße") == ["strasse"]
    assert texts.cardinal("one hundred and twenty three thousand four") == 123_004 and texts.cardinal("nope") is None and texts.cardinal("") is None
    assert [texts.kanji_number(x) for x in ("六", "十", "二十三", "九十九", "〇", "二三", "十十", "二三十", "元", "百", "x", "", None)] == [6, 10, 23, 99, 0, *[None] * 8]


TEXT = "Preamble words\n\nSection 1 – Names\n\n(1) First. See Section 9 of the Act.\n(2) Second.\n(a) point\n\nSection 3 – Ends\n\nSection 4 ...... 12\n"


def test_anchors_windows_and_segments(spark):
    got = [(a["kind"], a["eid"], a["heading"]) for a in anchors.scan(TEXT)]
    assert got == [("section", "sec_1", "Names"), ("paragraph", "sec_1__para_1", None), ("paragraph", "sec_1__para_2", None), ("point", "sec_1__para_2__point_a", None), ("section", "sec_3", "Ends")]
    assert "SECTION 1 - Names" in anchors.verbatim(TEXT) and anchors.verbatim("  plain ") == "plain" and anchors.scan(None) == []
    docs = spark.createDataFrame([(1, "x" * 15_000), (2, TEXT), (3, None), (4, "")], "id bigint, text string")
    w = sorted(map(tuple, anchors.windows(anchors.anchors(docs, "id", "text"), docs, "id", "text").collect()))
    assert [x for x in w if x[0] == 1] == [(1, 1, 0, 6000), (1, 2, 5600, 11600), (1, 3, 11200, 15000)] and {x[0] for x in w} == {1, 2}
    volume = "Ferry Act 4\n\nSection 1 – A\nwords\nHarbour Order 5\n1.\nwords"
    assert [s[2] for s in anchors.segment(volume)] == ["Ferry Act 4", "Harbour Order 5"] and anchors.segment(None) == []
    codes = anchors.goods_codes(spark.createDataFrame([(1, "see 0203.11.10, 8471 30 00 and heading 8544; not 5635.57"), (2, None)], "id int, text string"), "id", "text")
    assert {(r.code, r.partial) for r in codes.collect()} == {("02031110", False), ("84713000", False), ("8544", True)}


def test_resolution_rungs(spark):
    laws = spark.createDataFrame([("l1", "/akn/xb/act/2001/5"), ("l2", "/akn/xb/act/order/2002/6")], "id string, frbr_work_uri string")
    current = spark.createDataFrame([("l1", "v1"), ("l2", "v2")], "law_id string, version_id string")
    provisions = spark.createDataFrame([("p1", "v1", "sec_1"), ("p2", "v1", "sec_2")], "id string, version_id string, akn_wid string")
    refs = spark.createDataFrame([("a", "/akn/xb/act/2001/5/", "#sec_1"), ("b", "/akn/xb/act/2001/5", "sec_2__para_9"), ("c", "/akn/xb/act/2001/5", "sec_7"), ("d", "/akn/xb/act/2002/6", None), ("e", "/akn/xb/act/2009/6", "x"), ("f", None, "x")], "ref_id string, uri string, wid string")
    got = {r.ref_id: (r.outcome, r.provision_id) for r in resolution.resolve(refs, laws, current, provisions).collect()}
    assert got == {"a": ("provision", "p1"), "b": ("enclosing", "p2"), "c": ("law", None), "d": ("law_by_number", None), "e": ("unresolved", None), "f": ("no_target", None)}
    assert {r.outcome: r.n for r in resolution.histogram(resolution.resolve(refs, laws, current, provisions)).collect()}["law"] == 1


def test_stores(spark):
    s = spark.createDataFrame([("a", 1, "x"), (None, 1, "n")], "k string, o int, v string")
    n = spark.createDataFrame([("a", 2, "y"), ("a", 2, "y"), ("b", 1, "z"), (None, 5, "m")], "k string, o int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(stores.insert_new(s, n, ["k"])) == rows(s.unionByName(n.where("k = 'b'")))
    assert rows(stores.upsert(s, n, ["k"], "o")) == sorted([("a", 2, "y"), ("b", 1, "z"), (None, 5, "m")], key=str)
    assert rows(stores.replace_by(s, n.where("k = 'a'"), ["k"])) == sorted([(None, 1, "n"), ("a", 2, "y"), ("a", 2, "y")], key=str)
    g = spark.createDataFrame([("a", 1, None), ("b", 1, None)], "k string, generation int, retired_at timestamp_ntz")
    new = rows(stores.next_generation(g, spark.createDataFrame([("a",)], "k string"), "k", "2024-01-01"))
    assert [(r[0], r[1], r[2] is None) for r in new] == [("a", 1, False), ("a", 2, True), ("b", 1, True)]
    log = spark.createDataFrame([("r", "queued", 1), ("r", "failed", 2), ("r", "running", 3), ("q", "running", 1)], "run string, state string, t int")
    assert rows(stores.run_states(log, "run", "state", "t")) == [("q", "running", 1), ("r", "failed", 2)]
    p = spark.createDataFrame([("p1", "v1", "sec_1", "old"), ("p2", "v1", "sec_2", "kept")], "id string, version_id string, akn_eid string, text string")
    assert {(r.akn_eid, r.text, r.version_id) for r in stores.amend(p, "v1", "v2", spark.createDataFrame([("sec_1", "new")], "akn_eid string, new_text string")).collect()} == {("sec_1", "new", "v2"), ("sec_2", "kept", "v2")}
    assert stores.fill_missing(spark.createDataFrame([("a", None), ("b", "had")], "k string, v string"), spark.createDataFrame([("a", "got"), ("b", "no")], "k string, v string"), "k", "v").orderBy("k").collect() == [("a", "got"), ("b", "had")]
