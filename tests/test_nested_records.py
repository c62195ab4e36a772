from xml.etree import ElementTree

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lawlake.operators import nested_records as n

NS = 'xmlns:a="urn:x"'
SCHEMA = "id string, akn_xml string, node_no int"


def brute(text):
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None
    out, count = [], 0

    def visit(e, parent):
        nonlocal count
        tag = e.tag.rpartition("}")[2]
        here = parent
        if tag in n.ROW_ELEMENTS:
            count += 1
            here = count
            out.append((count, parent, tag))
        for c in e:
            visit(c, here)

    visit(root, 0)
    return out


tree = st.recursive(st.sampled_from(["p", "ref", "num"]), lambda kids: st.tuples(st.sampled_from(["section", "content", "point", "table", "b"]), st.lists(kids, max_size=4)), max_leaves=20)


def render(t):
    return f"<{t}/>" if isinstance(t, str) else f"<{t[0]}>{''.join(map(render, t[1]))}</{t[0]}>"


def rows_of(*texts, declared=frozenset(n.ROW_ELEMENTS)):
    """Rows of records in one batch, by the arrays."""
    parsed = [n.xml_triples(t) for t in texts]
    groups = frozenset().union(*(p[2] for p in parsed if p)) | declared
    pivot = n.Pivot(pa.array([p[0] if p else [] for p in parsed], pa.list_(pa.string())), declared, groups)
    return list(zip(*(c.to_pylist() for c in pivot.links(pa.array([str(k) for k in range(len(texts))])))))


@settings(max_examples=60, deadline=None)
@given(tree, tree)
def test_matches_tree_parser(t, u):
    texts = [f"<act>{render(x)}<!-- <section/> --><![CDATA[<ref>]]></act>" for x in (t, u)]
    got = rows_of(*texts)
    for k, text in enumerate(texts):
        assert [(a, b, c) for r, c, a, _, b in got if r == str(k) and c in n.ROW_ELEMENTS] == brute(text)


def test_an_unknown_repeated_element_is_a_table_of_its_own(spark):
    text = "<act><clause id='a'><term>x</term><term>y<note/></term></clause><section><clause id='b'><term>z</term></clause></section><clause/></act>"
    tables = n.Tables(spark, spark.createDataFrame([("v", text, 0)], SCHEMA), "id", "akn_xml")
    assert tables.groups() == {"clause", "term", *n.ROW_ELEMENTS}
    links = sorted((r.akn_type, r.node_no, r.parent_type, r.parent_no) for r in tables.links().collect())
    assert links == [("clause", 1, "", 0), ("clause", 2, "section", 1), ("clause", 3, "", 0), ("section", 1, "", 0), ("term", 1, "clause", 1), ("term", 2, "clause", 1), ("term", 3, "clause", 2)]
    assert sorted(tuple(r) for r in tables.table("term").collect()) == [("v", 1, "clause", 1, "x"), ("v", 2, "clause", 1, "y"), ("v", 3, "clause", 2, "z")]
    assert tables.table("term").columns[-1] == "#text" and tables.fields("clause") == ["@id"]


def test_of_differing_deliveries_one_holds_whole(spark):
    a, b = "<act><section eId='a1'/><section eId='a2'/></act>", "<act><part/><section eId='b1'/></act>"
    made = {tuple(sorted(map(tuple, n.found(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))) for rows in ([("v", a, 0), ("v", b, 0), ("v", a, 1)], [("v", b, 0), ("v", a, 0), ("v", "<no", 0)])}
    assert len(made) == 1 and made <= {tuple(("v", *r) for r in brute(x)) for x in (a, b)}


def test_rows_and_dirt(spark):
    good = f"<?xml version='1.0' encoding='UTF-8'?><a:act {NS}><a:section eId='s1'><a:num>1.</a:num><a:content><a:p>x &amp; <a:ref href='/y'>é</a:ref></a:p></a:content></a:section><section/></a:act>"
    df = spark.createDataFrame(
        [("v1", good, 9), ("v1", good, 9), ("v2", None, 1), ("v3", "  ", 1), ("v4", "<act><section></act>", 1), (None, good, 1), ("v5", "<act/>", 1), ("v6", "", 1)], SCHEMA
    )
    rows = sorted(map(tuple, n.found(spark, df).collect()))
    assert rows == [("v1", 1, 0, "section"), ("v1", 2, 1, "ref"), ("v1", 3, 0, "section")]
    table = n.Tables(spark, df, "id", "akn_xml").table("section", {"eid": "@eId", "num": "num", "said": "content/p"})
    sections = sorted(map(tuple, table.drop("parent_type").collect()))
    assert sections == [("v1", 1, 0, "s1", "1.", "x &"), ("v1", 3, 0, None, None, None)]


def test_empty_table(spark):
    assert n.found(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_and_long(spark):
    text = "<act>" + "<point>" * 500 + "<p>" + "x" * 1_000_000 + "</p>" + "</point>" * 500 + "</act>"
    got = n.found(spark, spark.createDataFrame([("v", text, 1)], SCHEMA)).collect()
    assert len(got) == 500 and max(r.parent_no for r in got) == 499
